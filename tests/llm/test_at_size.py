"""What changes with size: long words of the codec, large hypergeometric draws, hot keys, the shared folder."""

import math
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kelpie.llm import bpe, common, components, exact_dedup, license_scan, sharding

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_long_words_equal_tiktoken(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    k = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(6)
    pools = ["abcdefghijklmnopqrstuvwxyz", "ab", "aab", "etaoin", "日本語中文字漢国", "é", "-=", "=", "0123456789", "ACGT", "АБВГД"]
    for pool in pools:
        for n in (60, 64, 65, 191, 192, 193, 194, 500, 1500, 4000):
            t = "".join(rng.choice(pool) for _ in range(n))
            ids, back = c.run(t)
            assert list(np.frombuffer(ids, "<u4")) == k.encode_ordinary(t) and back.decode() == t, (pool, n)


def test_segments_without_a_common_token_grow(monkeypatch):
    c, seen = bpe.Codec(RANKS, public_tokenizers.PATTERN), []
    whole = c.joined
    monkeypatch.setattr(c, "learn_run", lambda word: False)
    monkeypatch.setattr(c, "joined", lambda starts, pieces: seen.append(len(starts)) or (None if len(seen) < 3 else whole(starts, pieces)))
    t = "qwertzuiopasdfgh" * 1000
    c.learn([t])
    assert seen == [125, 32, 8] and c.decoded[t].decode() == t


def test_long_runs_equal_tiktoken():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    k = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(7)
    texts = [chr(x) * n for x in (0x200B, 0x2022, 0x2588, 0x2500, 0x314B, 0x1F600) for n in (250, 7000, 22_001)]
    texts += ["-" * 100_000, "日本語" * 10_000, "=-" * 9_999, "".join(rng.choice("─━█▓") for _ in range(9000)), "".join(rng.choice("qwertyuiop") for _ in range(100_000))]
    for t in texts:
        ids, back = c.run(t)
        assert list(np.frombuffer(ids, "<u4")) == k.encode_ordinary(t) and back.decode() == t, (t[:3], len(t))


def test_large_chances_are_exact():
    def exact(k, good, bad, n):
        return math.log(Fraction(math.comb(good, k) * math.comb(bad, n - k), math.comb(good + bad, n)))

    for good, bad, n in ((50, 900, 40), (3000, 9000, 700), (7, 20, 27), (5, 0, 3), (0, 6, 2)):
        for k in range(max(0, n - bad), min(n, good) + 1, 1 + min(n, good) // 9):
            assert sharding.log_chance(k, good, bad, n) == pytest.approx(exact(k, good, bad, n), rel=1e-10, abs=1e-11)
    # Around the mode, the chances of 2.4e12 rows sum to one.
    good, bad, n = 100_000_000_000, 2_300_000_000_000, 24_000_000
    mode, wide = n * good // (good + bad), 8 * int((n / 24) ** 0.5)
    chances = [math.exp(sharding.log_chance(mode + d, good, bad, n)) for d in range(-wide, wide + 1)]
    assert sum(chances) == pytest.approx(1.0, abs=1e-8)


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(2)
    good, bad, n = 100_000_000_000, 2_300_000_000_000, 2_400_000
    x = np.array([sharding._hypergeometric(good, bad, n, rng) for _ in range(600)])
    mean, var = n / 24, n / 24 * 23 / 24
    assert abs(x.mean() - mean) < 4 * (var / 600) ** 0.5 and 0.8 < x.var() / var < 1.25


def test_hot_keys_meet_copies(spark, monkeypatch):
    many = spark.range(5000).select((F.col("id") % 50).alias("v"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).cast("bigint").alias("k"))
    many = common.written(many, "many")
    one = spark.range(11).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    plain = sorted(map(tuple, many.join(one, "k").collect()))
    assert sorted(map(tuple, common.spread_join(many, one, ["k"], hot_at=50).collect())) == plain
    assert sorted(map(tuple, common.spread_join(many, one, ["k"], hot_at=10**6).collect())) == plain


def test_a_hub_is_one_component(spark):
    edges = spark.range(1, 30_000).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b")).union(spark.sql("SELECT 40000L AS a, 40001L AS b"))
    got = components.components(edges)
    assert got.count() == 30_002 and {r[0] for r in got.select("component").distinct().collect()} == {0, 40_000}


def test_a_text_with_many_copies(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.exact_groups(docs)
    assert got.count() == 30_000 and got.filter("group_size = 15000 AND keep_id = 0").count() == 15_000 and got.filter("kept").count() == 15_001
    none = docs.limit(0)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.keep_one(none).count() == 0


def test_short_phrases_are_refused(spark):
    docs = spark.createDataFrame([(1, "under mit license here")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="at least 3 words"):
        license_scan.scan(docs, base=[("mit license", "mit")])


def test_a_cluster_must_name_the_shared_folder():
    class Session:
        def __init__(self, **conf):
            self.conf = conf

    with pytest.raises(RuntimeError, match="share"):
        common.scratch_root(Session(**{"spark.master": "spark://host:7077"}))
    assert common.scratch_root(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert common.scratch_root(Session(**{"spark.master": "local[4]"})).startswith("file:/")


def test_settled_tables_leave_nothing_behind(spark):
    import os

    since = common.mark()
    a = common.written(spark.range(5), "a")
    b = common.settled(common.written(a, "b"), "c", since)
    assert b.count() == 5 and common.mark() == since + 1
    assert [os.path.exists(f.removeprefix("file://")) for f in (common._made.folders[-1],)] == [True]
    with pytest.raises(Exception, match="(?i)exist"):
        a.count()
