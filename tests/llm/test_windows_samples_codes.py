"""Substring dedup, importance resampling and vector codes against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.llm import quantizer, resampling, substrings

SCHEMA = "doc_id bigint, text string, lang string, block bigint, row string, task double, answers string"
FULL = [f"w{k}" for k in range(90)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 900)
    monkeypatch.setattr(substrings, "TASK_HASHES", 100)


def table(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "en", 1, "r", 0.5, "a") for i, t in texts], SCHEMA).repartition(parts)


def plain_repeats(texts, window):
    split = [[w for w in brute.WS.split(t or "") if w] for _, t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(texts, split):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def told(df):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return sorted(map(tuple, df.collect()), key=key)


def test_halved():
    assert substrings.halved(35, 9) == [9, 18, 35] and substrings.halved(35, 1) == [1, 2, 3, 5, 9, 18, 35] and substrings.halved(4, 9) == [4]


@pytest.mark.parametrize(("window", "shortest"), [(35, 9), (6, 2), (5, 5), (1, 1)])
def test_repeats_on_edges(spark, small_blocks, window, shortest):
    rng = random.Random(window)
    body = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(60))) for _ in range(12)]
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, " ".join(FULL)), (5, "x\n" + "\t".join(FULL[3:60]) + " y"), (6, "Aa aA " * 60), (6, "Aa aA " * 60), (None, "no name"), (None, " ".join(FULL[10:50])),
        (7, " ".join(f"u{k}" for k in range(34))), (8, " ".join(f"v{k}" for k in range(36))), (9, " ".join(FULL)), (10, "é ñ 日本 🙂 " * 30), (11, " ".join(FULL[:9] * 2)), *((20 + k, b) for k, b in enumerate(body)),
    ]
    got = substrings.without_repeats(table(spark, texts), window, shortest)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert told(got.select("doc_id", "n_words", "n_removed", "kept_text")) == sorted(plain_repeats(texts, window), key=key)
    for r in got.collect():
        assert sum(s.length for s in r.spans) == r.n_removed and all(s.start + s.length <= r.n_words for s in r.spans)


def test_repeats_inside_one_block_and_one_document(spark):
    texts = [(1, " ".join(FULL[:40] * 2)), (2, "alone " + " ".join(FULL[50:60]))]
    got = substrings.without_repeats(table(spark, texts, 1))
    assert told(got.select("doc_id", "n_words", "n_removed", "kept_text")) == plain_repeats(texts, 35)


def test_a_very_long_text_and_many_copies(spark, small_blocks):
    rng = random.Random(5)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(30_000))
    texts = [(0, long), (1, "start " + long[:50_000]), *((k, " ".join(FULL) + f" end{k}") for k in range(2, 300))]
    got = substrings.without_repeats(table(spark, texts, 5))
    assert told(got.select("doc_id", "n_words", "n_removed", "kept_text")) == sorted(plain_repeats(texts, 35), key=lambda r: str(r[0]))


def test_levels_end_early(spark):
    texts = [(1, " ".join(FULL)), (2, " ".join(f"z{k}" for k in range(50)))]
    assert {r.n_removed for r in substrings.without_repeats(table(spark, texts)).collect()} == {0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substrings.without_repeats(none).count() == 0
    assert resampling.resample(none, none).count() == 0
    assert quantizer.compress(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


# Resampling ---------------------------------------------------------------------------------------------------------


def plain_sample(docs, target, percent=10, buckets=10_000, longest=1, least=20, seed=2024):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(text or ""))
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    own, asked = [features(t) for _, t in docs], Counter()
    for t in target:
        asked.update(features(t)[1])
    source = sum((c for _, c in own), Counter())
    s_all, t_all = sum(source.values()), sum(asked.values())
    gain = [math.floor(1000 * math.log((asked[b] + 1) * (t0 := float(s_all + buckets)) / ((source[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for (d, _), (n, c) in zip(docs, own):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append([d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize(("percent", "buckets", "longest"), [(10, 10_000, 1), (60, 100, 3), (100, 1, 1)])
def test_resampling(spark, monkeypatch, percent, buckets, longest):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", 2_000)
    rng = random.Random(buckets)
    words = ["Alpha", "beta", "GAMMA3", "délta", "日本", "x-y", "q_r", "0"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for k in range(70)]
    docs += [(200, None), (201, ""), (202, ".,;"), (203, "one word " * 20_000), (204, docs[60][1]), (204, docs[60][1]), (None, "alpha " * 30), (205, "À" * 40), (206, "ab\x00cd\x7fef " * 10)]
    target = ["beta beta gamma3 délta", None, "", "Alpha x"]
    asked = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(table(spark, docs), asked, percent, buckets, longest)
    rank = lambda r: tuple((x is not None, str(x)) for x in r)
    want = sorted(plain_sample(docs, target, percent, buckets, longest), key=rank)
    assert told(got.select("doc_id", "n_features", "weight", "score", "rank")) == want


def test_resampling_without_a_target_and_equal_scores(spark):
    docs = [(5, "a b c " * 10)] * 7 + [(1, "d " * 19)]
    got = resampling.resample(table(spark, docs), spark.createDataFrame([], "text string"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == [1, 2, 3] and all(r["rank"] is None for r in got if r.doc_id == 1)


def test_the_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(resampling, "REMEMBERED", 3)
    b = resampling.Buckets(97)
    words = [str(k % 10).encode() for k in range(50)]
    assert b.of(words, 1).tolist() == [zlib.crc32(w) % 97 for w in words] and len(b) <= 3


# Codes --------------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                of = [c[p] for c, o in zip(cut, own) if o == e]
                if of:
                    books[p][e] = [sum(col) // len(of) for col in zip(*of)]
    out, totals = [], Counter()
    for (i, _, lab), c in zip(kept, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab))
        totals[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, err, totals[lab], sha) for i, code, err, lab in out]


@pytest.mark.parametrize(("n", "width", "entries", "spread"), [(400, 16, 16, 1.0), (5, 8, 16, 3.0), (300, 8, 16, 0.0007), (200, 24, 1, 40.0), (150, 8, 3, 9000.0)])
def test_codes(spark, monkeypatch, n, width, entries, spread):
    monkeypatch.setattr(quantizer, "BLOCK_VECTORS", 50)
    rng = random.Random(n)
    rows = [(k, [float(np.float32(rng.gauss(k % 7, 1) * spread)) for _ in range(width)], None if k % 3 == 0 else k % 5) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * width, 1), (n + 2, [float("nan")] * width, 2), (n + 3, [float("inf")] + [0.0] * (width - 1), 2), (None, rows[0][1], 4), (3, rows[1][1], 0), (3, rows[1][1], 0), (n + 4, [0.0] * width, None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, error int").repartition(3)
    assert told(quantizer.compress(df, entries=entries)) == sorted(plain_codes(rows, entries=entries), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_most_parts_stay_on_their_heaps():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 3, (200, 8)) for c in (0, 500, 1000, 1500)]).round().astype(np.int64)
    books = x[[0, 200, 400, 600]][None]
    drift = np.zeros((1, 4))
    heaps, change = quantizer.rescanned(x, None, books, drift)
    new = quantizer.moved_books(books, change)
    drift = quantizer.drifted(drift, books, new)
    assert sum(len(heaps.violated(h, float(drift[0, h]))) for h in range(4)) == 0


def test_vectors_that_cannot_be_cut(spark):
    for vectors in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9], [[1e9] * 8], [[]]):
        df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int")
        with pytest.raises(ValueError, match="can't be cut"):
            quantizer.compress(df)


def test_hot_labels_meet_copies(spark, monkeypatch):
    monkeypatch.setattr(quantizer, "SMALL_IDS", 1)
    rows = [(k, [float(k % 9)] * 8, k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert told(quantizer.compress(df)) == sorted(plain_codes(rows), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert df.agg(F.count("*")).first()[0] == 60
