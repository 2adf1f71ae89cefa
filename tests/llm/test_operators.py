"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kelpie.llm import bpe, exact_dedup, jaccard, license_scan, merkle, minhash, packing, pii, queries, sharding, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, run int, score double, `key` string"
LONG = "word " * 40_000 + "x" * 30_000 + " " * 3_000 + "é" * 2_000
TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "One two three"), (5, "one  TWO\nthree"), (6, "One two three"), (7, LONG), (8, LONG + " end"),
    (9, "Released under the MIT License. x " * 3), (10, "日本語 テキスト 🙂 é ÀÉ"), (11, "a b c d e f g h i j"), (12, "a b c d e f g h i j"), (12, "a b c d e f g h i j"),
    (13, "token 4111 1111 1111 1111 mail bob.1@mail.example.com"), (None, "no name here at all"), (14, "\x00\x1c\x85   odd spaces"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", 7, 0.5, "k") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def squeeze(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")


def test_exact_groups(edge):
    got = exact_dedup.exact_groups(edge, fan_in=2).collect()
    assert len(got) == len(TEXTS)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i is None, i or 0, i))
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(groups[key])
        assert r.keep_id == best[3] and r.group_size == len(groups[key])
    assert {r.doc_id for r in got if r.group_size == 3 and r.keep_id == 3} == {1, 2, 3}  # the longest blank text stays
    assert {(r.doc_id, r.kept) for r in got if r.keep_id == 4 or r.keep_id == 5} == {(4, True), (5, True), (6, False)}


def test_keep_one(edge):
    kept = exact_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in (3, 4, 5, 7, 8, 9, 10, 11, 13, 14, None))


def test_packing(edge, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for df in (edge.filter("doc_id <> 12"), docs):
        ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in df.select("doc_id", "text").collect()}
        got = packing.pack(df, RANKS, public_tokenizers.PATTERN).toPandas()
        assert set(got.doc_id.dropna()) == {k for k in ids if k is not None}
        for doc, g in got.sort_values("piece").groupby("doc_id"):
            x = ids[doc]
            assert g.length.sum() == len(x) and list(g.start) == [0, *np.cumsum(g.length)[:-1]] and list(g.piece) == list(range(len(g)))
            assert all(n == 2048 for n in g.length.iloc[1:]) and g.length.max() <= 2048
            assert all(zlib.crc32(x[s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32))
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 11 / 9 + 1


def test_best_fit_plan_places_every_count():
    rng = random.Random(3)
    for _ in range(30):
        cap = rng.choice([10, 64, 100])
        hist = {n: rng.randint(1, 60) for n in rng.sample(range(1, cap + 1), rng.randint(1, min(cap, 12)))}
        used: dict[int, list[tuple[int, int]]] = {}
        for length, slots in packing.best_fit_plan(hist, cap).items():
            for r in range(hist[length]):
                first, each, base, off = [s for s in slots if s[0] <= r][-1]
                used.setdefault(base + (r - first) // each, []).append((off + (r - first) % each * length, length))
        for spans in used.values():
            spans.sort()
            assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= cap


def test_pii_values(spark):
    texts = [
        "4111 1111 1111 1111 and 4111111111111111, not 4111111111111112", "GB82 WEST 1234 5698 7654 32; DE89370400440532013000", "+1 (136) 555-7479 4845168114407329",
        "10.0.0.1. 256.1.1.1 123-45-6789 000-12-3456", "2023-02-28 2023-02-30 28.02.2023 1/31/2024", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "", None, "Bob.Smith+1@Mail7.example.com x",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.findings(df, "k").collect()}
    other = {r.doc_id: r for r in pii.findings(df, "other").collect()}
    a, b = (v.pseudonym for v in got[0]["values"])
    assert a.replace(" ", "") == b and luhn(b) and got[0].text.endswith("not 4111111111111112") and got[0].n_values == 2
    assert [mod97(v.pseudonym) for v in got[1]["values"]] == [1, 1] and got[1].text.startswith("GB")
    assert [v.kind for v in got[2]["values"]] == ["phone", "card"] and got[2].text.startswith("+1 (")
    assert [v.kind for v in got[3]["values"]] == ["ip", "ssn"] and "256.1.1.1" in got[3].text and "000-12-3456" in got[3].text
    assert all(0 <= int(o) < 256 for o in got[3]["values"][0].pseudonym.split("."))
    iso, dotted, slash = (v.pseudonym for v in got[4]["values"])
    assert "-".join(reversed(dotted.split("."))) == iso and "2023-02-30" in got[4].text and len(slash) == len("1/31/2024")
    assert got[5]["values"][0].kind == "secret" and "b44e15e0" not in got[5].text and len(got[5].text) == len(texts[5])
    assert (got[6].text, got[6].n_values, got[7].text, got[7].n_values) == ("", 0, None, 0)
    assert got[8].text.endswith("@Mail7.example.com x") and "smith" not in got[8].text.lower()
    assert all(got[i].text != other[i].text for i in (0, 1, 2, 3, 4, 5, 8))


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def plain_feistel(key, tag, digits):
    """The digit permutation, written out."""
    n = len(digits)
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    for i in range(pii.ROUNDS):
        h = int(hashlib.sha256(f"{key.encode().hex()}|{tag}|{n}|0|{i}|{b}".encode()).hexdigest()[:15], 16)
        m = 10 ** (u if i % 2 == 0 else n - u)
        a, b = b, (a + h % m) % m
    return f"{a:0{u}d}{b:0{n - u}d}"


def test_pii_permutes_without_collisions(spark):
    df = spark.range(1000).select(F.format_string("%03d", "id").alias("d"))
    got = df.select("d", F.expr(pii.Pseudonyms("k").digits("d", "card")).alias("p")).collect()
    assert len({r.p for r in got}) == 1000
    assert all(r.p == plain_feistel("k", "card", r.d) for r in got)


def test_pii_edges(edge, none):
    out = pii.pseudonymised(edge, "k")
    assert out.columns == edge.columns and out.count() == len(TEXTS)
    same = {(r.doc_id, r.text) for r in out.collect() if r.doc_id != 13}
    assert same == {(i, t) for i, t in TEXTS if i != 13}
    assert pii.findings(none, "k").count() == 0 and pii.pseudonymised(none, "k").count() == 0


def test_toxicity_grammar():
    stems = {"idiot": 0.99, "vequ": 0.98, "scum$": 0.97}
    g = toxicity.Grammar(stems, {"plain": 0.95, "target": 1.0, "negated": 0.3, "reported": 0.5})
    s = g.score
    assert s("You are an idiot.") > s("An idiot.") > 0.7 > s("He said idiot.") > s("You are not an idiot.") > s("all fine")
    assert s("I will kill you") > 0.7 and s("to kill time") < 0.1
    assert s("vequance") > 0.7 and s("scums") < 0.1 and s("xidiot") < 0.1 and s("IDIOT!! SO") > 0.7
    assert s(None) == s("") == pytest.approx(toxicity.LEAST_SCORE)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(400)]
    data = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["grobbel", "snarkit", "frumpto"]) + rng.choice(["", "us", "ing"])
        data.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id bigint, quality int, toxic int")
    weights = toxicity.learn(docs, labels)
    got = toxicity.scores(docs, weights).collect()
    truth = {i: y for i, _, y in data}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == truth[r.doc_id] == int(r.score >= 0.7) for r in got)
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, flipped) == weights  # held-out labels are never read
    assert toxicity.accepted(docs, weights).count() == sum(1 - y for y in truth.values())


def test_toxicity_edges(edge, none, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    weights = toxicity.learn(edge, labels)
    assert toxicity.scores(edge, weights).count() == len(TEXTS) and toxicity.scores(none, weights).count() == 0
    assert toxicity.accepted(edge, weights).columns == edge.columns


def test_copies_teach_one_stem_only():
    copy = "rare unusual peculiar singular words stand here around idiot today in this long text"
    toxic = [copy] * 30 + [f"filler{i} idiot other{i} things{i} go{i}" for i in range(30)]
    stems, _ = toxicity.learn_from([(1, t) for t in toxic] + [(0, f"plain{i} filler{i} words{i}") for i in range(200)])
    assert "idiot" in stems and "peculia" not in stems and "rare" not in stems


def test_near_groups(docs, edge, none):
    real = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    made = []
    for k in range(90):  # borderline copies: links of some, chains through others
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
        made.append((10_000 + k, " ".join(w)))
    shared = " ".join(f"p{i}" for i in range(60))
    made += [(20_000 + k, " ".join(f"u{k}x{i}" for i in range(40)) + " " + shared) for k in range(60)]
    made += [(30_000 + k, " ".join(f"s{i}" for i in range(n))) for k, n in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 19, 20, 5, 4))]
    data = real + made
    got = jaccard.near_groups(docs.sparkSession.createDataFrame(data, "doc_id bigint, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups(data)


def test_cells_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 4)
    rng = random.Random(2)
    data = []
    for c in range(6):
        base = [f"c{c}w{i}" if i > 22 else f"w{i}" for i in range(40)]
        for k in range(8):
            w = list(base)
            w[rng.randrange(24, 40)] = f"e{c}{k}"
            data.append((c * 100 + k, " ".join(w)))
    got = jaccard.near_groups(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups(data)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (5, 40, 300, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**63, n // 8 + 1).astype(np.uint64)]))
        diff = len(np.setxor1d(a, b))
        assert jaccard.apart(jaccard.parity_bits(a), jaccard.parity_bits(b)) <= diff
        for band, count in jaccard.emissions(n):
            assert len(jaccard.sketch_words(a, band, count, None)) == count


def test_near_groups_edges(edge, none):
    got = jaccard.near_groups(edge).collect()
    assert len(got) == len(TEXTS)
    by = {(r.doc_id, r.n_shingles, r.component_id) for r in got}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 4), (11, 6, 11), (12, 6, 11), (None, 1, None)} <= by
    assert jaccard.near_groups(none).count() == 0
    assert jaccard.one_of_each(edge).columns == edge.columns


def test_license_places(docs, edge, none):
    for df in (docs, edge):
        texts = {}
        for r in df.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, r.text)
        got = license_scan.scan(df).collect()
        assert len(got) == df.count()
        for r in got:
            n, places = brute.license_places(texts[r.doc_id], license_scan.BASE)
            assert (r.n_words, r.n_base) == (n, len(places))
            assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
            base = sorted({label for _, label in places})
            assert r.base_labels == ",".join(base) and set(base) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_scan.scan(none).count() == 0


def test_license_merges_diagonals(spark):
    text = "This work is, as stated, licensed under the GNU General Public License, version 3"
    r = license_scan.scan(spark.createDataFrame([(1, text), (2, "a license of its own")], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert r[0].labels == "gpl-3" and r[0].base_labels == "" and r[0].score > 0.7 and r[1].labels == ""


def test_sharding(docs, edge, none):
    for df, n in ((docs, 24), (edge, 24), (edge, 3)):
        got = sharding.uniform_shards(df, n).toPandas()
        sizes = got.groupby("shard").size().reindex(range(n), fill_value=0)
        assert len(got) == df.count() and sizes.max() - sizes.min() <= 1
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
        assert set(got.law) == {"rows"} and got.grown_shard.isna().all()
    assert sharding.uniform_shards(none).count() == 0
    texts = {r.doc_id: r.text for r in edge.collect()}
    got = sharding.uniform_shards(edge).collect()
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)


def test_sharding_is_uniform():
    total = np.zeros((3, 4))
    for seed in range(3000):
        m = sharding.communication_matrix([10, 20, 11], 4, seed)
        assert list(m.sum(1)) == [10, 20, 11] and list(m.sum(0)) == [11, 10, 10, 10]
        total += m
    want = np.outer([10, 20, 11], [11, 10, 10, 10]) / 41
    assert np.abs(total / 3000 - want).max() < 0.12


def test_large_hypergeometric_has_the_right_mean():
    rng = np.random.default_rng(1)
    good, bad, n = 2_000_000_000, 6_000_000_000, 40_000
    x = [sharding._hypergeometric(good, bad, n, rng) for _ in range(400)]
    assert abs(np.mean(x) - n / 4) < 4 * (n * 3 / 16 / 400) ** 0.5 and 0.8 < np.var(x) / (n * 3 / 16) < 1.25


def reference_codec():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, edge, none):
    k = reference_codec()
    for df in (docs, edge):
        for r in bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN).join(df.select("doc_id", "text"), "doc_id").collect():
            ids = k.encode_ordinary(r.text or "")
            assert list(r.ids) == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_random_unicode():
    k, c = reference_codec(), bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(8)
    pools = ["abc deAB'st're 12\n\t  ", "é è ñ ü ß Ā ſ ", "日本 語。🙂👍🏽 ", "\x00\x1c\x1d\x1e\x1f\x85  　​ ", "١٢٣ ²½ Ⅷ "]
    for _ in range(400):
        pool = "".join(rng.sample(pools, 2))
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        ids, back = c.run(t)
        assert list(np.frombuffer(ids, "<u4")) == k.encode_ordinary(t) and back.decode() == t
    for t in ("a" * 5000, "ab" * 3000, " " * 4000 + "x", "0" * 999):
        assert list(np.frombuffer(c.run(t)[0], "<u4")) == k.encode_ordinary(t)


def test_bpe_cache_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    k, c = reference_codec(), bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for t in ("one two three four five six seven", "eight nine ten one two", "eleven twelve one"):
        assert list(np.frombuffer(c.run(t)[0], "<u4")) == k.encode_ordinary(t)


def test_fingerprints(docs, edge, none):
    for df in (docs, edge.filter("doc_id <> 12 AND doc_id IS NOT NULL")):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        order = sorted(texts)
        got = {r.doc_id: r for r in minhash.fingerprints(df).collect()}
        assert set(got) == set(texts)
        assert {d: r.near_id for d, r in got.items()} == {d: c for d, (_, c) in brute.near_groups(list(texts.items())).items()}
        prints = {}
        for i, d in enumerate(order):
            t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
            cut = len(t) // 4
            changed = t[: len(t) - cut] + nxt[:cut]
            r = got[d]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert prints.setdefault(t, r.fingerprint) == r.fingerprint
            assert r.near_next == pytest.approx(minhash.likeness(bytes.fromhex(r.fingerprint), bytes.fromhex(got[order[(i + 1) % len(order)]].fingerprint)))
            x, y = brute.shingles(t), brute.shingles(changed)
            if len(x) > 100:
                assert abs(r.near_edited - len(x & y) / len(x | y)) < 0.25
    out = minhash.fingerprints(edge).collect()
    assert sorted((str(r.doc_id), r.near_id) for r in out if r.doc_id in (None, 6, 12)) == [("12", 11), ("12", 11), ("6", 4), ("None", None)]
    assert len(out) == len(TEXTS) and minhash.fingerprints(none).count() == 0


def test_fingerprints_of_ties_and_one_row(spark):
    df = spark.createDataFrame([(1, "b c d e f g h"), (1, "a"), (1, None), (2, "z" * 9)], "doc_id bigint, text string")
    out = minhash.edited_fingerprints(df).collect()
    assert sorted((r.doc_id, r.n_chars) for r in out) == [(1, 0), (1, 1), (1, 13), (2, 9)]
    assert sorted(tuple(r) for r in minhash.edited_fingerprints(df.repartition(3)).collect()) == sorted(tuple(r) for r in out)
    (one,) = minhash.edited_fingerprints(df.filter("doc_id = 2")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"z" * 9).hexdigest() and one.near_next == 1.0


def plain_fingerprint(text):
    """Permutation by permutation, shingle by shingle."""
    out = b""
    tokens = [int(x) >> 32 for x in next(iter(minhash.shingle_sets([text])))]
    for a, b in zip(minhash._A[:, 0].tolist(), minhash._B[:, 0].tolist()):
        low = min(((a * x + b) % 2**32 for x in tokens), default=2**32 - 1)
        if tokens:
            low ^= low >> 15
            low = low * 0x2C1B3C6D % 2**32
            low ^= low >> 12
            low = low * 0x297A2D39 % 2**32
        out += bytes([low >> 24])
    return out


def test_fingerprint_equals_the_plain_one():
    for t in ("", "one", "one two three four five six", "w " * 3000, " ".join(f"w{i}" for i in range(2500))):
        assert minhash.fingerprint(next(iter(minhash.shingle_sets([t])))) == plain_fingerprint(t)


def test_bands_find_verified_groups(docs):
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = [f"q{i}" for i in range(200)]
    data += [(5000 + k, " ".join(words[:k] + ["edit"] + words[k + 1 :])) for k in range(0, 200, 20)]
    got = minhash.near_groups(docs.sparkSession.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups(data)


def test_merkle_finds_exactly_the_damage(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN_OUT", 4)
    data = [(i, f"http://x/{i}", f"<p>{i}</p>", "extra") for i in range(100)] + [(None, None, None, "extra"), (7, "http://x/7", "<p>again</p>", "extra")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string, digest string").repartition(3)
    broken = pages.withColumn("html", F.when(F.col("page_id").isin(5, 63), "changed").otherwise(F.col("html"))).filter("page_id <> 40 OR page_id IS NULL")
    got = merkle.fixity(pages, broken).collect()
    assert len(got) == 102 and {(r.page_id, r.status) for r in got if r.status != "ok"} == {(5, "altered"), (63, "altered"), (40, "missing")}
    assert len({(r.root_sha256, r.replica_root_sha256) for r in got}) == 1 and got[0].root_sha256 != got[0].replica_root_sha256
    at = sorted((r.offset, r.length) for r in got)
    assert [o for o, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1]]
    same = merkle.fixity(pages, pages.repartition(5)).collect()
    assert {r.status for r in same} == {"ok"} and same[0].root_sha256 == same[0].replica_root_sha256 == got[0].root_sha256
    more = pages.union(spark.createDataFrame([(500, "u", "h", "e"), (7, "http://x/7", "<p>again</p>", "e")], pages.schema))
    got = merkle.fixity(pages, more).collect()
    assert len(got) == 104 and sorted(r.page_id for r in got if r.status == "extra") == [7, 500]
    assert {r.page_id for r in got if r.status == "altered"} <= {7}  # a record more can shift the numbers of its identifier
    assert got[0].root_sha256 != got[0].replica_root_sha256
    assert [r.status for r in merkle.fixity(pages.limit(0), more.limit(3)).collect()] == ["extra"] * 3
    assert merkle.fixity(pages.limit(0), pages.limit(0)).count() == 0


def test_merkle_hashes_cover_offsets_and_lengths(spark):
    leaves = lambda *rows: spark.createDataFrame([(0, *rows[0]), (1, *rows[1])], "n bigint, start bigint, length bigint, digest string")
    root = lambda *rows: merkle.tree(leaves(*rows), 2)[-1].first().digest
    assert len({root((0, 5, "x"), (5, 3, "y")), root((0, 4, "x"), (5, 3, "y")), root((0, 5, "x"), (6, 3, "y"))}) == 3


def test_merkle_spreads_a_shared_identifier(spark):
    data = [(None if i % 3 == 0 else i // 3, "u", "z" * (i % 7) if i % 2 else f"b{i}") for i in range(900)] + [(1, "u", "long " * 300_000)]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(4)
    got = merkle.fixity(pages, pages.filter("html IS NULL OR html <> 'b4'").repartition(2)).collect()
    assert len(got) == 901 and [r.page_id for r in got if r.status == "missing"] == [1]
    assert [r.status for r in got].count("altered") <= 3  # the shifted numbers of that identifier's records
    assert sorted(r.offset for r in got) == [0, *np.cumsum([n for _, n in sorted((r.offset, r.length) for r in got)])[:-1]]


def test_queries_run_over_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [f"op{k}_" for k in range(1, 11)] == [q[: q.index("_") + 1] for q in queries.QUERIES]
    for name in ("op2_exact_dedup", "op4_pii_pseudonyms", "op5_toxicity", "op6_ngram_jaccard", "op7_license_scan", "op8_sharding", "op9_bpe_codec", "op10_fingerprints"):
        assert queries.QUERIES[name](spark, SF).count() == n, name
