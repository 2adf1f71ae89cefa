import sqlite3

from pyspark.sql import functions as F

from kelpie.functions import scalars as S
from kelpie.functions import text as X


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in cols.items())) if names else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_terms_keep_first_seen_order_and_split_cjk(spark):
    assert one(spark, X.terms(F.col("t")), t="DB-5432 uses db-5432 数据库 和 PostgreSQL/v2") == ["db-5432", "uses", "数据", "据库", "和", "postgresql/v2"]
    assert one(spark, X.terms(F.col("t")), t=None) == []
    assert one(spark, X.index_text(F.col("t")), t="a 数据库") == "a 数据库 数据 据库"


def test_stop_words_leave_candidates_only(spark):
    assert one(spark, X.content_terms(F.col("t")), t="do not use the Port") == ["use", "port"]
    assert len(X.STOP) == len(set(X.STOP))


def test_word_tokens_fold_accents_like_fts5(spark):
    text = "Café NAÏVE über x2 ñandú-Été"
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(a, tokenize='unicode61')")
    db.execute("insert into t values (?)", (text,))
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    theirs = [r[0] for r in db.execute("select term from v order by offset")]
    assert one(spark, X.word_tokens(F.col("t")), t=text) == theirs


def test_porter_agrees_with_fts5():
    words = (
        "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky "
        "relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism "
        "decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance "
        "inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective "
        "bowdlerize probate rate cease controll roll databases running queries memories retrieval generously by ease"
    ).split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(a, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.execute("insert into t values (?)", (" ".join(words),))
    theirs = [r[0] for r in db.execute("select term from v order by offset")]
    assert [(w, X.porter(w)) for w in words] == list(zip(words, theirs, strict=True))


def test_contains_word_is_whole_and_literal(spark):
    has = X.contains_word(F.col("t"), F.col("w"))
    assert one(spark, has, t="Ask Ann now", w="ann")
    assert not one(spark, has, t="Ask Annette", w="ann")
    assert one(spark, has, t="see a.b here", w="a.b") and not one(spark, has, t="see axb here", w="a.b")
    assert not one(spark, has, t="éann", w="ann")


def test_visible_text_drops_fences_and_quotes(spark):
    assert one(spark, X.visible_text(F.col("t")), t="a\n```\nb\n```\n> q\nc\n```\nopen") == "a\nc"


def test_evidence_ids(spark):
    e = one(spark, X.evidence_ids(F.col("t")), t="D1:3; D2:7 D1:3")
    assert e.ids == ["D1:3", "D2:7"] and not e.malformed
    assert one(spark, X.evidence_ids(F.col("t")), t="D1:3-5").malformed


def test_source_block_is_pythons_json(spark):
    import json

    cols = {"i": 'a"b\\', "s": "Zoë\n", "d": "", "t": "text"}
    label = json.dumps({"id": cols["i"], "speaker": cols["s"], "date": cols["d"]}, ensure_ascii=False)
    assert one(spark, X.source_block(*map(F.col, "isdt")), **cols) == f"[source {label}]\ntext"


def test_exact_f1(spark):
    f = X.exact_f1(F.col("a"), F.col("g"))
    assert one(spark, f, a="the cat cat", g="cat the dog") == 2 * 2 / 6
    assert one(spark, f, a="", g="") == 1.0 and one(spark, f, a="x", g="y") == 0.0


def test_kernels_halve_at_half_life_and_fall(spark):
    for k in ("power", "exponential", "bounded_power"):
        assert abs(one(spark, S.decay(F.lit(30), k)) - 0.5) < 1e-12
    rows = spark.range(400).select(*(S.decay(F.col("id"), k).alias(k) for k in S.KERNELS)).collect()
    for k in S.KERNELS:
        v = [r[k] for r in rows]
        assert all(a >= b for a, b in zip(v, v[1:], strict=False))
    assert rows[181]["bounded_power"] == 0.0


def test_locators_and_topics(spark):
    assert one(spark, S.safe_locator(F.col("t")), t="warm/a.md") == "warm/a.md"
    for bad in ("/etc/x", "../x", "a/../b", "C:\\x", " "):
        assert one(spark, S.safe_locator(F.col("t")), t=bad) is None
    assert one(spark, S.locator_topic(F.col("t")), t="warm/my_topic-one.md") == "my topic one"
    assert one(spark, S.sanitised(F.col("t"), 5), t=" a | b\nc ddd") == "a / b"


def test_epoch_needs_an_offset(spark):
    assert str(one(spark, S.epoch(F.col("t")).cast("string"), t="2026-01-01T00:00:00+01:00")) == "2025-12-31 23:00:00"
    assert one(spark, S.epoch(F.col("t")), t="2026-01-01T00:00:00") is None
    assert str(one(spark, S.epoch(F.col("t")).cast("string"), t="86400")) == "1970-01-02 00:00:00"


def test_canonical_hash_styles(spark):
    import hashlib

    text = '{"b": "é", "a": 1}'
    for style, form in (("spaced", '{"a": 1, "b": "é"}'), ("compact", '{"a":1,"b":"é"}'), ("ascii", '{"a":1,"b":"\\u00e9"}')):
        assert one(spark, S.canonical_sha_udf(style)(F.col("t")), t=text) == hashlib.sha256(form.encode()).hexdigest()


def test_three_percentiles(spark):
    a = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)])
    assert one(spark, S.percentile_nearest(a, 0.95)) == 10.0 and one(spark, S.percentile_floor(a, 0.95)) == 9.0
