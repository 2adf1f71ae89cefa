"""Observations by the model's rules."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from kelpie.operators import mentions as M

NOW = datetime.datetime(2024, 3, 10, 12)
RECORDS = "id string, session string, role string, source string, ts timestamp, text string, memory_versions map<string,string>"
ANCHORS = "anchor string, version string, aliases array<string>, min_anchors int, case_insensitive boolean, valid_from timestamp, valid_until timestamp"


def at(hours):
    return NOW - datetime.timedelta(hours=hours)


def anchor(name="a", aliases=("Blue Fox",), least=1, fold=False, since=None, until=None, version="1"):
    return (name, version, list(aliases), least, fold, since, until)


def scan(spark, texts, anchors, **more):
    rows = [(f"m{k}", f"s{k}", "assistant", "chat", at(k), t, None) if isinstance(t, str) else t for k, t in enumerate(texts)]
    return M.observed(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(anchors, ANCHORS), "p", F.lit(NOW), **more)


def found(df):
    return sorted((r.message_id, r.entry_id, tuple((m.anchor, m.start, m.end) for m in r.matches)) for r in df.collect())


def test_boundaries_only_beside_ascii_letters_and_digits(spark):
    texts = ["the Blue Fox runs", "xBlue Fox", "Blue Foxes", "blue fox", "我们问李明了吗", "a++b and C++", "éBlue Fox", "Blue Fox_", ">quoted Blue Fox\nplain", "```\nBlue Fox\n```"]
    got = found(scan(spark, texts, [anchor(), anchor("cjk", ["李明"]), anchor("sym", ["++"]), anchor("low", ["BLUE fox"], fold=True)]))
    assert got == [
        ("m0", "a", (("Blue Fox", 4, 12),)), ("m0", "low", (("BLUE fox", 4, 12),)), ("m3", "low", (("BLUE fox", 0, 8),)), ("m4", "cjk", (("李明", 3, 5),)), ("m5", "sym", (("++", 1, 3),)),
    ]


def plain_tight(places, required):
    """The first place at which enough aliases stand within the reach behind it."""
    kept = [p for p in places if p[1] - p[0] <= M.SPAN]
    start = 0
    for i in range(len(kept)):
        while max(e for _, e, _ in kept[start : i + 1]) - kept[start][0] > M.SPAN:
            start += 1
        names = list(dict.fromkeys(a for _, _, a in kept[start : i + 1]))
        if len(names) >= required:
            return [next(p for p in kept[start : i + 1] if p[2] == a) for a in names[:required]]
    return []


def test_windows_equal_a_plain_version():
    rng = random.Random(1)
    for _ in range(500):
        places = sorted((s, s + rng.choice([2, 5, 90, 210]), rng.choice("abc")) for s in rng.sample(range(900), rng.randrange(14)))
        for required in (1, 2, 3):
            assert M.tight(places, required) == plain_tight(places, required)


def test_aliases_close_together_late_in_a_text(spark):
    far = "alpha " + "x " * 150 + "beta " + "y " * 150 + "alpha beta"
    got = found(scan(spark, [far, "alpha " + "x " * 150 + "beta", "beta alpha alpha"], [anchor("two", ["alpha", "beta"], 2)]))
    assert got == [("m0", "two", (("alpha", len(far) - 10, len(far) - 5), ("beta", len(far) - 4, len(far)))), ("m2", "two", (("beta", 0, 4), ("alpha", 5, 10)))]


def test_records_that_are_not_scanned(spark):
    texts = [
        "Blue Fox", ("u", "s", "user", "chat", at(1), "Blue Fox", None), ("c", "s", "assistant", "CRON", at(1), "Blue Fox", None), ("o", "s", "assistant", "chat", at(24 * 8), "Blue Fox", None), ("f", "s", "assistant", "chat", at(-1), "Blue Fox", None),
        ("e", "s", "assistant", None, at(2), "x [Kelpie Context] Blue Fox", None), ("q", "s", "assistant", None, at(2), "> memory audit report\nBlue Fox", {"a": "1"}), ("v", "s", "assistant", None, at(3), "Blue Fox", {"a": "2"}),
    ]
    df = spark.createDataFrame([(f"m{k}", f"s{k}", "assistant", "chat", at(k), t, None) if isinstance(t, str) else t for k, t in enumerate(texts)], RECORDS)
    assert {r.reason: r.n for r in M.skipped(df, F.lit(NOW), 7).collect()} == {"scanned": 3, "role_or_source": 2, "outside_window": 2, "self_echo": 1}
    got = M.observed(df, spark.createDataFrame([anchor()], ANCHORS), "p", F.lit(NOW))
    assert {r.message_id: r.exposure for r in got.collect()} == {"m0": "unknown", "q": "snapshot_matched", "v": "unknown"}


def test_copies_and_intervals(spark):
    same = [(i, s, "assistant", "chat", at(2), "Blue Fox", None) for i, s in (("b", "s2"), ("a", "s1"), ("c", "s3"))]
    got = scan(spark, [*same, ("d", "s4", "assistant", "chat", at(3), "Blue Fox", None)], [anchor(since=at(3)), anchor("gone", until=at(3)), anchor("edge", since=at(2), until=at(1))])
    assert [(m, e) for m, e, _ in found(got)] == [("a", "a"), ("a", "edge"), ("d", "a")]
    assert got.select("event_id").distinct().count() == 3 and {(r.type, r.weight, r.usefulness) for r in got.collect()} == {("mention_observed", 0.0, "unverified")}
    assert found(scan(spark, same, [anchor()][:0])) == []


@pytest.mark.parametrize("bad", [anchor(aliases=[]), anchor(aliases=[" x "]), anchor(aliases=["x"]), anchor(least=2), anchor(name=" "), anchor(aliases=["ab", "AB"], least=2, fold=True), anchor(since=NOW, until=NOW)])
def test_anchors_that_are_refused(spark, bad):
    with pytest.raises(ValueError, match="anchor|aliases"):
        scan(spark, ["x"], [bad])
    with pytest.raises(ValueError, match="of its own"):
        scan(spark, ["x"], [anchor(), anchor()])
