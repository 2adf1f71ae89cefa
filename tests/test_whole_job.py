"""Queries do the whole job: no row, term, relation or place in a text is left out."""

import re

import pytest

from kelpie import queries
from kelpie.operators import observe, ranking
from kelpie.sources import driver as D

SF = "/root/testdata/sf0.001"


def test_mentions_of_all_conversations(spark, tmp_path):
    rows = [(c, 1, "assistant", f"the answer {c}") for c in (0, 11, 100, 101, 5000)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["mention_scan"](spark, str(tmp_path))
    assert sorted(r.session for r in got.collect()) == sorted(str(r[0]) for r in rows)
    assert queries.QUERIES["mention_summary"](spark, str(tmp_path)).first().mentions == len(rows)


def test_passages_are_asked_whole(spark, tmp_path):
    passage = "common " * 40 + "zebra"
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, "zebra", "en", "s"), *((n, f"other words {n}", "en", "s") for n in range(2, 9))]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(c, 0, "user", t) for c, t, *_ in docs]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda n: queries.QUERIES[n](spark, str(tmp_path)).collect()
    assert [r.id for r in run("bm25_literal")] == ["1"] and run("bm25_weighted")[0].id == "1:0"
    assert [r.selected for r in run("recall_sparse")] == ["1:0"]
    assert "bm25_literal" in queries.ORACLE_SQL and "substr(text, 1, 200)" not in "".join(v for k, v in queries.ORACLE_SQL.items() if k.endswith(""))


def hop(ranked, docs, known, cap):
    """[(from_id, to_id, relation, target)] of one query, from all pairs."""
    best = {}
    for rank, a in ranked:
        for b in docs:
            kinds = (a.speaker and a.speaker == b.speaker, a.source and a.source == b.source, a.session == b.session and abs(a.ord - b.ord) == 1, re.search(rf"(?<!\w){re.escape(b.id)}(?!\w)", a.text, re.I))
            if b.rowid not in known and any(kinds):
                e = (rank, [bool(k) for k in kinds].index(True), a.id)
                best[b.rowid] = min(best.get(b.rowid, (e, b)), (e, b))
    names = ["same-explicit-speaker", "same-source", "session-adjacency", "explicit-identifier-reference"]
    return [(e[2], b.id, names[e[1]], b) for e, b in sorted(best.values(), key=lambda x: (x[0][0], x[1].rowid))][:cap]


@pytest.mark.parametrize("cap", [4, 45])
def test_associations_are_those_of_all_pairs(spark, cap):
    t = D.turns(spark, SF)
    docs, want = t.collect(), set()
    for a in (d for d in docs if d.ord == 0):
        first = hop([(1, a)], docs, {a.rowid}, cap)
        second = hop([(n, e[3]) for n, e in enumerate(first, 1)], docs, {a.rowid, *(e[3].rowid for e in first)}, cap)
        want |= {(int(a.session), *e[:3], 1) for e in first} | {(int(a.session), *e[:3], 2) for e in second[: cap - len(first)]}
    seeds = t.filter("ord = 0").selectExpr("cast(session AS bigint) AS query_id", "rowid", "1 AS rank")
    got = queries.QUERIES["association_expand"](spark, SF) if cap == 4 else ranking.associations(seeds, t, 2, cap)
    assert {(r.query_id, r.from_id, r.to_id, r.relation, r.hop) for r in got.collect()} == want
    assert {"same-explicit-speaker"} <= {e[3] for e in want}


def test_every_place_of_an_alias_counts(spark):
    far = "alpha " + "x " * 200
    rows = [
        ("1", "a", f"{far} Alpha and beta", 2), ("2", "a", "alphabet " + "x " * 200 + "alpha beta", 2), ("3", "a", f"{far} beta", 0),
        ("4", "a", "alpha alpha alpha", 0), ("5", "a", f"beta. {'x ' * 200}alpha.\nbeta", 2),
    ]
    records = spark.createDataFrame([r[:3] for r in rows], "id string, session string, text string").selectExpr("*", "timestamp'2026-09-01' AS ts")
    anchors = spark.sql("SELECT 'p' AS anchor, '1' AS version, array('alpha', 'beta') AS aliases, 2 AS min_anchors, CAST(NULL AS timestamp) AS valid_from, CAST(NULL AS timestamp) AS valid_until")
    assert {r.id: r.n_aliases for r in observe.scan(records, anchors).collect()} == {r[0]: r[3] for r in rows if r[3]}


def test_close_mentions_are_those_of_a_plain_scan(spark):
    texts = {r.id: r.text for r in D.turns(spark, SF).collect() if r.speaker == "assistant" and ">" not in r.text and "```" not in r.text}
    want = set()
    for anchor, words, least in (("en", "the of and", 2), ("de", "der die und", 3)):
        for i, text in texts.items():
            at = sorted((m.start(), m.end(), w) for w in words.split() for m in re.finditer(rf"(?<!\w){w}(?!\w)", text, re.I))
            close = max((len({w for b, e, w in at if b >= a and e <= a + 200}) for a, *_ in at), default=0)
            want |= {(anchor, i, close)} if close >= least else set()
    got = {(r.anchor, r.id, r.n_aliases) for r in queries.QUERIES["mention_close"](spark, SF).collect() if r.id in texts}
    assert got == want and want
