"""Recall from SQL text alone: scalar functions, a stemming function and two table functions over partitioned tables.

After ``register(spark)``, SQL can use

* ``kelpie_tokens(text)``, ``kelpie_terms(text)``, ``kelpie_block(id, speaker, date, text)``: SQL functions, inlined by Catalyst;
* ``kelpie_stems(tokens)``: Porter stems of an array, in Arrow batches;
* ``recall_fused(TABLE(scored) PARTITION BY (query_id), k)``: the ``k`` best rows of each channel, fused by reciprocal ranks;
* ``pack_budget(TABLE(ranked) PARTITION BY (query_id) ORDER BY (rank), budget)``: the greedy pack of each query.

The table functions see one query's rows after the other and keep its best rows, or its pack so far, never the rows themselves; so a
query with very many candidates needs no array of them. ``recall_sql`` is a whole recall written with these functions.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lexical, ranking


class RecallFused:
    """Rows (query_id, channel, rowid, id, score) of one query to (query_id, rowid, score, rank)."""

    def __init__(self):
        self.best: dict[str, list] = {}
        self.query_id = None

    def eval(self, row: Row, k: int) -> Iterator[tuple]:
        self.query_id = row["query_id"]
        heap = self.best.setdefault(row["channel"], [])
        entry = (row["score"], _Last(row["id"]), row["rowid"])
        if len(heap) < k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        score: dict[int, float] = {}
        for channel in sorted(self.best):
            for rank, (_, _, rowid) in enumerate(sorted(self.best[channel], reverse=True), 1):
                score[rowid] = score.get(rowid, 0.0) + 1 / (ranking.RRF_K + rank)
        for rank, (s, rowid) in enumerate(sorted((-round(s, 12), r) for r, s in score.items()), 1):
            yield self.query_id, rowid, -s, rank


class _Last:
    """An id that sorts the other way round: of equal scores the smaller id is the better one."""

    def __init__(self, key: str):
        self.key = key.encode()

    def __lt__(self, other: _Last) -> bool:
        return self.key > other.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.key == other.key


class PackBudget:
    """Rows (query_id, id, block) of one query in rank order to (query_id, selected_ids, context, budget_used)."""

    def __init__(self):
        self.query_id, self.ids, self.blocks, self.used = None, [], [], 0

    def eval(self, row: Row, budget: int) -> Iterator[tuple]:
        self.query_id = row["query_id"]
        units = len(row["block"].encode("utf-8", "surrogatepass")) + (2 if self.ids else 0)
        if self.used + units <= budget:
            self.used += units
            self.ids.append(row["id"])
            self.blocks.append(row["block"])
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self.query_id is not None:
            yield self.query_id, self.ids, "\n\n".join(self.blocks), self.used


@functools.lru_cache(maxsize=500_000)
def _stem(word: str) -> str:
    return X.porter(word)


def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ws: [_stem(w) for w in ws])


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> SparkSession:
    """The functions of this module, as temporary functions of the session."""
    spark.udtf.register("recall_fused", F.udtf(RecallFused, returnType="query_id bigint, rowid bigint, score double, rank int"))
    spark.udtf.register("pack_budget", F.udtf(PackBudget, returnType="query_id bigint, selected_ids array<string>, context string, budget_used bigint"))
    spark.udf.register("kelpie_stems", F.pandas_udf(_stems, "array<string>"))
    escaped = "t"
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        escaped = f"replace({escaped}, {_quoted(char)}, {_quoted(escape)})"
    run = f"""CASE WHEN NOT run RLIKE {_quoted(X.CJK_RUN)} THEN array(lower(run)) WHEN char_length(run) = 1 THEN array(run)
        ELSE transform(sequence(1, greatest(char_length(run) - 1, 1)), i -> substr(run, i, 2)) END"""
    bodies = {
        "kelpie_tokens(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(translate(lower(coalesce(t, '')), {_quoted(X._OLD)}, {_quoted(X._NEW)}), {_quoted(X.WORD)}, 0)",
        "kelpie_terms(t STRING) RETURNS ARRAY<STRING>": f"array_distinct(flatten(transform(regexp_extract_all(coalesce(t, ''), {_quoted(X.TERM)}, 0), run -> {run})))",
        "kelpie_json(t STRING) RETURNS STRING": f"concat('\"', {escaped}, '\"')",
        "kelpie_block(id STRING, speaker STRING, date STRING, body STRING) RETURNS STRING": """concat('[source {"id": ', kelpie_json(id), ', "speaker": ', kelpie_json(speaker), ', "date": ', kelpie_json(date), '}]\\n', body)""",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return spark


STOP = "array(" + ", ".join(map(_quoted, X.STOP)) + ")"


#: Documents that one task scores, and questions of one pass over them: bound the groups (document, query) that it holds. Fewer
#: documents a task would not do instead: of few, nearly all are among a task's ``k`` best, and move.
TASK_DOCS, BLOCK_QUESTIONS = 1000, 1000


def recall_sql(docs: str, questions: str, mode: str = "sparse", budget: int = 600, k: int = 100, reach: int = 0, parts: int | None = None, few: bool = True) -> str:
    """SQL of the recall of ``questions`` (query_id, query) over ``docs`` (rowid, id, session, ord, text, speaker, timestamp), views of one scope.

    Tokens are dealt by ``rowid``, into ``parts`` partitions; counts and scores stay where they are, and only the best rows of each
    task move on. With ``few`` questions (some thousands) their phrases are broadcast to the documents.
    """
    if mode not in ("literal", "sparse") or not 1 <= k <= 1000 or not 0 <= budget <= 32768 or reach not in (0, 1, 2):
        raise ValueError("options are out of range")
    stems = "kelpie_stems({})" if mode == "sparse" else "{}"
    cjk = f"filter(kelpie_terms(text), t -> t RLIKE {_quoted(X.CJK_RUN)})"
    columns = {"text": "text", "meta": "concat_ws(' ', speaker, timestamp)"}
    weights = {"literal": ("tokens", {"text": 1.0, "meta": 0.0})}
    if mode == "sparse":
        columns = {"body": f"concat(text, ' ', array_join({cjk}, ' '))", "context": "concat_ws(' ', lag(text) OVER w, lead(text) OVER w)", "meta": "concat(speaker, ' ', timestamp)"}
        weights = {"focus": ("focus", {"body": 1.0, "context": 0.0, "meta": 0.02}), "context": ("content", {"body": 1.0, "context": 0.12, "meta": 0.05})}
    tokens = ", ".join(f"struct('{c}' AS col, {stems.format(f'c_{c}')} AS toks)" for c in columns)
    asked = " UNION ALL ".join(f"SELECT '{channel}' AS channel, query_id, explode({terms}) AS phrase FROM q" for channel, (terms, _) in weights.items())
    frequency = " ".join(f"WHEN channel = '{channel}' THEN " + " + ".join(f"{w} * f_{c}" for c, w in ws.items()) for channel, (_, ws) in weights.items())
    dealt = f"REPARTITION({parts}, rowid)" if parts else "REPARTITION(rowid)"
    # Stems are made in Python, which forgets how rows were dealt; before it, texts are only spread.
    spread = f"/*+ {dealt} */" if mode == "sparse" else ""
    small = "/*+ BROADCAST({}) */" if few else ""
    sums = ", ".join(f"sum(IF(col = '{c}', n, 0)) AS f_{c}" for c in columns)
    ranked = "SELECT query_id, rowid, rank FROM fused"
    if reach:
        ranked = f"""SELECT query_id, rowid, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rank FROM (
            SELECT query_id, n.rowid, min(struct(rank, IF(n.rowid = s.rowid, 0, 1) AS other, abs(n.ord - s.ord) AS far, n.ord, n.rowid)) AS o
            FROM (SELECT rank, rowid, session, ord, query_id, explode(sequence(ord - {reach}, ord + {reach})) AS near FROM fused JOIN {docs} USING (rowid)) s
            JOIN {docs} n ON n.session = s.session AND n.ord = s.near GROUP BY query_id, n.rowid)"""
    return f"""
    WITH whole AS (SELECT rowid, id, {', '.join(f'{e} AS c_{c}' for c, e in columns.items())} FROM {docs} WINDOW w AS (PARTITION BY session ORDER BY ord, id)),
    apart AS (SELECT {spread} * FROM whole),
    split AS (SELECT rowid, id, {', '.join(f'kelpie_tokens(c_{c}) AS c_{c}' for c in columns)} FROM apart),
    toked AS (SELECT /*+ {dealt} */ rowid, id, length, array({tokens}) AS cs FROM (SELECT *, {' + '.join(f'size(c_{c})' for c in columns)} AS length FROM split)),
    rich AS (SELECT rowid, id, length, explode(cs) AS c FROM toked),
    stats AS (SELECT count(*) AS n_rows, avg(length) AS avg_length FROM (SELECT {' + '.join(f'size(kelpie_tokens(c_{c}))' for c in columns)} AS length FROM whole)),
    speakers AS (SELECT array_distinct(flatten(collect_set(names))) AS names FROM (SELECT kelpie_terms(speaker) AS names FROM {docs})),
    tokened AS (SELECT query_id, slice(kelpie_terms(query), 1, 64) AS tokens FROM {questions}),
    content AS (SELECT query_id, tokens, array_except(tokens, {STOP}) AS content FROM tokened),
    q AS (SELECT query_id, tokens, content, IF(size(array_except(content, names)) > 0, array_except(content, names), content) AS focus FROM content CROSS JOIN speakers),
    asked AS ({asked}),
    parts AS (SELECT phrase, size(p) AS n_parts, posexplode(p) AS (part, token) FROM (SELECT phrase, {stems.format('p')} AS p FROM (SELECT phrase, kelpie_tokens(phrase) AS p FROM (SELECT DISTINCT phrase FROM asked)))),
    posts AS (SELECT rowid, id, length, c.col, posexplode(c.toks) AS (pos, token) FROM rich),
    starts AS (SELECT {small.format('parts')} rowid, id, length, phrase, col, n_parts, count(*) AS n FROM posts JOIN parts USING (token) GROUP BY rowid, id, length, phrase, col, n_parts, IF(n_parts > 1, pos - part, NULL)),
    tf AS (SELECT rowid, id, length, phrase, {sums} FROM (SELECT rowid, id, length, phrase, col, IF(n_parts = 1, n, 1) AS n FROM starts WHERE n_parts = 1 OR n = n_parts) GROUP BY rowid, id, length, phrase),
    idf AS (SELECT phrase, avg_length, IF(ln((n_rows - df + 0.5D) / (df + 0.5D)) > 0, ln((n_rows - df + 0.5D) / (df + 0.5D)), 1e-6D) AS idf FROM (SELECT phrase, count(*) AS df FROM tf GROUP BY phrase) CROSS JOIN stats),
    valued AS (SELECT channel, query_id, phrase, idf, avg_length FROM asked JOIN idf USING (phrase)),
    parted AS (SELECT {small.format('valued')} channel, query_id, rowid, id, idf, length / avg_length AS share, CAST(CASE {frequency} END AS DOUBLE) AS f FROM tf JOIN valued USING (phrase)),
    scored AS (SELECT query_id, channel, rowid, id, round(sum(idf * f * 2.2D / (f + 1.2D * (0.25D + 0.75D * share))), {lexical.DIGITS}) AS score FROM parted GROUP BY query_id, channel, rowid, id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS place FROM scored),
    best AS (SELECT query_id, channel, rowid, id, score FROM placed WHERE place <= {k}),
    fused AS (SELECT * FROM recall_fused(TABLE(best) PARTITION BY (query_id), {k})),
    ranked AS ({ranked}),
    blocks AS (SELECT query_id, rank, id, kelpie_block(id, speaker, timestamp, text) AS block FROM ranked JOIN {docs} USING (rowid))
    SELECT * FROM pack_budget(TABLE(blocks) PARTITION BY (query_id) ORDER BY (rank), {budget})"""
