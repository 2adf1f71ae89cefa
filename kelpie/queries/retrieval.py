"""Queries over documents, turns and vectors."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import ann, dense, lexical, ranking, store
from ..plans import recall as R
from ..plans import table_functions
from ..sources import driver as D
from ..sources import scratch, segments

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TURNS = """turns AS (
    SELECT conv_id * 100000 + turn AS rowid, conv_id || ':' || turn AS id, 'conv' AS scope, conv_id::VARCHAR AS session, turn AS ord,
           coalesce(text, '') AS text, role AS speaker, '' AS "timestamp", 'conversation:' || conv_id AS source FROM conversations)"""
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP) + "]"
TERM = r"[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*|[\x{3400}-\x{9fff}]+"
TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
TERMS = f"(SELECT list(t ORDER BY p) FROM (SELECT lower(u.t) AS t, min(u.p) AS p FROM (SELECT unnest(regexp_extract_all({{0}}, '{TERM}')) AS t, generate_subscripts(regexp_extract_all({{0}}, '{TERM}'), 1) AS p) u GROUP BY 1))"


def bm25_sql(docs: str, queries: str, columns: dict[str, float], k: int) -> str:
    """CTEs ending in ``ranked`` (query_id, rowid, id, score, rank); ``docs`` and ``queries`` (query_id, term) are CTE names."""
    toks = " UNION ALL ".join(f"SELECT rowid, {w} AS weight, unnest({TOKENS.format(c)}) AS token FROM {docs}" for c, w in columns.items())
    return f"""
        toks AS ({toks}),
        lens AS (SELECT d.rowid, d.id, count(t.token) AS length FROM {docs} d LEFT JOIN toks t USING (rowid) GROUP BY ALL),
        stats AS (SELECT count(*) AS n, avg(length) AS a FROM lens),
        asked AS (SELECT DISTINCT query_id, term, {TOKENS.format('term')}[1] AS token FROM {queries}),
        tf AS (SELECT rowid, token, sum(weight) AS f FROM toks WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
        idf AS (SELECT token, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, a FROM df, stats),
        scored AS (SELECT query_id, rowid, id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / a))), 9) AS score
                   FROM asked JOIN tf USING (token) JOIN idf USING (token) JOIN lens USING (rowid) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= {k})"""


@query(f"WITH {TURNS} SELECT id, session, ord, speaker, strlen(text)::INTEGER AS n_bytes, length(text)::INTEGER AS n_points FROM turns")
def scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.turns(spark, sf_dir).select("id", "session", "ord", "speaker", F.octet_length("text").alias("n_bytes"), F.char_length("text").alias("n_points"))


@query(f"""WITH {TURNS} SELECT id, md5(concat_ws(' ', lag(text) OVER w, lead(text) OVER w)) AS context_md5, speaker || ' ' || "timestamp" AS meta
    FROM turns WINDOW w AS (PARTITION BY scope, session ORDER BY ord, id)""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.context_columns(D.turns(spark, sf_dir)).select("id", F.md5("context").alias("context_md5"), "meta")


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TERM}')) AS t, generate_subscripts(regexp_extract_all(text, '{TERM}'), 1) AS p FROM documents),
    d AS (SELECT doc_id, lower(t) AS t, min(p) AS p FROM w GROUP BY ALL)
    SELECT doc_id AS rowid, count(t)::INTEGER AS n_terms, md5(coalesce(string_agg(t, ' ' ORDER BY p), '')) AS terms_md5 FROM documents LEFT JOIN d USING (doc_id) GROUP BY ALL""")
def terms_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.articles(spark, sf_dir).select("rowid", X.terms(F.col("text")).alias("t"))
    return d.select("rowid", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query("""SELECT lang AS scope, string_agg(DISTINCT source, ',' ORDER BY source) AS speaker_terms FROM documents GROUP BY ALL""")
def speaker_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.speaker_terms(D.articles(spark, sf_dir)).select("scope", F.array_join("speaker_terms", ",").alias("speaker_terms"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.articles(spark, sf_dir).withColumn("scope", F.lit("corpus")).withColumn("meta", F.concat(F.col("speaker"), F.lit(" "), F.col("timestamp")))


def _asked(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    return D.questions(spark, sf_dir).withColumn("scope", F.lit(scope)).withColumn("tokens", X.content_terms(F.col("query")))


CORPUS = """corpus AS (SELECT doc_id AS rowid, doc_id::VARCHAR AS id, coalesce(text, '') AS text, source || ' ' AS meta FROM documents)"""
ASKED = f"""raw AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM benchmark),
    queries AS (SELECT DISTINCT query_id, lower(term) AS term FROM raw WHERE NOT list_contains({STOP}, lower(term)))"""


@query(f"WITH {CORPUS}, {ASKED}, {bm25_sql('corpus', 'queries', {'text': 1.0, 'meta': 0.0}, 10)} SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked")
def bm25_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.bm25(_corpus(spark, sf_dir), _asked(spark, sf_dir, "corpus"), [("text", 1.0), ("meta", 0.0)], "tokens", 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {TURNS}, rich AS (SELECT *, concat_ws(' ', lag(text) OVER w, lead(text) OVER w) AS context, speaker || ' ' || "timestamp" AS meta
        FROM turns WINDOW w AS (PARTITION BY scope, session ORDER BY ord, id)), {ASKED},
    {bm25_sql('rich', 'queries', {'text': 1.0, 'context': 0.12, 'meta': 0.05}, 20)} SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked""")
def bm25_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = lexical.context_columns(D.turns(spark, sf_dir))
    found = lexical.bm25(rich, _asked(spark, sf_dir, "conv"), [("text", 1.0), ("context", 0.12), ("meta", 0.05)], "tokens", 20)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rowid"), F.col("embedding").alias("vector"), "label")


def _probes(v: DataFrame) -> DataFrame:
    return v.filter("rowid % 100 = 0").select(F.col("rowid").alias("query_id"), "vector")


def dense_sql(cut: str, k: int) -> str:
    return f"""SELECT q.vec_id AS query_id, e.vec_id AS rowid, round(list_dot_product(q.embedding{cut}::DOUBLE[], e.embedding{cut}::DOUBLE[]), 9) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding{cut}::DOUBLE[], e.embedding{cut}::DOUBLE[]), 9) DESC, e.vec_id) AS rank
        FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 QUALIFY rank <= {k}"""


@query(f"SELECT query_id, rowid, round(score, 6) AS score, rank::INTEGER AS rank FROM ({dense_sql('', 10)})")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return dense.top_k(v, _probes(v), 10).select("query_id", "rowid", F.round("score", 6).alias("score"), "rank")


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
    SELECT vec_id AS rowid, round(v[1] / n, 6) AS first, round(list_sum(v) / n, 6) AS total FROM n""")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("rowid", dense.normalised(F.col("vector")).alias("v"))
    return v.select("rowid", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _two_channels(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    v = _vectors(spark, sf_dir)
    half = v.withColumn("vector", F.slice("vector", 1, 32))
    return [dense.top_k(x, _probes(x), 20) for x in (v, half)]


@query(f"""WITH a AS ({dense_sql('', 20)}), b AS ({dense_sql('[1:32]', 20)}),
    f AS (SELECT query_id, rowid, round(sum(1.0 / (60 + rank)), 12) AS score FROM (FROM a UNION ALL FROM b) GROUP BY ALL)
    SELECT query_id, rowid, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rowid))::INTEGER AS rank FROM f""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_channels(spark, sf_dir)
    both = a.withColumn("channel", F.lit("whole")).unionByName(b.withColumn("channel", F.lit("half")))
    return ranking.rrf(both).select("query_id", "rowid", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH a AS ({dense_sql('', 20)}), b AS ({dense_sql('[1:32]', 20)}),
    j AS (SELECT a.query_id, count(b.rowid) AS overlap, avg(abs(a.rank - b.rank)) AS shift FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.rowid = b.rowid GROUP BY ALL)
    SELECT query_id, overlap / 20.0 AS recall, overlap::INTEGER AS overlap, (40 - 2 * overlap)::INTEGER AS symmetric_difference, round(shift, 6) AS mean_rank_shift FROM j""")
def ann_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.ann_quality(*_two_channels(spark, sf_dir)).withColumn("mean_rank_shift", F.round("mean_rank_shift", 6))


def ivf_sql(rounds: int = ann.ROUNDS) -> str:
    """CTEs ending in ``member`` (rowid, v, cell) and ``place`` (query_id, cell, p): cells by Lloyd's rounds over integers, and each row's cells by distance."""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = "".join(
        f""", n{r} AS MATERIALIZED (SELECT rowid, any_value(x) AS x, min({{'d': {far}, 'cell': cell}}).cell AS cell FROM x, c{r} GROUP BY rowid),
        m{r} AS (SELECT cell, list(mean ORDER BY i) AS c FROM (SELECT cell, i, floor(sum(v) / count(*)) AS mean FROM (SELECT cell, unnest(x) AS v, unnest(range(len(x))) AS i FROM n{r}) GROUP BY ALL) GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT cell, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cell))"""
        for r in range(rounds)
    )
    return f"""x AS MATERIALIZED (SELECT vec_id AS rowid, list_transform(embedding, lambda e: floor(e::DOUBLE * {ann.SCALE})) AS x, embedding::DOUBLE[] AS v FROM embeddings),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(rowid::VARCHAR), rowid) - 1 AS cell, x AS c FROM x QUALIFY cell < (SELECT floor(sqrt(count(*))) FROM x)){steps},
        far AS MATERIALIZED (SELECT rowid, cell, row_number() OVER (PARTITION BY rowid ORDER BY {far}, cell) AS p FROM x, c{rounds}),
        member AS MATERIALIZED (SELECT x.rowid, v, cell FROM x JOIN far USING (rowid) WHERE p = 1),
        exact AS MATERIALIZED (SELECT q.rowid AS query_id, e.rowid, row_number() OVER (PARTITION BY q.rowid ORDER BY round(list_dot_product(q.v, e.v), 9) DESC, e.rowid) AS rank
                  FROM x q JOIN x e ON q.rowid % 50 = 0 QUALIFY rank <= 10)"""


IVF_FOUND = """found AS (SELECT q.rowid AS query_id, m.rowid, round(list_dot_product(q.v, m.v), 9) AS score, row_number() OVER (PARTITION BY q.rowid ORDER BY round(list_dot_product(q.v, m.v), 9) DESC, m.rowid) AS rank
    FROM x q JOIN far ON q.rowid = far.rowid AND p <= {probes} JOIN member m USING (cell) WHERE q.rowid % 100 = 0 QUALIFY rank <= 10)"""
IVF_PROBES = 6


@query(f"WITH {ivf_sql()}, {IVF_FOUND.format(probes=IVF_PROBES)} SELECT query_id, rowid, round(score, 6) AS score, rank::INTEGER AS rank FROM found")
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ann.search(ann.build(v), _probes(v), 10, IVF_PROBES).select("query_id", "rowid", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {ivf_sql()},
    kept AS (SELECT p, row_number() OVER (ORDER BY p) AS n, count(*) OVER () AS total FROM exact e JOIN member m USING (rowid) JOIN far f ON f.rowid = e.query_id AND f.cell = m.cell WHERE e.query_id % 100 = 50),
    probes AS (SELECT min(p) AS probes FROM kept WHERE n >= ceil(0.95 * total)), {IVF_FOUND.format(probes='(SELECT probes FROM probes)')},
    shares AS (SELECT f.rowid AS query_id, sum(n) / (SELECT count(*) FROM x) AS scanned_share FROM far f LEFT JOIN (SELECT cell, count(*) AS n FROM member GROUP BY ALL) USING (cell)
               WHERE f.rowid % 100 = 0 AND p <= (SELECT probes FROM probes) GROUP BY ALL)
    SELECT query_id, count(f.rowid) / 10.0 AS recall, count(f.rowid)::INTEGER AS overlap, probes::INTEGER AS probes, round(any_value(scanned_share), 9) AS scanned_share
    FROM exact e LEFT JOIN found f USING (query_id, rowid) JOIN shares USING (query_id), probes WHERE query_id % 100 = 0 GROUP BY query_id, probes""")
def ivf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at a number of probes calibrated on other vectors to hold 95 % of their exact neighbours."""
    v = _vectors(spark, sf_dir)
    index, asked = ann.build(v), _probes(v)
    others = v.filter("rowid % 100 = 50").select(F.col("rowid").alias("query_id"), "vector")
    probes = ann.calibrated(index, v, others, 10, 0.95)
    q = dense.ann_quality(dense.top_k(v, asked, 10), ann.search(index, asked, 10, probes)).join(ann.scanned(index, asked, probes), "query_id")
    return q.select("query_id", "recall", "overlap", F.lit(probes).alias("probes"), F.round("scanned_share", 9).alias("scanned_share"))


@query("""SELECT vec_id AS rowid, len(embedding) AS dimension, md5(array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000)::BIGINT), ',')) AS vector_md5 FROM embeddings""")
def segment_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors through segments, a migration and back; each block is a partition that checks its own hash."""
    folder = scratch.folder(spark)
    segments.written(_vectors(spark, sf_dir), f"{folder}/first", profile="driver", generation="1")
    segments.migrated(spark, f"{folder}/first", f"{folder}/second", blockRows="512")
    back = segments.read(spark, f"{folder}/second", profile="driver", generation="1")
    digits = F.transform("vector", lambda x: F.floor(x.cast("double") * 1000000).cast("string"))
    return back.select("rowid", F.size("vector").cast("long").alias("dimension"), F.md5(F.array_join(digits, ",")).alias("vector_md5"))


@query(f"""WITH {TURNS}, seeds AS (SELECT session::BIGINT AS query_id, rowid, session, ord, row_number() OVER (PARTITION BY session ORDER BY length(text) DESC, ord) AS rank FROM turns QUALIFY rank <= 2),
    around AS (SELECT s.query_id, t.rowid, min(row(s.rank, (t.rowid <> s.rowid)::INTEGER, abs(t.ord - s.ord), t.ord, t.rowid)) AS o
               FROM seeds s JOIN turns t ON s.session = t.session AND abs(t.ord - s.ord) <= 1 GROUP BY ALL)
    SELECT query_id, rowid, (row_number() OVER (PARTITION BY query_id ORDER BY o))::INTEGER AS rank FROM around""")
def neighbors_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir)
    w = Window.partitionBy("session").orderBy(F.desc(F.char_length("text")), "ord")
    seeds = t.select(F.col("session").cast("long").alias("query_id"), "rowid", F.row_number().over(w).alias("rank")).filter("rank <= 2")
    return ranking.neighbours(seeds, t, 1)


BLOCK = """'[source {"id": "' || id || '", "speaker": "' || speaker || '", "date": "' || "timestamp" || '"}]' || chr(10) || text"""
PACK = """list_reduce(list({{'u': strlen(block)::BIGINT, 'ids': [id], 'n': 0}} ORDER BY rank), lambda a, x:
    CASE WHEN a.u + x.u + (CASE WHEN a.n > 0 THEN 2 ELSE 0 END) <= {budget}
         THEN {{'u': a.u + x.u + (CASE WHEN a.n > 0 THEN 2 ELSE 0 END), 'ids': a.ids || x.ids, 'n': a.n + 1}} ELSE a END,
    {{'u': 0::BIGINT, 'ids': []::VARCHAR[], 'n': 0}})"""


@query(f"""WITH {TURNS}, blocks AS (SELECT session::BIGINT AS query_id, id, ord AS rank, {BLOCK} AS block FROM turns),
    p AS (SELECT query_id, {PACK.format(budget=600)} AS p FROM blocks GROUP BY query_id)
    SELECT query_id, list_aggregate(p.ids, 'string_agg', ',') AS selected, p.u AS budget_used FROM p""")
def pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.turns(spark, sf_dir).withColumn("query_id", F.col("session").cast("long")).withColumn("rank", F.col("ord"))
    p = ranking.pack(rows, 600)
    return p.select("query_id", F.when(F.size("selected_ids") > 0, F.array_join("selected_ids", ",")).alias("selected"), "budget_used")


HELD = "gold AS (SELECT item_id AS query_id, doc_id::VARCHAR AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {HELD} SELECT * FROM gold")
def gold_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gold(D.articles(spark, sf_dir), D.questions(spark, sf_dir))


@query()
def recall_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, q = D.turns(spark, sf_dir), D.questions(spark, sf_dir).withColumn("scope", F.lit("conv"))
    return R.recall(t, q, "sparse", 600, reach=1).select("query_id", F.array_join("selected_ids", ",").alias("selected"), "budget_used")


def _recall_text(spark: SparkSession, sf_dir: str, mode: str, reach: int) -> DataFrame:
    """Recall by SQL text over two views, with the table functions; questions in blocks of about BLOCK_QUESTIONS, each a pass over the dealt tokens."""
    table_functions.register(spark)
    turns, questions = D.turns(spark, sf_dir), D.questions(spark, sf_dir)
    turns.createOrReplaceTempView("kelpie_turns")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns.count() // table_functions.TASK_DOCS + 1)
    blocks = max(1, -(-questions.count() // table_functions.BLOCK_QUESTIONS))
    found = []
    for i in range(blocks):
        questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).createOrReplaceTempView("kelpie_questions")
        found.append(spark.sql(table_functions.recall_sql("kelpie_turns", "kelpie_questions", mode, 600, reach=reach, parts=parts)))
    return functools.reduce(DataFrame.union, found).select("query_id", F.array_join("selected_ids", ",").alias("selected"), "budget_used")


@query(f"""WITH {TURNS}, metas AS (SELECT *, speaker || ' ' || "timestamp" AS meta FROM turns), raw AS (SELECT item_id AS query_id, {TERMS.replace('{0}', 'text')}[:64] AS ts FROM benchmark),
    queries AS (SELECT query_id, unnest(ts) AS term FROM raw), {bm25_sql('metas', 'queries', {'text': 1.0, 'meta': 0.0}, 100)},
    fused AS (SELECT query_id, rowid, round(1.0 / (60 + rank), 12) AS s FROM ranked),
    blocks AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rowid) AS rank, {BLOCK} AS block FROM fused JOIN turns USING (rowid)),
    p AS (SELECT query_id, {PACK.format(budget=600)} AS p FROM blocks GROUP BY query_id)
    SELECT query_id, coalesce(list_aggregate(p.ids, 'string_agg', ','), '') AS selected, p.u AS budget_used FROM p""")
def recall_literal_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall_text(spark, sf_dir, "literal", 0)


@query()
def recall_sparse_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``recall_sparse``, from SQL text alone."""
    return _recall_text(spark, sf_dir, "sparse", 1)


@query()
def entity_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir)
    rows = t.withColumn("query_id", F.col("session").cast("long")).withColumn("rank", F.col("ord") + 1)
    q = rows.select("query_id").distinct().withColumn("query", F.lit("what did the assistant say about BUG-42"))
    return ranking.entity_reorder(rows, q)


@query(f"""WITH {TURNS}, named AS (SELECT rowid, unnest(list_distinct([speaker, source, id] || regexp_extract_all(text, '\\b[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)+\\b'))) AS locator FROM turns),
    q AS (SELECT DISTINCT conv_id AS query_id, 'who said conversation:' || conv_id || ' and ' || conv_id || ':0 first' AS query FROM conversations),
    hits AS (SELECT DISTINCT query_id, rowid FROM q JOIN named ON locator <> '' AND regexp_matches(query, '(?:^|[^0-9A-Za-z_])' || regexp_escape(locator) || '(?:$|[^0-9A-Za-z_])', 'i'))
    SELECT query_id, rowid, (row_number() OVER (PARTITION BY query_id ORDER BY rowid))::INTEGER AS rank FROM hits QUALIFY rank <= 100""")
def alias_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir)
    q = t.select(F.col("session").cast("long").alias("query_id")).distinct()
    q = q.withColumn("query", F.format_string("who said conversation:%d and %d:0 first", "query_id", "query_id"))
    return ranking.alias_channel(t, q)


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir)
    return t.withColumn("timestamp", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("session").cast("int") * 7 + F.col("ord") * 11) % 300).cast("int")), "yyyy-MM-dd"))


@query(f"""WITH {TURNS}, dated AS (SELECT *, DATE '2024-01-01' + ((session::INTEGER * 7 + ord * 11) % 300)::INTEGER AS day, session::BIGINT AS query_id, ord + 1 AS rank FROM turns),
    words AS (SELECT rowid, regexp_extract_all(text, '{TERM}') AS w FROM dated),
    scored AS (SELECT query_id, d.rowid, rank, list_has_any(list_transform(w, lambda x: lower(x)), ['user', 'happened', 'after', '2024', '2024-05']) AS lexical,
                      (day > DATE '2024-05-31')::INTEGER AS after FROM dated d JOIN words USING (rowid))
    SELECT query_id, rowid, (row_number() OVER (PARTITION BY query_id ORDER BY lexical::INTEGER DESC, CASE WHEN lexical THEN after ELSE 0 END DESC, rank))::INTEGER AS rank FROM scored""")
def temporal_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dated(spark, sf_dir).withColumn("query_id", F.col("session").cast("long")).withColumn("rank", F.col("ord") + 1)
    q = rows.select("query_id").distinct().withColumn("query", F.lit("what happened after 2024-05"))
    return ranking.temporal_reorder(rows, q).select("query_id", "rowid", "rank")


@query()
def association_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir)
    seeds = t.filter("ord = 0").select(F.col("session").cast("long").alias("query_id"), "rowid", F.lit(1).alias("rank"))
    return ranking.associations(seeds, t)


@query()
def segment_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.turns(spark, sf_dir).withColumn("query_id", F.col("session").cast("long")).withColumn("rank", F.col("ord"))
    q = rows.select("query_id", F.lit("the of and with la der en de que").alias("query")).distinct()
    return ranking.pack_segments(rows, q, 600).select("query_id", "id", "n", "complete", F.octet_length("segment").alias("n_bytes"))


@query(f"""WITH {TURNS}, new AS (SELECT id, session, ord, reverse(text) AS text FROM turns WHERE session::INTEGER % 2 = 0)
    SELECT session, id, md5(text) AS text_md5 FROM turns WHERE session::INTEGER % 2 <> 0 UNION ALL SELECT session, id, md5(text) FROM new""")
def scope_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir).withColumn("scope", F.col("session"))
    new = t.filter(F.col("session").cast("int") % 2 == 0).withColumn("text", F.reverse("text"))
    return store.replace_scope(t, new).select("session", "id", F.md5("text").alias("text_md5"))


@query(f"""WITH {TURNS} SELECT id, source FROM turns WHERE NOT starts_with(source, 'conversation:1') UNION ALL
    SELECT id || '+' AS id, source FROM turns WHERE starts_with(source, 'conversation:1')""")
def sync_kind_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir).select("id", "source")
    new = t.filter(F.col("source").startswith("conversation:1")).withColumn("id", F.concat("id", F.lit("+")))
    return store.sync_kind(t, new, "conversation:1")


@query(f"""WITH {TURNS} SELECT id, sha256(text) AS hash FROM turns WHERE speaker <> 'user'""")
def anti_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir).withColumn("hash", F.sha2("text", 256))
    return dense.missing_vectors(t, t.filter("speaker = 'user'")).select("id", "hash")


@query("""SELECT count(*) AS inputs, (count(*) - count(DISTINCT text)) AS duplicates,
    (sum(strlen(text)) - (SELECT sum(strlen(text)) FROM (SELECT DISTINCT text FROM documents)))::BIGINT AS bytes_avoided,
    (count(*) - count(DISTINCT text)) / count(*) AS duplicate_share FROM documents""")
def reuse_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import evaluate

    return evaluate.reuse_census(D.table(spark, sf_dir, "documents"))
