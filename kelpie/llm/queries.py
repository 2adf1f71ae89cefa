"""The registered queries of the training-data operators, over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard, license_scan, merkle, minhash, packing, pii, quantizer, resampling, sharding, substrings, toxicity

#: The key of the registered queries; a production run passes its own secret.
PII_KEY = "registered-query"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def packed(docs: DataFrame) -> DataFrame:
    added = packing.added_tokens(tokenizer("byte_bpe_50k.json")[0])
    return packing.pack(docs, *tokenizer("byte_bpe_50k.tiktoken"), added=added)


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return merkle.fixity(pages, merkle.damaged(pages))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_docs(spark, sf_dir))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("values", lambda v: v["kind"] == kind)).alias(f"n_{kind}")

    return pii.findings(_docs(spark, sf_dir), PII_KEY).select("doc_id", "text", "n_values", *map(count, pii.KINDS))


def toxicity_weights(spark: SparkSession, docs: DataFrame, sf_dir: str):
    return toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.scores(docs, toxicity_weights(spark, docs, sf_dir))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(_docs(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir)).drop("spans")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.uniform_shards(_docs(spark, sf_dir))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_docs(spark, sf_dir), *tokenizer("byte_bpe_50k.tiktoken"), full=False)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(_docs(spark, sf_dir))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizer.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_merkle_fixity, op2_exact_dedup, op3_best_fit_packing, op4_pii_pseudonyms, op5_toxicity, op6_ngram_jaccard, op7_license_scan, op8_sharding, op9_bpe_codec, op10_fingerprints, op11_substring_dedup, op12_importance_resampling, op13_heap_lloyd)
}

def _merkle_sql(replica: str) -> str:
    """The root over up to 64 ** 4 places."""
    return f"""(SELECT CASE WHEN (SELECT count(*) FROM place) <= 64 THEN (SELECT any_value(d) FROM {replica}1)
                WHEN (SELECT count(*) FROM place) <= 4096 THEN (SELECT any_value(d) FROM {replica}2)
                WHEN (SELECT count(*) FROM place) <= 262144 THEN (SELECT any_value(d) FROM {replica}3) ELSE (SELECT any_value(d) FROM {replica}4) END)"""


def _levels_sql(replica: str, leaves: str) -> str:
    up = "SELECT n // 64 AS n, min(o) AS o, sum(l)::BIGINT AS l, sha256(string_agg(o || ':' || l || ':' || d, chr(10) ORDER BY n)) AS d FROM {} GROUP BY n // 64"
    return ", ".join(f"{replica}{k} AS ({up.format(leaves if k == 1 else f'{replica}{k - 1}')})" for k in (1, 2, 3, 4))


_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)
    || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10)"""

def _license_sql() -> str:
    phrases = [(p, label, True) for p, label in license_scan.BASE] + [(p, label, False) for p, label in license_scan.TEMPLATES]
    values = ", ".join(f"({i}, '{p}', '{label}', {base})" for i, (p, label, base) in enumerate(phrases))
    return rf"""
        WITH t AS (SELECT template, label, base, string_split(phrase, ' ') AS w FROM (VALUES {values}) v(template, phrase, label, base)),
        tg AS (SELECT template, label, base, len(w) AS n, i - 1 AS tpos, w[i:i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t)),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        dg AS (SELECT doc_id, i - 1 AS pos, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
        votes AS (SELECT doc_id, template, label, base, n, pos - tpos AS diagonal, list(DISTINCT tpos) AS places FROM dg JOIN tg USING (g) GROUP BY ALL),
        marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {license_scan.SLACK} THEN 0 ELSE 1 END AS new FROM votes),
        spanned AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
        covered AS (SELECT doc_id, label, base, count(DISTINCT p + k) / any_value(n) AS score
                    FROM (SELECT *, unnest(places) AS p FROM spanned), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id, template, label, base, span),
        whole AS (SELECT doc_id, label, diagonal FROM votes WHERE base AND len(places) = n - 2),
        named AS (SELECT doc_id, label FROM whole UNION SELECT doc_id, label FROM covered WHERE NOT base AND score >= {license_scan.THRESHOLD}),
        a AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM whole GROUP BY ALL),
        b AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named GROUP BY ALL),
        c AS (SELECT doc_id, max(score) AS score FROM covered GROUP BY ALL)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""


def _resampling_sql() -> str:
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
        WITH crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: {bit}) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
        d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
        dw AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
        bw AS (SELECT word, count(*) AS n FROM (SELECT unnest({words}) AS word FROM benchmark) GROUP BY ALL),
        bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b
                  FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
        bucketed AS MATERIALIZED (
            SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) % {resampling.BUCKETS} AS bucket
            FROM bytes, crc),
        s AS (SELECT bucket, sum(n) AS s FROM dw JOIN bucketed USING (word) GROUP BY ALL),
        t AS (SELECT bucket, sum(n) AS t FROM bw JOIN bucketed USING (word) GROUP BY ALL),
        g AS MATERIALIZED (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {resampling.BUCKETS})::DOUBLE
                   / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
        w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN bucketed USING (word) JOIN g USING (bucket) GROUP BY ALL),
        scored AS (
            SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM d LEFT JOIN w USING (doc_id)),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {resampling.LEAST_WORDS})
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= {resampling.PERCENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""


def _lloyd_sql() -> str:
    """Lloyd's rounds over all entries of each part."""
    parts, entries, rounds = quantizer.PARTS, quantizer.ENTRIES, quantizer.ROUNDS

    def near(k: int) -> str:
        d = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"""a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({{'d': {d}, 'e': e}}) AS best FROM x JOIN c{k} USING (p) GROUP BY vec_id, p)"""

    def moved(k: int) -> str:
        return f"""m{k} AS (SELECT p, e, list(mean ORDER BY i) AS c FROM (
                SELECT p, e, i, floor(sum(v) / count(*))::BIGINT AS mean FROM (SELECT p, best.e AS e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL),
            c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))"""

    steps = ", ".join(f"{near(k)}, {moved(k)}" for k in range(rounds))
    return f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor({quantizer.SCALE} * v::DOUBLE)::BIGINT) AS v FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        x AS MATERIALIZED (SELECT vec_id, p, v[p * w + 1:(p + 1) * w] AS x FROM (SELECT vec_id, v, len(v) // {parts} AS w, unnest(range({parts})) AS p FROM kept)),
        c0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}) USING (vec_id)),
        {steps}, {near(rounds)},
        coded AS (SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL),
        book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (vec_id), book"""


ORACLE_SQL = {
    "op1_merkle_fixity": f"""
        WITH p AS (SELECT page_id, url, substr(md5(coalesce(url, '')), 1, 2) AS mark, coalesce(html, '') AS html FROM pages),
        first AS (
            SELECT page_id, sha256({_RECORD.replace('body', 'html')}) AS d, strlen({_RECORD.replace('body', 'html')}) AS l, row_number() OVER (PARTITION BY page_id ORDER BY d) AS nth FROM p),
        copy AS (
            SELECT page_id, sha256({_RECORD}) AS d, strlen({_RECORD}) AS l
            FROM (SELECT page_id, url, CASE WHEN mark = '07' THEN '?' || substr(html, 2) ELSE html END AS body FROM p, (SELECT unnest([1, 2]) AS time) WHERE mark <> '0f' AND (time = 1 OR mark = '0b'))),
        second AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY d) AS nth FROM copy),
        place AS (
            SELECT coalesce(f.page_id, s.page_id) AS page_id, f.d, f.l, s.d AS rd, s.l AS rl, row_number() OVER w - 1 AS n, (sum(coalesce(f.l, 0)) OVER w - coalesce(f.l, 0))::BIGINT AS o
            FROM first f FULL JOIN second s ON f.page_id IS NOT DISTINCT FROM s.page_id AND f.nth = s.nth
            WINDOW w AS (ORDER BY coalesce(f.page_id, s.page_id) NULLS FIRST, coalesce(f.nth, s.nth) ROWS UNBOUNDED PRECEDING)),
        a AS (SELECT n, o, coalesce(l, 0) AS l, coalesce(d, '') AS d FROM place), b AS (SELECT n, o, coalesce(rl, 0) AS l, coalesce(rd, '') AS d FROM place),
        {_levels_sql('a', 'a')}, {_levels_sql('b', 'b')}
        SELECT page_id, o AS "offset", coalesce(l, rl)::BIGINT AS length, coalesce(d, rd) AS record_sha256,
               (n // 64)::BIGINT AS range_id, CASE WHEN rd IS NULL THEN 'missing' WHEN d IS NULL THEN 'extra' WHEN d <> rd THEN 'altered' ELSE 'ok' END AS status,
               {_merkle_sql('a')} AS root_sha256, {_merkle_sql('b')} AS replica_root_sha256
        FROM place""",
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
        reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON r.other = l.x)
        SELECT doc_id, n AS n_shingles, (SELECT min(other) FROM reached r WHERE r.doc_id = s.doc_id) AS component_id FROM sizes s""",
    "op7_license_scan": _license_sql(),
    "op11_substring_dedup": rf"""
        WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        starts AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + {substrings.WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substrings.WINDOW - 2})) AS i FROM d)),
        twice AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + {substrings.WINDOW})) AS j FROM starts SEMI JOIN twice USING (h)) GROUP BY ALL),
        kept AS MATERIALIZED (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
                 CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END AS left_over
                 FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(left_over, ' '), '')) AS kept_sha256 FROM kept""",
    "op12_importance_resampling": _resampling_sql(),
    "op13_heap_lloyd": _lloyd_sql(),
}
