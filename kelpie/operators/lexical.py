"""BM25 over weighted columns with phrase terms, as joins and aggregations of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources import scratch

#: Digits of a score that count in ranking; sums of doubles depend on their order beyond these.
DIGITS = 9


def context_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of the previous and next row of its session, and a line of speaker and time."""
    w = Window.partitionBy("scope", "session").orderBy("ord", "id")
    near = F.concat_ws(" ", F.lag("text").over(w), F.lead("text").over(w))
    return docs.withColumn("context", near).withColumn("meta", F.concat(F.col("speaker"), F.lit(" "), F.col("timestamp")))


def speaker_terms(docs: DataFrame) -> DataFrame:
    """(scope, speaker_terms): the terms of all speakers of a scope, sorted."""
    names = docs.select("scope", "speaker").distinct()
    return names.select("scope", F.explode(X.terms(F.col("speaker"))).alias("t")).groupBy("scope").agg(F.array_sort(F.collect_set("t")).alias("speaker_terms"))


def focus_terms(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``queries`` with ``tokens`` (first 64 terms), ``content`` (without stop words) and ``focus`` (and without speakers)."""
    tokens = F.slice(X.terms(F.col("query")), 1, 64)
    q = queries.withColumn("tokens", tokens).withColumn("content", F.array_except("tokens", F.array(*map(F.lit, X.STOP))))
    q = q.join(speaker_terms(docs), "scope", "left")
    focus = F.array_except("content", F.coalesce("speaker_terms", F.array().cast("array<string>")))
    return q.withColumn("focus", F.when(F.size(focus) > 0, focus).otherwise(F.col("content"))).drop("speaker_terms")


#: Queries that one pass over the texts answers, and (document, query) pairs that are scored and tokens that are counted at once.
BLOCK_QUERIES, PAIRS, TOKENS = 4096, 1 << 18, 1 << 19


def bm25_channels(
    docs: DataFrame, queries: DataFrame, columns: list[str], channels: dict[str, tuple[str, list[float]]], k: int = 100, stem: bool = False, idf_scope: str = "corpus"
) -> DataFrame:
    """(channel, query_id, rowid, id, score, rank): the ``k`` best documents of each query's scope, by channel.

    A channel is (column of ``queries`` with its terms, weight of each of ``columns``); ``queries`` has (query_id, scope, terms).
    Each term is a phrase of one or more tokens. A phrase's document frequency counts rows with it in any column, a row's length
    all its tokens; ``idf_scope`` is ``corpus`` or ``scope``.

    Queries go to all tasks in blocks of BLOCK_QUERIES. For a block, one pass over the texts makes a table of postings, a row a
    document with the numbers and counts of the asked phrases that it has; document frequencies and average lengths come from it,
    and a pass over it scores documents where they are and moves the ``k`` best of each task. Texts and postings don't move.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = None
    for name, (terms_col, _) in channels.items():
        one = queries.select(F.lit(name).alias("channel"), "query_id", "scope", F.explode(terms_col).alias("phrase"))
        asked = one if asked is None else asked.union(one)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    best = None
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).distinct()
        found = _block(docs, block, columns, {n: w for n, (_, w) in channels.items()}, k, stem, idf_scope, kind)
        best = found if best is None else best.union(found)
    w = Window.partitionBy("channel", "query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Phrases:
    """The asked phrases as token numbers, and who asks for them."""

    def __init__(self, rows: list, parts: dict[str, list[str]]):
        kept = sorted({r.phrase for r in rows if parts[r.phrase]})
        self.number = {p: n for n, p in enumerate(kept)}
        self.tokens = sorted({t for p in kept for t in parts[p]})
        at = {t: n for n, t in enumerate(self.tokens)}
        self.words = [[] for _ in self.tokens]  # numbers of the one-token phrases of each token
        self.longer = []  # (number, tokens) of the others
        for p, n in self.number.items():
            ids = [at[t] for t in parts[p]]
            if len(ids) == 1:
                self.words[ids[0]].append(n)
            else:
                self.longer.append((n, ids))
        # A column for each channel and query, and for each phrase the columns that ask for it.
        self.columns = sorted({(r.channel, r.query_id, r.scope) for r in rows}, key=str)
        column = {c: n for n, c in enumerate(self.columns)}
        pairs = sorted({(self.number[r.phrase], column[r.channel, r.query_id, r.scope]) for r in rows if r.phrase in self.number})
        self.asking = np.array([c for _, c in pairs], np.int64)
        self.begin = np.searchsorted(np.array([p for p, _ in pairs], np.int64), np.arange(len(kept) + 1))

    def counted(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, count) of the phrases in token numbers ``ids`` (-1 for others) of ``row``."""
        known = np.flatnonzero(ids >= 0)
        rows, phrases = [row[known]], [self._first[ids[known]]]
        for n in self._twice:  # tokens that several phrases mean, such as two forms of one stem
            at = np.flatnonzero(ids == n)
            for p in self.words[n][1:]:
                rows.append(row[at])
                phrases.append(np.full(len(at), p))
        if self.longer:
            order = np.argsort(ids, kind="stable")
            ordered = ids[order]
            for p, tokens in self.longer:
                starts = order[np.searchsorted(ordered, tokens[0]) : np.searchsorted(ordered, tokens[0], side="right")]
                starts = starts[starts + len(tokens) <= len(ids)]
                for k, t in enumerate(tokens[1:], 1):
                    starts = starts[(ids[starts + k] == t) & (row[starts + k] == row[starts])]
                rows.append(row[starts])
                phrases.append(np.full(len(starts), p))
        r, p = np.concatenate(rows), np.concatenate(phrases)
        r, p = r[p >= 0], p[p >= 0]
        keys, counts = np.unique(r * len(self.number) + p, return_counts=True) if len(r) else (np.empty(0, np.int64),) * 2
        return keys // max(1, len(self.number)), keys % max(1, len(self.number)), counts

    def ready(self) -> Phrases:
        self._first = np.array([w[0] if w else -1 for w in self.words] or [-1], np.int64)
        self._twice = [n for n, w in enumerate(self.words) if len(w) > 1]
        return self


def _pieces(batch: pa.RecordBatch, first: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about TOKENS tokens in the columns from ``first``; a longer row stands alone."""
    size = sum(np.diff(batch.column(c).offsets.to_numpy()).astype(np.int64) for c in range(first, batch.num_columns))
    ends = np.cumsum(size)
    a = 0
    while a < batch.num_rows:
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + TOKENS, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _postings(asked: Phrases, n_columns: int, stem: bool):
    """rowid, id, scope, length and, for each phrase found, its number and its count in each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        asked.ready()
        known, value_set = {}, pa.array(asked.tokens, pa.string())
        for batch in (piece for b in batches for piece in _pieces(b, 3)):
            length, found = np.zeros(batch.num_rows, np.int64), []
            for c in range(n_columns):
                lists = batch.column(3 + c)
                sizes = np.diff(lists.offsets.to_numpy())
                length += sizes
                words = lists.flatten()
                if stem:
                    coded = words.dictionary_encode()
                    fresh = [w for w in coded.dictionary.to_pylist() if w not in known]
                    if len(known) + len(fresh) > 500_000:
                        known.clear()
                        fresh = coded.dictionary.to_pylist()
                    known |= {w: X.porter(w) for w in fresh}
                    stems = pc.index_in(pa.array([known[w] for w in coded.dictionary.to_pylist()], pa.string()), value_set=value_set)
                    ids = pc.fill_null(stems, -1).to_numpy().astype(np.int64)[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
                else:
                    ids = pc.fill_null(pc.index_in(words, value_set=value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                found.append(asked.counted(ids, np.repeat(np.arange(batch.num_rows), sizes)))
            keys = [r * max(1, len(asked.number)) + p for r, p, _ in found]
            every = np.unique(np.concatenate(keys))
            counts = np.zeros((n_columns, len(every)), np.int32)
            for c, (key, (_, _, n)) in enumerate(zip(keys, found, strict=True)):
                counts[c, np.searchsorted(every, key)] = n
            begin = np.searchsorted(every, np.arange(batch.num_rows + 1) * max(1, len(asked.number))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(v.astype(np.int32))) for v in (every % max(1, len(asked.number)), *counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(length), *lists], names=["rowid", "id", "scope", "length", "phrases", *(f"n{c}" for c in range(n_columns))])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scope, phrase, n) summed over a task."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        scopes, lists = b.column(0).to_pylist(), b.column(1)
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        for scope in set(scopes):
            rows = np.array([s == scope for s in scopes])
            own = flat[np.repeat(rows, np.diff(ends))] if len(flat) == ends[-1] - ends[0] and ends[0] == 0 else np.concatenate([flat[ends[k] : ends[k + 1]] for k in np.flatnonzero(rows)])
            counts = np.bincount(own)
            old = total.get(scope, np.zeros(0, np.int64))
            if len(old) < len(counts):
                old, counts = counts, old
            old = old.copy()
            old[: len(counts)] += counts
            total[scope] = old
    for scope, n in total.items():
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([scope] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], names=["scope", "phrase", "n"])


def _scored(asked: Phrases, weights: dict[str, list[float]], stats: dict, k: int, kind: str):
    """The ``k`` best documents of a task for each channel and query, by score and then by id."""
    n_columns, n_asking = len(next(iter(weights.values()))), np.diff(asked.begin)
    names = sorted(weights)
    channel_of = np.array([names.index(c) for c, _, _ in asked.columns], np.int64)
    weight = np.array([weights[n] for n in names])
    wanted = {s: np.array([c[2] == s for c in asked.columns]) for s in {c[2] for c in asked.columns}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        ids_type = None
        for batch in batches:
            ids_type = (batch.schema.field("rowid").type, batch.schema.field("id").type)
            rowids, ids, scopes, length = batch.column("rowid").to_pylist(), batch.column("id").to_pylist(), batch.column("scope").to_pylist(), batch.column("length").to_numpy()
            offsets, phrases = batch.column("phrases").offsets.to_numpy(), batch.column("phrases").values.to_numpy().astype(np.int64)
            counts = np.stack([batch.column(f"n{c}").values.to_numpy() for c in range(n_columns)]) if len(phrases) else np.zeros((n_columns, 0))
            pairs = np.append(0, np.cumsum(n_asking[phrases]))[offsets]
            by_id = sorted(range(len(ids)), key=ids.__getitem__)
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            a = 0
            while a < len(ids):
                room = min(pairs[a] + PAIRS, pairs[-1])
                b = max(a + 1, min(int(np.searchsorted(pairs, room, side="right")) - 1, a + max(1, PAIRS // max(1, len(asked.columns))), len(ids)))
                at = slice(offsets[a], offsets[b])
                doc = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                own, n = phrases[at], n_asking[phrases[at]]
                which = np.repeat(np.arange(len(own)), n)
                column = asked.asking[np.repeat(asked.begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                inside = np.zeros(len(which), bool)
                row_scope = [scopes[x] for x in range(a, b)]
                for scope, cols in wanted.items():
                    inside |= np.array([s == scope for s in row_scope])[doc[which]] & cols[column]
                which, column = which[inside], column[inside]
                idf = np.array([stats["idf"].get(None if stats["whole"] else s, stats["none"]) for s in row_scope])[doc[which], own[which]]
                average = np.array([stats["length"].get(None if stats["whole"] else s, 1.0) for s in row_scope])
                f = (weight[channel_of[column]].T * counts[:, at][:, which]).sum(axis=0)
                part = idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[a:b][doc[which]] / average[doc[which]]))
                cell = doc[which] * len(asked.columns) + column
                size = (b - a) * len(asked.columns)
                score, seen = np.bincount(cell, part, size), np.bincount(cell, minlength=size) > 0
                cells = np.flatnonzero(seen)
                d, c, s = cells // len(asked.columns), cells % len(asked.columns), np.round(score[cells], DIGITS)
                order = np.lexsort((place[a:b][d], -s, c))
                d, c, s = d[order], c[order], s[order]
                first = np.searchsorted(c, c)
                best = np.arange(len(c)) - first < k
                kept += [(int(x), float(y), ids[a + z], rowids[a + z]) for x, y, z in zip(c[best], s[best], d[best], strict=True)]
                a = b
            if len(kept) > 4 * k * max(1, len(asked.columns)):
                kept = _pruned(kept, k)
        kept = _pruned(kept, k)
        if kept:
            columns = [asked.columns[c] for c, *_ in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[0] for c in columns], pa.string()), pa.array([c[1] for c in columns], pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()), pa.array([x[3] for x in kept], ids_type[0]), pa.array([x[2] for x in kept], ids_type[1]), pa.array([x[1] for x in kept], pa.float64())],
                names=["channel", "query_id", "rowid", "id", "score"],
            )

    return run


def _pruned(rows: list[tuple], k: int) -> list[tuple]:
    rows.sort(key=lambda x: (x[0], -x[1], x[2]))
    out, column, n = [], None, 0
    for r in rows:
        column, n = (column, n + 1) if r[0] == column else (r[0], 1)
        if n <= k:
            out.append(r)
    return out


def _block(docs: DataFrame, asked: DataFrame, columns: list[str], weights: dict[str, list[float]], k: int, stem: bool, idf_scope: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    id_type = docs.schema["id"].dataType.simpleString()
    row_type = docs.schema["rowid"].dataType.simpleString()
    out = f"channel string, query_id {kind}, rowid {row_type}, id {id_type}, score double"
    rows = asked.collect()  # the terms of at most BLOCK_QUERIES queries
    split = asked.select("phrase").distinct().select("phrase", X.word_tokens(F.col("phrase")).alias("p")).collect() if rows else []
    phrases = Phrases(rows, {r.phrase: [X.porter(t) for t in r.p] if stem else list(r.p) for r in split})
    if not phrases.number:
        return spark.createDataFrame([], out)
    tokens = docs.select("rowid", "id", "scope", *(X.word_tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)))
    lists = ", ".join(f"n{i} array<int>" for i in range(len(columns)))
    posts = scratch.written(tokens.mapInArrow(_postings(phrases, len(columns), stem), f"rowid {row_type}, id {id_type}, scope string, length bigint, phrases array<int>, {lists}"), "postings")
    whole = idf_scope == "corpus"
    asking = sorted({r.scope for r in rows if r.scope is not None})
    lengths = posts.groupBy("scope").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    seen = posts.select("scope", "phrases").mapInArrow(_frequencies, "scope string, phrase int, n bigint")
    if whole:
        size = [(None, *lengths.agg(F.sum("n"), F.sum("length")).first())]
        df = [(None, r.phrase, r.n) for r in seen.groupBy("phrase").agg(F.sum("n").alias("n")).collect()]  # one row a phrase
    else:
        own = F.col("scope").isin(asking)
        size = [tuple(r) for r in lengths.filter(own).collect()]  # scopes that the block asks for
        df = [tuple(r) for r in seen.filter(own).groupBy("scope", "phrase").agg(F.sum("n").alias("n")).collect()]
    n_rows = {s: n for s, n, _ in size}
    idf = {s: np.full(len(phrases.number), 1e-6) for s in n_rows}
    for s, phrase, n in df:
        ratio = np.log((n_rows[s] - n + 0.5) / (n + 0.5))
        idf[s][phrase] = ratio if ratio > 0 else 1e-6
    stats = {"whole": whole, "idf": idf, "none": np.full(len(phrases.number), 1e-6), "length": {s: (length or 0) / n if n and length else 1.0 for s, n, length in size}}
    return posts.filter(F.size("phrases") > 0).mapInArrow(_scored(phrases, weights, stats, k, kind), out)


def bm25(docs: DataFrame, queries: DataFrame, columns: list[tuple[str, float]], terms_col: str, k: int = 100, stem: bool = False, idf_scope: str = "corpus") -> DataFrame:
    """(query_id, rowid, id, score, rank): ``bm25_channels`` of one channel; ``columns`` are (name, weight)."""
    return bm25_channels(docs, queries, [c for c, _ in columns], {"": (terms_col, [w for _, w in columns])}, k, stem, idf_scope).drop("channel")


def channels(docs: DataFrame, queries: DataFrame, mode: str, k: int = 100, stem: bool = True) -> DataFrame:
    """(query_id, channel, rowid, id, rank) of the lexical channels of a mode: literal one, sparse and hybrid two, dense none."""
    q = focus_terms(queries, docs)
    if mode == "literal":
        return bm25_channels(docs.withColumn("meta", F.concat_ws(" ", "speaker", "timestamp")), q, ["text", "meta"], {"literal": ("tokens", [1.0, 0.0])}, k)
    rich = context_columns(docs).withColumn("body", X.index_text(F.col("text")))
    return bm25_channels(rich, q, ["body", "context", "meta"], {"focus": ("focus", [1.0, 0.0, 0.02]), "context": ("content", [1.0, 0.12, 0.05])}, k, stem)
