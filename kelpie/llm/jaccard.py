"""Jaccard join on five-word shingles by parity sketches; exact, with groups instead of all pairs.

Two sets of sizes n and m with 100 * |A & B| >= 80 * |A | B| differ in at most (n + m) / 9 tokens. A size band covers
[4**k, 4**(k+1)); in a band every token belongs to one of p blocks by its hash, and a block's sketch word is the XOR of the
hashes of its tokens (64 parity bits). A token that only one set has changes one block, so the number of blocks whose words
differ - the Hamming distance of the sketches over blocks - is a lower bound of the symmetric difference. By the
pigeonhole principle, with at most s differing words, the s + 1 first non-empty words of both sketches *in any order common
to all documents* share one. Each set is therefore joined on its s + 1 first words in its own band and, where a larger
partner may lie in the next band, on the first words under that band's blocks. The order puts words made of frequent
shingles last, so passages that many documents share make no large groups; which shingles count as frequent is read from a
sample of ``SAMPLE_DOCS`` documents and only affects speed.

Documents that share a word are compared with the smallest of them first; a bit sketch of two to four parities a token drops
pairs whose Hamming distance exceeds the bound, and the rest are verified on their whole shingle sets. Groups that then still
span several components make a second star around another member; in those open even after that, all members of different
components compare their bit sketches, in cells of at most 2 * ``CELL`` members, so a large group spreads over many tasks and
only pairs near enough to be verified become rows. No pair or partner is ever capped.

Edge cases: a null or empty text has no shingles and links with nothing; a text of fewer than five words is one shingle;
equal texts in a partition share one representative; repeated rows each get a result row; rows of one identifier with
different texts are one node, whose candidate pairs are compared by the sketch of one of these texts and verified by any; a row without an identifier is
linked with nothing and its component is null; an empty table gives an empty result; further columns are not read.
Identifiers are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, fresh, mark, settled, written
from .components import components
from .shingles import mix, shingle_sets, text_chunks

SAMPLE_DOCS = 12_000
#: A shingle in so many sampled documents is frequent; at most HOT_SHINGLES of them are broadcast (8 bytes each).
HOT_AT, HOT_SHINGLES = 4, 100_000
#: Members of a group that one cell takes from each of its two blocks.
CELL = 512
_U = np.uint64
_TOP = _U(1 << 63)


def band_of(n: int) -> int:
    return (n.bit_length() - 1) // 2


def blocks_of(band: int) -> int:
    """Blocks of a band: two tokens each at its largest size; for small sets practically a block for every token."""
    return 1 << 20 if band < 3 else 2 ** (2 * band + 1)


def emissions(n: int) -> list[tuple[int, int]]:
    """(band, words to emit) of a set of n tokens."""
    band = band_of(n)
    most, end = n * 5 // 4, 4 ** (band + 1)
    out = [(band, (n + min(most, end - 1)) // 9 + 1)]
    if most >= end:
        out.append((band + 1, (n + most) // 9 + 1))
    return out


def sketch_words(tokens: np.ndarray, band: int, count: int, hot: np.ndarray | None) -> np.ndarray:
    """The ``count`` first non-empty words of the block sketch; ``tokens`` are sorted."""
    block = (tokens >> _U(32)) * _U(blocks_of(band)) >> _U(32)
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    words = mix(np.bitwise_xor.reduceat(tokens, starts) + mix(block[starts] + _U(band + 1 << 40))) & ~_TOP
    if len(words) < count:
        raise RuntimeError("a sketch has fewer non-empty blocks than the pigeonhole needs")
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        words |= np.where(np.logical_and.reduceat(hot[at] == tokens, starts), _TOP, _U(0))
    return np.partition(words, count - 1)[:count] if count < len(words) else words


def parity_bits(tokens: np.ndarray) -> bytes:
    """One parity per hash bucket, of two to four buckets a token."""
    size = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    at = (mix(tokens) & _U(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two parity sketches, the longer one folded: a lower bound of the symmetric difference."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def sketch_prefix(hot: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The words that a set is joined on, over all its bands."""

    def words(tokens: np.ndarray) -> np.ndarray:
        return np.concatenate([sketch_words(tokens, band, count, hot) for band, count in emissions(len(tokens))])

    return words


def _signatures(words_of: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, texts in text_chunks(batch.column(1)):
                sig, owner, size, at, bits = [], [], [], [], []
                for doc, tokens in zip(ids[row : row + len(texts)], shingle_sets(texts), strict=True):
                    n, rep = len(tokens), int(doc)
                    if n:
                        rep = seen.setdefault(hashlib.md5(tokens.tobytes()).digest(), rep)
                    # The document's own row: doc_id, representative and -1 - size.
                    sig.append(np.array([doc], np.int64))
                    owner.append(rep)
                    size.append(-1 - n)
                    at.append(1)
                    bits.append(parity_bits(tokens) if n and rep == doc else None)
                    if n and rep == doc:
                        w = words_of(tokens)
                        sig.append(w.view(np.int64))
                        owner.append(rep)
                        size.append(n)
                        at.append(len(w))
                        bits.extend([None] * len(w))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sig)), pa.array(np.repeat(np.array(owner, np.int64), at)), pa.array(np.repeat(np.array(size, np.int32), at)), pa.array(bits, pa.binary())],
                    names=["sig", "id", "n", "bits"],
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, id): document rows, and a row for each further member of a word's group.

    Of rows with one identifier only one keeps its bit sketch.
    """
    last = None  # (sig, pivot, pivot's size, last id, rank of the last)
    sketched = None  # the last document with a bit sketch
    for batch in batches:
        sig, ids, n = (batch.column(k).to_numpy() for k in range(3))
        own = np.flatnonzero(n < 0)
        if len(own):
            m = len(own)
            bits = batch.column(3).take(pa.array(own))
            has = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False))
            if len(has):
                docs = sig[own][has]
                again = np.append(sketched == docs[0], docs[1:] == docs[:-1])
                sketched = docs[-1]
                if again.any():
                    drop = np.zeros(m, bool)
                    drop[has[again]] = True
                    bits = pc.if_else(pa.array(drop), pa.scalar(None, pa.binary()), bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[own]), pa.array(sig[own]), pa.array(ids[own]), pa.array(-1 - n[own], pa.int32()), pa.array(np.full(m, -1, np.int32)), pa.array(np.zeros(m, np.int32)), bits],
                names=["sig", "a", "b", "na", "nb", "rank", "bits"],
            )
        at = np.flatnonzero(n > 0)
        sig, ids, n = sig[at], ids[at], n[at]
        if not len(sig):
            continue
        keep = np.append(True, (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1]))
        if last and last[0] == sig[0] and last[3] == ids[0]:
            keep[0] = False
        sig, ids, n = sig[keep], ids[keep], n[keep]
        if not len(sig):
            continue
        new = np.append(not last or last[0] != sig[0], sig[1:] != sig[:-1])
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        carried = not new[0]
        if carried:
            group += 1
            starts = np.append(0, starts)
            pivots, sizes = np.append(last[1], ids[starts[1:]]), np.append(last[2], n[starts[1:]])
        else:
            pivots, sizes = ids[starts], n[starts]
        rank = np.arange(len(sig)) - starts[group]
        if carried:
            rank[group == 0] += last[4] + 1
        last = (sig[-1], int(pivots[-1]), int(sizes[-1]), ids[-1], int(rank[-1]))
        more = np.flatnonzero(rank > 0)
        if len(more):
            g = group[more]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[more]), pa.array(pivots[g].astype(np.int64)), pa.array(ids[more]), pa.array(sizes[g].astype(np.int32)), pa.array(n[more], pa.int32()), pa.array(rank[more].astype(np.int32)), pa.array([None] * len(more), pa.binary())],
                names=["sig", "a", "b", "na", "nb", "rank", "bits"],
            )


def _near_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bit sketches allow the similarity."""
    for batch in batches:
        most = ((batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()) // 9).tolist()
        x, y = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
        yield batch.select(["a", "b"]).filter(pa.array([apart(p, q) <= m for p, q, m in zip(x, y, most, strict=True)], pa.bool_()))


def near_in_cell(ids: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[bytes], first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (smaller id first) of a member of ``first`` and a member of ``second`` (positions) that sizes and sketches allow.

    Members of one component are no pair. Sketches of one size are compared at once; a longer one is folded first.
    """
    words = [np.frombuffer(b, dtype=np.uint64) for b in bits]
    size = np.array([len(w) for w in words])
    found = []
    for level in np.unique(size):
        folded = {}
        for k in np.flatnonzero(size >= level):
            w = words[k]
            while len(w) > level:
                w = w[: len(w) // 2] ^ w[len(w) // 2 :]
            folded[k] = w
        for xs, ys in ((first, second), (second, first)):
            ys = ys[size[ys] >= level]
            if not len(ys):
                continue
            table = np.stack([folded[y] for y in ys])
            for x in xs[size[xs] == level]:
                ok = (comp[ys] != comp[x]) & (100 * np.minimum(n[x], n[ys]) >= 80 * np.maximum(n[x], n[ys]))
                if not ok.any():
                    continue
                at = np.flatnonzero(ok)
                far = np.bitwise_count(table[at] ^ folded[x]).sum(axis=1)
                found += [(int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))) for y in ys[at[far <= (n[x] + n[ys[at]]) // 9]]]
            if first is second:
                break
    return found


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From members sorted by cell (sig, i, j): candidate pairs of each cell, at most 2 * CELL members at a time."""
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sig, i, j, block, ids, n, comp = (rows.column(k).to_numpy() for k in range(7))
        bits = rows.column(7).to_pylist()
        n = n.astype(np.int64)
        starts = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        out: set[tuple[int, int]] = set()
        for a, b in zip(starts, np.append(starts[1:], len(sig)), strict=True):
            if b - a < 2:
                continue
            own = np.arange(b - a)
            x, y = (own, own) if i[a] == j[a] else (own[block[a:b] == i[a]], own[block[a:b] == j[a]])
            out.update(near_in_cell(ids[a:b], n[a:b], comp[a:b], bits[a:b], x, y))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        key = lambda r, k: tuple(r.column(c)[k].as_py() for c in range(3))
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield from pairs(joined())
            held.clear()
        # The last cell of the batch may go on in the next one.
        sig, i, j = (batch.column(k).to_numpy() for k in range(3))
        same = (sig == sig[-1]) & (i == i[-1]) & (j == j[-1])
        cut = len(sig) - int(same.sum())
        if cut:
            held.append(batch.slice(0, cut))
            yield from pairs(joined())
            held.clear()
        held.append(batch.slice(cut))
    if held:
        yield from pairs(joined())


def linked(x: np.ndarray, y: np.ndarray, percent: int = 80) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (a, b, side, text) sorted by pair: the pairs that link."""
    sets: dict[int, np.ndarray] = {}
    half = None
    for batch in batches:
        a, b, side = (batch.column(k).to_pylist() for k in range(3))
        for row, texts in text_chunks(batch.column(3)):
            span = range(row, row + len(texts))
            ids = [b[i] if side[i] else a[i] for i in span]
            keep = {half[0], half[1]} if half else set()
            sets = {k: v for k, v in sets.items() if k in keep or k == ids[0]}
            todo = {d: t for d, t in zip(ids, texts, strict=True) if d not in sets}
            sets.update(zip(todo, shingle_sets(todo.values()), strict=True))
            found = []
            for i in span:
                if not side[i]:
                    half = (a[i], b[i])
                elif half == (a[i], b[i]):
                    if linked(sets[a[i]], sets[b[i]]):
                        found.append(half)
                    half = None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without those whose ``doc_id`` is not in ``ids``, for a join that follows: what it has no use for does not move.

    Up to SMALL_IDS identifiers are broadcast. More of them are broadcast as at most SMALL_IDS words of 64 bits, a bit for the
    hash of each: rows of other identifiers with the same bit stay too, and the join drops them.
    """
    ids = ids.distinct()
    if ids.count() <= SMALL_IDS:
        return rows.join(F.broadcast(ids), "doc_id", "left_semi")
    word, bit = f"pmod(xxhash64(doc_id), {SMALL_IDS})", "cast(pmod(xxhash64(1, doc_id), 64) AS int)"
    marks = ids.groupBy(F.expr(word).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("marks"))
    return rows.withColumn("word", F.expr(word)).join(F.broadcast(marks), "word").filter(f"getbit(marks, {bit}) = 1").drop("word", "marks")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts link. ``pairs`` is a table. Only documents of pairs move."""
    docs = among(docs, _ends(pairs))
    sides = pairs.select("a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("doc_id", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    rows = sides.join(docs.select("doc_id", "text"), "doc_id").select("a", "b", "side", "text")
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(_verified, "a bigint, b bigint")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in text_chunks(batch.column(0)):
            tokens, n = np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_sets(texts)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles that are frequent in a sample of about SAMPLE_DOCS documents; sorted."""
    step = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    counts = sample.mapInArrow(_counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_AT)
    top = counts.orderBy(F.desc("n"), "token").limit(HOT_SHINGLES).select("token").toPandas()["token"].to_numpy(dtype=np.int64)
    return np.sort(top.view(np.uint64))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose components (ca, cb) differ."""
    for x in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("component").alias("c")), x, "left").withColumn(f"c{x}", F.coalesce("c", x)).drop("c")
    return pairs.filter("ca <> cb")


def _size_ok(x: str, y: str):
    return 100 * F.least(x, y) >= 80 * F.greatest(x, y)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id.

    ``words_of`` gives the 64-bit words that bring sets together, instead of the parity sketches; links are the verified ones
    among sets that share a word.
    """
    since = mark()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    nameless, docs = docs.filter("doc_id IS NULL"), docs.filter("doc_id IS NOT NULL")
    rows = docs.mapInArrow(_signatures(words_of or sketch_prefix(frequent_shingles(docs))), "sig bigint, id bigint, n int, bits binary")
    grouped = written(
        rows.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(_groups, "sig bigint, a bigint, b bigint, na int, nb int, rank int, bits binary"),
        "groups",
    )
    own = grouped.filter("nb < 0").select(F.col("a").alias("doc_id"), F.col("b").alias("rep"), F.col("na").alias("n"), "bits")
    star = grouped.filter("nb >= 0").drop("bits")
    bits = own.filter("bits is not null").select("doc_id", "bits")

    def tested(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb), a table, that link."""
        # Both sides of each join are exchanges as they come, which Spark can split for a hot pivot.
        own_bits = among(bits, _ends(pairs))
        near = (
            pairs.join(own_bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a")), "a")
            .join(own_bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b")), "b")
            .select("a", "b", "na", "nb", "bits_a", "bits_b")
            .mapInArrow(_near_bits, "a bigint, b bigint")
        )
        # Written first: with few pairs left, texts need no shuffle.
        return verify(written(near, "near"), docs)

    done = written(star.filter(_size_ok("na", "nb")).select("a", "b", "na", "nb").distinct(), "pairs")
    links = written(own.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(tested(done)), "links")
    labels = components(links)
    members = star.select("sig", F.col("b").alias("id"), F.col("nb").alias("n"), "rank")
    for last in (False, True):
        # Groups whose members still span several components; pairs with the first pivots are done.
        named = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        spans = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("rank").alias("most"), F.min(F.xxhash64("id")).alias("pick")).filter("lo <> hi")
        # A table of its own: both sides of the join are then exchanges, which Spark can split for a hot word.
        spans = written(spans.drop("lo", "hi"), "spans")
        opened = written(named.join(spans, "sig"), "open")
        if opened.isEmpty():
            break
        if not last:
            # A second star around one member that groups of like members have in common.
            pivot = opened.filter(F.xxhash64("id") == F.col("pick")).select("sig", F.col("id").alias("p"), F.col("n").alias("np"), F.col("comp").alias("cp"))
            pairs = opened.join(pivot, "sig").filter((F.col("cp") != F.col("comp")) & _size_ok("np", "n"))
            smaller = F.col("p") < F.col("id")
            pairs = pairs.select(
                F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b"), F.when(smaller, F.col("np")).otherwise(F.col("n")).alias("na"), F.when(smaller, F.col("n")).otherwise(F.col("np")).alias("nb")
            ).distinct()
            more = tested(written(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), "pairs"))
        else:
            # Everyone left against everyone, in cells of bounded size: a member moves once per block of its group.
            block = F.floor(F.col("rank") / CELL).cast("int")
            other = F.explode(F.sequence(F.lit(0), F.floor(F.col("most") / CELL).cast("int")))
            own_bits = among(bits, opened.select(F.col("id").alias("doc_id")))
            cells = opened.join(own_bits.withColumnRenamed("doc_id", "id"), "id").withColumn("block", block).withColumn("other", other)
            cells = cells.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "comp", "bits")
            near = cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(_cells, "a bigint, b bigint")
            near = written(near.distinct(), "near")
            # A few pairs of any two components first: most components then are one, and their other pairs need no test.
            pair = F.min(F.struct("a", "b")).alias("p")
            some = _apart(near, labels).groupBy(F.least("ca", "cb"), F.greatest("ca", "cb"), F.pmod(F.xxhash64("a", "b"), F.lit(8))).agg(pair)
            links = written(links.union(verify(written(some.select("p.a", "p.b"), "pairs"), docs)), "links")
            labels = components(links)
            more = verify(written(_apart(near, labels).select("a", "b"), "pairs"), docs)
        links = written(links.union(more), "links")
        labels = components(links)
        members = opened.select("sig", "id", "n", "rank")
    named = (
        own.select("doc_id", "n")
        .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )
    return settled(named, "components", since).union(nameless.mapInArrow(_nameless, "doc_id bigint, n_shingles bigint, component_id bigint"))


def _nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(s) for s in shingle_sets(batch.column(1).to_pylist())]
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group."""
    (drop,) = fresh(docs, "drop")
    dropped = near_groups(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(drop))
    return docs.join(dropped, F.col(id_col) == F.col(drop), "left_anti")
