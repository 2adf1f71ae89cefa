"""Merkle fixity audit of WARC replicas.

A manifest puts the records of both replicas in order of their identifiers and gives each its place and byte offset. Each
replica hashes its records; ``FAN_OUT`` consecutive places make an ordered offset range. A range's hash covers the offset,
length and hash of each of its records in order (a record that the replica lacks has none), so bytes that move between
records change it too; ranges make ranges, upwards to one root. Two replicas first compare roots; where these differ, only
mismatching ranges are opened, level by level, down to the records. A healthy archive moves one hash; a damaged one moves the
path to each damage.

Records are hashed where they are read; only hashes and lengths move. Places come from range partitions and running totals
per partition, so nothing is ordered in a single task, and an identifier that very many records share is spread over tasks by
the records' hashes; a node never gathers more than ``FAN_OUT`` hashes.

Edge cases: null addresses or bodies are empty; records of a repeated identifier are told apart by their number in order
of hashes; a null identifier sorts first; a record that the replica lacks is ``missing``, one with other bytes is ``altered``, one
that only the replica has is ``extra`` (its hash and length are the replica's); empty tables have no nodes, no root and no
findings; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prefix_totals, written

FAN_OUT = 64


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as the text of a WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _ordered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` in range partitions by ``keys``, with ``part`` and ``k``, the place in it from 1; a table.

    ``rows`` is a table; rows alike in all keys are split by their place in it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("part").orderBy(*(F.col(k).asc_nulls_first() for k in keys), "tie")
    tied = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    split = written(tied.repartitionByRange(parts, *(F.col(k).asc_nulls_first() for k in keys), "tie").withColumn("part", F.spark_partition_id()), "ranges")
    return split.withColumn("k", F.row_number().over(w)).drop("tie")


def hashed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(record, nth, length, digest) of a replica's records, in a table; ``nth`` tells records of one identifier apart."""
    raw = pages.select(F.col(id_col).alias("record"), warc_record(F.col(id_col), F.col(url_col), F.col(html_col)).alias("raw"))
    rows = written(raw.select("record", F.octet_length("raw").cast("long").alias("length"), F.sha2("raw", 256).alias("digest")), "hashed")
    placed = written(_ordered(rows, ["record", "digest"]), "records")
    first = placed.groupBy("part", "record").agg(F.min("k").alias("k1"), F.max("k").alias("k2"))
    # An identifier goes on into the next partition only as the last of its own: one row a partition.
    ends = placed.groupBy("part").agg(F.max("k").alias("k2"))
    going = first.join(ends, ["part", "k2"]).select("part", "record", (F.col("k2") - F.col("k1") + 1).alias("n"))
    starting = first.filter("k1 = 1").select("part", "record", F.lit(0).cast("int").alias("n"))
    edges = starting.unionByName(going.select("part", "record", F.col("n").cast("int").alias("n")))
    earlier = Window.partitionBy("record").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).groupBy(F.col("part").alias("cp"), F.col("record").alias("cr")).agg(F.max("before").alias("before"))
    carry = first.join(carried, (F.col("part") == F.col("cp")) & F.col("record").eqNullSafe(F.col("cr")) & (F.col("k1") == 1), "left")
    carry = carry.select(F.col("part").alias("p"), F.col("record").alias("r"), "k1", F.coalesce("before", F.lit(0)).alias("before"))
    named = placed.join(carry, (F.col("part") == F.col("p")) & F.col("record").eqNullSafe(F.col("r")))
    return written(named.select("record", (F.col("k") - F.col("k1") + 1 + F.col("before")).alias("nth"), "length", "digest"), "records")


def manifest(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Both replicas' (length, digest) and (r_length, r_digest) by record, with place ``n`` and byte ``offset``, in a table."""
    r = replica.select(F.col("record").alias("r"), F.col("nth").alias("r_nth"), F.col("length").alias("r_length"), F.col("digest").alias("r_digest"))
    both = records.join(r, F.col("record").eqNullSafe(F.col("r")) & (F.col("nth") == F.col("r_nth")), "full_outer")
    both = both.withColumn("record", F.when(F.col("nth").isNull(), F.col("r")).otherwise(F.col("record"))).withColumn("nth", F.coalesce("nth", "r_nth"))
    rows = written(_ordered(written(both.drop("r", "r_nth"), "both"), ["record", "nth"]), "ordered")
    bytes_ = F.coalesce("length", F.lit(0))
    totals = rows.groupBy("part").agg(F.count("*").alias("rows"), F.sum(bytes_).alias("bytes"))
    before = prefix_totals(prefix_totals(totals, ["part"], "rows", "n0"), ["part"], "bytes", "o0").select("part", "n0", "o0")
    w = Window.partitionBy("part").orderBy("k")
    placed = rows.withColumn("upto", F.sum(bytes_).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    offset = (F.col("o0") + F.col("upto") - bytes_).alias("offset")
    return written(placed.join(before, "part").select("record", "nth", "length", "digest", "r_length", "r_digest", (F.col("n0") + F.col("k") - 1).alias("n"), offset), "manifest")


def leaves(index: DataFrame, length: str, digest: str) -> DataFrame:
    """(n, start, length, digest) of one replica at the manifest's places; an empty digest where it has no record."""
    return index.select("n", F.col("offset").alias("start"), F.coalesce(F.col(length), F.lit(0)).alias("length"), F.coalesce(F.col(digest), F.lit("")).alias("digest"))


def _node(nodes: DataFrame, n: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), F.concat_ws(":", "start", "length", "digest").alias("entry"))))
    return nodes.groupBy(F.floor(F.col(n) / FAN_OUT).cast("long").alias("node")).agg(
        F.min("start").alias("start"), F.sum("length").alias("length"), F.sha2(F.array_join(ordered["entry"], "\n"), 256).alias("digest")
    )


def tree(below: DataFrame, n_records: int) -> list[DataFrame]:
    """Levels (node, start, length, digest) from ranges of records up to the root; ``below`` are the leaves."""
    levels, count, key = [], n_records, "n"
    while count:
        count = -(-count // FAN_OUT)
        below, key = written(_node(below, key), f"level{len(levels)}"), "node"
        levels.append(below)
        if count == 1:
            break
    return levels


def audit(index: DataFrame, ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(n, status) of damaged records only, found by opening mismatching nodes from the root down."""
    opened = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if opened is not None:
            a, b = (x.join(opened, F.floor(F.col("node") / FAN_OUT) == F.col("parent"), "left_semi") for x in (a, b))
        both = a.join(b.select("node", F.col("digest").alias("theirs")), "node")
        opened = written(both.filter(F.col("digest") != F.col("theirs")).select(F.col("node").alias("parent")), "opened")
        if opened.isEmpty():
            opened = None
            break
    if opened is None:
        return index.select("n", F.lit("").alias("status")).filter(F.lit(False))
    inside = index.join(opened, F.floor(F.col("n") / FAN_OUT) == F.col("parent"), "left_semi")
    status = F.when(F.col("r_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("digest") != F.col("r_digest"), "altered")
    return inside.select("n", status.alias("status")).filter("status IS NOT NULL")


def fixity(pages: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per record of either replica: record, offset, length, record_sha256, range_id, status, root and replica root."""
    index = manifest(hashed(pages, id_col, url_col, html_col), hashed(replica, id_col, url_col, html_col))
    n = index.count()
    ours, theirs = tree(leaves(index, "length", "digest"), n), tree(leaves(index, "r_length", "r_digest"), n)
    root = lambda levels: levels[-1].first()["digest"] if levels else None
    return index.join(audit(index, ours, theirs), "n", "left").select(
        F.col("record").alias("page_id"),
        "offset",
        F.coalesce("length", "r_length").alias("length"),
        F.coalesce("digest", "r_digest").alias("record_sha256"),
        F.floor(F.col("n") / FAN_OUT).cast("long").alias("range_id"),
        F.coalesce("status", F.lit("ok")).alias("status"),
        F.lit(root(ours)).cast("string").alias("root_sha256"),
        F.lit(root(theirs)).cast("string").alias("replica_root_sha256"),
    )


def damaged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A replica with planted damage: some bodies lose their first character to ``?``, some records are gone, some are there twice."""
    mark = F.substring(F.md5(F.coalesce(F.col(url_col), F.lit(""))), 1, 2)
    body = F.coalesce(F.col(html_col), F.lit(""))
    left = pages.filter(mark != "0f").withColumn(html_col, F.when(mark == "07", F.concat(F.lit("?"), F.substring(body, 2, 2**31 - 1))).otherwise(body))
    return left.unionByName(left.filter(mark == "0b"))
