"""License scan by diagonal voting.

Every rolling three-word window of every text is hashed and joined in Spark with the windows of the templates, a fixed
table of a few hundred rows. A hit votes for the diagonal ``document position - template position``; votes are summed per
document, template and diagonal. Neighbouring diagonals of a template (apart by at most ``SLACK`` words, so that an inserted
or dropped word does not break a match) merge into one span, and a span's score is the share of the template's words that
its verified windows cover. A window is verified by the hashes of its three words, besides the hash of the window itself.

A phrase of the base list counts where all its windows stand on one diagonal, that is, where its words stand
consecutively. Labels are the base labels and those of templates whose best span scores at least ``THRESHOLD``.

Edge cases: a null text is the empty text, with no words; texts shorter than a window have no hits; repeated places are all
counted; repeated rows each get a result row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shingles import mix, text_chunks

K, SLACK, THRESHOLD = 3, 3, 0.7

# Phrases whose places are counted, with their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Opening or naming sentences of public licences, with their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
]

_U = np.uint64
_WORD = np.ones(256, dtype=bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_rng = np.random.default_rng(0x11CE)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 2**63, K, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0xD1342543DE82EF95)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of the lowered bytes."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    inside = _WORD[buf]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64), at
    new = np.append(True, np.diff(at) > 1)
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    power = np.multiply.accumulate(np.full(int(lengths.max()), _STEP, dtype=np.uint64))
    return mix(np.add.reduceat(_BYTE[buf[at]] * power[place], first) + lengths.astype(np.uint64)), at[first]


def windows(h: np.ndarray) -> np.ndarray:
    n = max(0, len(h) - K + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(K):
        out += h[k : k + n] * _PLACE[k]
    return mix(out)


def _check(h: np.ndarray, n: int) -> np.ndarray:
    """A second combination of each window's word hashes."""
    return mix(h[:n] ^ mix(h[1 : n + 1] + _U(1)) ^ mix(mix(h[2 : n + 2] + _U(2))))


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window (row, start, hash, second hash), and one per document with its id, start -1 and word count."""
    for batch in batches:
        rows = batch.column(2).to_numpy()
        for row, texts in text_chunks(batch.column(1), 1 << 20):
            raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
            h, starts = word_hashes(b"\n".join(raw) + b"\n")
            bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))])
            n_words = np.diff(bounds)
            n = max(0, len(h) - K + 1)
            doc = np.repeat(np.arange(len(texts)), n_words)[:n]
            pos = np.arange(n) - bounds[doc]
            whole = pos + K <= n_words[doc]
            ids = batch.column(0).slice(row, len(texts))
            own = rows[row : row + len(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), ids, pa.array(np.full(len(own), -1, np.int32)), pa.array(np.zeros(len(own), np.int64)), pa.array(n_words.astype(np.int64))],
                names=["row", "doc_id", "pos", "hash", "word_check"],
            )
            if whole.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[doc[whole]]), pa.nulls(int(whole.sum()), ids.type), pa.array(pos[whole].astype(np.int32)), pa.array(windows(h)[whole].view(np.int64)), pa.array(_check(h, n)[whole].view(np.int64))],
                    names=["row", "doc_id", "pos", "hash", "word_check"],
                )


def _template_table(spark, phrases: list[tuple[str, str]]) -> DataFrame:
    """(template, label, base, n_words, tpos, hash, word_check); template -1 matches the rows of documents."""
    rows = [(-1, "", False, 0, 0, 0, None)]
    for t, (phrase, label, base) in enumerate(phrases):
        h, _ = word_hashes(phrase.encode())
        for p, w in enumerate(windows(h)):
            rows.append((t, label, base, len(h), p, int(w.view(np.int64)), int(_check(h[p : p + K], 1).view(np.int64)[0])))
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = ["template", "label", "base", "n_template", "tpos", "hash", "template_check"]
    return spark.createDataFrame(pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, cols, kinds, strict=True)}))


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    if short := [p for p, _ in [*base, *templates] if len(word_hashes(p.encode())[0]) < K]:
        raise ValueError(f"phrases need at least {K} words: {short}")
    phrases = [(p, label, True) for p, label in base] + [(p, label, False) for p, label in templates]
    table = F.broadcast(_template_table(docs.sparkSession, phrases))  # a row per window of the fixed phrases
    id_type = docs.schema[id_col].dataType.simpleString()
    rolled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(
        _rolled, f"row bigint, doc_id {id_type}, pos int, hash bigint, word_check bigint"
    )
    hits = rolled.join(table, "hash").filter(
        ((F.col("pos") < 0) & (F.col("template") < 0)) | ((F.col("pos") >= 0) & (F.col("word_check") == F.col("template_check")))
    )
    votes = (
        hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("row", "template", "label", "base", "n_template", "diagonal")
        .agg(F.collect_set("tpos").alias("places"), F.max("doc_id").alias("doc_id"), F.max("word_check").alias("n_words"))
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= SLACK, 0).otherwise(1)
    spans = (
        votes.withColumn("new", apart)
        .withColumn("span", F.sum("new").over(along))
        .groupBy("row", "template", "label", "base", "n_template", "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
            F.min("diagonal").alias("start"),
            F.max(F.col("diagonal") + F.array_max("places") + K).alias("end"),
            # Diagonals on which every window of the phrase stands.
            F.array_sort(F.collect_list(F.when(F.size("places") == F.col("n_template") - K + 1, F.col("diagonal")))).alias("full"),
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
        )
    )
    words = F.array_distinct(F.flatten(F.transform("places", lambda t: F.sequence(t, t + K - 1))))
    found = F.col("template") >= 0
    full = found & F.col("base") & (F.size("full") > 0)
    scored = spans.withColumn("score", F.when(found, F.size(words) / F.col("n_template")).otherwise(F.lit(0.0)))
    named = full | (found & ~F.col("base") & (F.col("score") >= THRESHOLD))
    labels = lambda on: F.array_join(F.array_sort(F.collect_set(F.when(on, F.col("label")))), ",")
    return (
        scored.groupBy("row")
        .agg(
            F.max(F.when(~found, F.col("doc_id"))).alias("doc_id"),
            F.max(F.when(~found, F.col("n_words"))).alias("n_words"),
            F.sum(F.when(full, F.size("full")).otherwise(0)).alias("n_base"),
            F.min(F.when(full, F.element_at("full", 1))).cast("long").alias("first_word"),
            F.max(F.when(full, F.element_at("full", -1))).cast("long").alias("last_word"),
            labels(full).alias("base_labels"),
            labels(named).alias("labels"),
            F.max("score").alias("score"),
            F.array_sort(F.collect_list(F.when(named, F.struct("label", "start", "end", "score")))).alias("spans"),
        )
        .drop("row")
    )
