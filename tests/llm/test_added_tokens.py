"""Added tokens of the vocabulary's JSON file in a text, against ``tokenizers`` with that file."""

import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from kelpie.llm import queries

TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b ", "it's  <|endoftext|>'s  \n", "<|endoftext|", "<|endoftext|>word " * 900, "plain", "", None]


def test_added_tokens_in_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(TEXTS)}
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for got in (queries.QUERIES["op3_best_fit_packing"](spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["best-fit packing"](spark, df, str(tmp_path))):
        rows = got.collect()
        assert {r.doc_id for r in rows} == set(ids)
        assert all(sum(r.length for r in rows if r.doc_id == i) == len(x) for i, x in ids.items())
        assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
