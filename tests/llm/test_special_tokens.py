"""Operators 9 and 10 and the pipeline: an added token's string is its id, as the library has it."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm.registry import QUERIES
from barloom.llm.tokenize import default_path, encoder

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n\n x", "<|endoftext|", "plain", ""]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_path())
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 0]


def test_ids_with_special_tokens(library):
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "don't", "Übung", "日本語", "12", "😀", "　", "<|"]
    for t in TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2000)]:
        assert encoder(default_path()).ids(t).tolist() == library(t)


@pytest.mark.parametrize("name", ["op9_packing", "op10_token_output", "pipeline"])
def test_queries_give_special_tokens(spark, tmp_path, library, name):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path)) if name in QUERIES else corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    length = defaultdict(int)
    for r in got.collect():
        ids = library(TEXTS[r.doc_id])
        length[r.doc_id] += r.length
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert length == {k: len(library(t)) for k, t in enumerate(TEXTS)}
