"""Special strings in texts get the ids that the library gives whole texts by default."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import packing, token_files, tokens
from ledgerloom.llm.workers import importable
from ledgerloom.session import scratch_dir, stage

TEXTS = ["a <|endoftext|> b", "<|startoftext|>Word<|endoftext|>", "x<|endoftext|>y <|endoftext|>\n<|startoftext|> z.", "<|ENDOFTEXT|> <|endof text|>",
         "é<|endoftext|>\U0001f600 q<|endoftext|><|endoftext|>,,", "\x1c<|endoftext|>\x1c.", "plain after it"]


def library_ids(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.word_file()).encode(text, add_special_tokens=False).ids


def test_chunks_match_the_library():
    assert library_ids(TEXTS[0]) == [320, 49407, 321]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.ChunkEncoder(tokens.word_file()).encode(TEXTS)] == [library_ids(t) for t in TEXTS]


def test_packing_and_files(spark):
    importable(spark)
    docs = stage(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), "special")
    crc = lambda text, end: zlib.crc32(np.array(library_ids(text) + [end], "<u4").tobytes())
    packed = packing.pack_documents(docs, tokens.word_file()).collect()
    assert {(r.doc_id, r.length, r.ids_crc32) for r in packed} == {(k, len(library_ids(t)) + 1, crc(t, 0)) for k, t in enumerate(TEXTS)}
    folder = scratch_dir(spark, "tokens")
    found = token_files.read_tokens(spark, folder, token_files.write_tokens(docs, folder, tokens.word_file())).orderBy(F.col("doc_id")).collect()
    starts = np.cumsum([0] + [len(library_ids(t)) + 1 for t in TEXTS]).tolist()
    assert [(r.doc_id, r.start, r.ids_crc32) for r in found] == [(k, starts[k], crc(t, 2)) for k, t in enumerate(TEXTS)]
