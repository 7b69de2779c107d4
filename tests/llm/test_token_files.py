import io
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import token_files as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    cases = [np.array([0]), np.array([7] * 4096), np.array([2**32 - 1, 0]), rng.integers(0, 50_000, 4096), rng.integers(0, 2**32, 999)]
    cases += [np.where(rng.random(4000) < 0.02, rng.integers(0, 2**32, 4000), rng.integers(100, 130, 4000))]
    for ids in cases:
        ids = ids.astype(np.uint32)
        packed = op.pack_block(ids)
        assert (op.unpack_block(memoryview(packed)) == ids).all()
    assert len(op.pack_block(cases[5].astype(np.uint32))) < 4000


def test_file_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    docs = [(i if i else None, rng.integers(0, 50_000, n).astype(np.uint32)) for i, n in enumerate([3, 0, 100_000, 1, 4096, 4095])]
    out = io.BytesIO()
    w = op.Writer(out)
    for d in docs:
        w.add(*d)
    w.close()
    r = op.Reader(out, len(out.getvalue()))
    for (a, x), (b, y) in zip(docs, r.documents(), strict=True):
        assert a == b and (x == y).all()
    ids = np.concatenate([x for _, x in docs])
    assert (r.slice(4000, 9000) == ids[4000:13_000]).all()


def test_matches_the_library(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").collect()
    tokenizer = Tokenizer.from_file(PATH)
    start, expected = 0, {}
    for r in docs:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op.query(spark, sf_small).collect()}
    assert got == expected


def test_words_between_spaces_make_the_text():
    texts = ["Á b", " ́x", "it's don'T  x\t\ny", "ΣΑΣ ΟΔΟΣ", "İI ﬁ ½ ①  é", "a　b c d", "<|endoftext|> x", "日本 語 " * 50, "A.\n\nÀÖß!\n Þ\tÿ µ", "".join(map(chr, range(1, 256)))]
    encoder = op.Encoder(PATH)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == [*encoder.words.tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_defined_cases(spark, tmp_path):
    rows = [(2, None), (1, ""), (3, "same"), (3, "same"), (None, "lost"), (5, "long word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("tie", F.lit("a"))
    got = op.token_files(df, f"file://{tmp_path}/x", PATH).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 5] and [r.n_tokens for r in got[:5]] == [2, 1, 1, 2, 2]
    assert got[5].n_tokens == 80_001
    assert op.token_files(df.limit(0), f"file://{tmp_path}/y", PATH).count() == 0


def test_added_tokens_in_other_case_are_text():
    encoder = op.Encoder(PATH)
    texts = ["<|ENDOFTEXT|> x", "A <|EndOfText|>\nB", "É <|STARTOFTEXT|> <|endoftext|> Y"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == [*encoder.words.tokenizer.encode(text, add_special_tokens=False).ids, 1], text
