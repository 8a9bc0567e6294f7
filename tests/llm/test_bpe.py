"""BPE against the tokenizers library."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meshweave.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = bpe.Encoder(bpe.Tokenizer.read(PATH))
LIBRARY = Tokenizer.from_file(PATH)


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = ENCODER.encode(text)
    assert got.tolist() == want
    assert ENCODER.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "Hello  WORLD's 123 été", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ İstanbul ẞ", "\x1c\x1d x᠎y 　z", "é ñ 漢字 👩‍👩‍👧", "ab" * 900, "we'll I'm 'S", "a b\u0085c", "x" * 3000, "##$$%% 's't"])
def test_cases(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    same(text)


def test_null_and_query(spark, sf):
    assert len(ENCODER.encode(None)) == 0
    out = {r["doc_id"]: r for r in queries.op4_bpe(spark, sf).collect()}
    import hashlib

    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        e = LIBRARY.encode(r["text"] or "", add_special_tokens=False)
        assert out[r["doc_id"]]["n_tokens"] == len(e.ids)
        assert out[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert out[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_general_output(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y")], "doc_id long, text string, ids string")
    rows = bpe.encode(df, PATH).collect()
    assert sorted(len(r["ids"]) for r in rows) == [0, 2, 2]
    assert bpe.encode(df.limit(0), PATH).count() == 0
