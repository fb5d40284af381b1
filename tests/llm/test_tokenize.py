import os

import pytest

from actlens.llm import tokenize

pytestmark = pytest.mark.skipif(not os.path.exists(tokenize.DEFAULT_TOKENIZER), reason="vocabulary files are not here")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


ODD = ["", None, " ", "\r\n\n  a", "aaaaaaaaaaa", "<|endoftext|> don't we'll", "città è già", "𝒳 ​\u0085　x", "x" * 5000 + " " * 300, "1234567 12.5", "a\tb", "ſİ"]


def test_equals_the_library_on_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3])]
    got = tokenize.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = library()
    assert len(got) == len(rows)
    assert all(r["ids"] == want(ODD[r["doc_id"]]) for r in got)


def test_equals_the_library_on_the_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = library()
    got = tokenize.encode_corpus(docs).collect()
    assert len(got) == len(texts)
    assert all(r["ids"] == want(texts[r["doc_id"]]) for r in got)


def test_rounds_and_counts(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "ROUND_CHARS", 50)
    monkeypatch.setattr(tokenize, "MEMO", 3)
    texts = [f"una prova numero {i} " * (i % 4) for i in range(40)]
    want = library()
    out = list(tokenize.encode_batches(iter([texts[k : k + 7] for k in range(0, 40, 7)]), tokenize.DEFAULT_TOKENIZER))
    ids = [list(flat[b[k] : b[k + 1]]) for flat, b in out for k in range(len(b) - 1)]
    assert ids == [want(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in tokenize.encode_corpus(df, counts_only=True).collect()} == {i: len(want(t)) for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert tokenize.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
