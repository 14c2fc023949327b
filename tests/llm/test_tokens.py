import base64
import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridloom.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no tokenizer files")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def machine():
    with open(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY), "rb") as f:
        return tokens.Transducer(f.read())


@pytest.fixture(scope="module")
def known():
    import tiktoken

    with open(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), tiktoken.Encoding("raw", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aaaabbbcde  \n\t'\"==--__..0123éü日本😀")), min_size=1, max_size=40))
def test_transducer_equals_merging(machine, known, text):
    assert list(machine.run(text.encode())) == known[1].encode_ordinary(text)
    assert "".join(machine.decode(machine.run(text.encode()))) == text


@settings(max_examples=300, deadline=None)
@given(data=st.binary(max_size=30), cut=st.integers(0, 30))
def test_utf8_machine(data, cut):
    m = tokens.Utf8Machine()
    assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.close() == data.decode("utf-8", "replace")


def test_texts(spark, known):
    texts = [None, "", " ", "  \n\n  x", "it's we'll I'D", "def f(x):\r\n\treturn x  # ½ é", "<|endoftext|>", "  a　b", "x" * 50_000, "ab " * 40_000, "﻿mark", "日本語テキスト 12３４"] * 3
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in df.select("doc_id", tokens.encode(spark, F.col("text")).alias("e"), tokens.count(spark, F.col("text")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i].e == known[0].encode_ordinary(t or ""), repr(t)[:60]
        assert got[i].n == len(got[i].e)
    back = df.select("doc_id", tokens.decode(spark, tokens.encode(spark, F.col("text"))).alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert df.where("false").select(tokens.encode(spark, F.col("text"))).count() == 0


def test_states_are_forgotten_without_harm(machine, monkeypatch):
    want = machine.run("internationalization".encode())
    monkeypatch.setattr(tokens, "STATES", 1)
    assert machine.run("internationalization".encode()) == want
