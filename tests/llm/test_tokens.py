import base64
import os
import random

import pytest

from canopy.llm import tokens

FILE = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files")

TEXTS = ["", None, "Hello world", "<|endoftext|> is text", "aaaaaaaaaaaaaaaaa", "a" * 4001, " " * 50 + "x\n\n\t y  ", "naïve café 本文分析了 𝔊𝔯𝔞𝔭𝔥 🌲", "it's we'll they'd I'm you've SHE'S don’t", "12345 67.89", "x̂ ≈ Σᵢ", "\r\n ​﻿"]


@pytest.fixture(scope="module")
def known():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(spark, known):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab \n\tcé9's!本A_-", k=rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(0, "again", [2])], "doc_id long, text string, ids array<int>")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_texts(df, "doc_id", "text").collect())
    assert got == sorted([(i, known.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(0, known.encode_ordinary("again"))])


def test_words_are_forgotten_and_texts_split_without_a_change(known, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "TOGETHER", 10)
    enc = tokens.Encoder(FILE)
    texts = [t or "" for t in TEXTS] * 2
    got = [x.tolist() for p in tokens._portions(texts) for x in enc.encode(p)]
    assert got == [known.encode_ordinary(t) for t in texts] and len(enc.known) < 100


def test_counts_and_empty_table(spark, known):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df, "doc_id", "text", ["source"]).collect()}
    assert got == {i: len(known.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0
