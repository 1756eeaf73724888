import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm.tokenize import PATTERN, Encoder, MergeTree, encode_column, load_ranks, merge_piece, vocabulary_folder

PATH = os.path.join(vocabulary_folder(), "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="vocabulary not installed")
RANKS = load_ranks(PATH) if os.path.exists(PATH) else {}


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def enc():
    return Encoder(RANKS)


def plain_merge(piece):
    """Rescans all pairs for each merge."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranked = [(RANKS[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in RANKS]
        if not ranked:
            return [RANKS[p] for p in parts]
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 60)), max_size=30))
@settings(max_examples=100, deadline=None)
def test_tree_names_the_least(keys, puts):
    t = MergeTree(list(keys))
    for i, k in puts:
        if i < len(keys):
            keys[i] = k
            t.put(i, k)
        assert t.least() == min(keys)


@given(st.binary(min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_pieces_merge_as_by_rescanning(piece):
    assert merge_piece(piece, RANKS) == (plain_merge(piece) if piece not in RANKS else [RANKS[piece]])


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_text_as_the_public_encoder(text):
    import tiktoken

    e = test_any_text_as_the_public_encoder.__dict__.setdefault("ref", tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={}))
    own = test_any_text_as_the_public_encoder.__dict__.setdefault("enc", Encoder(RANKS))
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert own(text) == e.encode_ordinary(text)


def test_long_and_odd_texts(enc, reference):
    rng = random.Random(3)
    texts = ["a" * 20000, "ab" * 9000, " " * 5000 + "x", "\n\n \t" * 700, "日本語" * 3000, "<|endoftext|> isn't special", "it's I'LL we'd 'tis ''s", "".join(chr(rng.choice([*range(32, 127), *range(0x400, 0x460), 0x1F600])) for _ in range(5000)), "  x　", "\x00\x01"]
    for t in texts:
        ids = enc(t)
        assert ids == reference.encode_ordinary(t)
        assert reference.decode(ids) == t


def test_corpus_round_trip(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = encode_column(docs.withColumn("ids", F.lit("clash"))).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.ids == (reference.encode_ordinary(text[r.doc_id]) if text[r.doc_id] else [])


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, " ")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.ids) for r in encode_column(df).collect()) == [("1", []), ("2", []), ("3", [64]), ("3", [64]), ("None", [220])]
    assert encode_column(df.limit(0)).count() == 0
