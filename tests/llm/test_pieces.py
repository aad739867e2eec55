"""Sampled piece segmentation: distribution, reproducibility and round trips."""

import math
from collections import Counter

import numpy as np
import pytest

from flowmarrow.llm import pieces
from pyspark.sql import functions as F

ODD = [
    "", " ", "  a  b ", "tab\tnew\nline\r\n", "▁x ▁▁", "日本語 text 🙂 é é", "\x00\x01", "a" * 5000, "word " * 3000,
    "<0x41> <s> </s> <unk>", "�￿", "x y　z",
]


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def every_way(model, word, alpha):
    """All segmentations of a word with their weights."""
    known = {}
    for i, raw in enumerate(model.raw):
        if raw and i not in set(model.byte_ids.tolist()):
            known.setdefault(raw.decode().replace(" ", pieces.SPACE), i)
    ways = [((), 1.0, 0)]
    done = []
    while ways:
        ids, w, at = ways.pop()
        if at == len(word):
            done.append((ids, w))
            continue
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in known:
                i = known[word[at:end]]
                ways.append((ids + (i,), w * math.exp(model.weights[i] * alpha), end))
    return dict(done)


@pytest.mark.parametrize("text", ["thering", "  tion", "ß über"])
def test_frequencies(model, text):
    n = 20_000
    ids, sizes = pieces.encode_block(model, [text] * n, pieces._mix(np.arange(n, dtype=np.uint64)), 0.5)
    cuts = np.cumsum(sizes) - sizes
    seen = Counter(tuple(ids[a : a + s].tolist()) for a, s in zip(cuts, sizes))
    want = {(): 1.0}
    for w in pieces.words_of(text):
        ways = every_way(model, w, 0.5)
        want = {a + b: x * y for a, x in want.items() for b, y in ways.items()}
    total = sum(want.values())
    assert set(seen) <= set(want)
    for way, weight in want.items():
        p = weight / total
        assert abs(seen[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    assert len(seen) > 3


def test_round_trips(spark):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = [(i, t, 1, 2) for i, t in enumerate(ODD)] + [(None, "no key", 1, 2), (None, "no key", 1, 2), (99, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, key int")
    out = pieces.encode(docs, F.col("doc_id")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.text is None:
            assert r.ids is None
        elif pieces.SPACE not in r.text:
            assert reference.decode(list(r.ids)) == r.text
    assert all(r.lossless for r in pieces.round_trip(docs).collect())
    assert pieces.round_trip(docs.limit(0)).count() == 0


def test_same_on_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = {r.doc_id: r.ids for r in pieces.encode(docs.repartition(7), F.col("doc_id")).collect()}
    b = {r.doc_id: r.ids for r in pieces.encode(docs.orderBy("text").coalesce(1), F.col("doc_id")).collect()}
    c = {r.doc_id: r.ids for r in pieces.encode(docs, F.col("doc_id"), seed=1).collect()}
    assert a == b and a != c
