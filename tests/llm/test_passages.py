"""Induced suffix sorting and passage removal against brute force."""

import hashlib

import numpy as np
import pytest

from flowmarrow.llm import induced, passages


@pytest.mark.parametrize("in_memory", [10, 1_000_000])
@pytest.mark.parametrize("letters, size", [(2, 700), (4, 3000), (40, 3000), (3, 20_000), (1, 300)])
def test_suffix_order(letters, size, in_memory):
    rng = np.random.default_rng(letters * size)
    s = rng.integers(1, letters + 1, size)
    s[100:200] = s[:100]
    s = np.append(s, 0)
    order = induced.suffix_order(s, 30, None, in_memory)
    assert sorted(order.tolist()) == list(range(len(s)))
    heads = [tuple(s[i : i + 30]) for i in order]
    assert heads == sorted(heads)


def plain(rows):
    docs = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    rank = lambda d: float("inf") if d is None else d
    for d, b in docs:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], rank(d)), rank(d))
    out = []
    for d, b in docs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < rank(d):
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, doc int")
    return sorted((tuple(r) for r in passages.remove(docs).drop("kept").collect()), key=str)


def test_planted(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (5, 14, 15, 30, 60)]
    rows = [(i, " ".join(x for j in range(4) for x in (text(12), shared[(i + j) % 5], text(3)))) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1][1:]), (52, "ab" * 200), (53, "ab" * 90), (54, "b" * 49), (55, "b" * 50), (56, "b" * 51)]
    rows += [(57, None), (58, ""), (None, rows[4][1]), (None, "ab" * 200), (2, rows[7][1]), (2, rows[7][1]), (60, "x" * 5000), (61, "x" * 60)]
    assert rows_of(spark, rows) == plain(rows)


def test_full_filter_and_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(passages, "FILTER_BITS", 64)
    monkeypatch.setattr(passages, "BUFFERED", 50)
    monkeypatch.setattr(passages, "PLACES", 30)
    monkeypatch.setattr(passages, "BROADCAST_DOCS", -1)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    assert rows_of(spark, rows) == plain(rows)
    assert rows_of(spark, rows[:0] or [(1, None)]) == plain([(1, None)])


def test_broadcast_is_bounded_by_bytes(spark, monkeypatch):
    """Few documents with many spans are joined by shuffle, with the same result."""
    texts = [f"{i:05d}" * 12 for i in range(60)]
    docs = spark.createDataFrame([(1, "|".join(texts)), (2, "".join(f"{t}<{i}>" for i, t in enumerate(texts)))], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = passages.remove(docs)
    monkeypatch.setattr(passages, "BROADCAST_BYTES", 200)
    large = passages.remove(docs)
    assert "strategy=broadcast" in plan(small) and "strategy=broadcast" not in plan(large)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_places_travel_packed(spark):
    """A place of a repeated anchor takes about half of the 64 bytes that a row with its cut took."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(300) for _ in range(40)]
    rows = [(i, " ".join(x for j in range(3) for x in (text(20), shared[(i + j) % 40]))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bits, places = passages.anchor_bits(docs)
    sent = passages.cuts(docs, bits, 4).collect()
    held = [passages._places(r["cuts"]) for r in sent if r["cuts"] is not None]
    size = sum(len(r["cuts"] or b"") + len(r["runs"] or b"") for r in sent)
    assert sum(len(h[3]) for h in held) > 4000 and size < 36 * sum(len(h[3]) for h in held)
    sent = {d: t.encode() for d, t in rows}
    for doc, _, at, cuts in held:
        assert all(sent[d][a : a + len(c) - 1] == c[:-1] for d, a, c in zip(doc.tolist(), at.tolist(), cuts))
    assert rows_of(spark, rows) == plain(rows)


def test_every_string_stands_at_its_anchor():
    rng = np.random.default_rng(6)
    for n, letters in ((50, 3), (51, 1), (400, 2), (3000, 26)):
        t = rng.integers(0, letters, n).astype(np.uint8)
        at, h, least = passages.anchors(t)
        first, last = passages._surroundings(at, h, least)
        found = {(s, x) for a, b, x in zip(first.tolist(), last.tolist(), h.tolist()) for s in range(a, b + 1)}
        assert found == set(enumerate(least.tolist())) and (first <= at).all() and (last >= at - 26).all() and len(least) == n - 49


def test_shards_of_a_group_and_size_of_the_filter(spark, monkeypatch):
    rng = np.random.default_rng(7)
    shared = rng.integers(97, 123, 3000).astype(np.uint8).tobytes().decode()
    rows = [(i, shared[50 * i : 50 * i + 400] + str(i) * 30 + shared[900:1300]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits, _ = passages.anchor_bits(docs)
    blobs = [r["cuts"] for r in passages.cuts(docs, bits, 1).collect() if r["cuts"] is not None]
    whole = passages.removed_in_group(blobs)
    monkeypatch.setattr(passages, "SHARD", 20)
    small = passages.removed_in_group(blobs)
    assert len(whole) and sorted(map(tuple, whole.to_numpy())) == sorted(map(tuple, small.to_numpy()))
    monkeypatch.setattr(passages, "FILTER_BITS", 512)
    assert 8 * len(passages.anchor_bits(docs)[0]) == 2048
    assert rows_of(spark, rows) == plain(rows)
