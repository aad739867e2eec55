"""SimHash near-duplicates against brute force."""

import numpy as np
import pytest
import xxhash

from flowmarrow.llm import simhash
from flowmarrow.llm.graph import components


def plain_fingerprint(text):
    words = [w for w in text.translate({ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id -> (fingerprint, smallest reachable id), from all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[top(a)] = top(b)
    first = {}
    for d, f in rows:
        if d is not None:
            first[top(f)] = min(first.get(top(f), d), d)
    return [(d, f"{f:016x}", first.get(top(f))) for d, f in rows]


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(want)
    assert len({c for _, _, c in want}) < len(want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b"), (None, "a b"), (4, "A B"), (4, "A B"), (5, "x" * 100_000), (6, "é É")]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, fp int, row string")
    want = plain_components([(i, plain_fingerprint(t or "")) for i, t in rows])
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (4, "A B"), (5, "x" * 100_000), (6, "é É")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("members, visitors, leaf", [(20_000, 200_000, 50), (7, 11, 20)])
def test_links_are_complete(spark, monkeypatch, members, visitors, leaf):
    """Crowded balls, chains and stray fingerprints, through many leaves and blocks."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)]
    for centre in values[:20]:
        for _ in range(15):
            x = centre
            for b in rng.integers(0, 64, rng.integers(1, 8)):
                x ^= 1 << int(b)
            values.append(x)
    rows = [(i, f) for i, f in enumerate(values)]
    want = {f: c for _, f, c in plain_components(rows)}
    fps = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in rows], "doc_id long, fp long")
    got = {r.fp & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.near_groups(fps).collect()}
    assert len(got) == len(set(values))
    same = {}
    for f, r in got.items():
        same.setdefault(r, set()).add(want[f"{f:016x}"])
    assert all(len(s) == 1 for s in same.values()) and len(same) == len(set(want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 140)}}
