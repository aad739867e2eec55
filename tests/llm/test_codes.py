"""Vector codes against plain Lloyd rounds and SQL; bounds never decide."""

import duckdb
import numpy as np
import pytest

from flowmarrow.llm import catalog, codes

SCHEMA = "vec_id long, embedding array<float>, label string, v int, near string, code int, n int, none boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2, 3, True) for i, v, label in rows], SCHEMA)


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    x = {k: [int(np.floor(4096 * float(np.float32(c)))) for c in v] + [0] * (size - len(v)) for k, (_, v, _) in enumerate(kept)}
    first = sorted(x, key=lambda k: (kept[k][0] is None, kept[k][0] or 0, x[k]))[:entries]
    step = size // parts
    part = lambda k, p: x[k][p * step : (p + 1) * step]
    books = [[part(k, p) for k in first] for p in range(parts)]

    def nearest(k, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(k, p), e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        sets = [[[] for _ in b] for b in books]
        for k in x:
            for p in range(parts):
                sets[p][nearest(k, p)[1]].append(part(k, p))
        books = [[[sum(c) // len(c) for c in zip(*s)] if s else e for s, e in zip(sets[p], books[p])] for p in range(parts)]
    out = []
    for k in x:
        near = [nearest(k, p) for p in range(parts)]
        out.append((kept[k][0], bytes(j for _, j in near).hex(), sum(d for d, _ in near), kept[k][2]))
    return out, books


def as_plain(spark, rows, **how):
    got, books = codes.compress(frame(spark, rows), **how)
    want, want_books = plain(rows, **how)
    told = [(r.vec_id, r.code, r.error, r.label) for r in got.collect()]
    assert sorted(told, key=repr) == sorted(want, key=repr)
    assert books.tolist() == want_books


def cloud(n, d, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, spread, (20, d))
    return [(i, (centres[i % 20] + draw.normal(0, 0.1, d)).astype(np.float32).tolist(), str(i % 3)) for i in range(n)]


def test_many_vectors(spark):
    as_plain(spark, cloud(400, 16, 1))


def test_ties_and_copies(spark):
    draw = np.random.default_rng(2)
    rows = [(i // 3, draw.integers(0, 3, 16).astype(float).tolist(), None if i % 2 else "a") for i in range(200)]
    as_plain(spark, rows + [(500, [0.5] * 16, "b")] * 150)


def test_odd_rows(spark):
    rows = [
        (1, [0.1] * 16, "a"), (2, None, "a"), (3, [None] * 16, "b"), (4, [float("nan")] * 16, None), (5, [float("inf")] * 16, "a"),
        (None, [0.3, -0.2] * 8, None), (1, [0.1] * 16, "a"), (6, [], "c"), (7, [1.0] * 11, "c"), (8, [-2.5] * 16, None),
    ]
    as_plain(spark, rows)
    as_plain(spark, rows, parts=3, entries=2, rounds=1)
    as_plain(spark, [(1, [0.25] * 9, "a")])


def test_huge_components_do_not_overflow(spark):
    got, books = codes.compress(frame(spark, [(1, [3e38] * 16, "a"), (2, [-3e38] * 16, "a"), (3, [0.0] * 16, "a")]), entries=2)
    assert {r.vec_id: r.code for r in got.collect()}.keys() == {1, 2, 3}
    assert all(r.error >= 0 for r in got.collect())


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, [float("nan")], None)]])
def test_without_vectors(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.QUERIES["op12_vector_codes"](spark, str(tmp_path)).count() == 0


def test_as_in_sql_with_null_labels(spark, tmp_path):
    rows = cloud(120, 16, 3) + [(i, [float(i % 5)] * 16, None) for i in range(120, 160)] + [(7, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = duckdb.connect()
    made.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cur = made.execute(catalog.SQL_CHECKS["op12_vector_codes"])
    names = [d[0] for d in cur.description]
    got = catalog.QUERIES["op12_vector_codes"](spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


@pytest.mark.parametrize("keep", [(4, 4, 4), (2, 8, 3), (8, 2, 16), (1, 1, 1)])
def test_bounds_with_any_list_length(keep):
    draw = np.random.default_rng(5)
    x, of = draw.integers(-500, 500, (900, 4)), np.arange(900) % 3
    books = draw.integers(-500, 500, (3, 16, 4))
    near, low, outer, d = codes.first_lists(x, of, codes.Round(books, np.zeros((3, 16)), keep[0]))
    saved = 0
    for n, k in enumerate(keep * 2):
        was, books = books, books + draw.integers(-12, 13, books.shape) // (n + 1)
        moves = np.sqrt(((books - was) ** 2).sum(-1)) * (1 + codes.SAFE)
        near, low, outer, d, need = codes.next_lists(x, of, near, low, outer, codes.Round(books, moves, k))
        every = ((x[:, None] - books[of]) ** 2).sum(-1)
        assert (d == every.min(1)).all() and (near[:, 0] == every.argmin(1)).all() and near.shape[1] == k
        root = np.sqrt(every)
        listed = near >= 0
        assert (low[listed] <= np.take_along_axis(root, np.maximum(near, 0), 1)[listed]).all()
        others = np.ones(root.shape, bool)
        for z in range(k):
            others[np.flatnonzero(listed[:, z]), near[listed[:, z], z]] = False
        assert (outer <= np.where(others, root, np.inf).min(1)).all()
        saved += (need < 16).sum()
    assert saved or keep == (1, 1, 1)


def test_the_list_follows_what_was_needed():
    assert codes.fitted_keep(np.array([100, 0, 0, 0, 0]), 4, 4) == 2
    assert codes.fitted_keep(np.array([50, 20, 20, 5, 5]), 4, 4) == 4
    assert codes.fitted_keep(np.array([10, 0, 0, 0, 90]), 2, 4) == 4
    assert codes.fitted_keep(np.zeros(5, int), 3, 4) == 3


def test_codes_can_be_read_back(spark):
    rows = cloud(100, 16, 4)
    got, books = codes.compress(frame(spark, rows))
    by_id = {i: np.floor(4096 * np.array(v, np.float64)) for i, v, _ in rows}
    for r in codes.decoded(got, books).collect():
        assert round(((4096 * np.array(r.vector) - by_id[r.vec_id]) ** 2).sum()) == r.error
