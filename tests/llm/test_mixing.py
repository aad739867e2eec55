"""Mixing against a plain version and its SQL, hot sources, odd rows."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from flowmarrow.llm import catalog, mixing

COLUMNS = "doc_id long, text string, source string, size int, key string, row string, epochs int, part int, budget int"
ODD = [
    (1, "a b c d e", "x"), (2, None, "x"), (3, "", "y"), (4, " \t\n", None), (5, "long " * 3000, "x"), (5, "long " * 3000, "x"),
    (None, "p q", "y"), (None, None, None), (6, "é ß 日本", "Z"), (7, "x" * 50_000, ""), (8, "t u v", None), (9, "", "empty"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "k", "r", 2, 3, 4) for i, t, s in rows], COLUMNS)


def words(text):
    return len((text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).replace(" ", "\n").split("\n")) - (
        (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).replace(" ", "\n").split("\n").count("")
    )


def plain_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def plain_plan(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = plain_targets(sizes)

    def key(i, t):
        inner = hashlib.md5((t or "").encode()).hexdigest()
        return hashlib.md5(f"mix:{'' if i is None else i}:{inner}".encode()).hexdigest()

    out = []
    for s, size in sizes.items():
        budget, before = int(target[s]), 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: key(r[0], r[1])):
            n = words(t)
            more = min(n, max(0, budget % size - before)) if size else 0
            out.append((i, n, size, float(target[s]), (budget // size * n if size else 0) + more))
            before += n
    return out


def told(df):
    return Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def expected(rows):
    return Counter((a, b, c, round(d, 6), e) for a, b, c, d, e in plain_plan(rows))


def test_odd_rows_as_in_the_plain_version_and_sql(spark, tmp_path):
    docs = docs_of(spark, ODD)
    assert told(mixing.plan(docs)) == expected(ODD)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = duckdb.connect()
    made.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = made.execute(catalog.SQL_CHECKS["op13_mix_sources"])
    names = [d[0] for d in cur.description]
    got = catalog.QUERIES["op13_mix_sources"](spark, str(tmp_path)).select(names).collect()
    assert Counter(map(tuple, got)) == Counter(cur.fetchall())


def test_a_hot_source_and_copies_in_many_ranges(spark):
    rows = [(i, f"w{i} " * (i % 7), "hot" if i % 3 else f"s{i % 40}") for i in range(600)] + [(7, "same words here", "hot")] * 300
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert told(mixing.plan(docs_of(spark, rows))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 0}, {"a": 0}, {str(i): i * i for i in range(30)}])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_source boolean, src string, source_size long")
    got = {None if r.no_source else r.src: (r.target, r.budget) for r in mixing.targets(table).collect()}
    want = plain_targets(sizes)
    assert {s: b for s, (_, b) in got.items()} == {s: int(t) for s, t in want.items()}
    assert all(abs(got[s][0] - float(t)) < 1e-9 * max(1, float(t)) for s, t in want.items())


def test_more_than_all_limits_together(spark):
    table = spark.createDataFrame([(False, "a", 5), (False, "b", 7)], "no_source boolean, src string, source_size long")
    got = {r.src: r.budget for r in mixing.targets(table, share=Fraction(5)).collect()}
    assert got == {"a": 10, "b": 14}


def test_every_source_takes_its_target(spark):
    rows = mixing.plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r.src][0] += r.taken
        by[r.src][1] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    assert len(by) > 1 and all(0 <= target - taken < 1 for taken, target in by.values())


def test_the_mix_has_the_words_of_the_plan(spark):
    rows = [*ODD, *[(20 + i, f"alpha beta {i}", "y") for i in range(30)], *[(50, "twin words", "Z")] * 5]
    docs = docs_of(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = defaultdict(int)
    for r in mixing.plan(docs).collect():
        taken[None if r.no_source else r.src, r.doc_id] += r.taken
    mixed = defaultdict(int)
    for r in out.collect():
        mixed[r.source, r.doc_id] += words(r.text)
    assert mixed == {k: n for k, n in taken.items() if n}


def test_an_empty_table(spark):
    none = docs_of(spark, ODD).limit(0)
    assert mixing.plan(none).count() == 0 and mixing.mixed(none).count() == 0
