"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""


import duckdb
import pytest
from pyspark.sql import functions as F

from flowmarrow.llm import catalog, contamination, licenses, lines, passages, quality, toxicity, urls

SF = "/root/testdata/sf0.001"
LONG = "word " * 2_000
ROWS = [
    (1, "Alpha beta gamma delta\nalpha BETA gamma delta\n\n \t"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (5, LONG), (6, "x" * 50_000),
    (None, "alpha beta gamma delta"), (None, None), (7, "Licensed under CC BY-NC 4.0.\nalpha beta gamma delta epsilon"),
    (7, "alpha beta gamma delta epsilon zeta"), (8, "a b c d e f g h i j k l"), (9, "é É ß 日本語 \x00 z"),
]
CLASH = "doc_id long, text string, words string, key int, row string, n int, fp int, at int, kept int, doc int, sid int, url string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "w", 1, "r", 2, 3, 4, 5, 6, 7, None) for i, t in ROWS], CLASH)


@pytest.fixture
def db(spark, tmp_path, docs):
    """The same rows as tables of a folder and as views."""
    items = [(1, "b c d e f g h i j k l m"), (2, "Gamma, delta"), (3, None), (4, ""), (None, "y z"), (2, "gamma delta"), (5, "ß 日本語 \x00 z")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = duckdb.connect()
    for t in ("documents", "benchmark"):
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return made, str(tmp_path)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_line_dedup", "op7_passage_dedup", "op9_license_scan", "op10_decontamination"])
def test_same_as_sql(spark, db, name):
    made, folder = db
    got = catalog.QUERIES[name](spark, folder)
    cur = made.execute(catalog.SQL_CHECKS[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(str, got.select(names).collect())) == sorted(str(spark_row(names, r)) for r in cur.fetchall())


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values)))


def test_columns_stay(docs):
    items = docs.sparkSession.createDataFrame([(1, "d e f g")], "item_id long, text string")
    for out in (quality.keep_good(docs), lines.dedup(docs), contamination.keep_clean(docs, items)):
        assert out.columns == docs.columns
    assert quality.keep_good(docs).count() == 0
    assert contamination.keep_clean(docs, items).count() == len(ROWS) - 1
    kept = {(r.doc_id, r.text) for r in lines.dedup(docs).collect()}
    assert (1, "Alpha beta gamma delta\n\n \t") in kept and (2, None) in kept and (None, "") in kept and lines.dedup(docs).count() == len(ROWS)


def test_empty_tables(docs):
    none = docs.limit(0)
    items = docs.sparkSession.createDataFrame([], "item_id long, text string")
    assert [quality.judge(none).count(), lines.removals(none).count(), passages.remove(none).count(), licenses.scan(none).count()] == [0] * 4
    assert contamination.judge(none, items).count() == 0
    assert contamination.judge(docs, items).where("contaminated").count() == 0


def test_keep_good_agrees_with_the_judgement(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.keep_good(table).collect()}
    assert kept == {r.doc_id for r in quality.judge(table).where("kept").collect()}
    assert 0 < len(kept) < table.count()


def test_rules_are_ordered_by_rejections_per_cost():
    a, b, c = (quality.Rule(n, None) for n in "abc")
    assert quality.ordered([(a, 1.0, 0.1), (b, 0.1, 0.1), (c, 5.0, 0.9)]) == [b, c, a]


def test_many_windows_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BROADCAST_SHINGLES", -1)
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    made = duckdb.connect()
    for t in ("documents", "benchmark"):
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op10_decontamination", "op5_line_dedup"):
        got = catalog.QUERIES[name](spark, SF)
        cur = made.execute(catalog.SQL_CHECKS[name])
        names = [d[0] for d in cur.description]
        assert sorted(map(str, got.select(names).collect())) == sorted(str(spark_row(names, r)) for r in cur.fetchall())


def test_toxicity(spark, docs):
    labels = [(i, i % 2) for i in range(400)] + [(None, 1), (3, None), (7, 5), (2, 0)]
    texts = [(i, ("you nasty grobblex there " if i % 2 else "you nice person there ") + f"w{chr(97 + i % 26)}ab" * (i % 3)) for i in range(400)]
    more = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(more, table)
    got = toxicity.score(more, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got) and sum(r.held_out for r in got) > 50
    a, b, c, d = toxicity.score(spark.createDataFrame([(1, "GROB-BLEX!"), (2, "grobbblex"), (3, "g r o b b l e x"), (4, "person")], "doc_id long, text string"), model).collect()
    assert a.predicted == 1 and min(b.score, c.score) > d.score
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, table.limit(0))).collect()} == {0.0}


def test_kernel_against_plain():
    import itertools

    import numpy as np

    kernel = toxicity.Kernel({c: i + 1 for i, c in enumerate("^$abcdeq")})

    def feats(w):
        s, out = f"^{w}$", {}
        for at in itertools.combinations(range(len(s)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                k = tuple(c if c in kernel.codes else "?" for c in (s[i] for i in at))
                out[k] = out.get(k, 0) + toxicity.DECAY ** (at[3] - at[0] + 1)
        return out

    def value(a, b):
        x, y = feats(a), feats(b)
        dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0

    words, marks = ["abcde", "aabbccz", "a", "ab", "edcba", "abxcde", "aaaaaaa"], ["abcd", "edcb", "aaq"]
    got, _, _ = kernel.with_landmarks(words, marks)
    assert np.allclose(got, [[value(w, m) for m in marks] for w in words], atol=1e-5)


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = "", ""
    for i, c in enumerate(rest + "?"):
        if c in "/?#":
            host, rest = rest[:i], rest[i:]
            break
    for i, c in enumerate(rest + "?"):
        if c in "?#":
            path = rest[:i]
            break
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.HOST_RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls(spark):
    odd = [None, "", "x", "http://", "http://NET/", "http://a.net", "http://a.net?q", "ftp://É.Net/a://b", "http://example.net/en/1?x#y", "http://xexample.net/en/",
           "http://q.org/fr/#a", "http://org/fr", "http://example.com/de/", "http://w.example.com/DE/", "a://b.org#/fr/", "http://user@h.net:80/x"]
    given = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    bad = [f"http://h{i}.shop/buy/pill/{i}" if i % 2 else f"http://h{i}.shop/buy/book/{i}" for i in range(200)]
    every = odd + given + bad + bad[:3]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(every)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(len(odd) + len(given) + i, 0 if i % 2 else 1, 0) for i in range(150)] + [(None, 0, 0), (0, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    assert len(got) == len(every)
    for i, u in enumerate(every):
        host, path, rule = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[1] if rule else None), u
        if rule:
            assert got[i].verdict == rule[0]
        else:
            assert got[i].verdict == ("block" if u and "/pill/" in u else "allow"), u
    assert urls.judge(pages.limit(0), labels).count() == 0
    assert urls.judge(pages, labels.limit(0)).where("verdict = 'block' AND rule IS NULL").count() == 0


def test_mined_rules_against_plain(spark):
    """Every kept combination has the support and confidence it claims, and no part of it is as confident."""
    import itertools

    rows = [(["a", "b"], True)] * 8 + [(["a"], False)] * 8 + [(["b", "c"], True)] * 2 + [(["b"], False)] * 4 + [(["c", "d"], True)] * 5 + [([], True)]
    examples = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {tuple(r.tokens): r.confidence for r in urls.mine(examples, 0.05, 0.8).collect()}
    filled = [(set(t), b) for t, b in rows if t]
    conf = {}
    for n in (1, 2):
        for c in itertools.combinations("abcd", n):
            hold = [b for t, b in filled if set(c) <= t]
            if hold and sum(hold) / len(filled) >= 0.05 and sum(hold) / len(hold) >= 0.8:
                conf[c] = sum(hold) / len(hold)
    want = {c: v for c, v in conf.items() if not any(p != c and set(p) < set(c) and conf[p] >= v for p in conf)}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


