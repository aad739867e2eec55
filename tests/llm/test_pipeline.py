"""The pipeline's stages, each against a plain version on the rows it got."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from flowmarrow.llm import contamination, lines, quality
from flowmarrow.session import frozen

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(frozen(stage(spark, docs[-1], SF), name))
    return docs


def sql(df, body):
    """Rows of DuckDB SQL with ``docs`` as the documents."""
    made = duckdb.connect()
    docs = df.select("doc_id", "text").toPandas()
    made.register("docs", docs)
    made.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    return made.execute(body.replace("{docs}", "docs")).fetchall()


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "piece_encoding"]
    assert all(d.columns == steps[0].columns for d in steps[:-1])
    assert all(a.count() >= b.count() > 0 for a, b in zip(steps, steps[1:]))


def test_quality(steps):
    body = "WITH " + quality.MEASURES_SQL.format(docs="docs") + " SELECT doc_id FROM v WHERE NOT base_failed AND NOT own_failed"
    assert {r.doc_id for r in steps[1].collect()} == {r[0] for r in sql(steps[0], body)}


def test_line_dedup(steps):
    body = "WITH " + lines.REMOVED_SQL.format(docs="docs") + " SELECT doc_id, list(no) FROM d LEFT JOIN gone USING (rid) GROUP BY rid, doc_id"
    gone = {d: set(x) for d, x in sql(steps[1], body)}
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id]) for r in steps[1].collect()}
    got = {r.doc_id: r for r in steps[2].collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_dedup(steps):
    from test_simhash import plain_components, plain_fingerprint

    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in steps[2].collect()]
    assert {r.doc_id for r in steps[3].collect()} == {c for _, _, c in plain_components(rows)}


def test_decontamination(steps):
    body = "WITH " + contamination.JUDGED_SQL.format(docs="docs") + " SELECT doc_id FROM d WHERE rid NOT IN (SELECT rid FROM hit)"
    assert {r.doc_id for r in steps[4].collect()} == {r[0] for r in sql(steps[3], body)}


def test_encoding(steps):
    import sentencepiece

    from flowmarrow.llm import pieces

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    got = steps[5].collect()
    assert {r.doc_id: model.decode(list(r.ids)) for r in got} == texts
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in got)


def test_run(spark, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, steps[-1].collect()))
