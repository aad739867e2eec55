"""Documents through quality rules, line dedup, near-dedup, decontamination and piece encoding.

Every stage takes all documents that the stage before kept and calls one operator of ``flowmarrow.llm``. The stages
handle odd rows as their operators state it: null and empty texts fail the quality rules, so later stages see them
only if line dedup empties a text; such documents stay, and near-dedup then keeps one of them.
"""

from __future__ import annotations

from flowmarrow.llm import contamination, lines, pieces, quality, simhash
from flowmarrow.session import frozen


def good_documents(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def fresh_lines(spark, docs, sf_dir):
    """All documents, without the lines that repeat an earlier one; ``n_chars`` is the new length if there is one."""
    out = lines.dedup(docs)
    return out.withColumn("n_chars", lines.n_chars(out["text"]).cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def one_of_each(spark, docs, sf_dir):
    """One document of every near-duplicate group."""
    return simhash.keep_one(docs)


def without_benchmark(spark, docs, sf_dir):
    """Documents that hold no window of a benchmark item."""
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def encoded(spark, docs, sf_dir):
    """Sampled piece ids of every document, and whether they decode to its text."""
    return pieces.round_trip(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", fresh_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("piece_encoding", encoded),
]
#: The near-dedup and encoding stages are beyond SQL; tests hold all stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents table, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
