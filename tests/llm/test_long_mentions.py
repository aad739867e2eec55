"""Words, mentions and lines of any length: no pattern may recurse by the character or run quadratically."""

import time

import pytest

from flowmarrow.llm import licenses, quality, surrogates

ROWS = [
    "A" * 1_000_000 + "a", "AB" * 500_000, "\n" * 1_000_000, " \t" * 500_000 + "x", "Mr " + "A" * 100_000 + "b", "Mr " + "Abc-" * 50_000 + "D end",
    "Mr " + "Anna " * 50_000, "me@" + "a." * 100_000 + "org", "me@" + "a-" * 100_000 + "b.de.", "token=" + "x" * 1_000_000, "a@" * 200_000,
    "Dr A. " + "B. " * 50_000 + "Curie", "1234 " * 100_000, "copyright " * 100_000, ". " * 300_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id").persist()


@pytest.mark.parametrize("run", [quality.judge, surrogates.replace, licenses.scan])
def test_every_long_row_comes_back_soon(docs, run):
    start = time.time()
    found = run(docs)
    assert found.count() == len(ROWS) and len({r[0] for r in found.select("doc_id").collect()}) == len(ROWS)
    assert time.time() - start < 10 * len(ROWS)


def test_long_mentions_are_replaced_whole(spark):
    rows = [(1, "Mr " + "Abc" * 5000 + " said"), (2, "to me@" + "a." * 20_000 + "org."), (3, "ask Mr Jean-Luc O'Neil's x@y.co.uk... now")]
    got = {r.doc_id: r.text for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()}
    assert "Abc" not in got[1] and got[1].endswith(" said")
    assert "a.a." not in got[2] and got[2].endswith(".org.")
    assert "Jean" not in got[3] and "x@y" not in got[3] and got[3].endswith("... now") and "'s " in got[3]


def scanned(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licenses for r in licenses.scan(rows).orderBy("doc_id").collect()]


def test_every_template_gives_its_own_licence_alone(spark):
    assert scanned(spark, *[body for _, body in licenses.TEMPLATES]) == [name for name, _ in licenses.TEMPLATES]


def test_a_notice_inside_a_paragraph(spark):
    texts = ["Some code here today. Released under the MIT License. It does a lot of things for many people! Nothing else is said here.", "No word on it."]
    assert scanned(spark, *texts) == ["MIT", ""]


def test_no_match_lacks_all_needed_words():
    """Every way to lose as many bigrams of a short template as a match may lose leaves a needed word."""
    from itertools import combinations

    for percent in (50, 80, 100):
        words = set(licenses.needed_words(licenses.TEMPLATES, percent))
        for _, body in licenses.TEMPLATES:
            found = licenses.regex.findall(r"[\p{L}\p{N}]+", body.lower())
            grams = sorted(set(zip(found, found[1:])))
            if len(grams) > 14:
                continue
            for k in range(len(grams) + 1):
                for kept in combinations(grams, k):
                    # a unit of these bigrams and nothing else is as alike as one with them can be
                    if 200 * k >= percent * (k + len(grams)) and k:
                        assert words & {w for pair in kept for w in pair}
