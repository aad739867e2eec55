"""Quality rules as a short-circuit cascade.

A rule is a named Boolean column that is true for a text to reject. The cost of each rule (time) and its selectivity
(share of rejected texts) are estimated on a sample; the rules then form one ``CASE`` expression in the order of
rejections per cost, so a text that an early rule rejects is never tested by later ones. The order changes the time
and which rule is named first, never the verdict. Everything is a DataFrame expression; each row is judged by itself,
so nothing is shuffled.

Null and empty texts have no words and fail ``few_words``. Null ids and repeated rows pass through, row by row.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.text import let, query, rows_only, split_words, table, whole, with_row
from flowmarrow.session import frozen

SYMBOLS = "[#*$%&|<>]"
#: A word that has the first and not the second is shouted; two searches, each of which reads a word once.
UPPER_CASE, LOWER_CASE = r"\p{Lu}", r"\p{Ll}"
WINDOW = 8
SAMPLE_ROWS = 3000


@dataclass(frozen=True)
class Text:
    """The columns that rules look at."""

    text: Column
    words: Column

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    @property
    def lines(self) -> Column:
        return F.filter(F.split(whole(self.text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], Column]


def word_chars(t: Text) -> Column:
    return F.length(F.array_join(t.words, "")).cast("long")


def n_symbols(t: Text) -> Column:
    return F.regexp_count(whole(t.text), F.lit(SYMBOLS)).cast("long")


def n_dup_lines(t: Text) -> Column:
    return let(t.lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(t: Text, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` words that occur at least twice in the text.

    Windows are compared by their 64-bit hash within one text. Only texts with a repeated window sort theirs.
    """

    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def starts(s):
            same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return F.sort_array(F.transform(twice, lambda x: x["at"]))

        def total(p):
            reach = F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size))))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(let(pairs, starts), total)

    def windows(h):
        ends = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
        return F.slice(ends, F.lit(1), F.size(t.words) - size + 1)

    hashes = let(F.transform(t.words, lambda w: F.xxhash64(w)), windows)
    counted = let(hashes, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(t.words) > size, counted).otherwise(F.lit(0).cast("long"))


def _few_words(t: Text) -> Column:
    return t.n_words < 20


def _repeats(t: Text) -> Column:
    return 100 * n_repeat_words(t) > 30 * t.n_words


def _word_length(t: Text) -> Column:
    return let(word_chars(t), lambda c: (c < 2 * t.n_words) | (c > 14 * t.n_words))


def _symbols(t: Text) -> Column:
    return 10 * n_symbols(t) > t.n_words


def _dup_lines(t: Text) -> Column:
    return let(t.lines, lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > 50 * F.size(x))


def _upper_case(t: Text) -> Column:
    return 2 * F.size(F.filter(t.words, lambda w: w.rlike(UPPER_CASE) & ~w.rlike(LOWER_CASE))) > t.n_words


def _no_letters(t: Text) -> Column:
    return 100 * F.size(F.filter(t.words, lambda w: ~w.rlike(r"\p{L}"))) > 40 * t.n_words


def _bullets(t: Text) -> Column:
    return let(t.lines, lambda x: 100 * F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09]*[-•▪●]"))) > 90 * F.size(x))


def _ellipses(t: Text) -> Column:
    return let(t.lines, lambda x: 100 * F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))) > 30 * F.size(x))


#: What every text has to pass before the method's own rules.
BASE = [Rule("few_words", _few_words), Rule("repeats", _repeats)]
RULES = [
    Rule("word_length", _word_length), Rule("symbols", _symbols), Rule("dup_lines", _dup_lines),
    Rule("upper_case", _upper_case), Rule("no_letters", _no_letters), Rule("bullets", _bullets),
    Rule("ellipses", _ellipses),
]


def _text_of(docs: DataFrame) -> DataFrame:
    """The text and its words; the words are used so often that no rule splits the text again."""
    return docs.select(F.col("text").alias("text"), split_words(F.col("text")).alias("words"))


def estimate(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds on the sample, share rejected), from about ``rows`` rows chosen by hash of the text.

    The rows serve only to order the rules.
    """
    total = docs.count()
    share = min(1.0, rows / max(total, 1))
    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = frozen(_text_of(part), "quality-sample")
    t = Text(F.col("text"), F.col("words"))

    def timed(column: Column) -> tuple[float, int, int]:
        start = time.perf_counter()
        n, hit = sample.agg(F.count(F.lit(1)), F.count_if(column)).first()
        return time.perf_counter() - start, n, hit

    floor = min(timed(F.size("words") < 0)[0] for _ in range(2))
    found = []
    for rule in rules:
        seconds, n, hit = timed(rule.rejects(t))
        found.append((rule, max(seconds - floor, 1e-3), hit / max(n, 1)))
    return found


def ordered(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per cost first; ties by name."""
    return [r for r, _, _ in sorted(estimates, key=lambda x: (-x[2] / x[1], x[1], x[0].name))]


def first_failure(t: Text, rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the text, or null; later rules are not evaluated."""
    chain = None
    for r in rules:
        chain = F.when(r.rejects(t), r.name) if chain is None else chain.when(r.rejects(t), r.name)
    return F.lit(None).cast("string") if chain is None else chain


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    rules = ordered(estimate(docs, BASE + RULES if rules is None else rules))
    df = with_row(docs, text=F.col("text"), words=split_words(F.col("text")))
    return rows_only(df.where(first_failure(Text(F.col("text"), F.col("words")), rules).isNull()))


def judge(docs: DataFrame) -> DataFrame:
    """Base measures of every text, whether the base rules fail, and the verdict of the cascade."""
    rules = ordered(estimate(docs, RULES))
    t = Text(F.col("text"), F.col("words"))
    df = docs.select("doc_id", F.col("text").alias("text"), split_words(F.col("text")).alias("words"))
    df = df.select(
        "doc_id", "text", "words",
        t.n_words.alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(t).alias("n_repeat_words"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    failed = F.when(F.col("base_failed"), "base").otherwise(first_failure(t, rules))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        failed.isNull().alias("kept"),
    )


MEASURES_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
w AS (SELECT rid, doc_id, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, unnest(range(1, len(words) - 6)) AS pos,
  unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i+7], ' '))) AS win FROM w WHERE len(words) > 8),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(reach) AS n FROM (
  SELECT rid, least(8, coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos) - pos, 8)) AS reach FROM twice) GROUP BY rid),
m AS (SELECT w.rid, doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  (word_chars < 2 * n_words OR word_chars > 14 * n_words
   OR 10 * n_symbols > n_words
   OR 100 * n_dup_lines > 50 * len(lines)
   OR 2 * len(list_filter(words, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$'))) > n_words
   OR 100 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > 40 * n_words
   OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-•▪●]'))) > 90 * len(lines)
   OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) > 30 * len(lines)) AS own_failed
  FROM m)"""


@query(
    "WITH " + MEASURES_SQL.format(docs="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT own_failed AS kept FROM v"""
)
def op1_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
