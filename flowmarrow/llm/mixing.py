"""Mixing sources to target weights.

Every document gets a hash-random key. The documents of each source are range-sorted by it, running word counts are
summed inside the ranges and across them, and the mix takes whole epochs of a source plus the documents up to the
point where its budget is used up; the document at that point gives only the words that are still missing. So a
source contributes exactly the whole words of its target. Everything is DataFrame work on narrow rows; texts are read,
not shuffled, and no source is one task, however large.

Targets: sources in code point order, null last, take the weights in turn. Together they get ``share`` times all words;
no source gets more than ``most`` times its own, and what it cannot take goes to the others by weight.

Null and empty texts have size 0 and give nothing; a null source is a source of its own; null ids and repeated rows
are documents like any other (equal rows are interchangeable, so it does not matter which of them the cut meets).
An empty table gives no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmarrow.llm.text import query, rows_only, split_words, table, whole, with_row
from flowmarrow.session import frozen

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = Fraction(2)
SOURCE = ["no_source", "src"]
EXACT = "decimal(38,0)"


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A hash of the seed, the id and the text, so that null and repeated ids are spread as well."""
    return F.md5(F.concat_ws(":", F.lit(seed), whole(doc_id), F.md5(whole(text))))


def running(df: DataFrame, group: list[str], order: list[str], values: list[str], facts: DataFrame | None = None) -> DataFrame:
    """The rows with ``<v>_before``, the sum of ``v`` over the earlier rows of their group.

    Rows are cut into ranges of (group, order); sums run inside the ranges, and a table with one row for each range and
    group carries the offsets. Equal rows are spread over ranges too. ``facts`` holds one row per group to join on the way.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    ranges = df.withColumn("spread", spread).repartitionByRange(*group, *order, "spread")
    placed = frozen(ranges.withColumn("part", F.spark_partition_id()), "mix-ranges")
    place = ["part", *group]
    earlier = Window.partitionBy(*group) if group else Window.partitionBy()
    earlier = earlier.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*place).agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select(*place, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_offset") for v in values])
    if facts is not None:
        offsets = offsets.join(facts, group)
    inside = Window.partitionBy(*place).orderBy(*order, "spread").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.withColumns({f"{v}_inside": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(offsets, place)
    sums = sums.withColumns({f"{v}_before": F.col(f"{v}_inside") + F.col(f"{v}_offset") for v in values})
    return sums.drop("spread", "part", *[f"{v}_{x}" for v in values for x in ("inside", "offset")])


def exact(value: int) -> Column:
    return F.lit(str(value)).cast(EXACT)


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: Fraction = MOST
) -> DataFrame:
    """(no_source, src, source_size, target, budget) of a table (no_source, src, source_size).

    A common level per unit of weight fills all sources; those whose limit lies below it are full. The level follows
    from running sums over the sources by limit per weight, in whole numbers, so that no rounding decides.
    """
    unit = math.lcm(share.denominator, most.denominator)
    common = math.lcm(*weights)
    ranked = running(sources.withColumn("rank", F.lit(1).cast("long")), [], SOURCE, ["rank"])
    turn = (F.col("rank_before") % len(weights) + 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn)
    limit = F.col("source_size").cast(EXACT) * int(most * unit)
    steep = F.element_at(F.array(*[F.lit(common // w) for w in weights]), turn)
    weighted = ranked.select(
        *SOURCE, "source_size", weight.cast(EXACT).alias("weight"), limit.cast(EXACT).alias("limit"),
        (limit * steep).cast(EXACT).alias("reach"),
    )
    weighted = frozen(weighted, "mix-sources")
    whole_sum = weighted.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, all_weight = int(share * unit * int(whole_sum["size"] or 0)), int(whole_sum["weight"] or 0)
    by_reach = running(weighted, [], ["reach", *SOURCE], ["limit", "weight"])
    fits = (exact(total) - F.col("limit_before")) * common <= F.col("reach") * (exact(all_weight) - F.col("weight_before"))
    first = by_reach.where(fits).agg(F.min(F.struct("reach", *SOURCE, "limit_before", "weight_before")).alias("x")).first()["x"]
    full, full_budget = F.col("limit").cast("double") / unit, F.expr(f"`limit` div {unit}")
    if first is None:  # even all limits together are below the share
        return weighted.select(*SOURCE, "source_size", full.alias("target"), full_budget.alias("budget"))
    left, over = total - int(first["limit_before"]), unit * (all_weight - int(first["weight_before"]))
    level = F.col("weight") * exact(left)
    below = F.col("reach") * over >= exact(left) * (common * unit)
    return weighted.select(
        *SOURCE, "source_size",
        F.when(below, level.cast("double") / F.lit(float(over))).otherwise(full).alias("target"),
        F.when(below, F.expr(f"(weight * cast('{left}' as {EXACT})) div {over}")).otherwise(full_budget).alias("budget"),
    )


def keyed(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, no_source, src, size, key) of every document."""
    return docs.select(
        "doc_id", F.col("source").isNull().alias("no_source"), whole(F.col("source")).alias("src"),
        n_words(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
    )


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    most: Fraction = MOST,
    seed: str = "mix",
) -> DataFrame:
    """What the mix takes of every document of (doc_id, text, source).

    ``epochs`` is how often the whole source is taken, ``rest`` how many words of it are taken once more, in the order of
    the keys; ``taken`` counts the words of the document with all repeats.
    """
    base = frozen(keyed(docs, seed), "mix-keys")
    sizes = base.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    facts = targets(frozen(sizes, "mix-sizes"), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    facts = facts.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    rows = running(base, SOURCE, ["key", "size"], ["size"], facts)
    once_more = F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("size_before")))
    return rows.withColumn("taken", F.col("epochs") * F.col("size") + once_more)


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    most: Fraction = MOST,
    seed: str = "mix",
) -> DataFrame:
    """The documents of the mix with all their columns, once for each epoch that takes them.

    The text of a document at a cut is shortened to the words taken (joined by blanks). Documents without words are not
    in the mix. Texts are only scanned: a document compares its key with the last key its source takes in the epoch that
    is not whole, and only the few rows with that very key are gathered.
    """
    rows = plan(docs, weights, share, most, seed)
    last = rows.where("size > 0 AND size_before < rest").groupBy(*SOURCE, "key").agg(F.min("size_before").alias("start"))
    last = last.groupBy(*SOURCE).agg(F.max(F.struct("key", "start")).alias("last"))
    per_source = rows.groupBy(*SOURCE).agg(F.any_value("epochs").alias("epochs"), F.any_value("rest").alias("rest"))
    cuts = per_source.join(last, SOURCE, "left").select(
        F.col("no_source").alias("cut_none"), F.col("src").alias("cut_src"), "epochs", F.col("last.key").alias("cut_key"),
        (F.col("rest") - F.col("last.start")).alias("words"),
    )
    cuts = frozen(cuts, "mix-cuts")
    own = with_row(
        docs, no_source=F.col("source").isNull(), src=whole(F.col("source")), size=n_words(F.col("text")),
        key=random_key(F.col("doc_id"), F.col("text"), seed),
    ).where("size > 0")
    met = own.join(cuts, (F.col("no_source") == F.col("cut_none")) & (F.col("src") == F.col("cut_src")))
    times = F.col("epochs") + F.when(F.col("key") < F.col("cut_key"), 1).otherwise(0)
    full = met.where(times > 0).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    at_cut = met.where("key = cut_key").groupBy(*SOURCE, "key").agg(*[F.any_value(c).alias(c) for c in ("row", "size", "words")])
    pieces = F.sequence(F.lit(0).cast("long"), F.expr("(words - 1) div size"))
    at_cut = at_cut.withColumn("piece", F.explode(pieces)).withColumn("left", F.col("words") - F.col("piece") * F.col("size"))
    start = F.array_join(F.slice(split_words(F.col("row.text")), F.lit(1), F.col("left").cast("int")), " ")
    shorter = F.when(F.col("left") < F.col("size"), start).otherwise(F.col("row.text"))
    return rows_only(full.select("row")).unionByName(rows_only(at_cut.select(F.col("row").withField("text", shorter).alias("row"))))


@query(
    r"""WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT no_source, src, CAST(sum(size) AS HUGEINT) AS source_size,
  CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY no_source, src) - 1) % 3] AS HUGEINT) AS w FROM d GROUP BY no_source, src),
r AS (SELECT *, 4 * source_size AS lim, 4 * source_size * (6 // w) AS reach FROM s),
f AS (SELECT *, CAST(sum(3 * source_size) OVER () - coalesce(sum(lim) OVER b, 0) AS HUGEINT) AS rem,
  CAST(2 * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS HUGEINT) AS unfilled
  FROM r WINDOW b AS (ORDER BY reach, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rem, unfilled FROM f WHERE 12 * rem <= reach * unfilled ORDER BY reach, no_source, src LIMIT 1),
t AS (SELECT no_source, src, source_size, CASE WHEN reach * unfilled >= 12 * rem THEN CAST(w * rem AS DOUBLE) / CAST(unfilled AS DOUBLE)
    ELSE CAST(lim AS DOUBLE) / 2 END AS target,
  CASE WHEN reach * unfilled >= 12 * rem THEN (w * rem) // unfilled ELSE lim // 2 END AS budget
  FROM r, l),
p AS (SELECT d.*, t.source_size, t.target, t.budget,
  coalesce(sum(size) OVER (PARTITION BY d.no_source, d.src ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM d JOIN t ON d.no_source = t.no_source AND d.src = t.src)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
    + least(size, greatest(0, budget % source_size - before_)) END AS BIGINT) AS taken FROM p"""
)
def op13_mix_sources(spark, sf_dir):
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
