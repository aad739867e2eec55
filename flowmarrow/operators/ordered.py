"""Building blocks for results that depend on a global order or on a whole group.

None of them puts an unbounded group on one task: prefix sums run over value ranges,
row numbers come from a range-partitioned sort, and group statistics are joined back
with salt on the keys that hold more than a thousandth of the rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmarrow.session import frozen

#: Ranges whose totals are summed together.
BLOCK = 1024
HOT_SHARE = 1000
BROADCAST_ROWS = 100_000
BROADCAST_WIDTH = 1_000
NARROW_ABOVE = 1_000
ONE_RANGE = 100_000
ONE_AGGREGATE = 1_000_000
#: Accuracy of the percentile sketch: ranks are off by at most a share of 1 / SKETCH.
SKETCH = 10_000


def with_range(df: DataFrame, key: str, bounds: list[float], name: str = "_range") -> DataFrame:
    """Add the number of bounds at or below ``key`` (a binary search inside the JVM)."""
    if not bounds:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *[float(b) for b in bounds], float("inf")]
    return Bucketizer(splits=splits, inputCol=key, outputCol=name).transform(df)


def value_table(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """One row per distinct ``key`` with the given sums, frozen in the shared folder.

    The input is read once, with map-side combine; everything that follows (range bounds, range
    totals, running sums, several searches) reads this narrow table. A value that holds a third
    of the rows is a single row in it.
    """
    present = df.filter(F.col(key).isNotNull())
    return frozen(present.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "values")


def prefix_sums(
    table: DataFrame, key: str, values: list[str], by: list[str] = (), range_rows: int | None = None, block: int | None = None
) -> DataFrame:
    """Running ``cum_v`` and overall ``all_v`` over a table of distinct keys (``value_table``), in every group of ``by``.

    A table of few rows is one range; any other is cut into ranges of (by, key) of about ``range_rows`` rows, however many that
    makes. Sums run inside a range, over the ranges of a block of ranges, and over the blocks, so no task sees more
    than a range, a block of totals, or a total per block.
    """
    rows, by = table.count(), list(by)
    range_rows, block = range_rows or ONE_RANGE, block or BLOCK
    together = by or [F.lit(1)]
    if rows <= range_rows:
        overall = Window.partitionBy(*together)
        upto = overall.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        running = {f"cum_{v}": F.sum(v).over(upto) for v in values}
        return table.withColumns({**running, **{f"all_{v}": F.sum(v).over(overall) for v in values}})
    ranges = table.repartitionByRange(-(-rows // max(range_rows, 1)), *by, key)
    placed = frozen(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("_range", *by).agg(*[F.sum(v).alias(v) for v in values])
    totals = frozen(totals.withColumn("_block", F.floor(F.col("_range") / block)), "range-totals")
    before = lambda w, place: w.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sum_over = lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0))
    in_block = before(Window.partitionBy("_block", *by), "_range")
    over_blocks = before(Window.partitionBy(*together), "_block")
    blocks = totals.groupBy("_block", *by).agg(*[F.sum(v).alias(v) for v in values])
    blocks = blocks.select(
        F.col("_block").alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in by],
        *[sum_over(v, over_blocks).alias(f"_w_{v}") for v in values],
        *[F.sum(v).over(Window.partitionBy(*together)).alias(f"all_{v}") for v in values],
    )
    same = lambda prefix: [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by]
    offsets = totals.withColumns({f"_i_{v}": sum_over(v, in_block) for v in values})
    offsets = offsets.join(blocks, reduce(lambda a, b: a & b, [F.col("_block") == F.col("_b"), *same("_b_")])).select(
        F.col("_range").alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in by],
        *[(F.col(f"_i_{v}") + F.col(f"_w_{v}")).alias(f"_o_{v}") for v in values], *[f"all_{v}" for v in values],
    )
    inside = Window.partitionBy("_range", *by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({f"_c_{v}": F.sum(v).over(inside) for v in values})
    met = running.join(offsets, reduce(lambda a, b: a & b, [F.col("_range") == F.col("_r"), *same("_r_")]))
    return met.select(
        *table.columns, *[(F.col(f"_c_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values], *[f"all_{v}" for v in values]
    )


def _value_counts(df: DataFrame, value: str, weight: str | None) -> DataFrame:
    """Distinct values with their row counts; a weighted input is such a table already."""
    number = F.col(value).cast("double").alias("value")
    if weight is None:
        return value_table(df.select(number), "value", {"n": F.lit(1)})
    return df.select(number, F.col(weight).cast("long").alias("n")).filter("value IS NOT NULL")


def ranked_values(table: DataFrame) -> DataFrame:
    """Distinct values with the half-open interval [first, last) of their sorted positions."""
    sums = prefix_sums(table, "value", ["n"])
    return sums.select(
        "value", (F.col("cum_n") - F.col("n")).alias("first"), F.col("cum_n").alias("last"),
        F.col("all_n").alias("total"),
    )


def _candidate_shares(shares: list[float]) -> Column:
    """The shares a value may hold: all of a short list, a slice of an evenly spaced long one."""
    everything = F.array(*[F.lit(s) for s in shares])
    if len(shares) < 32:
        return everything
    step = (shares[-1] - shares[0]) / (len(shares) - 1)
    if any(abs(s - shares[0] - i * step) > 1e-9 for i, s in enumerate(shares)):
        return everything
    steps = F.greatest(F.col("total") - 1, F.lit(1))
    index = lambda position: (position / steps - shares[0]) / step
    start = F.greatest(F.floor(index(F.col("first") - 1)) - 1, F.lit(0))
    stop = F.ceil(index(F.col("last"))) + 2
    length = F.greatest(stop - start, F.lit(0))
    return F.slice(everything, (start + 1).cast("int"), length.cast("int"))


def percentiles(
    df: DataFrame, value: str, shares: list[float], weight: str | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, as rows ``(share, value)``.

    ``shares`` run from 0 to 1. A checked-small number of distinct values goes through the built-in
    aggregate. Otherwise each share needs the values at two sorted positions, and a value keeps the
    shares whose positions fall into its interval, so nothing is held per group.
    """
    table = _value_counts(df, value, weight)
    if table.count() <= ONE_AGGREGATE:
        listed = F.array(*[F.lit(float(s)) for s in shares])
        found = table.agg(F.percentile("value", listed, F.col("n")).alias("v"))
        pairs = F.arrays_zip(listed.alias("share"), F.col("v").alias("value"))
        return found.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()
    ranked = ranked_values(table)
    wanted = _candidate_shares([float(s) for s in shares])
    low = lambda s: F.floor(s * (F.col("total") - 1))
    high = lambda s: F.ceil(s * (F.col("total") - 1))
    inside = lambda p: (p >= F.col("first")) & (p < F.col("last"))
    if len(shares) < 32:  # plain comparisons first: few values hold any of few shares
        near = [inside(end(F.lit(float(s)))) for s in shares for end in (low, high)]
        ranked = ranked.filter(reduce(lambda a, b: a | b, near))
    hits = ranked.select(
        "value",
        "total",
        F.filter(wanted, lambda s: inside(low(s))).alias("lows"),
        F.filter(wanted, lambda s: inside(high(s))).alias("highs"),
    ).filter((F.size("lows") > 0) | (F.size("highs") > 0))
    ends = hits.select(
        "value", "total", F.explode(F.array_union("lows", "highs")).alias("share"), "lows", "highs"
    )
    picked = ends.groupBy("share").agg(
        F.max(F.when(F.array_contains("lows", F.col("share")), F.col("value"))).alias("lo"),
        F.max(F.when(F.array_contains("highs", F.col("share")), F.col("value"))).alias("hi"),
        F.max("total").alias("total"),
    )
    position = F.col("share") * (F.col("total") - 1)
    weight = position - F.floor(position)
    return picked.select(
        "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * weight).alias("value")
    )


def percentile_values(
    df: DataFrame, value: str, shares: list[float], weight: str | None = None
) -> list[float]:
    """The same percentiles as a short list on the driver (one number per share)."""
    found = {r["share"]: r["value"] for r in percentiles(df, value, shares, weight).collect()}
    return [found[float(s)] for s in shares] if found else []


def percentile_value(df: DataFrame, value: str, share: float, rows: int | None = None) -> float | None:
    """The exact percentile with linear interpolation of a column, without moving its rows; null without values.

    A mergeable sketch brackets the two sorted positions that count. One pass counts the rows below the bracket and
    inside it; while that is many rows, the sketch is taken again inside. Only the values in the last bracket, counted
    per task, are shuffled. A bracket that misses a position (the counts show it) is widened.
    """
    rows = ONE_AGGREGATE if rows is None else rows
    held = df.select(F.col(value).cast("double").alias("value")).filter("value IS NOT NULL").persist()
    try:
        n = held.count()
        if n == 0:
            return None
        low, high = math.floor(share * (n - 1)), math.ceil(share * (n - 1))
        inside, below, count, margin = held, 0, n, 2.0 / SKETCH
        while count > rows:
            at = lambda position, m: min(1.0, max(0.0, (position - below) / count + m))
            shares = F.array(F.lit(at(low, -margin)), F.lit(at(high, margin)))
            first, last = inside.agg(F.percentile_approx("value", shares, SKETCH).alias("b")).first()["b"]
            part = inside.filter(F.col("value").between(first, last))
            seen = inside.agg(F.count_if(F.col("value") < first).alias("under"), F.count_if(F.col("value").between(first, last)).alias("n")).first()
            if not (below + seen["under"] <= low and high < below + seen["under"] + seen["n"]):
                margin *= 4
                continue
            if seen["n"] == count or first == last:
                inside, below, count = part, below + seen["under"], seen["n"]
                break
            inside, below, count, margin = part, below + seen["under"], seen["n"], 2.0 / SKETCH
        counts = value_table(inside, "value", {"n": F.lit(1)})
        sums = prefix_sums(counts, "value", ["n"])
        holds = lambda p: (F.col("cum_n") - F.col("n") + below <= p) & (p < F.col("cum_n") + below)
        found = sums.filter(holds(low) | holds(high)).agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
        return found["a"] + (found["b"] - found["a"]) * (share * (n - 1) - low)
    finally:
        held.unpersist()


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, width: int = BROADCAST_WIDTH) -> bool:
    """Whether a table (materialised, so cheap to read) is proven small enough to broadcast."""
    sizes = [F.coalesce(F.length(c), F.lit(0)) if t == "string" else F.lit(16) for c, t in df.dtypes]
    seen = df.agg(F.count("*").alias("n"), F.max(reduce(lambda a, b: a + b, sizes)).alias("w")).first()
    return seen["n"] <= rows and (seen["w"] or 0) <= width


def salted_pair(
    df: DataFrame, other: DataFrame, counts: DataFrame, keys: list[str], weight: str, row_id: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Both join sides with a ``_salt`` column that splits the hot keys of ``df``.

    ``counts`` (a frozen table) has the rows of ``df`` per key in ``weight``. A key above 1/HOT_SHARE of all rows is
    split in proportion. At most HOT_SHARE keys can be that large, which bounds the broadcast list
    and the copies on the other side. Rows with a null key match nothing and are spread by id.
    """
    total = counts.agg(F.sum(weight).alias("total")).first()["total"] or 1
    splits = F.ceil(F.col(weight) * HOT_SHARE / F.lit(total)).cast("int")
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    hot = frozen(counts.filter(is_hot).select(*keys, splits.alias("_splits")), "hot-keys")
    spread = F.xxhash64(*row_id)
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    salt = (
        F.when(any_null, F.pmod(spread, F.lit(HOT_SHARE)))
        .when(F.col("_splits").isNotNull(), F.pmod(spread, F.col("_splits")))
        .otherwise(F.lit(0))
    )
    left = df.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("int")).drop("_splits")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)
    right = other.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies))
    return left, right.drop("_splits")


def with_group_stats(
    df: DataFrame,
    stats: DataFrame,
    keys: list[str],
    weight: str,
    row_id: list[str],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left-join per-group statistics back to the rows, safe for hot and null keys.

    The statistics are frozen, so the rows are aggregated once. A checked-small table is
    broadcast and the rows do not move. Otherwise hot groups are salted by ``weight``, the row
    count of a group.
    """
    stats = frozen(stats, "group-stats")
    if small_enough(stats, broadcast_rows):
        return df.join(F.broadcast(stats), keys, "left")
    left, right = salted_pair(df, stats, stats.select(*keys, weight), keys, weight, row_id)
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def first_rows(df: DataFrame, order: list[str], n: int, newest: bool = False) -> DataFrame:
    """The first ``n`` rows by ``order`` (the last ones with ``newest``).

    A plain top-n ships n rows of every task to one place. While far more rows than that remain,
    the range of the first order column is narrowed by an approximate percentile.
    """
    lead = F.col(order[0])
    if dict(df.dtypes)[order[0]].startswith("timestamp"):
        lead = F.unix_micros(lead.cast("timestamp"))
    rows, total = df, df.count()
    while total > NARROW_ABOVE * n:
        share = max(4.0 * n / total, 0.001)
        pick = 1.0 - share if newest else share
        bound = rows.agg(F.percentile_approx(lead, pick, 10000).alias("b")).first()["b"]
        if bound is None:
            break
        narrow = rows.filter(lead >= bound if newest else lead <= bound)
        left = narrow.count()
        if left < n or left > total // 2:
            break
        rows, total = narrow, left
    return rows.orderBy(*[F.desc(c) if newest else F.asc(c) for c in order]).limit(n)


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """Global row number (from 0) by ``order``, without a single-task window.

    A range-partitioned sort gives each row its partition and position; freezing the rows fixes
    both, so a lost executor cannot change them. Offsets are one row per partition.
    """
    placed = frozen(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("_place", 33)
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + inside)
        .drop("_part", "_base", "_place")
    )
