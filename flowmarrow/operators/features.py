"""Flow features: ratios, port entropy per host, connection rate, aligned projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmarrow.functions.columns import guarded_ratio, lenient_double, numeric_or_zero
from flowmarrow.operators.ordered import with_group_stats, with_ordinal
from flowmarrow.schemas import BASE_NUMERIC, FEATURES


def coerce_numeric(df: DataFrame, columns: list[str] = BASE_NUMERIC) -> DataFrame:
    """Numeric columns as doubles; unparsable or missing cells become 0."""
    return df.withColumns({c: numeric_or_zero(c) for c in columns if c in df.columns})


def with_totals_and_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "total_bytes": F.col("orig_bytes") + F.col("resp_bytes"),
            "total_pkts": F.col("orig_pkts") + F.col("resp_pkts"),
            "bytes_ratio": guarded_ratio("orig_bytes", "resp_bytes"),
            "pkts_ratio": guarded_ratio("orig_pkts", "resp_pkts"),
        }
    )


def port_entropy(df: DataFrame, host: str = "orig_h") -> DataFrame:
    """Per host: row count and base-2 entropy of source and destination ports.

    Both port columns go through one aggregation on (host, side, port), combined on the map
    side, so a host that sends a third of the traffic arrives as one row per port.
    """
    sides = F.array(
        F.struct(F.lit("src").alias("side"), F.col("orig_p").cast("long").alias("port")),
        F.struct(F.lit("dst").alias("side"), F.col("resp_p").cast("long").alias("port")),
    )
    per_port = (
        df.filter(F.col(host).isNotNull())
        .select(host, F.explode(sides).alias("s"))
        .groupBy(host, "s.side", "s.port")
        .agg(F.count("*").alias("n"))
    )

    def entropy(side: str):
        n = F.when((F.col("side") == side) & F.col("port").isNotNull(), F.col("n"))
        spread = F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
        return F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(0.0))

    return per_port.groupBy(host).agg(
        F.sum(F.when(F.col("side") == "src", F.col("n"))).alias("n_conns"),
        entropy("src").alias("src_port_entropy"),
        entropy("dst").alias("dst_port_entropy"),
    )


def connections_per_minute(df: DataFrame, host: str = "orig_h", ts: str = "ts") -> DataFrame:
    return (
        df.filter(F.col(host).isNotNull() & F.col(ts).isNotNull())
        .groupBy(host, F.date_trunc("minute", F.col(ts)).alias("minute"))
        .agg(F.count("*").alias("connections_per_min"))
    )


def connection_features(
    df: DataFrame, row_id: str = "conn_id", host: str = "orig_h", ts: str = "ts"
) -> DataFrame:
    """All twelve features next to the input columns."""
    base = with_totals_and_ratios(coerce_numeric(df))
    keyed = base.withColumn("minute", F.date_trunc("minute", F.col(ts)))
    rates = connections_per_minute(df, host, ts)
    rated = with_group_stats(keyed, rates, [host, "minute"], "connections_per_min", [row_id])
    hosts = port_entropy(df, host)
    full = with_group_stats(rated, hosts, [host], "n_conns", [row_id])
    return full.drop("minute", "n_conns")


def feature_matrix(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The features that are present, in their fixed order, null and NaN as 0."""
    present = [f for f in FEATURES if f in df.columns]
    if not present:
        raise ValueError("no feature column found")
    return df.select(*(keep or []), *[numeric_or_zero(c).alias(c) for c in present])


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def align_columns(df: DataFrame, wanted: list[str], keep: list[str] | None = None) -> DataFrame:
    """Exactly the wanted feature columns, in order; absent ones as 0.0, null cells as 0.0."""
    missing = set(missing_columns(df, wanted))
    if len(missing) == len(wanted):
        raise ValueError("none of the expected feature columns is present")
    cells = [
        F.lit(0.0).alias(c) if c in missing else numeric_or_zero(c).alias(c) for c in wanted
    ]
    return df.select(*(keep or []), *cells)


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


def finite_only(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(lenient_double(c), F.lit(0.0)) for c in columns})


def blocked_rows(
    df: DataFrame,
    features: list[str],
    order: list[str],
    length: int,
    host: str | None = None,
    extra: list[str] = (),
    block: int = 100_000,
) -> DataFrame:
    """Rows with a global ordinal ``_ord`` (by host first, when given) in blocks of ``block`` rows, their features in ``cells``.

    The last ``length - 1`` rows of a block (``_own``) are there again in the next ``_block``, ahead of its own rows.
    """
    sort = [*([host] if host else []), *order]
    cells = F.array(*[numeric_or_zero(c) for c in features]).alias("cells")
    narrow = df.filter(F.col(host).isNotNull()) if host else df
    rows = with_ordinal(narrow.select(*sort, *extra, cells), sort, "_ord")
    own = F.floor(F.col("_ord") / block)
    # a block shorter than a window hands its rows on to every block that one of its windows can end in
    reach = F.floor((F.col("_ord") + length - 1) / block)
    return rows.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, reach)))


def sliding_sequences(
    df: DataFrame,
    features: list[str],
    order: list[str],
    length: int = 10,
    host: str | None = None,
    label: str | None = None,
    block: int = 100_000,
) -> DataFrame:
    """Windows of ``length`` consecutive rows, stride 1; one row per window end.

    Each window function group is a block and the rows it needs from before, so at most ``block + length - 1`` rows, however
    many rows a host has.
    """
    sort = [*([host] if host else []), *order]
    extra = [label] if label else []
    copies = blocked_rows(df, features, order, length, host, extra, block)
    group = Window.partitionBy("_block", *([host] if host else [])).orderBy("_ord")
    window = group.rowsBetween(-(length - 1), 0)
    return (
        copies.withColumn("sequence", F.collect_list("cells").over(window))
        .filter((F.col("_block") == F.col("_own")) & (F.size("sequence") == length))
        .select(*sort, *extra, "sequence")
    )
