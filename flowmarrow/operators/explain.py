"""Explanations, priorities and alert handling, as expressions over feature arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmarrow.functions.columns import severity
from flowmarrow.operators.metrics import trailing_count
from flowmarrow.operators.ordered import with_group_stats
from flowmarrow.session import frozen

# What a deviating feature means. The texts are those an operator console shows.
ACTIONS = {
    "duration": (
        "Uzun süreli bağlantı tespit edildi",
        ["Session timeout kontrolü yapın", "Long-term connection log'larını inceleyin", "C&C communication olasılığını değerlendirin"],
        ["Persistent backdoor", "Data exfiltration", "Tunnel"],
    ),
    "orig_bytes": (
        "Anormal yüksek veri gönderimi",
        ["Data exfiltration araştırması yapın", "Gönderilen dosya/veri tiplerini kontrol edin", "Hedefe giden trafik içeriğini analiz edin"],
        ["Data theft", "Database dump", "File upload"],
    ),
    "resp_bytes": (
        "Anormal yüksek veri indirimi",
        ["Malware indirme olasılığını kontrol edin", "Payload analizi yapın", "C&C server iletişimini araştırın"],
        ["Malware download", "C&C communication", "Exploit payload"],
    ),
    "orig_pkts": (
        "Fazla paket gönderimi",
        ["Port scan aktivitesi kontrol edin", "DDoS saldırısı olasılığını değerlendirin", "Packet içeriklerini inceleyin"],
        ["Port scanning", "Network mapping", "Flood attack"],
    ),
    "resp_pkts": (
        "Fazla paket alımı",
        ["DDoS reflection olasılığını kontrol edin", "Service enumeration araştırın", "Response pattern'ini analiz edin"],
        ["Service scan", "DDoS reflection", "Amplification"],
    ),
    "bytes_ratio": (
        "Anormal upload/download oranı",
        ["Trafik akışını analiz edin", "Upload/Download dengesizliğini inceleyin", "Olası backdoor iletişimini araştırın"],
        ["Asymmetric communication", "Covert channel"],
    ),
    "throughput": (
        "Anormal veri transfer hızı",
        ["Bandwidth usage'ı monitör edin", "Bulk data transfer'i araştırın", "Rate limiting uygulamayı düşünün"],
        ["Bulk transfer", "DDoS", "Bandwidth abuse"],
    ),
    "proto": (
        "Beklenmeyen protokol kullanımı",
        ["Protokol policy'lerini kontrol edin", "Unauthorized protocol usage araştırın", "Firewall rule'larını gözden geçirin"],
        ["Protocol violation", "Tunneling", "Covert channel"],
    ),
    "service": (
        "Anormal servis aktivitesi",
        ["Servis erişim log'larını inceleyin", "Unauthorized service access kontrol edin", "Service fingerprinting araştırın"],
        ["Service abuse", "Exploitation attempt"],
    ),
    "conn_state": (
        "Beklenmeyen bağlantı durumu",
        ["Connection state pattern'ini analiz edin", "Failed connection'ları araştırın", "Reset/timeout sebeplerini kontrol edin"],
        ["Connection tampering", "Scan activity", "DoS"],
    ),
}
UNKNOWN_FEATURE = "Unknown feature"
FIRST_STEPS = [
    ("Verify the alert is not a false positive", "Check if similar behavior exists in historical data"),
    ("Identify the source", "Determine if source IP is internal/external, known/unknown"),
    ("Analyze traffic content", "Inspect payload if possible, check for malicious patterns"),
]
LAST_STEP = (
    "Document findings and take action",
    "Block if malicious, whitelist if benign, escalate if unsure",
)
BONUS = {"LOW": 5, "MEDIUM": 10, "HIGH": 15, "CRITICAL": 20}
TOP_FEATURES = 3


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _action_info(name: Column) -> Column:
    """Constant map lookup with a default; no join needed for ten entries."""
    info = lambda d, a, i: F.struct(
        F.lit(d).alias("description"), _texts(a).alias("actions"), _texts(i).alias("indicators")
    )
    pairs: list[Column] = []
    for feature, entry in ACTIONS.items():
        pairs += [F.lit(feature), info(*entry)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), info(UNKNOWN_FEATURE, [], []))


def _fixed(df: DataFrame, **cells: Column) -> DataFrame:
    """Add columns behind a generator of one row.

    The optimizer neither copies their expressions into later ones nor moves a filter on them
    below, where it would work the nested expressions out many times per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cells.items()]))))


def with_errors(df: DataFrame, original: str, expected: str) -> DataFrame:
    """Absolute errors per feature, their mean, and contributions in percent of the mean."""
    errors = F.zip_with(original, expected, lambda a, b: F.abs(a - b))
    mean = F.aggregate("errors", F.lit(0.0), lambda s, e: s + e) / F.size("errors")
    share = lambda e: F.coalesce(F.try_divide(e, F.col("anomaly_score")), F.lit(0.0)) * 100
    rows = _fixed(_fixed(df, errors=errors), anomaly_score=mean)
    return rows.withColumn("contributions", F.transform("errors", share))


def with_severity(df: DataFrame, threshold: float) -> DataFrame:
    return _fixed(df, severity=severity(F.col("anomaly_score") / F.lit(float(threshold))))


def with_priority(df: DataFrame, threshold: float) -> DataFrame:
    """0..100: size of the error (50), number of far-off features (30), severity bonus (20)."""
    n = F.size("errors")
    size = F.least(F.col("anomaly_score") / F.lit(float(threshold)), F.lit(10.0)) / 10 * 50
    square = F.aggregate(
        "errors", F.lit(0.0), lambda s, e: s + (e - F.col("anomaly_score")) * (e - F.col("anomaly_score"))
    )
    rows = _fixed(df, _far=F.col("anomaly_score") + F.sqrt(square / n))
    spread = F.size(F.filter("errors", lambda e: e > F.col("_far"))) / n.cast("double") * 30
    bonus = F.lit(0)
    for level, points in BONUS.items():
        bonus = F.when(F.col("severity") == level, points).otherwise(bonus)
    total = F.least(F.floor(size + spread + bonus), F.lit(100)).cast("int")
    return _fixed(rows, priority_score=total).drop("_far")


def with_top_features(
    df: DataFrame, names: list[str], original: str, expected: str, k: int = TOP_FEATURES
) -> DataFrame:
    """The ``k`` largest contributions with values and action texts, as an array of structs."""
    order = F.array(*[F.lit(n) for n in names])
    # contribution, then feature position, both descending
    indexed = F.transform("contributions", lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    best = F.slice(F.sort_array(indexed, asc=False), 1, k)
    at = lambda name, i: F.get(F.col(name), i)
    detail = lambda x: F.struct(
        F.get(order, x["i"]).alias("name"),
        x["c"].alias("contribution_percent"),
        at(original, x["i"]).alias("original_value"),
        at(expected, x["i"]).alias("expected_value"),
        at("errors", x["i"]).alias("deviation"),
        _action_info(F.get(order, x["i"])).alias("action_info"),
    )
    return _fixed(df, anomalous_features=F.transform(best, detail))


def with_guidance(df: DataFrame) -> DataFrame:
    """Recommended actions, investigation steps and threats from the top features."""
    top = F.col("anomalous_features")
    listed = F.flatten(
        F.transform(
            top,
            lambda f, i: F.transform(
                f["action_info"]["actions"],
                lambda a: F.struct(
                    a.alias("action"),
                    f["name"].alias("related_feature"),
                    F.when(i == 0, "HIGH").otherwise("MEDIUM").alias("priority"),
                ),
            ),
        )
    )
    # the first mention of an action stays
    texts = F.transform("_listed", lambda x: x["action"])
    first = F.filter("_listed", lambda x, i: F.array_position(F.col("_texts"), x["action"]) == i + 1)
    step = lambda n, a, d: F.struct(
        n.cast("int").alias("step"), a.alias("action"), d.alias("details")
    )
    fixed = [step(F.lit(i + 1), F.lit(a), F.lit(d)) for i, (a, d) in enumerate(FIRST_STEPS)]
    about = F.transform(
        F.slice(top, 1, 2),
        lambda f, i: step(
            i + 4,
            F.concat(F.lit("Investigate "), f["name"], F.lit(" anomaly")),
            f["action_info"]["description"],
        ),
    )
    last = step(F.least(F.size(top), F.lit(2)) + 4, F.lit(LAST_STEP[0]), F.lit(LAST_STEP[1]))
    threats = F.array_distinct(F.flatten(F.transform(top, lambda f: f["action_info"]["indicators"])))
    return (
        _fixed(_fixed(df, _listed=listed), _texts=texts)
        .withColumns(
            {
                "recommended_actions": first,
                "investigation_steps": F.concat(F.array(*fixed), about, F.array(last)),
                "potential_threats": threats,
            }
        )
        .drop("_listed", "_texts")
    )


def explain(
    df: DataFrame,
    names: list[str],
    threshold: float,
    original: str = "original",
    expected: str = "expected",
    info: list[str] | None = None,
    ts: str = "ts",
    urgent_first: bool = False,
) -> DataFrame:
    """The full explanation record of every row; input columns stay in front.

    With ``urgent_first`` the rows come by priority: they are sorted while they are numbers, before the texts join them.
    """
    rows = with_priority(with_severity(with_errors(df, original, expected), threshold), threshold)
    rows = rows.orderBy(F.desc("priority_score")) if urgent_first else rows
    rows = with_guidance(with_top_features(rows, names, original, expected))
    details = F.create_map(
        *[x for c in (info or []) for x in (F.lit(c), F.col(c).cast("string"))]
    ) if info else F.create_map().cast("map<string,string>")
    return rows.withColumns(
        {
            "explanation": F.struct(
                F.col(ts).alias("timestamp"),
                "anomaly_score",
                F.lit(float(threshold)).alias("threshold"),
                "severity",
                "priority_score",
                "anomalous_features",
                "recommended_actions",
                "investigation_steps",
                "potential_threats",
                details.alias("connection_info"),
            )
        }
    )


#: Slices of a busy hour that are ranked apart before the hour is.
SLICES = 64


def top_feature() -> Column:
    return F.col("anomalous_features")[0]["name"]


def filter_alerts(
    df: DataFrame,
    ts: str = "ts",
    row_id: str = "conn_id",
    min_priority: int = 50,
    max_per_hour: int = 100,
    keep: int = 10,
) -> DataFrame:
    """Alerts of enough priority; where the trailing hour is full only the top ``keep`` of each hour remain.

    ``suppressed`` counts the alerts of that hour that went.

    The trailing counts are one row per distinct time and join back as group statistics, so an
    instant with very many alerts is split.
    """
    enough = frozen(df.filter(F.col("priority_score") >= min_priority), "alerts")
    counts = trailing_count(enough.select(ts), ts).withColumnRenamed("ts", "_at")
    timed = enough.withColumn("_at", F.col(ts).cast("timestamp"))
    joined = with_group_stats(timed, counts, ["_at"], "n", [row_id]).drop("_at", "n")
    calm = joined.filter(F.col("recent") < max_per_hour).withColumn("suppressed", F.lit(0).cast("long"))
    busy = joined.filter(F.col("recent") >= max_per_hour).withColumn("_hour", F.date_trunc("hour", ts))
    busy = busy.withColumn("_slice", F.pmod(F.xxhash64(row_id), F.lit(SLICES)))
    # the best of every slice of an hour, then the best of those: no task sees a whole hour
    order = [F.desc("priority_score"), F.col(row_id)]
    best = lambda df, keys: df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= keep)
    top = best(best(busy, ["_hour", "_slice"]), ["_hour"])
    sizes = busy.groupBy(F.col("_hour").alias("_of")).agg((F.count("*") - keep).alias("_over"))
    top = top.join(sizes, F.col("_hour") == F.col("_of")).withColumn("suppressed", F.greatest("_over", F.lit(0)))
    return calm.unionByName(top.drop("_hour", "_slice", "_rank", "_of", "_over"))


def deduplicate_alerts(df: DataFrame, row_id: str = "conn_id") -> DataFrame:
    """Best alert per top feature with the size of its group; one combinable aggregation."""
    best = F.max_by(F.struct(*df.columns), F.struct("priority_score", -F.col(row_id)))
    return (
        df.groupBy(top_feature().alias("top_feature"))
        .agg(best.alias("b"), F.count("*").alias("similar_alerts_count"))
        .select("top_feature", "b.*", "similar_alerts_count")
    )


def explain_all(
    df: DataFrame,
    names: list[str],
    threshold: float,
    original: str = "original",
    expected: str = "expected",
    min_priority: int = 50,
    top: int = 10,
    row_id: str = "conn_id",
    info: list[str] | None = None,
) -> DataFrame:
    """Explain the rows flagged ``prediction = 1`` and keep the most urgent ones."""
    rows = explain(df.filter("prediction = 1"), names, threshold, original, expected, info)
    urgent = rows.filter(F.col("priority_score") >= min_priority)
    return urgent.orderBy(F.desc("priority_score"), row_id).limit(top)


def severity_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("severity").agg(F.count("*").alias("n"))


def top_feature_counts(df: DataFrame, k: int = 5) -> DataFrame:
    names = df.select(F.explode(F.transform("anomalous_features", lambda f: f["name"])).alias("feature"))
    return names.groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(k)


def threat_counts(df: DataFrame, k: int = 10) -> DataFrame:
    threats = df.select(F.explode("potential_threats").alias("threat"))
    return threats.groupBy("threat").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "threat").limit(k)


def alert_summary(df: DataFrame) -> DataFrame:
    """Report head as one row: totals, mean priority and three small maps.

    The explanations are worked out once, into a narrow table that all parts read.
    """
    names = F.transform("anomalous_features", lambda f: F.struct(f["name"].alias("name"))).alias("anomalous_features")
    df = frozen(df.select("severity", "priority_score", names, "potential_threats"), "alerts")
    as_map = lambda rows, key: rows.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("m")
    ).scalar()
    head = df.agg(
        F.count("*").alias("total_anomalies"), F.avg("priority_score").alias("average_priority")
    )
    return head.withColumns(
        {
            "severity_distribution": as_map(severity_distribution(df), "severity"),
            "top_anomalous_features": as_map(top_feature_counts(df), "feature"),
            "common_threats": as_map(threat_counts(df), "threat"),
        }
    )


def dashboard(df: DataFrame, ts: str = "ts") -> DataFrame:
    threats = F.col("potential_threats")
    return df.select(
        F.col(ts).alias("timestamp"),
        "severity",
        F.col("priority_score").alias("priority"),
        "anomaly_score",
        top_feature().alias("top_feature"),
        F.coalesce(F.get(threats, F.lit(0)), F.lit("Unknown")).alias("top_threat"),
    )


def alert_line(scores: dict[str, str]) -> Column:
    """``ANOMALY | src:port -> dst:port | proto=.. | scores: NAME=0.000, ..``; absent scores are left out."""
    parts = [
        F.when(F.col(c).isNotNull(), F.format_string(f"{name}=%.3f", F.col(c).cast("double")))
        for name, c in scores.items()
    ]
    return F.format_string(
        "ANOMALY | %s:%s -> %s:%s | proto=%s | scores: %s",
        *[F.col(c).cast("string") for c in ("orig_h", "orig_p", "resp_h", "resp_p")],
        F.col("proto"),
        F.concat_ws(", ", *parts),
    )
