"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ten consecutive words (an item of fewer words is one window). A window is the
set of its word shingles; a text contains it only if it contains every one of them, so the rarest shingle alone is a
necessary prefix. The documents are scanned once for shingles that occur in the benchmark; these occurrences give the
frequencies of the shingles, hence the order by rarity, and the windows of which every shingle occurs. Occurrences of
prefix shingles give candidate places, bounded by the position of the shingle in its window and by the length of the
text, and a place counts if every shingle of the window stands there in turn. Shingles are compared by 64-bit hash, a
window of ten words by six of them. The texts themselves are never shuffled.

Null and empty texts have no words: no hits as documents, no windows as items. Items without an id mark words but are
neither counted nor listed; rows of one item id are one item. Equal texts have equal results, whatever their ids.
All steps are keyed by the text's digest, and tables that meet the documents are written first, so that Spark can split
a text with very many copies in every join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.text import let, lower_ascii, query, rows_only, split_words, table, whole, with_row
from flowmarrow.session import frozen

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
#: Shingles of the benchmark (8 bytes each) that are sent to all executors at most; more are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def shingles(words: Column, size: int) -> Column:
    """A hash for the run of ``size`` words at each position, null where the text ends before."""

    def runs(h):
        return F.transform(
            h, lambda x, i: F.when(i <= F.size(h) - size, F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window, len): the distinct windows of every item."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("len", F.least(F.lit(WINDOW), F.size("words")))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)
    texts = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("len")), " "))
    return w.select("item_id", "len", F.explode(texts).alias("window")).distinct()


def _window_shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(window, len, off, sh): the shingles of every distinct window, of five words or of all if it has fewer."""
    w = windows.select("window", "len").distinct().withColumn("words", F.split("window", " "))
    picked = F.lit(None).cast("array<bigint>")
    for k in sizes:
        picked = F.when(F.least(F.col("len"), F.lit(SHINGLE)) == k, shingles(F.col("words"), k)).otherwise(picked)
    return w.select("window", "len", F.posexplode(picked).alias("off", "sh")).where("sh IS NOT NULL")


def _occurrences(docs: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, n, pos, sh): where the texts contain shingles of the benchmark."""
    d = docs.select(F.md5(whole(F.col("text"))).alias("key"), words_of(F.col("text")).alias("words"))
    d = d.select("key", F.size("words").alias("n"), F.concat(*[shingles(F.col("words"), k) for k in sizes]).alias("runs"))
    d = d.select("key", "n", F.posexplode("runs").alias("pos", "sh"))
    if wanted.count() <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)
    return d.join(wanted, "sh").select("key", "n", (F.col("pos") % F.col("n")).alias("pos"), "sh")


def _rarest(found: DataFrame, parts: DataFrame) -> DataFrame:
    """(window, len, n_shingles, off, sh): the rarest shingle of every window whose shingles all occur."""
    counts = found.groupBy("sh").agg(F.count(F.lit(1)).alias("n_found"))
    least = parts.join(counts, "sh", "left").groupBy("window", "len").agg(
        F.min(F.struct("n_found", "off", "sh")).alias("first"),
        F.bool_and(F.col("n_found").isNotNull()).alias("all"),
        F.count(F.lit(1)).alias("n_shingles"),
    )
    return least.where("all").select("window", "len", "n_shingles", "first.off", "first.sh")


def occurring_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, start, len, window): every place of a window in a distinct text, from word 0."""
    sizes = sorted(r[0] for r in windows.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # five at most
    if not sizes:
        sizes = [SHINGLE]
    parts = frozen(_window_shingles(windows, sizes), "window-shingles")
    found = frozen(_occurrences(docs, parts.select("sh").distinct(), sizes).distinct(), "shingle-places")
    places = found.join(_rarest(found, parts), "sh").withColumn("start", F.col("pos") - F.col("off"))
    places = places.where("start >= 0 AND start + len <= n").select("key", "start", "len", "window", "n_shingles")
    places = frozen(places, "window-candidates")
    due = places.join(parts, ["window", "len"]).withColumn("pos", F.col("start") + F.col("off"))
    met = due.join(found.select("key", "pos", "sh"), ["key", "pos", "sh"])
    met = met.groupBy("key", "start", "len", "window").agg(F.count(F.lit(1)).alias("n_met"), F.first("n_shingles").alias("n_shingles"))
    return met.where("n_met = n_shingles").select("key", "start", "len", "window")


def hits_by_text(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, n_hit, items): words inside windows, and the items whose windows occur, for every contaminated text."""
    windows = frozen(item_windows(items), "item-windows")
    seen = frozen(occurring_windows(docs, windows), "window-places")

    def covered(p):
        reach = lambda x, i: F.least(x["len"], F.coalesce(F.get(p, i + 1)["start"] - x["start"], x["len"]))
        return F.aggregate(F.transform(p, reach), F.lit(0).cast("long"), lambda a, b: a + b)

    spans = seen.groupBy("key", "start").agg(F.max("len").alias("len")).groupBy("key")
    hit = spans.agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("p"))
    # a shorter run that ends inside the one before it adds nothing
    ends = F.transform("p", lambda x, i: F.struct(x["start"].alias("start"), F.array_max(
        F.transform(F.slice("p", F.greatest(F.lit(1), i - WINDOW + 2), F.least(i + 1, F.lit(WINDOW))), lambda y: y["start"] + y["len"])
    ).alias("end")))
    hit = hit.select("key", let(F.transform(ends, lambda x: F.struct(x["start"].alias("start"), (x["end"] - x["start"]).alias("len"))), covered).alias("n_hit"))
    pairs = seen.select("key", "window", "len").distinct().join(windows, ["window", "len"])
    listed = pairs.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return hit.join(listed, "key")


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contamination figures of every document."""
    found = frozen(hits_by_text(docs, items), "contaminated")
    d = docs.select("doc_id", F.md5(whole(F.col("text"))).alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return d.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    found = frozen(hits_by_text(docs, items).select("key"), "contaminated")
    return rows_only(with_row(docs, key=F.md5(whole(F.col("text")))).join(found, "key", "left_anti"))


JUDGED_SQL = r"""
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, unnest(list_transform(range(1, len(words) - least(10, len(words)) + 2),
  lambda i: array_to_string(words[i:i + least(10, len(words)) - 1], ' '))) AS win FROM iw WHERE len(words) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM {docs}),
runs AS (SELECT rid, n, unnest(range(1, len(words) - n + 2)) AS pos,
  unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT n FROM win) l WHERE len(words) >= l.n),
seen AS (SELECT DISTINCT rid, pos, n, item_id FROM runs JOIN win USING (n, win)),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + n)) AS w FROM seen) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM seen GROUP BY rid)"""


@query(
    "WITH " + JUDGED_SQL.format(docs="documents") + """
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""
)
def op10_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
