"""Line dedup: what its plans shuffle and make once, which sets meet, how words are cut."""

import numpy as np
from pyspark.sql import functions as F

from flowmarrow.llm import lines


def _docs(spark, n=60):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    made = [" ".join(rng.choice(words, 12)) for _ in range(n)]
    near = [" ".join(x.split(" ")[:-1] + ["other"]) for x in made]
    return spark.createDataFrame([(i, f"{made[i]}\n{near[(i * 7) % n]}") for i in range(n)], "doc_id long, text string")


def _sets(spark, docs, percent=80):
    found = lines.occurrences(docs, percent).dropDuplicates(["sid"])
    return lines.frozen(found.withColumn("rid", F.monotonically_increasing_id()).withColumn("open", F.lit(True)), "test-sets")


def test_prefix_entries_are_shuffled_once(spark):
    sets = _sets(spark, _docs(spark))
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        pairs = lines.similar_pairs(sets, 80)
        found = {frozenset((r.a, r.b)) for r in pairs.collect()}
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, was)
    assert "ReusedExchange" in plan.split("Initial Plan")[0]
    text = {r.rid: r.line for r in sets.select("rid", "doc", "no").join(
        _docs(spark).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("no", "line")), ["doc", "no"]).collect()}
    bag = {k: set(v.split(" ")) for k, v in text.items()}
    alike = {frozenset((a, b)) for a in bag for b in bag if a < b and 180 * len(bag[a] & bag[b]) >= 80 * (len(bag[a]) + len(bag[b]))}
    assert len(alike) >= 40 and alike <= found


def test_digest_is_made_below_the_explosion(spark):
    plan = lines.occurrences(_docs(spark, 3), 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan[plan.rindex("Generate") :]


def test_only_texts_with_a_wanted_line_are_split(spark, monkeypatch):
    docs = _docs(spark)
    sets = _sets(spark, docs).withColumn("none", F.col("doc").isNull())
    rids = [r.rid for r in sets.where(F.col("doc") < 3).collect()]
    pairs = spark.createDataFrame([(rids[0], x) for x in rids[1:]], "a long, b long")
    split, numbered = [], lines._numbered
    monkeypatch.setattr(lines, "_numbered", lambda texts: split.append(texts.count()) or numbered(texts))
    small = {(r.rid, r.n) for r in lines._whole_sets(docs, sets, pairs).collect()}
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    large = {(r.rid, r.n) for r in lines._whole_sets(docs, sets, pairs).collect()}
    assert split == [3, 60] and small == large and {r for r, _ in small} == set(rids)


def _nested(spark, sizes):
    """Sets of the first words of one list, all with a word that is rare: the shorter the earlier."""
    return spark.createDataFrame([(i, " ".join(["zero", *[f"w{k}" for k in range(n - 1)]])) for i, n in enumerate(sizes)], "doc_id long, text string")


def test_sets_of_very_different_lengths_do_not_meet(spark):
    entered = lines.entries(_sets(spark, _nested(spark, [10, 11, 40, 90, 200, 450])), 80)
    n = F.shiftright("place", 32)
    spans = entered.groupBy("code").agg(F.min(n).alias("least"), F.max(n).alias("most")).collect()
    assert max(r.most / r.least for r in spans) < 4 and any(r.least == 10 and r.most == 11 for r in spans)


def test_all_similar_lengths_meet(spark):
    sizes = [*range(1, 80), 125, 156, 157, 195, 244]
    for percent in (80, 50, 100):
        sets = _sets(spark, _nested(spark, sizes), percent)
        n = {r.rid: r.n for r in sets.collect()}
        made = [(n[r.a], n[r.b]) for r in lines.similar_pairs(sets, percent).collect()]
        found = {frozenset(p) for p in made}
        assert len(found) == len(made) and all(a > b for a, b in made)  # each pair once, the longer set first
        alike = {frozenset((a, b)) for a in sizes for b in sizes if a < b and 100 * a >= percent * b}
        assert alike <= found, percent


def test_words_are_cut_at_every_blank(spark):
    texts = ["a b", "a\tb", "a\x0bb", "a\x0cb", "a\rb", "a\nb", " a  b ", "A \t\r B", "a\u00a0b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", lines._words(F.col("t")).alias("w"))
    assert [r.w for r in sorted(rows.collect())] == [["a", "b"]] * 8 + [["a\u00a0b"]]
