"""Fitted models against what must hold of them: sizes of splits, flagged shares, quality on unseen rows, equal scores after loading.

The SQL gives the sizes and says that every condition holds. Labels are those of the tables and in no feature.
"""

from functools import reduce

from pyspark.sql import functions as F

from flowmarrow.operators import ensemble as en
from flowmarrow.operators import supervised as sv
from flowmarrow.operators import tuning as tn
from flowmarrow.operators.detectors import DenseAutoencoder, IsolationForest, LstmAutoencoder, OneClassSvm, load_detector
from flowmarrow.operators.metrics import roc_auc
from flowmarrow.operators.scaling import stratified_split
from flowmarrow.plans.model_queries import COLUMNS, model_rows
from flowmarrow.plans.registry import query
from flowmarrow.plans.tables import CONN, table
from flowmarrow.session import frozen, scratch_path, spread

TEXT_COLUMNS = ["chars", "words", "lines", "long_words", "symbols", "digits", "capitals", "accents", "distinct_words", "distinct_lines"]


#: Labels that fit a broadcast.
FEW_LABELS = 2_000_000


def document_rows(spark, sf_dir):
    """Features of the labelled documents; ``y`` is 1 for those of low quality, ``kind`` is their language."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("y"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"), F.coalesce("text", F.lit("")).alias("text")))
    if labels.count() > FEW_LABELS:  # the join shuffles, so features are taken before it
        return frozen(text_features(docs).join(labels, "doc_id"), "document-rows")
    return frozen(text_features(docs.join(F.broadcast(labels), "doc_id")).select("doc_id", "kind", *TEXT_COLUMNS, "y"), "document-rows")


def text_features(docs):
    """``TEXT_COLUMNS`` instead of the text; a generator of one row keeps the words from being cut once for every feature."""
    cut = F.struct("text", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words"), F.split("text", "\n").alias("parts"))
    rows = docs.select(*[c for c in docs.columns if c != "text"], F.inline(F.array(cut)))
    text, words, lines = F.col("text"), F.col("words"), F.col("parts")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
    part = lambda a: F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1))
    cells = [
        F.log1p(F.length(text)), F.log1p(F.size(words)), F.log1p(F.size(lines)), F.length(F.array_join(words, "")) / F.greatest(F.size(words), F.lit(1)),
        share("[#*$%&|<>]"), share("[0-9]"), share("[A-Z]"), share("[\u00c0-\u024f]"), part(words), part(lines),
    ]
    return rows.select(*[c for c in docs.columns if c != "text"], *[c.cast("double").alias(n) for c, n in zip(cells, TEXT_COLUMNS)])


def outlier_rows(spark, sf_dir):
    """Connections as they are; ``y`` marks the hundredth with the most bytes, which a detector has to find unusual."""
    rows = model_rows(spark, sf_dir).drop("y")
    most = rows.agg(F.percentile("orig_bytes", F.lit(0.99)).alias("q")).first()["q"]
    return frozen(rows.withColumn("y", (F.col("orig_bytes") > most).cast("int")), "outlier-rows")


def all_of(rows):
    """Booleans and numbers of each model as one table."""
    return reduce(lambda a, b: a.unionByName(b), rows)


def same_scores(spark, fitted, load, rows, row_id):
    """Whether a saved and loaded model gives every row the score it gave before."""
    path = scratch_path(spark, "saved")
    fitted.save(spark, path)
    was = fitted.score(rows).select(row_id, F.col("score").alias("was"))
    now = load(spark, path).score(rows).select(row_id, "score")
    return was.join(now, row_id).filter(~F.col("was").eqNullSafe(F.col("score"))).isEmpty()


DETECTORS = {
    "isolation_forest": (IsolationForest, {}, 0.8), "one_class_svm": (OneClassSvm, {}, 0.8), "standard_ae": (DenseAutoencoder, {"encoding_dim": 4}, 0.6),
}


@query(
    f"""WITH {CONN}, o AS (SELECT quantile_cont(orig_bytes, 0.99) AS q FROM conn)
    SELECT model, count(*) AS n, CAST(sum(CASE WHEN orig_bytes > q THEN 1 ELSE 0 END) AS BIGINT) AS outliers, TRUE AS flagged_as_asked,
      TRUE AS outliers_stand_out, TRUE AS same_after_loading
    FROM conn, o, (SELECT unnest([{", ".join(repr(n) for n in DETECTORS)}]) AS model) GROUP BY model"""
)
def detectors_check(spark, sf_dir):
    """Detectors with their own settings: the share they flag is the one asked for, and outliers score high."""
    rows, found = outlier_rows(spark, sf_dir), []
    for name, (make, settings, least) in DETECTORS.items():
        fitted = make(**settings).fit(rows, COLUMNS)
        scored = frozen(fitted.predict(rows).select("conn_id", "y", "score", "prediction"), "scored")
        asked = getattr(fitted, "contamination", getattr(fitted, "nu", 0.01))
        share = scored.agg(F.avg("prediction").alias("p")).first()["p"]
        told = scored.agg(F.count("*").alias("n"), F.sum("y").alias("outliers"))
        found.append(
            told.select(
                F.lit(name).alias("model"), "n", "outliers", F.lit(abs(share - asked) <= 0.01).alias("flagged_as_asked"),
                (roc_auc(scored, "y").scalar() > least).alias("outliers_stand_out"),
                F.lit(same_scores(spark, fitted, load_detector, rows, "conn_id")).alias("same_after_loading"),
            )
        )
    return all_of(found)


LSTM_STEPS = 5


@query(
    f"""WITH {CONN}, h AS (SELECT orig_h, count(*) AS k FROM conn GROUP BY orig_h)
    SELECT model, CAST(sum(greatest(k - {LSTM_STEPS - 1}, 0)) AS BIGINT) AS windows, TRUE AS all_scored, TRUE AS flagged_as_asked,
      TRUE AS same_after_loading FROM h, (SELECT unnest(['lstm', 'bilstm']) AS model) GROUP BY model"""
)
def lstm_check(spark, sf_dir):
    """Both recurrent nets over all windows of all hosts."""
    rows, order, found = outlier_rows(spark, sf_dir), ["ts", "conn_id"], []
    for name, both_ways in (("lstm", False), ("bilstm", True)):
        net = LstmAutoencoder(sequence_length=LSTM_STEPS, units=(8,), latent_dim=4, bidirectional=both_ways, epochs=2, batch_size=128)
        net.fit_windows(rows, COLUMNS, order, host="orig_h")
        windows = frozen(net.windows(rows, order, "orig_h"), "windows")
        scored = frozen(net.predict(windows).select("conn_id", "score", "prediction"), "scored")
        told = scored.agg(F.count("*").alias("windows"), F.count_if(F.col("score") >= 0).alias("k"), F.avg("prediction").alias("p"))
        found.append(
            told.select(
                F.lit(name).alias("model"), "windows", (F.col("k") == F.col("windows")).alias("all_scored"),
                (F.abs(F.col("p") - 0.01) <= 0.02).alias("flagged_as_asked"),
                F.lit(same_scores(spark, net, load_detector, windows, "conn_id")).alias("same_after_loading"),
            )
        )
    return all_of(found)


SPLIT_SQL = """l AS (SELECT doc_id, 1 - quality AS y, lang AS kind FROM labels JOIN documents USING (doc_id)),
  s AS (SELECT {key} AS k, count(*) AS n, CAST(floor(count(*) * 0.8 + 0.5) AS BIGINT) AS train FROM l GROUP BY 1)"""


@query(
    f"""WITH {SPLIT_SQL.format(key='y')}
    SELECT model, CAST(sum(train) AS BIGINT) AS trained, CAST(sum(n - train) AS BIGINT) AS tested,
      CAST(sum(CASE WHEN k = 1 THEN n - train ELSE 0 END) AS BIGINT) AS positives,
      TRUE AS good_on_unseen_rows, TRUE AS same_after_loading, TRUE AS importances_add_up
    FROM s, (SELECT unnest(['logistic', 'random_forest', 'gradient_boosting']) AS model) GROUP BY model"""
)
def classifiers_check(spark, sf_dir):
    """Low quality of documents from the look of their text, by all classifiers with their full settings."""
    parts = frozen(stratified_split(document_rows(spark, sf_dir), "y", "doc_id"), "split")
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    n, found = train.count(), []
    for kind in ("logistic", "random_forest", "gradient_boosting"):
        fitted = sv.fit_classifier(train, TEXT_COLUMNS, "y", kind)
        scored = frozen(fitted.score(test).select("doc_id", "y", "score", "prediction"), "scored")
        total = 1.0 if kind == "logistic" else fitted.importances().agg(F.sum("importance").alias("t")).first()["t"]
        found.append(
            scored.agg(F.count("*").alias("tested"), F.sum("y").cast("long").alias("positives")).select(
                F.lit(kind).alias("model"), F.lit(n).cast("long").alias("trained"), "tested", "positives",
                (roc_auc(scored, "y").scalar() > 0.8).alias("good_on_unseen_rows"),
                F.lit(same_scores(spark, fitted, sv.load_classifier, test, "doc_id")).alias("same_after_loading"),
                F.lit(abs(total - 1) < 1e-6).alias("importances_add_up"),
            )
        )
    return all_of(found)


@query(
    f"""WITH {SPLIT_SQL.format(key='kind')}
    SELECT k AS kind, CAST(n - train AS BIGINT) AS tested, TRUE AS mostly_right, TRUE AS same_after_loading FROM s"""
)
def attack_types_check(spark, sf_dir):
    """The type classifier on the languages of documents that it has not seen."""
    rows = document_rows(spark, sf_dir).withColumn("attack_type", F.col("kind"))
    parts = frozen(stratified_split(rows, "kind", "doc_id"), "split")
    fitted = sv.fit_attack_types(parts.filter("split = 'train'"), TEXT_COLUMNS)
    test, path = parts.filter("split = 'test'"), scratch_path(spark, "types")
    fitted.save(spark, path)
    again = sv.load_attack_types(spark, path).score(test, "again")
    scored = frozen(fitted.score(test).join(again.select("doc_id", "again"), "doc_id").select("kind", "predicted_type", "again"), "scored")
    same = scored.filter("NOT predicted_type <=> again").isEmpty()
    right = scored.agg(F.avg((F.col("kind") == F.col("predicted_type")).cast("double")).alias("p")).first()["p"]
    return scored.groupBy("kind").agg(F.count("*").alias("tested")).withColumns(
        {"mostly_right": F.lit(right > 0.6), "same_after_loading": F.lit(same)}
    )


@query(
    f"""WITH {SPLIT_SQL.format(key='y')}
    SELECT CAST(sum(train) AS BIGINT) AS trained, CAST(sum(n - train) AS BIGINT) AS tested, CAST(5 AS BIGINT) AS folds,
      TRUE AS members_unseen, TRUE AS as_good_as_members FROM s"""
)
def stacking_check(spark, sf_dir):
    """A meta-model over the scores that two classifiers give to rows they have not seen, judged on rows none of them has."""
    parts = frozen(stratified_split(document_rows(spark, sf_dir), "y", "doc_id"), "split")
    train, test = parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'")
    columns = {"look": TEXT_COLUMNS[:5], "letters": TEXT_COLUMNS[5:]}
    members = {name: (lambda rows, c=c: sv.fit_classifier(rows, c, "y", "random_forest", numTrees=50).score) for name, c in columns.items()}
    unseen = en.out_of_fold(train, "y", "doc_id", members)
    meta = en.fit_stack(unseen, list(members))
    scored = test
    for name, fit in members.items():
        scored = fit(train)(scored).select(*scored.columns, F.col("score").alias(name))
    scored = frozen(meta(scored), "stacked")
    auc = {c: roc_auc(scored, "y", c).first()[0] for c in ("score", *members)}
    folds = unseen.agg(F.count_distinct("fold").alias("folds"), F.count("*").alias("trained"), F.count_distinct("doc_id").alias("ids"))
    return folds.select(
        "trained", F.lit(scored.count()).cast("long").alias("tested"), "folds", (F.col("ids") == F.col("trained")).alias("members_unseen"),
        F.lit(auc["score"] > max(auc[m] for m in members) - 0.02).alias("as_good_as_members"),
    )


@query(
    f"""WITH {CONN} SELECT CAST(f AS INTEGER) AS fold, TRUE AS outliers_stand_out FROM range(5) t(f)
    WHERE (SELECT count(*) FROM conn) > 0"""
)
def cross_validation_check(spark, sf_dir):
    """Five folds of an isolation forest with its own settings."""
    folds = tn.cross_validate(outlier_rows(spark, sf_dir), COLUMNS, k=5, make=IsolationForest)
    return folds.select(F.col("fold").cast("int").alias("fold"), (F.col("roc_auc") > 0.8).alias("outliers_stand_out"))
