"""Classifiers on feature rows, with Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmarrow.operators import metrics as mt
from flowmarrow.operators.forest import Forest, fit_forest, load_forest
from flowmarrow.operators.scaling import fit_scaler, scale, stratified_split
from flowmarrow.session import kept_for_fit

# Settings of the compared classifiers. Tree depth 30 is the deepest Spark allows.
SETTINGS = {
    "logistic": {"maxIter": 2000},
    "random_forest": {"numTrees": 400, "maxDepth": 30, "seed": 42},
    "gradient_boosting": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6, "seed": 42},
}
BALANCED = {"logistic", "random_forest"}
#: Forests with more levels grow on cells (``forest``); Spark's learner sends a histogram of every node of a level.
LEVELS = 12


def with_class_weight(df: DataFrame, y: str = "y", name: str = "class_weight") -> DataFrame:
    """n / (classes * class size); the class table is tiny and broadcast."""
    sizes = df.groupBy(y).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("t")).scalar()
    classes = sizes.agg(F.count("*").alias("k")).scalar()
    weights = sizes.select(y, (total / (classes * F.col("_n"))).alias(name))
    return df.join(F.broadcast(weights), y)


@dataclass
class Classifier:
    kind: str
    columns: list[str]
    scaler: dict[str, tuple[float, float]] | None
    model: PipelineModel | Forest

    def score(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``score`` = probability of the positive class, ``prediction`` = score >= threshold.

        Features go through a copy, so the input columns keep their values.
        """
        rows = _prepared(df, self.columns, self.scaler)
        if isinstance(self.model, Forest):
            p = self.model.score(rows, [f"_x_{c}" for c in self.columns])
        else:
            p = self.model.transform(rows).withColumn("score", vector_to_array("_probability")[1])
        return p.withColumn("prediction", (F.col("score") >= threshold).cast("int")).drop(
            "_features", "_probability", "_raw", "_predicted", *[f"_x_{c}" for c in self.columns]
        )

    def importances(self) -> DataFrame:
        """Features by importance, highest first."""
        values = self.model.gains if isinstance(self.model, Forest) else self.model.stages[-1].featureImportances.toArray().tolist()
        rows = sorted(zip(self.columns, values), key=lambda r: (-r[1], r[0]))
        ranked = [(i + 1, c, v) for i, (c, v) in enumerate(rows)]
        return SparkSession.active().createDataFrame(ranked, "rank int, feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted pipeline or forest, and kind, columns and scaler as JSON text."""
        deep = isinstance(self.model, Forest)
        if deep:
            self.model.save(spark, f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        head = {"kind": self.kind, "columns": self.columns, "scaler": self.scaler, "deep": deep}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def load_classifier(spark: SparkSession, path: str) -> Classifier:
    head = json.loads(spark.read.text(f"{path}/head").first()["value"])
    scaler = {c: tuple(v) for c, v in head["scaler"].items()} if head["scaler"] is not None else None
    model = load_forest(spark, f"{path}/model") if head.get("deep") else PipelineModel.load(f"{path}/model")
    return Classifier(head["kind"], head["columns"], scaler, model)


def _prepared(df, columns, scaler):
    copies = df.withColumns({f"_x_{c}": F.col(c).cast("double") for c in columns})
    return scale(copies, {f"_x_{c}": v for c, v in scaler.items()}) if scaler else copies


def fit_classifier(
    df: DataFrame,
    columns: list[str],
    y: str = "y",
    kind: str = "logistic",
    scaled: bool | None = None,
    with_mean: bool = True,
    **settings,
) -> Classifier:
    """Fit one of the three classifiers; logistic regression and forest weigh classes evenly."""
    scaled = kind == "logistic" if scaled is None else scaled
    options = {**SETTINGS[kind], **settings}
    common = {"featuresCol": "_features", "labelCol": y, "predictionCol": "_predicted"}
    if kind in BALANCED:
        common["weightCol"] = "class_weight"
    if kind == "logistic":
        learner = LogisticRegression(standardization=False, **common, **options)
    elif kind == "random_forest":
        learner = RandomForestClassifier(**common, **options)
    else:
        learner = GBTClassifier(**common, **options)
    learner = learner.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    assemble = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_features")
    with kept_for_fit(df.select(*dict.fromkeys([*columns, y]))) as kept:
        scaler = fit_scaler(kept, columns, with_mean) if scaled else None
        if kind == "random_forest" and set(options) <= {"numTrees", "maxDepth", "seed"} and options["maxDepth"] > LEVELS:
            known = kept.filter(F.col(y).isNotNull())
            sizes = {r[y]: r["n"] for r in known.groupBy(y).agg(F.count("*").alias("n")).collect()}
            if not sizes:
                raise ValueError("no training rows")
            if set(sizes) <= {0, 1}:
                cells = [f"_x_{c}" for c in columns]
                forest = fit_forest(
                    _prepared(known, columns, scaler), cells, y, sizes, options["numTrees"], options["maxDepth"], options["seed"]
                )
                return Classifier(kind, list(columns), scaler, forest)
        rows = with_class_weight(kept, y) if kind in BALANCED else kept
        model = Pipeline(stages=[assemble, learner]).fit(_prepared(rows, columns, scaler))
    return Classifier(kind, list(columns), scaler, model)


def report(scored: DataFrame, model: str, y: str = "y") -> DataFrame:
    """One metric row of a scored table."""
    row = mt.binary_metrics(scored, y).withColumn("roc_auc", mt.roc_auc(scored, y).scalar())
    return row.select(
        F.lit(model).alias("model"), "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1",
        "roc_auc", "false_positive_rate",
    )


def compare_classifiers(
    df: DataFrame,
    columns: list[str],
    row_id: str,
    y: str = "y",
    settings: dict[str, dict] | None = None,
) -> DataFrame:
    """Stratified 80/20 split, one metric row per classifier."""
    parts = stratified_split(df, y, row_id)
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    rows = [
        report(fit_classifier(train, columns, y, kind, **(settings or {}).get(kind, {})).score(test), kind, y)
        for kind in SETTINGS
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def cross_day(
    train: DataFrame, test: DataFrame, columns: list[str], y: str = "y", settings: dict[str, dict] | None = None
) -> DataFrame:
    """Fit on one day, test on another; scaling without centring, forest 300 trees, boosting depth 7."""
    base = {"random_forest": {"numTrees": 300}, "gradient_boosting": {"maxDepth": 7}}
    rows = []
    for kind in SETTINGS:
        options = {**base.get(kind, {}), **(settings or {}).get(kind, {})}
        fitted = fit_classifier(train, columns, y, kind, with_mean=False, **options)
        rows.append(report(fitted.score(test), kind, y))
    return reduce(lambda a, b: a.unionByName(b), rows)


@dataclass
class AttackTypeClassifier:
    columns: list[str]
    model: PipelineModel
    labels: list[str]

    def score(self, df: DataFrame, name: str = "predicted_type") -> DataFrame:
        done = self.model.transform(df)
        return done.withColumnRenamed("_predicted_label", name).drop(
            "_y", "_features", "_probability", "_raw", "_predicted"
        )


    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted pipeline, and columns and labels as JSON text."""
        self.model.write().overwrite().save(f"{path}/model")
        head = {"columns": self.columns, "labels": self.labels}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def load_attack_types(spark: SparkSession, path: str) -> AttackTypeClassifier:
    head = json.loads(spark.read.text(f"{path}/head").first()["value"])
    return AttackTypeClassifier(head["columns"], PipelineModel.load(f"{path}/model"), head["labels"])


def fit_attack_types(
    df: DataFrame,
    columns: list[str],
    attack_type: str = "attack_type",
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
) -> AttackTypeClassifier:
    """Forest over the attack types of anomaly rows, with label encoding both ways."""
    index = StringIndexer(
        inputCol=attack_type, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(df)
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_y", predictionCol="_predicted", probabilityCol="_probability",
        rawPredictionCol="_raw", numTrees=trees, maxDepth=depth, seed=seed,
    )
    back = IndexToString(inputCol="_predicted", outputCol="_predicted_label", labels=index.labels)
    assemble = VectorAssembler(inputCols=columns, outputCol="_features")
    model = Pipeline(stages=[index, assemble, forest, back]).fit(df)
    return AttackTypeClassifier(list(columns), model, list(index.labels))
