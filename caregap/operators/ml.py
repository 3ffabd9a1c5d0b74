"""Training sets, splits, models and metrics for prioritisation, on MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregap.functions import clean, scores
from caregap.operators import extra_trees, forest, gaps, hist_boosting, ingest, logistic
from caregap.operators.evidence import distinct_small
from caregap.operators.gaps import PAIR
from caregap.operators.ranking import global_rank, running_totals
from caregap.schemas import PRIORITY_LABELS
from caregap.session import materialize

RECAPTURE_FEATURES = (
    "diagnosis_count", "unique_icd_count", "active_years", "days_since_last_diagnosis", "unique_claim_count",
    "source_count", "inpatient_count", "outpatient_count", "carrier_count", "principal_diagnosis_count",
)
PRIORITY_NUMERIC = (
    "diagnosis_count", "unique_claim_count", "unique_event_count", "distinct_evidence_dates",
    "distinct_evidence_months", "distinct_sources", "principal_diagnosis_count", "prescription_support_count",
)
PRIORITY_SCORES = tuple(scores.EVIDENCE_WEIGHTS)
PRIORITY_CATEGORICAL = ("hcc_v28", "gap_type", "suspect_type", "status", "latest_context")
MODEL_VERSION = "hcc_priority_v1"


# --- data sets -------------------------------------------------------------------


def training_set(timeline: DataFrame, first_year: int, last_year: int, target_year: int, holdout_year: int) -> DataFrame:
    """Pair features from the window and 0/1 labels from two later years, in one pass.

    Features only see rows inside the window, so later years cannot leak into them.
    """
    events = ingest.dedup_training_events(gaps.diagnoses(timeline))
    day = F.col("event_date")
    used = clean.in_years(day, range(first_year, last_year + 1))

    def inside(c):
        return F.when(used, F.nullif(F.col(c), F.lit("")))

    anchor = F.lit(f"{last_year}-12-31").cast("date")
    sources = {f"{s.lower()}_count": F.count_if(used & (F.col("source") == s)) for s in ("INPATIENT", "OUTPATIENT", "CARRIER")}
    return (
        events.groupBy(*PAIR)
        .agg(
            F.count_if(used).alias("diagnosis_count"),
            distinct_small(inside("code")).alias("unique_icd_count"),
            distinct_small(F.when(used, F.year(day))).alias("active_years"),
            F.datediff(anchor, F.max(F.when(used, day))).cast("bigint").alias("days_since_last_diagnosis"),
            F.count_distinct(inside("claim_id")).alias("unique_claim_count"),
            distinct_small(inside("source")).alias("source_count"),
            *[c.alias(n) for n, c in sources.items()],
            F.count_if(used & F.col("is_principal")).alias("principal_diagnosis_count"),
            F.max(clean.in_years(day, [target_year])).cast("int").alias("target"),
            F.max(clean.in_years(day, [holdout_year])).cast("int").alias("holdout_target"),
        )
        .filter("diagnosis_count > 0")
    )


def dataset_metadata(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("training_rows"),
        F.sum("target").cast("bigint").alias("positive_rows"),
        F.count_if(F.col("target") == 0).alias("negative_rows"),
        F.sum("holdout_target").cast("bigint").alias("holdout_positive_rows"),
    ).withColumn("positive_rate", F.round(F.coalesce(F.try_divide("positive_rows", "training_rows"), F.lit(0.0)), 6))


def member_mode(rows: DataFrame, label: str = "target") -> DataFrame:
    """Most frequent label per member; the lowest label wins ties."""
    counts = rows.groupBy("bene_id", label).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("v"))).alias("_best")
    return counts.groupBy("bene_id").agg(best).select("bene_id", F.col("_best.v").alias(label))


def _rank_in_class(rows: DataFrame, label: str, key: str) -> DataFrame:
    """0-based position of each row among its class in hash order.

    Uses one global position and the start of each class, so a class that holds
    most rows is still spread over all tasks.
    """
    hashed = F.md5(F.col(key))
    placed = global_rank(rows, [F.col(label), hashed, F.col(key)], "_no")
    classes = placed.groupBy(label).agg(F.min("_no").alias("_first"), F.count("*").alias("_size"))
    return placed.join(F.broadcast(classes), label).withColumn("_pos", F.col("_no") - F.col("_first"))


def split_members(rows: DataFrame, label: str = "target") -> DataFrame:
    """70/15/15 split of members, stratified by their modal class; a member's rows stay together."""
    placed = _rank_in_class(member_mode(rows, label), label, "bene_id")
    share = F.col("_pos") / F.col("_size")
    return placed.select(
        "bene_id", label,
        F.when(share < 0.70, "train").when(share < 0.85, "validation").otherwise("test").alias("split"),
    )


def stratified_folds(rows: DataFrame, label: str = "target", folds: int = 5) -> DataFrame:
    keyed = rows.withColumn("_key", F.concat_ws("|", *PAIR))
    placed = _rank_in_class(keyed, label, "_key")
    return placed.withColumn("fold", F.pmod("_pos", F.lit(folds)).cast("int")).drop(
        "_key", "_no", "_first", "_size", "_pos"
    )


def class_weights(rows: DataFrame, label: str = "target", name: str = "class_weight") -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` beside each row (one side row per class)."""
    per_class = rows.groupBy(label).agg(F.count("*").alias("_n"))
    share = per_class.agg(F.sum("_n") / F.count("*")).scalar()
    weights = per_class.select(label, (share / F.col("_n")).alias(name))
    return rows.join(F.broadcast(weights), label)


# --- models ---------------------------------------------------------------------------


def fit_recapture(rows: DataFrame, label: str = "target", c: float = 1.0) -> logistic.LogisticFit:
    """Class-weighted logistic regression on standardised features with an L2 term of inverse strength ``c``."""
    return logistic.fit_logistic(materialize(_recapture_rows(rows, label)), RECAPTURE_FEATURES, label, "class_weight", c)


def _recapture_rows(rows: DataFrame, label: str) -> DataFrame:
    return class_weights(rows.select(*RECAPTURE_FEATURES, label), label)


def recapture_optimality(rows: DataFrame, label: str = "target") -> DataFrame:
    """Gradient of the loss at the fitted coefficients; zero everywhere is the optimum."""
    fit = fit_recapture(rows, label)
    scored = fit.transform(_recapture_rows(rows, label), "recapture_probability")
    return logistic.optimality(scored, fit, label, "class_weight", "recapture_probability")


def _fold_fits(data: DataFrame, label: str, folds: int) -> list[logistic.LogisticFit]:
    return [fit_recapture(data.filter(F.col("fold") != k), label) for k in range(folds)]


def out_of_fold(rows: DataFrame, label: str = "target", folds: int = 5) -> DataFrame:
    """Probability of every row from the model that did not see its fold."""
    data = materialize(stratified_folds(rows, label, folds))
    probability = None
    for k, fit in enumerate(_fold_fits(data, label, folds)):
        own = 1 / (1 + F.exp(-fit.decision()))
        probability = F.when(F.col("fold") == k, own) if probability is None else probability.when(F.col("fold") == k, own)
    return data.select(*PAIR, label, "fold", probability.alias("recapture_probability"))


def fold_optimality(rows: DataFrame, label: str = "target", folds: int = 5) -> DataFrame:
    """``recapture_optimality`` of the model of each fold, on the rows outside the fold."""
    data = materialize(stratified_folds(rows, label, folds))
    parts = []
    for k, fit in enumerate(_fold_fits(data, label, folds)):
        scored = fit.transform(_recapture_rows(data.filter(F.col("fold") != k), label), "recapture_probability")
        found = logistic.optimality(scored, fit, label, "class_weight", "recapture_probability")
        parts.append(found.select(F.lit(k).alias("fold"), "*"))
    return reduce(DataFrame.unionByName, parts)


def threshold_metrics(scored: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, balanced accuracy and positive rate at a threshold."""
    y, hit = F.col(label) == 1, F.col(probability) >= threshold
    counts = scored.agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        F.round(ratio(tp, tp + fp), 6).alias("precision"),
        F.round(ratio(tp, tp + fn), 6).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
        F.round((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, 6).alias("balanced_accuracy"),
        F.round(ratio(tp + fp, tp + fp + fn + tn), 6).alias("positive_rate"),
    )


def area_metrics(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """Exact ROC AUC (trapezoids) and average precision (sum of recall steps times precision), one row.

    Equal scores are one threshold. Running sums over the distinct scores come from
    per-partition totals, so nothing is thinned and no task holds all scores.
    """
    y = F.col(label) == 1
    steps = scored.groupBy(F.col(probability).alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    curve = running_totals(steps, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    sums = curve.agg(
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("_area"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    )
    return sums.select(
        "positives", "negatives",
        F.round(F.try_divide("_area", F.col("positives") * F.col("negatives")), 6).alias("roc_auc"),
        F.round(F.try_divide("_ap", "positives"), 6).alias("average_precision"),
    )


def preprocess_stages(numeric: list[str], categorical: list[str], modes: dict[str, str] | None = None) -> list:
    """Median and most-frequent imputation, scaling, and one-hot coding that ignores unseen values.

    ``modes`` are the training rows' most frequent categories; as a stage of the
    pipeline they fill missing values in training and in scoring alike.
    """
    filled, indexed, hot = ([f"{c}{s}" for c in cols] for cols, s in ((numeric, "_f"), (categorical, "_i"), (categorical, "_h")))
    stages: list = [
        Imputer(inputCols=numeric, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_numeric"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
    ]
    if categorical:
        known = [f"{c}_k" for c in categorical]
        text = {c: str((modes or {}).get(c) or "none").replace("\\", "\\\\").replace("'", "\\'") for c in categorical}
        filling = ", ".join(f"coalesce({c}, '{text[c]}') AS {k}" for c, k in zip(categorical, known, strict=True))
        stages += [
            SQLTransformer(statement=f"SELECT *, {filling} FROM __THIS__"),
            StringIndexer(inputCols=known, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        ]
    return [*stages, VectorAssembler(inputCols=["_scaled", *hot], outputCol="features")]


def category_modes(rows: DataFrame, categorical: list[str]) -> dict[str, str]:
    """Most frequent value of each column (lowest value on ties)."""
    return rows.agg(*[F.mode(c, True).alias(c) for c in categorical]).first().asDict()


def _numeric(rows: DataFrame, columns) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double") for c in columns})


def _label(rows: DataFrame, column: str = "disease_priority") -> DataFrame:
    """Numeric class of a LOW / MEDIUM / HIGH column; rows with other values are dropped."""
    value = F.upper(clean.strip(F.col(column)))
    index = F.array_position(F.array(*[F.lit(x) for x in PRIORITY_LABELS]), value)
    return rows.withColumn("target", (index - 1).cast("double")).filter(F.col("target") >= 0)


def prepared_priority(rows: DataFrame, label_column: str = "disease_priority") -> tuple[PipelineModel, DataFrame]:
    """Fitted preprocessing of the mixed features and the labelled rows with features, target and class weight."""
    data = materialize(class_weights(_numeric(_label(rows, label_column), PRIORITY_NUMERIC)))
    modes = category_modes(data, list(PRIORITY_CATEGORICAL))
    stages = Pipeline(stages=preprocess_stages(list(PRIORITY_NUMERIC), list(PRIORITY_CATEGORICAL), modes)).fit(data)
    return stages, stages.transform(data)


def fit_priority(rows: DataFrame, label_column: str = "disease_priority") -> PipelineModel:
    """Three-class priority model on mixed features, class-weighted."""
    data = materialize(class_weights(_numeric(_label(rows, label_column), PRIORITY_NUMERIC)))
    modes = category_modes(data, list(PRIORITY_CATEGORICAL))
    classifier = LogisticRegression(labelCol="target", weightCol="class_weight", family="multinomial", maxIter=2000)
    return Pipeline(stages=[*preprocess_stages(list(PRIORITY_NUMERIC), list(PRIORITY_CATEGORICAL), modes), classifier]).fit(data)


def with_priority_columns(rows: DataFrame) -> DataFrame:
    """``rows`` with every column the priority models read; numbers as doubles, missing ones as nulls."""
    data = _numeric(rows, PRIORITY_NUMERIC)
    return data.withColumns({c: (F.col(c) if c in data.columns else F.lit(None)).cast("string") for c in PRIORITY_CATEGORICAL})


def score_priority(candidates: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Class probabilities from a fitted model; without a model the rows come back unchanged."""
    if model is None:
        return candidates
    scored = model.transform(with_priority_columns(candidates)).withColumn("probability", vector_to_array("probability"))
    return priority_columns(scored.select(*candidates.columns, "probability"))


def score_with_function(candidates: DataFrame, features: list[str], predict: Callable) -> DataFrame:
    """Probabilities from a model that lives outside MLlib: ``predict`` maps a pandas frame to an n×3 array.

    Runs per Arrow batch inside the tasks; missing feature columns are passed as nulls.
    """
    columns = candidates.columns
    schema = T.StructType([*candidates.schema.fields, T.StructField("probability", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator) -> Iterator:
        for pdf in batches:
            frame = pdf.reindex(columns=features)
            yield pdf[columns].assign(probability=[[float(p) for p in row] for row in predict(frame)])

    return priority_columns(candidates.mapInPandas(score, schema))


def priority_columns(scored: DataFrame) -> DataFrame:
    """Label, expected priority and class probabilities from a (LOW, MEDIUM, HIGH) ``probability`` array."""
    p = F.col("probability")
    return scored.withColumns(
        {
            "ml_priority": scores.argmax_label(p, PRIORITY_LABELS),
            "ml_priority_score": scores.round_scaled(scores.expected_priority(p), 4),
            "ml_low_probability": scores.round_scaled(F.get(p, F.lit(0)), 4),
            "ml_medium_probability": scores.round_scaled(F.get(p, F.lit(1)), 4),
            "ml_high_probability": scores.round_scaled(F.get(p, F.lit(2)), 4),
            "ml_model_version": F.lit(MODEL_VERSION),
        }
    ).drop("probability")


def confidence_columns(scored: DataFrame) -> DataFrame:
    p = F.col("probability")
    return scored.withColumns(
        {"priority_confidence": F.round(F.array_max(p), 6), "high_priority_probability": F.round(F.get(p, F.lit(2)), 6)}
    )


def priority_order() -> list:
    """HIGH before MEDIUM before LOW, then P(HIGH) and confidence descending."""
    rank = F.when(F.col("ml_priority") == "HIGH", 0).when(F.col("ml_priority") == "MEDIUM", 1).when(
        F.col("ml_priority") == "LOW", 2
    ).otherwise(3)
    return [rank, F.desc("high_priority_probability"), F.desc("priority_confidence"), F.col("bene_id"),
            clean.hcc_order(F.col("hcc_v28")), F.col("gap_type")]


# --- multi-class metrics and comparison ------------------------------------------------


def confusion(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class plus macro and weighted averages."""
    a, b = F.col(actual), F.col(predicted)
    row = rows.agg(
        *[F.count_if((a == x) & (b == x)).alias(f"tp_{x}") for x in PRIORITY_LABELS],
        *[F.count_if(b == x).alias(f"pred_{x}") for x in PRIORITY_LABELS],
        *[F.count_if(a == x).alias(f"sup_{x}") for x in PRIORITY_LABELS],
    )
    items = F.array(
        *[
            F.struct(F.lit(x).alias("class"), F.col(f"tp_{x}").alias("tp"), F.col(f"pred_{x}").alias("pred"),
                     F.col(f"sup_{x}").alias("support"))
            for x in PRIORITY_LABELS
        ]
    )

    def ratio(x, y):
        return F.coalesce(F.try_divide(x, y), F.lit(0.0))

    per_class = row.select(F.explode(items).alias("r")).select("r.*").select(
        "class", ratio(F.col("tp"), F.col("pred")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("pred") + F.col("support")).alias("f1"), "support",
    )
    measures = ("precision", "recall", "f1")
    macro = per_class.agg(*[(F.sum(c) / len(PRIORITY_LABELS)).alias(c) for c in measures], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in measures],
        F.sum("support").alias("support"),
    )
    every = per_class.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )
    return every.select("class", *[F.round(c, 6).alias(c) for c in measures], "support")


def accuracy_report(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Rows, accuracy and balanced accuracy (mean recall of the classes that occur)."""
    a, hit = F.col(actual), F.col(actual) == F.col(predicted)
    per_class = rows.groupBy(a.alias("_class")).agg(F.count("*").alias("_n"), F.count_if(hit).alias("_hits"))
    return per_class.agg(
        F.sum("_n").alias("n"),
        F.round(F.try_divide(F.sum("_hits"), F.sum("_n")), 6).alias("accuracy"),
        F.round(F.avg(F.col("_hits") / F.col("_n")), 6).alias("balanced_accuracy"),
    )


def prioritised(scored: DataFrame) -> DataFrame:
    """The scored queue in ``priority_order`` with its position."""
    return global_rank(materialize(scored), priority_order(), "priority_position")


def compare_models(
    rows: DataFrame, label_column: str = "disease_priority", seed: int = 42, trees: int = 400, rounds: int = 250,
    iterations: int = 2000,
) -> DataFrame:
    """Four learners on a stratified 80/20 split, sorted by macro-F1 and then HIGH precision."""
    labelled = _numeric(_label(rows, label_column), (*PRIORITY_NUMERIC, *PRIORITY_SCORES))
    labelled = labelled.select(*PAIR, "gap_type", "target", *PRIORITY_NUMERIC, *PRIORITY_SCORES)
    placed = _rank_in_class(labelled.withColumn("_key", F.concat_ws("|", *PAIR, "gap_type")), "target", "_key")
    data = class_weights(placed.withColumn("is_test", F.col("_pos") / F.col("_size") >= 0.8))
    data = materialize(data.withColumn("_row", F.monotonically_increasing_id()))
    train, test = data.filter(~F.col("is_test")), data.filter("is_test")
    stages = preprocess_stages([*PRIORITY_NUMERIC, *PRIORITY_SCORES], [])
    names = F.array(*[F.lit(x) for x in PRIORITY_LABELS])

    def named(c: str):
        return F.element_at(names, (F.col(c) + 1).cast("int"))

    prepared = Pipeline(stages=stages).fit(train)
    points = [prepared.transform(part).withColumn("x", vector_to_array("features")) for part in (train, test)]
    learn = points[0].select("x", F.col("target").cast("int").alias("y"), F.col("class_weight").alias("w"))
    # Equal rows as one with their number: the same sums for the trees.
    equal = materialize(learn.groupBy("x", "y", "w").agg(F.count("*").alias("n")))
    weighed = equal.select("x", "y", (F.col("w") * F.col("n")).alias("w"))
    regression = LogisticRegression(labelCol="target", weightCol="class_weight", maxIter=iterations).fit(points[0])
    predictions = {"Logistic Regression": regression.transform(points[1])}
    grown = forest.fit(equal, len(PRIORITY_LABELS), trees, seed=seed)
    shares = extra_trees.class_shares(weighed, points[1].select(F.col("_row").alias("id"), "x"), len(PRIORITY_LABELS), trees, seed)
    best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
    booster = hist_boosting.fit(points[0].select(F.col("_row").alias("id"), "x", F.col("target").cast("int").alias("y")), len(PRIORITY_LABELS), rounds)
    boosted = points[1].select(F.col("_row").alias("id"), "x")
    boosted = booster.transform(boosted) if booster else boosted.select("id", F.array().cast("array<double>").alias("probability")).limit(0)
    voted = grown.transform(points[1].select(F.col("_row").alias("id"), "x"))
    predictions["Random Forest"] = test.join(voted.select(F.col("id").alias("_row"), best.alias("prediction")), "_row")
    predictions["Histogram Boosting"] = test.join(boosted.select(F.col("id").alias("_row"), best.alias("prediction")), "_row")
    predictions["Extra Trees"] = test.join(shares.select(F.col("id").alias("_row"), best.alias("prediction")), "_row")
    result = None
    for name, scored in predictions.items():
        report = class_report(materialize(scored.select(named("target").alias("actual"), named("prediction").alias("predicted"))))
        row = report.agg(
            F.max(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("macro_f1"),
            F.max(F.when(F.col("class") == "HIGH", F.col("precision"))).alias("high_precision"),
            F.max(F.when(F.col("class") == "HIGH", F.col("recall"))).alias("high_recall"),
            F.max(F.when(F.col("class") == "macro avg", F.col("precision"))).alias("macro_precision"),
            F.max(F.when(F.col("class") == "weighted avg", F.col("precision"))).alias("weighted_precision"),
            F.max(F.when(F.col("class") == "weighted avg", F.col("recall"))).alias("accuracy"),
        ).select(F.lit(name).alias("model"), "*")
        result = row if result is None else result.unionByName(row)
    return result.orderBy(F.desc("macro_f1"), F.desc("high_precision"), "model")
