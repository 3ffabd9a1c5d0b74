"""Training sets, splits, metrics and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caregap.operators import extra_trees, gaps, hist_boosting, kernel, ml, ranking
from caregap.plans.registry import query
from caregap.session import materialize

PAIR = gaps.PAIR
_FEATURES = ", ".join(ml.RECAPTURE_FEATURES)


def _training(f):
    return ml.training_set(f.dx_timeline, 1997, 1999, 2000, 2001)


@query("a8_training_features", f"SELECT bene_id, hcc_v28, {_FEATURES} FROM training_features")
def _(f):
    return _training(f).drop("target", "holdout_target")


@query("j15_label_join", "SELECT bene_id, hcc_v28, target, holdout_target FROM training_set")
def _(f):
    return _training(f).select(*PAIR, "target", "holdout_target")


@query("m1_training_set", f"SELECT bene_id, hcc_v28, {_FEATURES}, target, holdout_target FROM training_set")
def _(f):
    return _training(f)


@query(
    "m2_dataset_metadata",
    """SELECT count(*) AS training_rows, CAST(sum(target) AS BIGINT) AS positive_rows, count(*) FILTER (target = 0) AS negative_rows,
              CAST(sum(holdout_target) AS BIGINT) AS holdout_positive_rows,
              round(CAST(sum(target) AS BIGINT) / CAST(count(*) AS DOUBLE), 6) AS positive_rate FROM training_set""",
)
def _(f):
    return ml.dataset_metadata(_training(f))


@query("m3_recapture_model")
def _(f):
    rows = ml.materialize(_training(f))
    scored = ml.fit_recapture(rows).transform(rows, "recapture_probability")
    return scored.select(*PAIR, "holdout_target", "recapture_probability")


_COEFFICIENTS = f"unnest({[*ml.RECAPTURE_FEATURES, 'intercept']})"


@query("m3_optimality", f"SELECT {_COEFFICIENTS} AS coefficient, TRUE AS is_optimal WHERE EXISTS (FROM training_set)")
def _(f):
    """Certificate of the fitted model: its loss is strictly convex and its gradient zero, so no other model fits as well."""
    return ml.recapture_optimality(ml.materialize(_training(f))).drop("gradient")


@query(
    "m4_optimality",
    f"""SELECT CAST(fold AS INTEGER) AS fold, coefficient, TRUE AS is_optimal
        FROM (SELECT {_COEFFICIENTS} AS coefficient) CROSS JOIN range(5) t(fold) WHERE EXISTS (FROM training_set)""",
)
def _(f):
    return ml.fold_optimality(_training(f)).drop("gradient")


@query("m4_out_of_fold")
def _(f):
    return ml.out_of_fold(_training(f))


@query(
    "m4_every_row_scored_once",
    """SELECT bene_id, hcc_v28, target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5(bene_id || '|' || hcc_v28),
              bene_id || '|' || hcc_v28) - 1) % 5 AS INTEGER) AS fold, TRUE AS is_probability FROM training_set""",
)
def _(f):
    return ml.out_of_fold(_training(f)).select(
        *PAIR, "target", "fold", F.col("recapture_probability").between(0, 1).alias("is_probability")
    )


@query(
    "m4_stratified_folds",
    """SELECT bene_id, hcc_v28, target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5(bene_id || '|' || hcc_v28),
              bene_id || '|' || hcc_v28) - 1) % 5 AS INTEGER) AS fold FROM training_set""",
)
def _(f):
    return ml.stratified_folds(_training(f)).select(*PAIR, "target", "fold")


@query(
    "m3_class_weights",
    """SELECT bene_id, hcc_v28, round(count(*) OVER () / (2.0e0 * count(*) OVER (PARTITION BY target)), 8) AS class_weight FROM training_set""",
)
def _(f):
    return ml.class_weights(_training(f)).select(*PAIR, F.round("class_weight", 8).alias("class_weight"))


@query(
    "m5_threshold_metrics",
    """SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
              round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1,
              round((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 6) AS balanced_accuracy,
              round((tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS positive_rate
       FROM (SELECT count(*) FILTER (target = 1 AND p >= 0.5e0) AS tp, count(*) FILTER (target = 0 AND p >= 0.5e0) AS fp,
                    count(*) FILTER (target = 1 AND p < 0.5e0) AS fn, count(*) FILTER (target = 0 AND p < 0.5e0) AS tn
             FROM (SELECT target, diagnosis_count / (diagnosis_count + 1.5e0) AS p FROM training_set))""",
)
def _(f):
    scored = _training(f).withColumn("p", F.col("diagnosis_count") / (F.col("diagnosis_count") + 1.5))
    return ml.threshold_metrics(scored, "target", "p")


@query(
    "m5_area_metrics",
    """SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
              round(sum(neg * (tp - pos / 2.0e0)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
              round(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / sum(pos), 6) AS average_precision
       FROM (SELECT pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
               SELECT p, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target <> 1) AS neg FROM (
                 SELECT target, diagnosis_count / (diagnosis_count + 1.5e0) AS p FROM training_set) GROUP BY p)
             WINDOW w AS (ORDER BY p DESC))""",
)
def _(f):
    scored = _training(f).select("target", (F.col("diagnosis_count") / (F.col("diagnosis_count") + 1.5)).alias("p"))
    return ml.area_metrics(scored, "target", "p")


_MODE_SQL = """(SELECT bene_id, arg_min(target, struct_pack(k := -n, t := target)) AS target FROM (
       SELECT bene_id, target, count(*) AS n FROM training_set GROUP BY ALL) GROUP BY bene_id)"""


@query("a25_member_mode", f"SELECT bene_id, target FROM {_MODE_SQL}")
def _(f):
    return ml.member_mode(_training(f))


@query(
    "m6_member_split",
    f"""SELECT bene_id, target, CASE WHEN share < 0.70e0 THEN 'train' WHEN share < 0.85e0 THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT bene_id, target, (row_number() OVER (PARTITION BY target ORDER BY md5(bene_id), bene_id) - 1)
                     / CAST(count(*) OVER (PARTITION BY target) AS DOUBLE) AS share FROM {_MODE_SQL})""",
)
def _(f):
    return ml.split_members(_training(f))


def _labelled_suspects(f):
    return f.suspects_v2.withColumn("disease_priority", F.when(F.col("frequency_score") + F.col("recency_score") > 0.7, "high")
                                    .when(F.col("recency_score") > 0.4, " Medium ").otherwise("LOW"))


# Each numeric column misses in every member whose number leaves another remainder by 7; each categorical one by 11.
_GAPPED = (
    "(SELECT * REPLACE ("
    + ", ".join(f"CASE WHEN CAST(substr(bene_id, 2) AS BIGINT) % 7 <> {i % 7} THEN {c} END AS {c}" for i, c in enumerate(ml.PRIORITY_NUMERIC))
    + "), CASE WHEN CAST(substr(bene_id, 2) AS BIGINT) % 11 <> 3 THEN latest_context END AS context FROM suspects_v2)"
)
_FILLED = (
    "(SELECT bene_id, hcc_v28, gap_type, "
    + ", ".join(f"CAST(coalesce({c}, (SELECT quantile_disc({c}, 0.5) FROM {_GAPPED})) AS DOUBLE) AS {c}" for c in ml.PRIORITY_NUMERIC)
    + f", coalesce(context, (SELECT context FROM {_GAPPED} WHERE context IS NOT NULL GROUP BY context ORDER BY count(*) DESC, context LIMIT 1)) AS context"
    + f" FROM {_GAPPED})"
)


def _position_sql(c: str) -> str:
    return f"(SELECT {c} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS DOUBLE) AS place FROM {_FILLED} GROUP BY {c})"


@query(
    "m7_prepared_features",
    "SELECT bene_id, hcc_v28, gap_type, "
    + ", ".join(f"{c} AS filled_{c}, round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0), 6) AS scaled_{c}"
                for c in ml.PRIORITY_NUMERIC)
    + ", h.place AS hcc_place, x.place AS context_place FROM "
    + f"{_FILLED} r JOIN {_position_sql('hcc_v28')} h ON h.v = r.hcc_v28 JOIN {_position_sql('context')} x ON x.v = r.context",
)
def _(f):
    """What the learner gets: medians and most frequent values for missing ones, scaled numbers, places of the categories in the one-hot vector."""
    number = F.substring("bene_id", 2, 20).cast("bigint")
    missing = {c: F.when(number % 7 != i % 7, F.col(c)) for i, c in enumerate(ml.PRIORITY_NUMERIC)}
    gapped = _labelled_suspects(f).withColumns({**missing, "latest_context": F.when(number % 11 != 3, F.col("latest_context"))})
    _, data = ml.prepared_priority(gapped)
    scaled, features = vector_to_array("_scaled"), vector_to_array("features")
    sizes = {c: data.schema[f"{c}_h"].metadata["ml_attr"]["num_attrs"] for c in ml.PRIORITY_CATEGORICAL}

    def place(c: str):
        """Where the one is in the column's part of the feature vector."""
        start = len(ml.PRIORITY_NUMERIC) + sum(sizes[x] for x in ml.PRIORITY_CATEGORICAL[: ml.PRIORITY_CATEGORICAL.index(c)])
        return (F.array_position(F.slice(features, start + 1, sizes[c]), F.lit(1.0)) - 1).cast("double")

    return data.select(
        *PAIR, "gap_type",
        *[F.col(f"{c}_f").alias(f"filled_{c}") for c in ml.PRIORITY_NUMERIC],
        *[F.round(F.get(scaled, F.lit(i)), 6).alias(f"scaled_{c}") for i, c in enumerate(ml.PRIORITY_NUMERIC)],
        place("hcc_v28").alias("hcc_place"), place("latest_context").alias("context_place"),
    )


@query("m7_m8_priority_classifier")
def _(f):
    rows = ml.materialize(_labelled_suspects(f))
    model = ml.fit_priority(rows)
    return ml.score_priority(rows, model).select(
        *PAIR, "gap_type", "ml_priority", "ml_priority_score", "ml_low_probability", "ml_medium_probability",
        "ml_high_probability",
    )


@query(
    "m7_every_suspect_scored_once",
    """SELECT bene_id, hcc_v28, gap_type, TRUE AS label_is_largest, TRUE AS probabilities_add_up FROM suspects_v2""",
)
def _(f):
    """What is fixed about the fitted model: one row per suspect, label of the largest probability, a sum of one."""
    rows = ml.materialize(_labelled_suspects(f))
    p = {x: F.col(f"ml_{x.lower()}_probability") for x in ("LOW", "MEDIUM", "HIGH")}
    own = F.coalesce(*[F.when(F.col("ml_priority") == x, c) for x, c in p.items()])
    return ml.score_priority(rows, ml.fit_priority(rows)).select(
        *PAIR, "gap_type", (own >= F.greatest(*p.values()) - 0.0001).alias("label_is_largest"),
        (F.abs(sum(p.values()) - 1) < 0.001).alias("probabilities_add_up"),
    )


_DRAW = "((('0x' || substr(md5({}), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0)"


@query(
    "m8_fourier_features",
    f"""SELECT bene_id, hcc_v28, gap_type, CAST(j AS INTEGER) AS feature, round(sqrt(2 / 16.0e0) * cos(sum(x * w) + any_value(b)), 6) AS value
        FROM (SELECT bene_id, hcc_v28, gap_type, unnest([{", ".join(ml.PRIORITY_SCORES)}]) AS x, unnest(range(8)) AS i FROM suspects_v2)
        JOIN (SELECT i, j, sqrt(-2 * ln({_DRAW.format("'42|' || i || '|' || j || '|radius'")})) * cos(2 * pi() * {_DRAW.format("'42|' || i || '|' || j || '|angle'")}) AS w
              FROM range(8) a(i), range(16) b(j)) USING (i)
        JOIN (SELECT j, 2 * pi() * {_DRAW.format("'42|' || j || '|phase'")} AS b FROM range(16) b(j)) USING (j)
        GROUP BY ALL""",
)
def _(f):
    """The evidence scores in 16 random features at gamma 0.5."""
    scores = F.array(*[F.col(c).cast("double") for c in ml.PRIORITY_SCORES])
    mapped = kernel.FourierFeatures(len(ml.PRIORITY_SCORES), 0.5, 16).transform(f.suspects_v2.select(*PAIR, "gap_type", scores.alias("x")))
    return mapped.select(*PAIR, "gap_type", F.posexplode("z").alias("feature", "value")).withColumn("value", F.round("value", 6))


def _classifier_rows(f):
    """Stored suspects with their keys, label and what the kernel classifier reads."""
    columns = dict.fromkeys([*PAIR, "gap_type", *ml.PRIORITY_NUMERIC, *ml.PRIORITY_CATEGORICAL, "disease_priority"])
    return ml.materialize(_labelled_suspects(f).select(*columns))


@query(
    "m8_duality_gap",
    """SELECT plus, minus, TRUE AS within_bound FROM (VALUES ('LOW', 'MEDIUM'), ('LOW', 'HIGH'), ('MEDIUM', 'HIGH')) t(plus, minus)
       WHERE EXISTS (FROM suspects_v2)""",
)
def _(f):
    """Certificate of the fitted machines: a loss within one percent of the optimum, by its dual."""
    rows = _classifier_rows(f)
    return kernel.gap_report(rows.sparkSession, kernel.fit_kernel(rows).machines).drop("loss", "gap")


@query("m8_kernel_classifier")
def _(f):
    rows = _classifier_rows(f)
    scored = ml.priority_columns(kernel.fit_kernel(rows).transform(rows))
    return scored.select(
        *PAIR, "gap_type", "ml_priority", "ml_priority_score", "ml_low_probability", "ml_medium_probability", "ml_high_probability"
    )


# The first cut of each tree: four of the columns by their draw, each cut between its ends, the one with the purest sides.
_TREE_DRAW = _DRAW.format("'42|' || tree || '||' || f")
_TREE_CUT = _DRAW.format("'42|' || tree || '||' || f || '|cut'")


@query(
    "m9_extra_tree_roots",
    f"""SELECT CAST(tree AS INTEGER) AS tree, CAST(arg_max(f, (purity, -place)) AS INTEGER) AS first_column, round(arg_max(cut, (purity, -place)), 6) AS cut FROM (
          SELECT tree, f, place, cut, sum(l * l) / sum(l) + sum(r * r) / sum(r) AS purity FROM (
            SELECT tree, f, place, cut, y, CAST(count(*) FILTER (x <= cut) AS DOUBLE) AS l, CAST(count(*) FILTER (x > cut) AS DOUBLE) AS r
            FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY {_TREE_DRAW}) AS place, low + {_TREE_CUT} * (high - low) AS cut
                  FROM (SELECT f, min(x) AS low, max(x) AS high FROM point GROUP BY f HAVING min(x) < max(x)) CROSS JOIN range(20) t(tree)) d
            JOIN point USING (f) WHERE place <= 2 GROUP BY ALL) GROUP BY ALL) GROUP BY tree""".replace(
        "FROM point", f"""FROM (SELECT unnest([{", ".join(ml.PRIORITY_SCORES)}]) AS x, unnest(range(8)) AS f FROM suspects_v2)"""
    ).replace(
        "JOIN point USING (f)", f"""JOIN (SELECT unnest([{", ".join(ml.PRIORITY_SCORES)}]) AS x, unnest(range(8)) AS f,
               CASE WHEN frequency_score + recency_score > 0.7e0 THEN 2 WHEN recency_score > 0.4e0 THEN 1 ELSE 0 END AS y FROM suspects_v2) USING (f)"""
    ),
)
def _(f):
    """Column and cut at the root of 20 trees on the evidence scores, every root split by Spark."""
    rows = _labelled_suspects(f).select(
        F.array(*[F.col(c).cast("double") for c in ml.PRIORITY_SCORES]).alias("x"),
        F.array_position(F.lit(["LOW", "MEDIUM", "HIGH"]), F.upper(F.trim("disease_priority"))).cast("int").alias("y"),
    )
    rows = rows.select("x", (F.col("y") - 1).alias("y"), F.lit(1.0).alias("w"))
    roots = extra_trees.root_cuts(rows, 3, 20)
    return roots.select("tree", "first_column", F.round("cut", 6).alias("cut"))


# The first two splits of each class's first tree: sums of rounded gradients up to each value, the cut of the greatest gain,
# then the same below both sides, of which the one with the greater gain is split.
_CELLS = f"""SELECT row_id, y, unnest([{", ".join(ml.PRIORITY_SCORES)}]) AS v, unnest(range(8)) AS f FROM (
    SELECT row_number() OVER () AS row_id, CASE WHEN frequency_score + recency_score > 0.7e0 THEN 2 WHEN recency_score > 0.4e0 THEN 1 ELSE 0 END AS y,
           {", ".join(f"floor({c} * 64.0e0) AS {c}" for c in ml.PRIORITY_SCORES)} FROM suspects_v2)"""


def _best_cuts(cells: str) -> str:
    return f"""(SELECT k, path, f, v, gain FROM (
        SELECT *, row_number() OVER (PARTITION BY k, path ORDER BY gain DESC, f, v) AS place FROM (
          SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht AS gain FROM (
            SELECT k, path, f, v, CAST(sum(g) OVER up AS DOUBLE) / 16777216 AS gl, CAST(sum(h) OVER up AS DOUBLE) / 16777216 AS hl, sum(n) OVER up AS nl,
                   CAST(sum(g) OVER whole AS DOUBLE) / 16777216 AS gt, CAST(sum(h) OVER whole AS DOUBLE) / 16777216 AS ht, sum(n) OVER whole AS nt
            FROM (SELECT k, path, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {cells} GROUP BY ALL)
            WINDOW up AS (PARTITION BY k, path, f ORDER BY v), whole AS (PARTITION BY k, path, f))
          WHERE nl >= 20 AND nt - nl >= 20 AND hl >= 0.001e0 AND ht - hl >= 0.001e0) WHERE gain > 1e-12) WHERE place = 1)"""


@query(
    "m9_boosting_first_splits",
    f"""SELECT CAST(k AS INTEGER) AS class, path, CAST(f AS INTEGER) AS first_column, (v + above) / 2 AS cut, round(gain, 4) AS gain FROM (
          WITH cell AS MATERIALIZED ({_CELLS}),
          share AS (SELECT k, count(*) FILTER (y = k) / CAST(count(*) AS DOUBLE) AS p FROM cell, range(3) c(k) WHERE f = 0 GROUP BY k),
          summand AS MATERIALIZED (SELECT cell.*, k, '' AS path, CAST(round((p - (y = k)::INTEGER) * 16777216) AS BIGINT) AS g,
                                          CAST(round(p * (1 - p) * 16777216) AS BIGINT) AS h FROM cell, share),
          root AS MATERIALIZED {_best_cuts("summand")},
          side AS (SELECT s.row_id, s.k, CASE WHEN s.v <= r.v THEN 'L' ELSE 'R' END AS path FROM summand s JOIN root r ON s.k = r.k AND s.f = r.f),
          below AS MATERIALIZED {_best_cuts("(SELECT s.* REPLACE (side.path AS path) FROM summand s JOIN side USING (row_id, k))")},
          made AS (FROM root UNION ALL SELECT k, path, f, v, gain FROM below QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, path) = 1)
          SELECT made.*, above FROM made JOIN (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS above FROM (SELECT DISTINCT f, v FROM cell)) USING (f, v))""",
)
def _(f):
    """Splits of the first round of boosting on the evidence scores in steps of a 64th, three leaves a tree."""
    rows = materialize(_labelled_suspects(f)).select(
        F.monotonically_increasing_id().alias("id"),
        F.array(*[F.floor(F.col(c) * 64.0).cast("double") for c in ml.PRIORITY_SCORES]).alias("x"),
        (F.array_position(F.lit(["LOW", "MEDIUM", "HIGH"]), F.upper(F.trim("disease_priority"))) - 1).cast("int").alias("y"),
    )
    booster = hist_boosting.fit(rows, 3, rounds=1, leaves=3, stop_from=1 << 62)
    splits = booster.split_table() if booster and booster.rounds else []
    made = rows.sparkSession.createDataFrame(splits, "class int, path string, first_column int, cut double, gain double")
    return made.withColumn("gain", F.round("gain", 4))


@query("m9_model_comparison")
def _(f):
    return ml.compare_models(_labelled_suspects(f))


@query(
    "m10_confusion_matrix",
    "SELECT actual, predicted, count(*) AS n FROM labelled GROUP BY ALL",
)
def _(f):
    return ml.confusion(ml.priority_columns(f.predictions), predicted="ml_priority")


@query(
    "m10_class_report",
    """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
         SELECT class, precision, recall, f1, support FROM (SELECT c AS class,
           CASE WHEN pred > 0 THEN tp / CAST(pred AS DOUBLE) ELSE 0.0e0 END AS precision, CASE WHEN sup > 0 THEN tp / CAST(sup AS DOUBLE) ELSE 0.0e0 END AS recall,
           CASE WHEN pred + sup > 0 THEN 2 * tp / CAST(pred + sup AS DOUBLE) ELSE 0.0e0 END AS f1, sup AS support FROM reported)
         UNION ALL SELECT 'macro avg', sum(p) / 3, sum(r) / 3, sum(f) / 3, CAST(sum(sup) AS BIGINT) FROM reported
         UNION ALL SELECT 'weighted avg', sum(p * sup) / sum(sup), sum(r * sup) / sum(sup), sum(f * sup) / sum(sup), CAST(sum(sup) AS BIGINT) FROM reported)""",
)
def _(f):
    return ml.class_report(ml.priority_columns(f.predictions), predicted="ml_priority")


@query(
    "m10_accuracy",
    """SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(hits) / CAST(sum(n) AS DOUBLE), 6) AS accuracy,
              round(avg(hits / CAST(n AS DOUBLE)), 6) AS balanced_accuracy
       FROM (SELECT actual, count(*) AS n, count(*) FILTER (actual = predicted) AS hits FROM labelled GROUP BY actual)""",
)
def _(f):
    return ml.accuracy_report(ml.priority_columns(f.predictions), predicted="ml_priority")


@query(
    "m11_expected_priority",
    """SELECT bene_id, hcc_v28, gap_type, predicted AS ml_priority, round_even(10000.0e0 * (p1 * 0.5e0 + p2), 0) / 10000.0e0 AS ml_priority_score,
              round_even(10000.0e0 * p0, 0) / 10000.0e0 AS ml_low_probability, round_even(10000.0e0 * p1, 0) / 10000.0e0 AS ml_medium_probability,
              round_even(10000.0e0 * p2, 0) / 10000.0e0 AS ml_high_probability FROM labelled""",
)
def _(f):
    return ml.priority_columns(f.predictions).drop("actual", "ml_model_version")


_W4 = """SELECT bene_id, hcc_v28, gap_type, row_number() OVER (ORDER BY s DESC, h DESC, bene_id, CAST(hcc_v28 AS INTEGER), gap_type) AS ml_review_rank
       FROM (SELECT *, round_even(10000.0e0 * (p1 * 0.5e0 + p2), 0) / 10000.0e0 AS s, round_even(10000.0e0 * p2, 0) / 10000.0e0 AS h FROM labelled)"""


@query("w4_ml_rank", f"SELECT *, ml_review_rank <= 100 AS ml_top_100 FROM ({_W4})")
def _(f):
    return ranking.rank_by_expected_priority(ml.priority_columns(f.predictions)).select(
        *PAIR, "gap_type", "ml_review_rank", "ml_top_100"
    )


@query(
    "m12_outside_model",
    """SELECT bene_id, hcc_v28, gap_type, diagnosis_count, distinct_evidence_months,
              CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'LOW' WHEN p1 >= p2 THEN 'MEDIUM' ELSE 'HIGH' END AS ml_priority,
              round_even(10000.0e0 * (p1 * 0.5e0 + p2), 0) / 10000.0e0 AS ml_priority_score,
              round_even(10000.0e0 * p0, 0) / 10000.0e0 AS ml_low_probability, round_even(10000.0e0 * p1, 0) / 10000.0e0 AS ml_medium_probability,
              round_even(10000.0e0 * p2, 0) / 10000.0e0 AS ml_high_probability, 'hcc_priority_v1' AS ml_model_version
       FROM (SELECT *, 1.0e0 / t AS p0, diagnosis_count / t AS p1, distinct_evidence_months / 2.0e0 / t AS p2
             FROM (SELECT *, 1.0e0 + diagnosis_count + distinct_evidence_months / 2.0e0 AS t FROM suspects_v2))""",
)
def _(f):
    import numpy as np

    def predict(frame):
        z = frame[["diagnosis_count", "distinct_evidence_months", "not_there"]].fillna(0.0).to_numpy(dtype=float)
        raw = np.stack([np.ones(len(z)), z[:, 0], z[:, 1] / 2.0], axis=1)
        return raw / raw.sum(axis=1, keepdims=True)

    rows = f.suspects_v2.select(*PAIR, "gap_type", "diagnosis_count", "distinct_evidence_months")
    return ml.score_with_function(rows, ["diagnosis_count", "distinct_evidence_months", "not_there"], predict)


@query(
    "m13_confidence",
    """SELECT bene_id, hcc_v28, gap_type, round(greatest(p0, p1, p2), 6) AS priority_confidence, round(p2, 6) AS high_priority_probability
       FROM labelled""",
)
def _(f):
    return ml.confidence_columns(f.predictions).drop("probability", "actual")
