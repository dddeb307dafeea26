"""Registered queries of the modelling side."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import adapters as a
from vitalspan.ml import cv, evaluate, margins, models, prep, sampling, shared
from vitalspan.ml.calibrate import calibrate
from vitalspan.ml.specs import (
    CATEGORICAL,
    FULL_NUMERIC,
    GRID_COSTS,
    GRID_SPEC,
    GRID_WEIGHTS,
    LOGIT_MODELS,
    MARGIN_MODELS,
    UNDERSAMPLED_MODELS,
    ModelSpec,
)
from vitalspan.operators import tenants
from vitalspan.plans import training
from vitalspan.session import cut_lineage, scratch_path
from vitalspan.sources import tables, tenant_files

NUMBERS = ("n_chars", "n_words", "n_lines")
KINDS = ("lang", "source")
LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
DOCUMENT_LOGIT = ModelSpec(NUMBERS, KINDS, kind="lbfgs", folds=5)
GAP = ("1999-01-01", "1999-06-01")


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.labelled_documents(spark, sf_dir)
    out = [f"{c}_scaled" for c in NUMBERS]
    model = prep.PopulationScaler(inputCols=list(NUMBERS), outputCols=out).fit(rows)
    return model.transform(rows).select("row_id", *out)


def onehot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set features per row, with every level and without each column's first."""
    rows = a.labelled_documents(spark, sf_dir)
    frames = []
    for variant, drop in (("all", False), ("rest", True)):
        spec = ModelSpec((), KINDS, drop_first=drop)
        model, encoded = prep.encode(rows, spec)
        names = F.lit(prep.encoded_names(model, spec))
        exploded = encoded.select("row_id", F.posexplode(vector_to_array("encoded")).alias("place", "value"))
        frames.append(
            exploded.where(F.col("value") != 0).select(
                "row_id", F.lit(variant).alias("variant"), F.get(names, F.col("place")).alias("feature"), "value"
            )
        )
    return frames[0].unionByName(frames[1])


def kbest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best features of each fold's training rows, from one pass over all rows."""
    encoded = shared.encode_once(a.labelled_documents(spark, sf_dir), NUMBERS, KINDS, folds=10)
    best = shared.best_per_fold(shared.left_out(shared.cells(encoded), encoded.folds), 10)
    names = F.array(*[F.lit(encoded.shown(k)) for k in range(len(encoded.names))])
    return best.select(F.col("without").alias("fold"), F.get(names, F.col("feature")).alias("feature"))


def kbest_fit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that a cross-validated model's own selection has chosen."""
    spec = ModelSpec(NUMBERS, KINDS, kind="lbfgs", select=10, folds=3)
    result = cv.cross_validate(a.labelled_documents(spark, sf_dir), spec, 1.0)
    return cv.selected_features(result, spec, spark)


def logit_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.cross_validate(a.labelled_documents(spark, sf_dir), DOCUMENT_LOGIT, 1.0).folds


def model_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = {
        "baseline": ModelSpec(NUMBERS[:1], costs=(1.0, 10.0), kind="lbfgs", folds=3),
        "full": ModelSpec(NUMBERS, KINDS, costs=(1.0, 10.0), kind="lbfgs", folds=3),
    }
    return cv.sweep(a.labelled_documents(spark, sf_dir), chosen, date=None)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ModelSpec(NUMBERS, KINDS, folds=3)
    return margins.grid_margins(a.labelled_documents(spark, sf_dir), spec, GRID_COSTS, GRID_WEIGHTS, components=64, maxIter=15)


def vector_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ModelSpec]:
    rows = a.labelled_vectors(spark, sf_dir)
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = tuple(f"e{i}" for i in range(width))
    return rows.select("row_id", "label", *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(names)]), ModelSpec(
        names, folds=3
    )


def kernel_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spec = vector_columns(spark, sf_dir)
    return cv.cross_validate(rows, spec, 0.2, components=128, maxIter=25).folds


def undersampled_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spec = vector_columns(spark, sf_dir)
    sampler = sampling.edited_nearest_neighbours()
    return cv.cross_validate(rows, spec, 0.2, sampler=sampler, components=128, maxIter=25).folds


def enn_undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.labelled_vectors(spark, sf_dir)
    points = rows.select("row_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    return sampling.edited_rows(points)


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.labelled_documents(spark, sf_dir).select("row_id", "label")
    return cv.stratified_folds(rows, "row_id", k=10)


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.labelled_documents(spark, sf_dir)
    ensemble = calibrate(rows, DOCUMENT_LOGIT, 1.0, folds=5)
    return ensemble.transform(rows).select("row_id", "label", "probability_1")


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = models.fit_model(a.labelled_documents(spark, sf_dir), DOCUMENT_LOGIT, 1.0)
    return models.coefficients(model, DOCUMENT_LOGIT, spark)


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model saved and loaded again."""
    rows = a.labelled_documents(spark, sf_dir)
    path = scratch_path(spark, "model")
    tables.save_model(models.fit_model(rows, DOCUMENT_LOGIT, 1.0), path)
    return models.scores(tables.load_model(path), rows).select("row_id", "score", "probability_1", "prediction")


def evaluation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "evaluations")
    tables.append_evaluations(model_sweep(spark, sf_dir), path)
    return tables.read_evaluations(spark, path, drop=["logged_at", "weights", "features"])


def roundtrip_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per label, and those that a model scores alike before saving and after loading."""
    rows = a.labelled_documents(spark, sf_dir)
    path = scratch_path(spark, "model")
    model = models.fit_model(rows, DOCUMENT_LOGIT, 1.0)
    tables.save_model(model, path)
    before = models.scores(model, rows).select("row_id", "label", "score", "probability_1")
    after = models.scores(tables.load_model(path), rows).select("row_id", F.col("score").alias("again"), F.col("probability_1").alias("again_1"))
    same = (F.col("score") == F.col("again")) & (F.col("probability_1") == F.col("again_1"))
    return before.join(after, "row_id").groupBy("label").agg(F.count(F.lit(1)).alias("scored"), F.count_if(same).alias("equal"))


def logged_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two thresholds per line status, logged by two runs and read back as one log."""
    mixed = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1000
    lines = a.table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("model_name"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (mixed / 1000.0).alias("score")
    )
    path = scratch_path(spark, "evaluations")
    for threshold in (0.25, 0.75):
        said = lines.withColumn("prediction", evaluate.label_at(F.col("score"), threshold))
        found = evaluate.class_metrics(said, keys=["model_name"])
        logged = found.select(
            "model_name",
            F.array(F.lit("score")).alias("features"),
            F.create_map(F.lit(0), F.lit(1.0), F.lit(1), F.lit(1.0)).alias("weights"),
            "accuracy",
            F.lit(None).cast("double").alias("roc_auc"),
            *("f1", "precision", "recall"),
            F.lit("threshold").alias("kind"),
            F.lit(False).alias("outside_spell"),
            F.lit(threshold).alias("c"),
        )
        tables.append_evaluations(logged, path)
    log = tables.read_evaluations(spark, path, drop=["roc_auc", "outside_spell"])
    return log.select(
        *("model_name", "kind", "c"),
        *[F.round(m, 6).alias(m) for m in ("accuracy", "f1", "precision", "recall")],
        F.array_join("features", ",").alias("features"),
        F.col("weights")[1].alias("weight_1"),
        F.col("logged_at").isNotNull().alias("stamped"),
    )


def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set written to a snapshot, and its labelled rows read back."""
    from catalog.queries import build_full_training

    path = scratch_path(spark, "training")
    tables.snapshot(build_full_training(spark, sf_dir), path)
    labelled = tables.read_labelled(spark, path)
    return labelled.groupBy(F.col("hs_did_change").cast("int").alias("label"), "change_type_order").agg(
        F.count(F.lit(1)).alias("stored"), F.countDistinct("sf_an").alias("accounts")
    )


def labels_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.scored_lines(spark, sf_dir).withColumn("prediction", evaluate.label_at(F.col("score"), 0.5))


def roc_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the score, of no skill, and of the hard labels."""
    rows = labels_said(spark, sf_dir)
    kinds = F.array(
        F.struct(F.lit("score").alias("kind"), F.col("score").alias("s")),
        F.struct(F.lit("no skill").alias("kind"), F.lit(0.0).alias("s")),
        F.struct(F.lit("labels").alias("kind"), F.col("prediction").cast("double").alias("s")),
    )
    long = rows.select("label", F.explode(kinds).alias("k")).select("label", "k.kind", F.col("k.s").alias("score"))
    return evaluate.roc_auc(long, keys=["kind"])


def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.scored_lines(spark, sf_dir)
    best = evaluate.best_threshold(evaluate.threshold_sweep(rows)).first()["threshold"]
    return evaluate.tuned_metrics(rows, best).withColumn("threshold", F.lit(best))


def decision_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.scored_lines(spark, sf_dir).withColumn("score", F.col("score") * 8 - 3)
    return evaluate.reliability_curve(rows, normalize=True)


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.correlations(a.table(spark, sf_dir, "lineitem"), LINE_NUMBERS)


def collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = a.table(spark, sf_dir, "lineitem").withColumn("cost", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return prep.collinear_pairs(lines, [*LINE_NUMBERS, "cost"], above=0.5)


def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = a.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "label")
    return prep.anova_f(lines, LINE_NUMBERS)


def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalog.queries import build_full_training

    return training.labelled_rows(build_full_training(spark, sf_dir), FULL_NUMERIC + CATEGORICAL, outside=GAP)


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set's labelled rows with a key, the date and a numeric label."""
    from catalog.queries import build_full_training

    rows = training.labelled_rows(build_full_training(spark, sf_dir), FULL_NUMERIC + CATEGORICAL)
    keyed = shared.identified(rows).withColumn("label", F.col("hs_did_change").cast("double"))
    return cut_lineage(keyed.drop("hs_did_change"))


def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the labelled rows, and what a unique key has to satisfy."""
    keyed = model_rows(spark, sf_dir)
    return keyed.groupBy("label").agg(F.count(F.lit(1)).alias("labelled"), F.countDistinct("row_id").alias("keys"))


def logit_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logistic model and cost on the training set, with and without the spell."""
    return shared.sweep_logistic(model_rows(spark, sf_dir), LOGIT_MODELS)


def margin_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return margins.sweep_margins(model_rows(spark, sf_dir), MARGIN_MODELS, components=64, maxIter=15)


def undersampled_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under-sampled margin models with all kernel components, each fit run until it has converged."""
    sampler = sampling.edited_nearest_neighbours()
    return margins.sweep_margins(model_rows(spark, sf_dir), UNDERSAMPLED_MODELS, sampler=sampler, maxIter=None)


def training_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return margins.grid_margins(model_rows(spark, sf_dir), GRID_SPEC, GRID_COSTS, GRID_WEIGHTS, components=64, maxIter=15)


def margin_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of the margin classifier's held-out scores before and after calibration."""
    rows = a.labelled_documents(spark, sf_dir)
    stored = cv.held_out(rows, ModelSpec(NUMBERS, KINDS, folds=5), 0.2, components=64, maxIter=15)
    before = evaluate.reliability_curve(stored, normalize=True).withColumn("curve", F.lit("before"))
    after = shared.calibrated_scores(stored, ["fold"]).drop("score").withColumnRenamed("probability_1", "score")
    return before.unionByName(evaluate.reliability_curve(after).withColumn("curve", F.lit("after")))


def tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = a.tenant_directory(spark, sf_dir)
    done = directory.where(F.col("number") % 7 == 0).select(F.col("db").alias("client"))
    return tenants.pending_tenants(directory.drop("number"), done)


def tenant_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written per nation as CSV, read back, with each nation's ledger."""
    path = scratch_path(spark, "extract")
    events = a.tenant_events(spark, sf_dir).select("client", "event_id", "user_id", "event_type", "k")
    tenant_files.write_tenant_csv(events, path)
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string, k int")
    rows = tenant_files.read_tenant_csv(spark, path, schema)
    ledger = tenants.row_ledger(a.tenant_tables(spark, sf_dir).clients, rows)
    sums = rows.groupBy("client").agg(F.sum("k").alias("k_total"), F.countDistinct("user_id").alias("users"))
    return ledger.join(sums, "client", "left")


def tenant_gather_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extracts whose files have other columns in another order, stacked by name."""
    events = a.tenant_events(spark, sf_dir)
    first, second = scratch_path(spark, "extract"), scratch_path(spark, "extract")
    tenant_files.write_tenant_csv(events.where("event_id % 2 = 0").select("client", "event_id", "user_id", "event_type", "k"), first)
    tenant_files.write_tenant_csv(events.where("event_id % 2 = 1").select("k", "event_id", "client", F.lit("x").alias("more"), "user_id"), second)
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string, k int")
    rows = tenant_files.combine_csv(spark, [first, second], [schema, schema])
    sums = [F.sum("k").alias("k_total"), F.countDistinct("user_id").alias("users"), F.sum("event_id").alias("ids"), F.count("event_type").alias("typed")]
    return rows.groupBy("client").agg(*sums)


def tenant_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in which one batch of tenants fails, resumed by a second run."""
    path = scratch_path(spark, "runs")
    events = a.tenant_events(spark, sf_dir).select("client", "event_id", "user_id", "event_type", "k")
    clients = a.tenant_tables(spark, sf_dir).clients
    lost = clients.agg(F.min("client")).first()[0]

    def extract(some: DataFrame, failing: bool) -> DataFrame:
        if failing and some.where(F.col("client") == lost).take(1):
            raise ConnectionError("no answer")
        return events.join(some, "client", "left_semi")

    tenant_files.run_tenants(clients, lambda some: extract(some, True), path, batches=4)
    tenant_files.run_tenants(clients, lambda some: extract(some, False), path, batches=4)
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string, k int")
    rows = tenant_files.read_committed(spark, path, schema)
    ledger = tenant_files.read_ledger(spark, path).where("failure IS NULL").select("client", "row_count")
    sums = rows.groupBy("client").agg(F.sum("k").alias("k_total"), F.countDistinct("user_id").alias("users"))
    return ledger.join(sums, "client", "left")


def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made of order lines, then replaced with a part of itself."""
    name = "lines_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    tables.materialize(a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), name)
    kept = tables.materialize(spark.table(name).where("l_quantity > 10"), name)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


MODELLING = {
    "labelled_rows": labelled_rows,
    "tenant_filter": tenant_filter,
    "tenant_gather": tenant_gather,
    "tenant_gather_runs": tenant_gather_runs,
    "tenant_resume": tenant_resume,
    "replaced_table": replaced_table,
    "scale_features": scaled_features,
    "onehot_features": onehot_features,
    "corr_matrix": correlation_matrix,
    "collinear_pairs": collinear,
    "anova_f": anova,
    "kbest_features": kbest_features,
    "kbest_fit_features": kbest_fit_features,
    "row_identity": row_identity,
    "logit_models": logit_models,
    "margin_models": margin_models,
    "undersampled_models": undersampled_models,
    "training_grid": training_grid,
    "margin_calibration": margin_calibration,
    "weighted_logit_cv": logit_folds,
    "model_sweep": model_sweep,
    "grid_search": grid,
    "rff_svm_cv": kernel_folds,
    "undersampled_cv": undersampled_folds,
    "enn_undersample": enn_undersample,
    "stratified_folds": folds,
    "platt_calibration": calibrated,
    "coefficients": coefficients,
    "model_roundtrip": model_roundtrip,
    "roundtrip_equality": roundtrip_equality,
    "eval_log": evaluation_log,
    "logged_thresholds": logged_thresholds,
    "stored_labels": stored_labels,
    "class_metrics": lambda s, d: evaluate.class_metrics(labels_said(s, d)),
    "roc_auc": roc_areas,
    "roc_points": lambda s, d: evaluate.roc_points(a.scored_lines(s, d)),
    "threshold_sweep": lambda s, d: evaluate.threshold_sweep(a.scored_lines(s, d)),
    "best_threshold_metrics": tuned,
    "reliability_curve": lambda s, d: evaluate.reliability_curve(a.scored_lines(s, d)),
    "decision_reliability": decision_reliability,
}
