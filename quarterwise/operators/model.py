"""Pooled boosted-tree regressor: binning, training, learning curve, masked prediction, backtest over one or many folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import InheritableThread
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, QuantileDiscretizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterwise.functions.numbers import rmse
from quarterwise.operators import backtest
from quarterwise.operators.evaluate import pooled_metrics
from quarterwise.operators.features import present_features
from quarterwise.operators.splits import hash_split
from quarterwise.session import materialise, new_folder
from quarterwise.spec import MODEL_FEATURES, PanelSpec

_VECTOR = "__features"
_RAW = "__prediction"
_LEAVES = "__leaves"
_BIN = "__bin_"
#: Bins of a feature at most, and the rank error of their edges.
BINS = 256
RANK_ERROR = 1e-4
#: Folds whose models are trained at the same time.
CONCURRENT = 8


@dataclass(frozen=True)
class TreeParams:
    trees: int
    depth: int
    rate: float
    row_share: float = 0.9
    column_share: float = 0.9
    seed: int = 42


# The regular setting, and those that suit sets too small for it.
REGULAR = TreeParams(600, 4, 0.05)
SMALL_LAST_ROW = TreeParams(100, 3, 0.1)
SMALL = TreeParams(200, 3, 0.08)
MIN_ROWS = 5

#: Parameters, or what chooses them by the number of complete rows and of features.
Params = TreeParams | Callable[[int, int], TreeParams]


def by_rows(small: TreeParams = SMALL_LAST_ROW, least: int = MIN_ROWS, features_too: bool = False, regular: TreeParams = REGULAR) -> Params:
    """The `small` setting for sets of fewer than `least` rows (with `features_too`, or no more rows than features), else `regular`."""
    return lambda n_rows, n_features: small if n_rows < (max(least, n_features + 1) if features_too else least) else regular


def fit_bins(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> Bucketizer:
    """Edges of up to `bins` bins per feature from one pass of mergeable quantile sketches; outer bins are open."""
    sketch = QuantileDiscretizer(
        inputCols=list(features), outputCols=[_BIN + c for c in features], numBuckets=bins, relativeError=RANK_ERROR, handleInvalid="keep"
    )
    return sketch.fit(rows)


def assembler(features: Sequence[str]) -> VectorAssembler:
    # "keep" turns a NULL into NaN, which a tree sends down the right branch
    return VectorAssembler(inputCols=list(features), outputCol=_VECTOR, handleInvalid="keep")


@dataclass(frozen=True)
class TrainedModel:
    pipeline: PipelineModel
    features: tuple[str, ...]
    params: TreeParams
    n_rows: int

    @property
    def boosted(self) -> GBTRegressionModel:
        return self.pipeline.stages[-1]


def complete_rows(df: DataFrame, target: str, features: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Rows without a gap in target and features, as `label`, the features and further columns, stored.

    Boosting reads its input many times: the rows are written once, so that neither the plan
    behind them nor a lost executor makes Spark compute them again.
    """
    used = present_features(df, features)
    complete = df.na.drop("any", subset=[*used, target])
    more = [c for c in carry if c not in used]
    return materialise(complete.select(F.col(target).cast("double").alias("label"), *used, *more), "training-rows")


def fit(rows: DataFrame, features: Sequence[str], params: Params = REGULAR, min_rows: int = MIN_ROWS, bins: Bucketizer | None = None) -> TrainedModel:
    """Fit the pooled regressor on stored complete rows.

    Too few of them are an error that names a setting for such sets, unless `params` chooses by rows. With `bins`,
    `rows` hold bin numbers in place of the features. The session's checkpoint folder cuts the lineage that the boosting rounds build up.
    """
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(new_folder(spark, "boosting"))
    n = rows.count()
    if n < (1 if callable(params) else min_rows):
        raise ValueError(f"{n} complete rows to train on; below {min_rows} give min_rows=1 and params=SMALL or SMALL_LAST_ROW, or params=by_rows()")
    chosen = params(n, len(features)) if callable(params) else params
    learner = GBTRegressor(
        featuresCol=_VECTOR,
        labelCol="label",
        predictionCol=_RAW,
        maxIter=chosen.trees,
        maxDepth=chosen.depth,
        stepSize=chosen.rate,
        subsamplingRate=chosen.row_share,
        featureSubsetStrategy=str(chosen.column_share),
        maxBins=BINS,
        seed=chosen.seed,
        checkpointInterval=10,
        # a row finds its node in at most `depth` steps, which is cheaper than carrying node ids from job to job
        cacheNodeIds=False,
    )
    assemble = assembler([_BIN + c for c in features] if bins else features)
    fitted = learner.fit(assemble.transform(rows))
    stages = [bins, assemble, fitted] if bins else [assemble, fitted]
    return TrainedModel(PipelineModel(stages), tuple(features), chosen, n)


def train(
    df: DataFrame,
    target: str,
    features: Sequence[str] = MODEL_FEATURES,
    params: Params = REGULAR,
    holdout: Sequence[str] = (),
    validation_fraction: float = 0.2,
    min_rows: int = MIN_ROWS,
) -> TrainedModel:
    """Fit the pooled regressor on complete rows. Validation rows are never used to stop early.

    With `holdout`, about `validation_fraction` of the rows, told by a hash of these key columns, is
    kept out of the fit; `held_out` gives the same rows. Parameters are what the caller says.
    """
    used = present_features(df, features)
    source = hash_split(df, holdout, validation_fraction).where(F.col("split") == "train") if holdout else df
    return fit(complete_rows(source, target, used), used, params, min_rows)


def held_out(df: DataFrame, keys: Sequence[str], validation_fraction: float = 0.2) -> DataFrame:
    """The rows that `train` keeps out of its fit."""
    return hash_split(df, keys, validation_fraction).where(F.col("split") == "val").drop("split")


def predict(df: DataFrame, model: TrainedModel, output: str = "xgb_point", complete_only: bool = True) -> DataFrame:
    """Add forecasts in one pass. Rows that lack a feature get NULL, or a forecast too if not `complete_only`."""
    scored = model.pipeline.transform(df)
    forecast = F.col(_RAW)
    if complete_only:
        complete = F.lit(True)
        for c in model.features:
            complete = complete & F.col(c).isNotNull()
        forecast = F.when(complete, forecast)
    return scored.withColumn(output, forecast).drop(_RAW, _VECTOR, *[_BIN + c for c in model.features])


def running_sums(values: Column, n: int) -> Column:
    """Sums of the first 1, 2, ... n entries of an array, in blocks so that the work is n times the root of n."""
    block = max(1, math.isqrt(n))
    starts = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // block)), lambda b: b * block + 1)

    def along(array: Column) -> Column:
        empty = F.array().cast("array<double>")
        return F.aggregate(array, empty, lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + x)))

    inside = F.transform(starts, lambda at: along(F.slice(values, at, F.lit(block))))
    before = along(F.concat(F.array(F.lit(0.0)), F.transform(inside, lambda sums: F.try_element_at(sums, F.lit(-1)))))
    return F.flatten(F.zip_with(inside, F.slice(before, 1, F.size(inside)), lambda sums, b: F.transform(sums, lambda x: x + b)))


def _leaf_values(model: TrainedModel, spark) -> DataFrame:
    """One row: per tree, in order, the weighted forecasts of its leaves. Its size is trees times leaves, whatever the data."""
    path = new_folder(spark, "trees")
    model.boosted.write().save(path)
    first, *later = model.boosted.treeWeights
    node = F.col("nodeData")
    weight = F.when(F.col("treeID") == 0, first).otherwise(later[0] if later else first)
    # leaves are numbered in the order of their node ids
    leaves = spark.read.parquet(f"{path}/data").where(node["leftChild"] < 0).groupBy("treeID").agg(
        F.array_sort(F.collect_list(F.struct(node["id"].alias("id"), (node["prediction"] * weight).alias("y")))).alias("leaves")
    )
    ordered = F.array_sort(F.collect_list(F.struct("treeID", F.transform("leaves", lambda x: x["y"]).alias("y"))))
    return materialise(leaves.agg(F.transform(ordered, lambda t: t["y"]).alias("trees")), "leaf-values")


def learning_curve(model: TrainedModel, rows: DataFrame, actual: str) -> DataFrame:
    """(round, n_rows, mae, rmse) on complete rows after each boosting round, from 1 to the number of trees.

    One pass over the rows: the leaves that a row falls into give the forecast of every round as running sums. No
    round is left out and none is stopped on; the model is the same with or without a curve.
    """
    n = len(model.boosted.treeWeights)
    used = rows.na.drop("any", subset=[*model.features, actual])
    leafed = model.boosted.copy().setLeafCol(_LEAVES)
    scored = leafed.transform(PipelineModel(model.pipeline.stages[:-1]).transform(used))
    trees = _leaf_values(model, rows.sparkSession).scalar()
    placed = scored.select(F.col(actual).cast("double").alias("y"), vector_to_array(_LEAVES).alias("leaf")).withColumn("trees", trees)
    steps = F.zip_with("leaf", "trees", lambda at, values: F.element_at(values, at.cast("int") + 1))
    errors = placed.select(F.posexplode(F.transform(running_sums(steps, n), lambda x: F.col("y") - x)).alias("at", "err"))
    return errors.groupBy((F.col("at") + 1).alias("round")).agg(
        F.count("err").alias("n_rows"), F.avg(F.abs("err")).alias("mae"), rmse(F.col("err") * F.col("err")).alias("rmse")
    )


def train_and_validate(
    train_rows: DataFrame, val_rows: DataFrame, features: Sequence[str], target: str = "y_next", **settings
) -> tuple[TrainedModel, DataFrame]:
    """The model with its metrics on held-out rows; `learning_curve` has those of every round."""
    model = train(train_rows, target, features, **settings)
    return model, pooled_metrics(predict(val_rows, model), actual=target)


def run_backtest(
    panel: DataFrame,
    sup: DataFrame,
    train_end: str,
    test_date: str,
    features: Sequence[str],
    spec: PanelSpec = PanelSpec(),
    strict: bool = False,
    as_written: bool = False,
    **settings,
) -> DataFrame:
    """Train up to train_end, forecast test_date, put forecasts beside actuals.

    Leakage checks run before anything is trained. `strict` wants supervised rows from
    supervised_strict and scores on the KPI at test_date itself. Otherwise the label of the last
    training rows is the value at the test date, which the check on label dates stops, unless the caller
    asks for the procedure `as_written`.
    """
    rows = backtest.training_rows(sup, train_end, spec, strict)
    tests = backtest.test_rows(panel, test_date, spec)
    checks = backtest.AS_WRITTEN_CHECKS if as_written else backtest.BLOCKING_CHECKS
    backtest.require_no_leakage(backtest.leakage_report(rows, tests, train_end, test_date, spec), checks)
    forecasts = _forecasts(tests, train(rows, "y_next", features, **settings))
    truth = backtest.actuals(sup, panel, [test_date], spec, "at_test_date" if strict else "next")
    return backtest.compare(forecasts, truth, _COMPARED, spec)


_COMPARED = ["arima_naive", "arima_drift", "xgb_point"]


def _forecasts(tests: DataFrame, model: TrainedModel) -> DataFrame:
    # every test row is forecast, as it stands
    return predict(backtest.naive_drift(tests), model, complete_only=False)


def fit_folds(
    rows: DataFrame,
    train_ends: Sequence[str],
    features: Sequence[str],
    spec: PanelSpec = PanelSpec(),
    strict: bool = False,
    params: Params = REGULAR,
    min_rows: int = MIN_ROWS,
    bins: Bucketizer | None = None,
    concurrent: int = CONCURRENT,
) -> dict[str, TrainedModel]:
    """One model per training end, on stored rows, `concurrent` of them at a time.

    Boosting is a long chain of short jobs that leaves most of a cluster idle; the chains of several folds fill it. Each
    runs in a scheduler pool of its own, which shares executors fairly where the session schedules fairly (`build_session` does).
    """
    context = rows.sparkSession.sparkContext

    def one(end: str) -> TrainedModel:
        context.setLocalProperty("spark.scheduler.pool", f"fold-{end}")
        return fit(backtest.training_rows(rows, end, spec, strict), features, params, min_rows, bins)

    wanted = sorted(set(train_ends))
    if not context.getCheckpointDir():
        context.setCheckpointDir(new_folder(rows.sparkSession, "boosting"))
    found: dict[str, TrainedModel] = {}
    with ThreadPoolExecutor(max(1, concurrent)) as pool:
        for end, model in zip(wanted, pool.map(lambda end: _in_thread(one, end), wanted)):
            found[end] = model
    return found


def _in_thread(run: Callable[[str], TrainedModel], end: str) -> TrainedModel:
    """The result of `run` in a thread that has its own JVM thread and the caller's job settings."""
    got: list = []

    def kept() -> None:
        try:
            got.append((run(end), None))
        except Exception as e:  # noqa: BLE001 - raised again by the caller
            got.append((None, e))

    thread = InheritableThread(target=kept)
    thread.start()
    thread.join()
    model, error = got[0]
    if error is not None:
        raise error
    return model


def run_walk_forward(
    panel: DataFrame,
    sup: DataFrame,
    folds: Sequence[tuple[str, str]],
    features: Sequence[str],
    spec: PanelSpec = PanelSpec(),
    strict: bool = False,
    as_written: bool = False,
    params: Params = REGULAR,
    min_rows: int = MIN_ROWS,
    concurrent: int = CONCURRENT,
    share_bins: bool | None = None,
) -> DataFrame:
    """The backtest for several (train_end, test_date) folds.

    What folds share is done once: test rows of all folds in one job, leakage checks of all folds in one
    aggregate, complete rows stored once, and, with `share_bins`, binned once. Models are trained several at a time.
    Shared bin edges come from the rows of all folds; they hold no labels, but the distribution of later features, so
    they are the default only where the procedure is not `strict`.
    """
    if not folds:
        raise ValueError("no folds given")
    used = present_features(sup, features)
    share_bins = not strict if share_bins is None else share_bins
    dates = [c for c in ("label_date",) if c in sup.columns]
    stored = complete_rows(sup, "y_next", used, [spec.time, *dates])
    tests = materialise(backtest.walk_forward_rows(panel, [test for _, test in folds], spec), "test-rows")
    checks = backtest.AS_WRITTEN_CHECKS if as_written else backtest.BLOCKING_CHECKS
    backtest.require_no_leakage_in_folds(stored, tests, folds, checks, spec, strict)
    bins = None
    if share_bins:
        last = max(end for end, _ in folds)
        bins = fit_bins(backtest.training_rows(stored, last, spec, strict), used)
        # bin numbers are ordered: without the mark that makes them categories
        numbers = [F.col(_BIN + c).alias(_BIN + c, metadata={}) for c in used]
        binned = bins.transform(stored).select("label", *numbers, spec.time, *dates)
        stored = materialise(binned, "binned-rows")
    models = fit_folds(stored, [end for end, _ in folds], used, spec, strict, params, min_rows, bins, concurrent)
    at = F.col(spec.time)
    forecasts = reduce(
        DataFrame.unionByName, [_forecasts(tests.where(at == F.lit(test).cast("date")), models[end]) for end, test in folds]
    )
    truth = backtest.actuals(sup, panel, [test for _, test in folds], spec, "at_test_date" if strict else "next")
    return backtest.compare(forecasts, truth, _COMPARED, spec)
