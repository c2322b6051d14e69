"""The usual runs from files to files, put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterwise.operators import chat, clean, evaluate, facts, features, model, normalise, splits
from quarterwise.session import materialise
from quarterwise.sinks import files, upsert
from quarterwise.sources import filings
from quarterwise.spec import MODEL_FEATURES, PanelSpec


def ingest(
    spark: SparkSession,
    facts_path: str,
    filings_path: str,
    out: str,
    as_of: str,
    tags: Sequence[str] = facts.TAGS,
    periods: int = facts.LATEST_PERIODS,
) -> DataFrame:
    """Filing documents to the panel: one row per company and period, stored in three formats below `out`."""
    kept = facts.filter_facts(filings.read_company_facts(spark, facts_path, tags), tags)
    allowed = facts.allowed_filings(filings.read_filings(spark, filings_path), as_of)
    chosen = materialise(facts.facts_of_filings(kept, allowed), "chosen-facts")
    files.write_raw_facts(chosen, f"{out}/raw_facts", ("Company", "tag", "form", "end", "value", "uom", "accn"))
    wide = facts.pivot_last(facts.facts_in_latest_periods(chosen, periods), tags, ["Company"])
    panel = clean.drop_null_columns(materialise(clean.drop_null_rows(wide), "panel"))
    files.write_csv(panel, f"{out}/panel_csv")
    files.write_json_records(panel, f"{out}/panel_json")
    files.write_by_entity(panel, f"{out}/panel")
    return panel


def baselines(
    spark: SparkSession,
    raw: DataFrame,
    out: str,
    spec: PanelSpec = PanelSpec(),
    last_rows: bool = False,
    validation_fraction: float = 0.2,
    **settings,
) -> tuple[DataFrame, DataFrame]:
    """Clean, build features, train, predict with intervals, finalise; returns metrics by model and on held-out rows.

    One row per entity is a small set by nature: for `last_rows` give params=model.SMALL_LAST_ROW.
    """
    panel = clean.clean_panel(raw, spec)
    feats = features.last_row_features(panel, spec) if last_rows else features.timeseries_features(panel, spec)
    prepared = f"{out}/{'prepared_last_rows' if last_rows else 'prepared_timeseries'}"
    feats = spark.read.parquet(files.write_artifact(feats, prepared))
    keys = [spec.entity, spec.time]
    fitted = model.train(feats, spec.kpi, MODEL_FEATURES, holdout=keys, validation_fraction=validation_fraction, **settings)
    # an interval reads the forecasts twice
    scored = materialise(model.predict(feats, fitted), "scored")
    final = normalise.finalise(evaluate.prediction_interval(scored, spec.kpi, [spec.entity, spec.time]), spec.kpi)
    files.write_artifact(final, f"{out}/predictions")
    metrics = evaluate.metrics_by_model(spark.read.parquet(f"{out}/predictions"), spec.kpi)
    files.write_csv(metrics, f"{out}/metrics")
    unseen = evaluate.pooled_metrics(model.held_out(scored, keys, validation_fraction), spec.kpi)
    files.write_csv(unseen, f"{out}/metrics_held_out")
    return metrics, unseen


def chat_files(spark: SparkSession, predictions_path: str, out: str, kpi: str, year_val: int) -> str:
    """Predictions to training and validation records, one folder per split."""
    rows = normalise.normalise_predictions(spark.read.parquet(predictions_path), kpi)
    return files.write_chat(chat.split_by_year(chat.series_records(rows), year_val), out)


def last_row_chat_files(spark: SparkSession, predictions_path: str, out: str, kpi: str, fraction: float = 0.2) -> str:
    """One record per row; the first rows by company are for validation."""
    rows = chat.last_row_records(spark.read.parquet(predictions_path), kpi)
    return files.write_chat(splits.head_split(rows, ["Company", "Date"], fraction), out)


def backtest_report(
    raw: DataFrame,
    train_end: str,
    test_date: str,
    out: str | None = None,
    spec: PanelSpec = PanelSpec(),
    strict: bool = False,
    as_written: bool = False,
    **settings,
) -> tuple[DataFrame, DataFrame]:
    """Clean, build supervised rows, pick features by coverage, backtest; returns comparison and metrics.

    With `out`, the comparison is merged into the prediction table there.
    """
    panel = materialise(clean.clean_panel(raw, spec), "clean-panel")
    sup = features.supervised_strict(panel, spec) if strict else features.supervised(panel, spec, label_date=True)
    sup = materialise(sup, "supervised")
    train = splits.chronological_split(sup, spec=spec).where(F.col("split") == "train")
    chosen = features.gated_features(train)
    compared = model.run_backtest(panel, sup, train_end, test_date, chosen, spec, strict, as_written, **settings)
    compared = materialise(compared, "compared")
    if out:
        upsert.upsert_predictions(compared, out, keep=["actual"])
    return compared, evaluate.pooled_metrics(compared)


__all__ = ["backtest_report", "baselines", "chat_files", "ingest", "last_row_chat_files"]
