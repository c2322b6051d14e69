"""Append-and-deduplicate for prediction tables.

A table is a folder of immutable data files and numbered manifests. A manifest names the files that
make up one version, by year of the date. An upsert writes new files, then publishes the next manifest by
one rename that fails if another writer was first; it then merges again on top of that version. Readers open
the files of the newest manifest and write nothing, so they see one version or the next, never a mixture, and an upsert that
breaks off leaves only files that no version names.

Only files that hold a key of the new rows are rewritten. They are found by reading the key columns of the files of the touched
years; rows are sorted by key inside the files and carry Bloom filters of the entity.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterwise.operators.neighbours import latest_rows
from quarterwise.session import file_system_of, read_note, write_note

# The columns a saved prediction has, and those it may have.
KEY = ("Company", "Date")
SAVED = ("Company", "Date", "xgb_point")
OPTIONAL = ("arima_naive", "arima_drift", "pi_lower", "pi_upper", "year", "quarter", "month", "Revenues")
_TYPES = {"Date": "date", "year": "int", "quarter": "int", "month": "int"} | dict.fromkeys(
    ("xgb_point", "arima_naive", "arima_drift", "pi_lower", "pi_upper", "Revenues"), "double"
)
_PART = "date_year"
_MANIFESTS, _DATA = "_manifests", "data"
#: Versions whose files stay for readers that have opened them.
KEPT_VERSIONS = 10
#: Files of a year beyond which an upsert rewrites the whole year into fewer.
MOST_FILES = 64
ATTEMPTS = 5


class ConcurrentWrite(RuntimeError):
    """Another writer published the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    """One state of a table: its number and, by year (text, "none" for undated rows), the paths of its files below the table."""

    number: int
    files: Mapping[str, tuple[str, ...]]

    def paths(self, table: str, years: Sequence[str] | None = None) -> list[str]:
        return [f"{table}/{f}" for year in sorted(self.files) if years is None or year in years for f in self.files[year]]


def select_saved(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The columns worth saving; `keep` names further ones, such as the actual value."""
    missing = [c for c in KEY if c not in df.columns]
    if missing:
        raise ValueError(f"missing key columns: {missing}")
    # one type per column, so that files of different writers go together
    typed = df.withColumns({c: F.col(c).try_cast(t) for c, t in _TYPES.items() if c in df.columns})
    return typed.select(*SAVED, *[c for c in (*OPTIONAL, *keep) if c in df.columns and c not in SAVED])


def merge_keep_last(existing: DataFrame, new: DataFrame, order: Sequence[str | Column] = (), key: Sequence[str] = KEY) -> DataFrame:
    """Union of both, one row per key: the new row wins, and the last by `order` among equals.

    NULL keys count as equal. The rank limit runs before the exchange, so a key with
    very many copies sends one row per task.
    """
    return keep_last(
        existing.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True),
        ["__batch", *order],
        key,
    ).drop("__batch")


def keep_last(df: DataFrame, order: Sequence[str | Column], key: Sequence[str] = KEY) -> DataFrame:
    """One row per key, the last by `order`; remaining ties go to the larger row hash."""
    marks = {f"__k{i}": F.struct(F.col(c)) for i, c in enumerate(key)}  # a struct is never NULL
    tied = df.withColumns({**marks, "__hash": F.xxhash64(*df.columns)})
    return latest_rows(tied, list(marks), [*order, "__hash"], 1, "__rn").drop("__rn", "__hash", *marks)


def current_version(spark: SparkSession, path: str) -> Version:
    """The newest version of a table; number 0 without files where there is none yet."""
    numbers = _numbers(spark, path)
    return _version(spark, path, max(numbers)) if numbers else Version(0, {})


def _numbers(spark: SparkSession, path: str) -> list[int]:
    file_system, folder = file_system_of(spark, f"{path.rstrip('/')}/{_MANIFESTS}")
    if not file_system.exists(folder):
        return []
    names = [status.getPath().getName() for status in file_system.listStatus(folder)]
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]


def _version(spark: SparkSession, path: str, number: int) -> Version:
    text = read_note(spark, f"{path.rstrip('/')}/{_MANIFESTS}/{number:012d}.json")
    return Version(number, {year: tuple(names) for year, names in json.loads(text).items()})


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version the newest one, in one step; ConcurrentWrite if its number is taken."""
    jvm = spark.sparkContext._jvm
    at, options = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options
    folder = f"{path.rstrip('/')}/{_MANIFESTS}"
    file_system, draft = file_system_of(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    write_note(spark, draft.toString(), json.dumps(version.files), overwrite=False)
    once = spark.sparkContext._gateway.new_array(options.Rename, 1)
    once[0] = options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, at(f"{folder}/{version.number:012d}.json"), once)
    except Exception as e:  # noqa: BLE001 - told apart by what is there now
        file_system.delete(draft, False)
        if version.number in _numbers(spark, path):
            raise ConcurrentWrite(f"version {version.number} of {path} was published by another writer") from e
        raise


def _read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    # the folders' names are not columns: files of different batches lie in different folders
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*paths)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the table, with the columns of all its files."""
    table = path.rstrip("/")
    paths = current_version(spark, table).paths(table)
    if not paths:
        raise FileNotFoundError(f"no predictions at {path}")
    return _read(spark, paths)


def _year(value: int | None) -> str:
    return "none" if value is None else str(value)


def _touched_files(base: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> list[str]:
    """Paths of the files that hold a key of the new rows; at most one entry per file reaches the driver."""
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
    old = base.select(*key, F.col("_metadata.file_path").alias("path")).alias("o")
    wanted = new.select(*key).distinct().alias("n")
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return [r.path for r in old.join(wanted, cond, "left_semi").select("path").distinct().collect()]


def _written(spark: SparkSession, rows: DataFrame, table: str) -> dict[str, tuple[str, ...]]:
    """Write rows to a new folder below the table, sorted by key inside the files; the files by year."""
    name = f"{_DATA}/{uuid.uuid4().hex}"
    options = {f"parquet.bloom.filter.enabled#{KEY[0]}": "true"}
    dealt = rows.hint("rebalance", _PART).sortWithinPartitions(_PART, *KEY)
    dealt.write.options(**options).partitionBy(_PART).parquet(f"{table}/{name}")
    file_system, folder = file_system_of(spark, f"{table}/{name}")
    found: dict[str, tuple[str, ...]] = {}
    for year in file_system.listStatus(folder):
        label = year.getPath().getName()
        if year.isDirectory() and label.startswith(f"{_PART}="):
            value = label.removeprefix(f"{_PART}=")
            parts = [f.getPath().getName() for f in file_system.listStatus(year.getPath())]
            files = tuple(f"{name}/{label}/{p}" for p in sorted(parts) if p.endswith(".parquet"))
            found["none" if value.startswith("__") else value] = files
    return found


def upsert_predictions(df: DataFrame, path: str, order: Sequence[str] = (), keep: Sequence[str] = (), attempts: int = ATTEMPTS) -> str:
    """Merge predictions into the table at `path`, keeping the last row per (Company, Date).

    Files that hold none of the new keys stay as they are. Columns of either side stay. If another writer publishes
    first, the rows are merged again on top of its version, at most `attempts` times.
    """
    for attempt in range(attempts):
        try:
            _upsert_once(df, path.rstrip("/"), order, keep)
            return path
        except ConcurrentWrite:
            if attempt == attempts - 1:
                raise
    return path


def _upsert_once(df: DataFrame, table: str, order: Sequence[str], keep: Sequence[str]) -> Version:
    spark = df.sparkSession
    new = df.withColumns({f"__s{i}": F.col(c) for i, c in enumerate(order)})
    sort = [f"__s{i}" for i in range(len(order))]
    new = select_saved(new, [*keep, *sort]).withColumn(_PART, F.year("Date"))
    base = current_version(spark, table)
    # bounded by the calendar: one entry per year
    years = [_year(r[0]) for r in new.select(_PART).distinct().collect()] if base.number else []
    files = {year: set(names) for year, names in base.files.items()}
    known = base.paths(table, years)
    if known:
        touched = _touched_files(_read(spark, known), new)
        names = {f"{_DATA}/" + p.split(f"/{_DATA}/")[-1] for p in touched}
        for year in years:
            if len(files.get(year, ())) >= MOST_FILES:
                names |= files[year]
    else:
        names = set()
    if names:
        merged = merge_keep_last(_read(spark, [f"{table}/{n}" for n in sorted(names)]).withColumn(_PART, F.year("Date")), new, sort)
    else:
        merged = keep_last(new, sort)
    for year, added in _written(spark, merged.drop(*sort), table).items():
        files[year] = (files.get(year, set()) - names) | set(added)
    kept = {year: tuple(sorted(files[year] - names)) for year in files}
    version = Version(base.number + 1, {year: names_left for year, names_left in kept.items() if names_left})
    _publish(spark, table, version)
    return version


def vacuum(spark: SparkSession, path: str, versions: int = KEPT_VERSIONS) -> int:
    """Delete manifests before the newest `versions` and the data folders that no remaining one names; returns how many folders.

    For a quiet moment: folders of an upsert that is under way are not named by a manifest yet.
    """
    table = path.rstrip("/")
    file_system, data = file_system_of(spark, f"{table}/{_DATA}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    numbers = sorted(_numbers(spark, table))
    for old in numbers[:-versions]:
        file_system.delete(at(f"{table}/{_MANIFESTS}/{old:012d}.json"), False)
    named = {f.split("/")[1] for n in numbers[-versions:] for names in _version(spark, table, n).files.values() for f in names}
    gone = [status.getPath() for status in file_system.listStatus(data) if status.getPath().getName() not in named]
    for folder in gone:
        file_system.delete(folder, True)
    return len(gone)
