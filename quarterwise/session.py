"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quarterwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on for large inputs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split skewed join sides even where that costs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # models of several folds train at the same time
        "spark.scheduler.mode": "FAIR",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quarterwise-shared"


_made: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A path nobody has used before, below the shared folder. It goes when the session ends, or by `forget`."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(forget)
    _made.append((spark, path))
    return path


def forget() -> None:
    """Delete every folder made so far; frames that read them cannot be used afterwards."""
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is not None:  # the session may have been stopped
            file_system, hadoop_path = file_system_of(spark, path)
            file_system.delete(hadoop_path, True)


def file_system_of(spark: SparkSession, path: str):
    """The file system that a path's scheme names, and the path as it knows it."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whichever file system its scheme names."""
    file_system, hadoop_path = file_system_of(spark, path)
    return bool(file_system.exists(hadoop_path))


def write_note(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small text file, written by the driver."""
    file_system, hadoop_path = file_system_of(spark, path)
    out = file_system.create(hadoop_path, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_note(spark: SparkSession, path: str) -> str:
    """A small text file, whatever its name."""
    file_system, hadoop_path = file_system_of(spark, path)
    source = file_system.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: a cut in its lineage."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
