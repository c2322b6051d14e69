"""Answers that are looked up by key: bucketed, sorted Parquet instead of one file per answer.

A key's bucket follows from its hash, so a lookup opens the files of one bucket and no others; inside them rows
are sorted by key and carry a Bloom filter of it, so row groups without the key are passed over. The number of buckets
is fixed when a store is written and kept beside it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterwise.session import read_note, write_note

_BUCKET = "bucket"
_ABOUT = "_buckets.json"
#: Answers of a bucket to aim at: a bucket is one file.
PER_BUCKET = 1_000_000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_answer_store(df: DataFrame, path: str, key: str, answer: str, buckets: int | None = None, order: str | None = None) -> str:
    """Write (key, answer), one answer per key: the last by `order`, ties to the greater answer. NULL keys cannot be looked up and are left out.

    Without `buckets` their number follows from a count of the rows. A key with very many answers sends one row per task to
    its bucket.
    """
    spark = df.sparkSession
    keyed = df.where(F.col(key).isNotNull())
    newest = F.struct(*([F.col(order)] if order else []), F.col(answer).alias("answer"))
    kept = keyed.groupBy(F.col(key).cast("string").alias("key")).agg(F.max(newest).alias("last")).select("key", "last.answer")
    n = buckets or max(1, -(-keyed.count() // PER_BUCKET))
    dealt = kept.withColumn(_BUCKET, bucket_of(F.col("key"), n)).repartition(n, _BUCKET).sortWithinPartitions(_BUCKET, "key")
    writer = dealt.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true")
    writer.partitionBy(_BUCKET).parquet(path)
    write_note(spark, f"{path.rstrip('/')}/{_ABOUT}", json.dumps({"buckets": n}))
    return path


def _buckets(spark: SparkSession, path: str) -> int:
    return json.loads(read_note(spark, f"{path.rstrip('/')}/{_ABOUT}"))["buckets"]


_SCHEMA = f"key string, answer string, {_BUCKET} int"


def _store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def answer_of(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, answer) of one key, from the files of its bucket; no row if it is not there."""
    n = _buckets(spark, path)
    # a literal, so that the other buckets' folders are not even listed for the scan
    at = spark.range(1).select(bucket_of(F.lit(key), n)).first()[0]
    return _store(spark, path).where((F.col(_BUCKET) == at) & (F.col("key") == key)).select("key", "answer")


def answers_of(wanted: DataFrame, path: str, key: str) -> DataFrame:
    """`wanted` with the answer of its `key` column, NULL where there is none; only buckets of wanted keys are read if these are few."""
    spark = wanted.sparkSession
    n = _buckets(spark, path)
    asked = wanted.withColumn("__bucket", bucket_of(F.col(key).cast("string"), n))
    store = _store(spark, path).select(F.col("key").alias("__key"), "answer", F.col(_BUCKET).alias("__at"))
    same = (F.col("__bucket") == F.col("__at")) & (F.col(key).cast("string") == F.col("__key"))
    return asked.join(store, same, "left").drop("__bucket", "__key", "__at")
