"""Signals: ordered integer series as DataFrames, and the views of the tables that serve as signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Samples that share a task in positional windows; neighbours of a chunk are copied into it.
CHUNK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, x: the events' values in cents."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.round(F.col("value") * 100).cast("long").alias("x"))


def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, l, r: the events' values in cents and 100 times the k of their properties."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("n"), F.round(F.col("value") * 100).cast("long").alias("l"), (F.get_json_object("props", "$.k").cast("long") * 100).alias("r"))


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, n, x: one signal for each user, in the order of time and id."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", (n - 1).cast("long").alias("n"), F.round(F.col("value") * 100).cast("long").alias("x"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, v: the embeddings as fingerprints of frames."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("f"), F.col("embedding").cast("array<double>").alias("v"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, line: documents as streams of lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


def halo(signal: DataFrame, before: int, after: int, chunk: int = CHUNK, n: str = "n") -> DataFrame:
    """``signal`` dealt into chunks, each with copies of the ``before`` samples before it and ``after`` past it.

    chunk is a sample's chunk there, own tells samples from copies. Positional windows partitioned by
    chunk then give what they would give over the whole signal, in tasks of bounded size.
    """
    if max(before, after) > chunk:
        raise ValueError("a halo can't be wider than a chunk")
    c = F.floor(F.col(n) / chunk).cast("long")
    at = F.col(n) - c * chunk
    places = F.array_compact(F.array(c, F.when(at >= chunk - before, c + 1), F.when(at < after, c - 1)))
    return signal.withColumn("chunk", F.explode(places)).withColumn("own", F.col("chunk") == c)


def near(n: str = "n") -> Window:
    """The order of a chunk."""
    return Window.partitionBy("chunk").orderBy(n)


def owned(signal: DataFrame, *columns: Column | str) -> DataFrame:
    return signal.filter("own").select(*columns)


def div(a: str, k: int) -> Column:
    """Floor division of a column."""
    return F.floor(F.col(a) / k).cast("long")
