"""Readers and writers: CSV, nested JSON, JSON lines, Parquet, manifests, resumable shards."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated, gzipped or not, with a header; the schema is given, so the data are read once."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """minConceptGroup.minConcept[] of a JSON document -> (name, rxcui), lower-cased; of equal names the last counts."""
    schema = "minConceptGroup struct<minConcept: array<struct<name: string, rxcui: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("minConceptGroup.minConcept").alias("place", "c"))
    rows = rows.select("place", F.lower("c.name").alias("name"), "c.rxcui").where("name <> '' and rxcui <> ''")
    return rows.groupBy("name").agg(F.max_by("rxcui", "place").alias("rxcui"))


def read_log(spark: SparkSession, path: str, schema: str, order: str, limit: int) -> DataFrame:
    """The newest lines of a JSON-lines log; malformed ones are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where(F.col(order).isNotNull()).orderBy(F.desc(order)).limit(limit)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_index(frames: dict[str, DataFrame], path: str) -> None:
    """A store of several tables (vectors, chunks, parents; term counts; nodes, edges), one folder each."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_manifest(spark: SparkSession, summary: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """None where it is missing or isn't JSON."""
    from pyspark.errors import AnalysisException

    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    except (AnalysisException, ValueError):
        return None


def write_missing_shards(df: DataFrame, shard: str, path: str) -> None:
    """Appends the shards that path doesn't have yet, one folder each: a run that was cut short goes on where it was."""
    from pyspark.errors import AnalysisException

    try:
        done = df.sparkSession.read.parquet(path).select(shard).distinct()
        df = df.join(done, shard, "left_anti")
    except AnalysisException:
        pass  # nothing has been written
    df.write.mode("append").partitionBy(shard).parquet(path)
