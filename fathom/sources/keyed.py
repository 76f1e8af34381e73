"""A table by key, of which an upsert rewrites only the buckets that new rows touch.

Under its path, `data/<write>/bucket=<b>` has the rows of bucket b as a write left them, and `pointers/v=<n>` says, for version n,
which write each bucket's rows are in. A version is there once its pointer is written whole, which is the last thing a write
does: one that fails changes nothing that readers see.
"""

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.cohort import upsert as merged

BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def pointer(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The newest version's pointer, or a given one's: version, key, buckets, schema, and the write of each bucket."""
    rows = spark.read.text(f"{path}/pointers")
    rows = rows if version is None else rows.where(F.col("v") == version)
    found = rows.orderBy(F.desc("v")).limit(1).collect()
    if not found:
        raise ValueError(f"{path} has no version {version}")
    return json.loads(found[0]["value"]) | {"version": found[0]["v"]}


def _point(spark: SparkSession, path: str, to: dict) -> None:
    row = spark.createDataFrame([(json.dumps({k: v for k, v in to.items() if k != "version"}),)], "value string")
    row.coalesce(1).write.text(f"{path}/pointers/v={to['version']}")  # fails where another write was first


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> str:
    write = uuid.uuid4().hex
    rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{write}")
    return write


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Writes rows, which have one row a key, as version 0. buckets: so many that each is some 100 MB when the table is full."""
    spark = rows.sparkSession
    write = _write(rows, path, key, buckets)
    found = _buckets_of(spark, path, write)
    _point(spark, path, {"version": 0, "key": key, "buckets": buckets, "schema": rows.schema.json(), "at": {str(b): write for b in found}})


def _buckets_of(spark: SparkSession, path: str, write: str) -> list[int]:
    try:
        return [r[0] for r in spark.read.parquet(f"{path}/data/{write}").select("bucket").distinct().collect()]
    except AnalysisException:  # it has no rows
        return []


def _read(spark: SparkSession, path: str, at: dict, only: list[int] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(at["schema"]))
    where = [f"{path}/data/{write}/bucket={b}" for b, write in sorted(at["at"].items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*where) if where else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version's rows, or a given one's."""
    return _read(spark, path, pointer(spark, path, version))


def upsert(new: DataFrame, path: str, updated: list[str]) -> dict:
    """Merges new rows, which have the table's columns and seq, as `cohort.upsert` does; {"version": n, "buckets": touched}.

    Only the buckets of the new rows' keys are read, merged and written: a batch costs what it touches. Columns that aren't the
    table's are an error. Two upserts at a time: the second to end fails, and can be tried again.
    """
    spark = new.sparkSession
    at = pointer(spark, path)
    own = [f["name"] for f in json.loads(at["schema"])["fields"]]
    if sorted(new.columns) != sorted([*own, "seq"]):
        raise ValueError(f"new rows have {sorted(new.columns)}, not {sorted([*own, 'seq'])}")
    touched = sorted(r[0] for r in new.select(_bucket(at["key"], at["buckets"])).distinct().collect())  # buckets at most
    if not touched:
        return {"version": at["version"], "buckets": []}
    rows = merged(_read(spark, path, at, touched), new, at["key"], updated)
    write = _write(rows, path, at["key"], at["buckets"])
    _point(spark, path, at | {"version": at["version"] + 1, "at": at["at"] | {str(b): write for b in touched}})
    return {"version": at["version"] + 1, "buckets": touched}
