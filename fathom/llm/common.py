"""Helpers that several operators share."""

from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.session import materialise, scratch, working_folder

#: A word is a run of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """While this lasts texts go to Python in batches of about size, unless the session has a size of its own: the default,
    64 MB, is held several times over by each Python worker."""
    own = spark.conf.get(BATCH_BYTES) == "67108864b"
    if own:
        spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if own:
            spark.conf.unset(BATCH_BYTES)


def whole(operator):
    """An operator, its first argument a DataFrame, whose result is written as one table of the shared folder, texts going to
    Python in small batches. All other tables it wrote are deleted then, and the session's settings are as before."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        outside = working_folder.get()
        with small_batches(df.sparkSession), scratch(df.sparkSession):
            out = operator(df, *args, **kwargs)
            inside = working_folder.set(outside)  # the result stays
            try:
                return materialise(out, operator.__name__)
            finally:
                working_folder.reset(inside)

    return run


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus = remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def in_slices(rows: list, limit: int, length=len):
    """(first, past last) of consecutive rows that hold about limit bytes together, one row at least."""
    first, held = 0, 0
    for i, row in enumerate(rows):
        held += length(row) + 1
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(rows):
        yield first, len(rows)


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return [x or "" for x in column.to_pylist()]


class Generations(dict):
    """A bounded cache: entries not asked for while `size` others came in are forgotten."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        value = self.old[key]
        self[key] = value
        return value

    def absent(self, keys) -> list:
        """The distinct keys that are not held; the others are moved to the young generation."""
        missing = []
        for key in dict.fromkeys([k for k in keys if k not in self]):
            if key in self.old:
                self[key] = self.old[key]
            else:
                missing.append(key)
        return missing

    def age(self) -> None:
        """To be called between batches, when no key is in use."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()


def hash_threshold(ids: DataFrame, n: int, seed: int = 11) -> tuple[Column, int]:
    """The seeded key of doc_id and the key of the n-th row in its order: rows up to it are a uniform sample of n (and copies).

    Only the doc_id column is read, and one number comes to the driver.
    """
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    last = ids.select(key.alias("key")).orderBy("key").limit(n).agg(F.max("key")).first()[0]
    return key, -(1 << 63) if last is None else last


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, limit: int = 50_000) -> DataFrame:
    """rows left-joined with the groups they belong to: one row a key, with a count of its rows in column `size`.

    Up to limit groups are sent to all executors. Of more, those that hold over a limit-th of all grouped rows, of which there
    can't be more than limit, are sent, so that no key of the shuffle that joins the others has more rows than that. Rows with
    a null key belong to no group and don't move. groups is read several times: a written table.
    """
    n, total = groups.agg(F.count("*"), F.sum(size)).first()
    if n <= limit:
        return rows.join(F.broadcast(groups), key, "left")
    hot = F.col(size) * limit > total
    names = [*rows.columns, *[c for c in groups.columns if c != key]]
    sent, keyed = groups.where(hot), rows.where(F.col(key).isNotNull())
    in_hot = keyed.join(F.broadcast(sent), key).select(names)
    in_cold = keyed.join(F.broadcast(sent.select(key)), key, "left_anti").join(groups.where(~hot), key, "left").select(names)
    in_none = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(t).alias(c) for c, t in groups.dtypes if c != key])
    return in_hot.unionByName(in_cold).unionByName(in_none)
