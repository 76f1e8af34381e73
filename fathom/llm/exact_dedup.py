"""Exact deduplication by progressive refinement.

Texts are equal when they are the same after A-Z are lower-cased; null is empty. Rows are grouped by the length of their
text, those of a shared length by a hash of its first characters, and those that share both by a hash of the whole text. Only
rows that are left then have their whole content read. What a step hands on to the next scan is a table of bits of a fixed
size, so texts that no other can equal are never moved, and few others are: groups are made of hashes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import attach, materialise, whole

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX = 256
#: Bits of a sieve; 16 MB. More keys than this let more rows through, which the next hash tells apart.
BITS = 1 << 27


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty. `lower` does that for ASCII, and does it fast."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def prefix_hash(text: Column, n: int = PREFIX) -> Column:
    """A hash of the normalised text's length in bytes (lower-casing keeps it) and first n characters."""
    return F.xxhash64(F.coalesce(F.octet_length(text), F.lit(0)), normalised(F.substring(text, 1, n)))


def sieved(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """df with a boolean column `name`: whether its long column `key` is among the long column `key` of keys.

    It misses none; it says so too of another key whose remainder by BITS is that of one. The keys become a table of BITS
    bits in 4,096 rows at most, whatever their number, which all executors get.
    """
    cell = F.pmod(F.col(key), F.lit(BITS))
    bits = keys.groupBy(F.bitmap_bucket_number(cell).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("_bits"))
    met = df.join(F.broadcast(bits), F.bitmap_bucket_number(cell) == F.col("_bucket"), "left")
    place = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int"))
    return met.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_bits")


def shared_prefixes(texts: DataFrame) -> DataFrame:
    """(head): the `prefix_hash` of each length and prefix that several rows of texts (text) have.

    One reading of the texts gives each row's length and prefix hash; lengths are counted, and then, of the rows whose length
    is shared, prefixes.
    """
    rows = materialise(texts.select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), prefix_hash(F.col("text")).alias("head")), "prefixes")
    lengths = rows.groupBy("bytes").count().where("count > 1").select("bytes")
    rest = sieved(rows, "bytes", lengths, "shared").where("shared")
    return materialise(rest.groupBy("head").count().where("count > 1").select("head"), "shared-prefixes")


def _hashed(rows: DataFrame, text: Column) -> DataFrame:
    """rows with `full`: the SHA-256 of a text whose length and prefix others share, null for the rest."""
    heads = shared_prefixes(rows.select(text.alias("text")))
    tried = sieved(rows.withColumn("head", prefix_hash(text)), "head", heads, "tried")
    return tried.withColumn("full", F.when(F.col("tried"), F.sha2(normalised(text), 256))).drop("head", "tried")


@whole
def groups(docs: DataFrame, **extra: Column) -> DataFrame:
    """One row per document: doc_id, keep_id (doc_id of the row of its group that stays), group_size, kept; and the columns in
    extra, each computed from doc_id and text.

    Of equal texts the row with the largest doc_id stays; null is the smallest. Of rows that share text and doc_id one stays.
    Null and empty texts are one group. A text of any length is hashed whole by one task. An empty table gives no rows. Other
    columns are not read. A group of any size is counted before it moves, and its rows are joined with their count as
    `attach` does it.
    """
    hashed = _hashed(docs.select("doc_id", "text"), F.col("text"))
    rows = hashed.select("doc_id", F.monotonically_increasing_id().alias("uid"), "full", *[c.alias(name) for name, c in extra.items()])
    rows = materialise(rows, "hashed")
    sizes = rows.where("full is not null").groupBy("full").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("n"))
    joined = attach(rows, materialise(sizes.where("n > 1"), "groups"), "full", "n")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.uid") == F.col("uid"))).alias("kept"),
        *extra,
    )


@whole
def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of docs (no maps among them).

    As in `groups`; of rows that share text and doc_id the one with the largest hash of all its columns stays. Rows whose
    length and prefix no other has don't move; of the others, those that are no group's largest doc_id go before any shuffle,
    but for groups too many to be sent to all executors.
    """
    rows = _hashed(docs.select(F.struct("*").alias("row")), F.col("row.text"))
    largest = materialise(rows.where("full is not null").groupBy("full").agg(F.max("row.doc_id").alias("last"), F.count("*").alias("n")), "largest")
    found = attach(rows, largest.where("n > 1"), "full", "n").where(F.col("n").isNull() | F.col("row.doc_id").eqNullSafe(F.col("last")))
    single = found.where("n is null").select("row")
    several = found.where("n is not null").groupBy("full").agg(F.max_by("row", F.xxhash64("row")).alias("row")).select("row")
    return single.unionByName(several).select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
