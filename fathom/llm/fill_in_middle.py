"""Fill-in-the-middle transformation: DuckDB's SQL on each Arrow batch inside mapInArrow.

A text is cut into units, `[A-Za-z]+|[^A-Za-z]`, and at two seeded places between units into prefix, middle and suffix, which
are written in the order that a model is to learn. Each batch is registered as a table; counting, cutting, joining and hashing
are SQL, and no row is touched by Python.
"""

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.llm.common import whole

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Characters cut into a list of units at a time: a list takes 16 bytes a unit.
PIECE = 1 << 18
#: Percentages: of texts that stay plain, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20

#: batch (doc_id, text) -> doc_id, text, n, form, prefix_chars, middle_chars, output. The units of a piece that begins within
#: a unit are counted without that one; a cut is looked for only in the piece that holds it.
TRANSFORM = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM batch
), piece AS (
  SELECT r, s, substr(text, s * {piece} + 1, {piece}) AS part, (s > 0 AND regexp_full_match(substr(text, s * {piece}, 2), '[A-Za-z]{{2}}'))::INT AS inside
  FROM (SELECT r, text, unnest(range(greatest(1, (length(text) + {piece} - 1) // {piece}))) AS s FROM doc)
), counted AS (
  SELECT *, length(regexp_replace(part, '[A-Za-z]+', 'a', 'g')) - inside AS units FROM piece
), placed AS (
  SELECT *, sum(units) OVER (PARTITION BY r ORDER BY s) - units AS before FROM counted
), drawn AS (
  SELECT doc.*, n, ('0x' || h[1:8])::UBIGINT % (n + 1)::UBIGINT AS one, ('0x' || h[9:16])::UBIGINT % (n + 1)::UBIGINT AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100 - {plain} THEN 'plain'
              WHEN ('0x' || h[25:32])::UBIGINT % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM doc JOIN (SELECT r, sum(units)::BIGINT AS n FROM counted GROUP BY r) USING (r)
), bound AS (
  SELECT r, 1 AS k, least(one, two)::BIGINT AS unit FROM drawn UNION ALL SELECT r, 2, greatest(one, two)::BIGINT FROM drawn
), cut AS (
  SELECT r, k, s * {piece} + length(array_to_string(list_slice(regexp_extract_all(part, '{unit}'), 1, (unit - before + inside)::BIGINT), '')) AS place
  FROM bound JOIN placed USING (r) WHERE before <= unit AND unit < before + units
), ends AS (
  SELECT r, max(place) FILTER (k = 1) AS a, max(place) FILTER (k = 2) AS b FROM cut GROUP BY r
), cut_text AS (
  SELECT doc_id, text, n, form, a, b, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix
  FROM (SELECT drawn.*, coalesce(a, length(text)) AS a, coalesce(b, length(text)) AS b FROM drawn LEFT JOIN ends USING (r))
)
SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
FROM cut_text
"""

#: batch (form, output, others) -> the same and restored. No marker occurs in the parts, and none can begin in one part and
#: end in the next marker.
RESTORE = """
SELECT * EXCLUDE (m, x, first, second), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN first || substr(output, m + 3) || second ELSE second || substr(output, m + 3) || first END AS restored
FROM (
  SELECT *, substr(output, 4, x - 4) AS first, substr(output, x + 3, m - x - 3) AS second
  FROM (SELECT *, strpos(output, '<M>') AS m, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x FROM ({source}))
)
"""


def transform_sql(seed: int = 1, piece: int = PIECE, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> str:
    return TRANSFORM.format(seed=seed, piece=piece, plain=plain, suffix_first=suffix_first, unit=UNIT)


def in_duckdb(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """sql over each batch of df, the table `batch`. One thread and no files: memory is that of a batch and its lists."""

    def run(batches):
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")

    return df.mapInArrow(run, schema)


def transform(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Null texts are empty, and empty texts, and those that hold a marker, stay plain. A null doc_id draws as an empty one, and
    rows of one doc_id draw alike. A very long text is cut into units piece by piece. An empty table gives no rows. Other
    columns are not read.
    """
    sql = f"SELECT * EXCLUDE (text) FROM ({transform_sql(**options)})"
    return in_duckdb(docs.select("doc_id", "text"), sql, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """doc_id and restored, the exact texts, of transformed rows (doc_id, form, output)."""
    sql = f"SELECT doc_id, restored FROM ({RESTORE.format(source='SELECT doc_id, form, output FROM batch')})"
    return in_duckdb(rows.select("doc_id", "form", "output"), sql, "doc_id long, restored string")


@whole
def digests(docs: DataFrame, **options: int) -> DataFrame:
    """`transform`, with the SHA-256 of output and of what it restores to, in place of output."""
    made = f"SELECT * EXCLUDE (text) FROM ({transform_sql(**options)})"
    sql = f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({RESTORE.format(source=made)})"
    return in_duckdb(docs.select("doc_id", "text"), sql, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


#: The same rows from whole lists of units.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), k AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR ('0x' || h[17:24])::BIGINT % 100 >= 90 AS plain,
         ('0x' || h[25:32])::BIGINT % 100 < 20 AS spm
  FROM d
), c AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM k
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""
