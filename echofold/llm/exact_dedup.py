"""Exact deduplication by a 128-bit content hash, natively in Spark.

Rows are grouped by the 128-bit hash together with the text itself.  The aggregation compares
whole keys, so two different texts of one hash never share a group: bytes are compared inside
each hash group, not assumed equal.  Copies collapse on the map side, so a group that holds a
third of all rows reaches its reducer as one row per map task.  The group's slim row (hashes,
size, kept id) then joins back to the documents' ids and hashes; texts are shuffled once.  That
join is an ordinary sort-merge join, which adaptive execution splits where a hash is hot.
``deduplicate`` needs no join: the same grouping carries one whole row per text.

Defined results: null text counts as empty; texts are equal when the same after lower-casing
A-Z; rows with a null id are counted and dropped for any row with an id, and if a group has only
null ids its keep_id is null and ``assign`` flags all its rows kept; a repeated row (same id and
text) is flagged kept on each of its copies by ``assign``; ``deduplicate`` leaves one row of each
text in both cases; other columns pass through, and columns named like a result of ``assign`` are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The compared form of a text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per distinct text: _h (128-bit hash), _sha, keep_id, group_size.

    ``keep`` says which id stays, "min" or "max".  _h and _sha identify the text: texts of one
    _h are told apart by their bytes when grouped, and differ in _sha.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    counted = rows.groupBy(F.md5("_text").alias("_h"), "_text").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return counted.select("_h", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", carry: list[str] | None = None) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256; ``carry`` names the columns to
    pass through (all by default)."""
    results = ("keep_id", "group_size", "kept", "text_sha256")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in results or c == id_col]
    own, h, sha, keep_id = unused(docs.columns, "_id", "_h", "_sha", "_keep")
    text = normalised(F.col(text_col))
    rows = docs.select(*carry, F.col(id_col).alias(own), F.md5(text).alias(h), F.sha2(text, 256).alias(sha))
    one = groups(docs, id_col, text_col, keep).select(F.col("_h").alias(h), F.col("_sha").alias(sha), F.col("keep_id").alias(keep_id), "group_size")
    joined = rows.join(one, [h, sha], "left")
    kept = F.col(own).eqNullSafe(F.col(keep_id))
    return joined.select(*carry, F.col(keep_id).alias("keep_id"), "group_size", kept.alias("kept"), F.col(sha).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of each distinct text, in the columns of ``docs``: a row with the kept id, and just
    one of them where that row is repeated."""
    text, own, known = normalised(F.col(text_col)), F.col(id_col), F.col(id_col).isNotNull()
    pick, first = {"min": (F.min_by, ~known), "max": (F.max_by, known)}[keep]
    row = pick(F.struct(*docs.columns), F.struct(first, own, F.xxhash64(text_col))).alias("_row")
    return docs.groupBy(F.md5(text).alias("_h"), text.alias("_text")).agg(row).select("_row").select("_row.*")
