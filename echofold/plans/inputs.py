"""The engine's file table built from the documents, in Spark and in SQL.

There are no pictures among the tables, so a document stands for a file: its text is the content,
its source the folder, and names with copy and edit markers, sizes, times and places follow from
its id and length.  Both forms use the same formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..runtime import spread, table

CHUNK = 64
BLOCKS = 16

FILES_SQL = """
    raw_files AS (SELECT doc_id AS file_id, coalesce(text, '') AS content, source, n_chars, doc_id // 5 AS k,
        CASE WHEN doc_id % 7 = 4 THEN 'cr2' WHEN doc_id % 7 = 5 THEN 'png' WHEN doc_id % 7 = 6 THEN 'mp4' ELSE 'jpg' END AS ext FROM documents),
    files AS (SELECT file_id, content, length(content) AS size, '/' || source AS root, ext,
        CASE file_id % 5 WHEN 0 THEN 'IMG_' || k WHEN 1 THEN 'IMG_' || k || ' (1)' WHEN 2 THEN 'Copy of IMG_' || k WHEN 3 THEN 'IMG_' || k || '-edited' ELSE 'IMG_' || k || '_1' END AS base,
        '/' || source || CASE WHEN file_id % 3 = 0 THEN '/sub/' ELSE '/' END || base || '.' || ext AS path, ext = 'mp4' AS is_video,
        'img_' || k AS normalized, file_id % 5 IN (1, 2) AS has_copy, file_id % 5 = 3 AS has_edit,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(file_id * 37 % 1000 AS INTEGER)) AS last_write,
        CAST(1000 + n_chars % 7 * 100 AS INTEGER) AS width, CAST(800 + n_chars % 5 * 100 AS INTEGER) AS height, CAST(file_id % 4 AS INTEGER) AS richness,
        (n_chars * 7919 % 1000) / 10.0::DOUBLE AS sharpness,
        CASE WHEN file_id % 4 <> 0 THEN TIMESTAMP '2024-05-01 00:00:00' + to_seconds(n_chars % 4000 * 3) END AS taken_at,
        CASE WHEN file_id % 6 = 0 THEN '' ELSE 'Cam|' || (file_id % 2) END AS camera_key,
        CASE WHEN file_id % 5 <> 0 THEN 45.4 + file_id % 10 * 0.0005 END::DOUBLE AS latitude, CASE WHEN file_id % 5 <> 0 THEN 9.19 END::DOUBLE AS longitude FROM raw_files)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of ``FILES_SQL``."""
    i, n = F.col("doc_id"), F.col("n_chars")
    k = F.floor(i / 5).cast("string")
    ext = F.when(i % 7 == 4, "cr2").when(i % 7 == 5, "png").when(i % 7 == 6, "mp4").otherwise("jpg")
    base = F.when(i % 5 == 0, F.concat(F.lit("IMG_"), k)).when(i % 5 == 1, F.concat(F.lit("IMG_"), k, F.lit(" (1)"))).when(i % 5 == 2, F.concat(F.lit("Copy of IMG_"), k)).when(i % 5 == 3, F.concat(F.lit("IMG_"), k, F.lit("-edited"))).otherwise(F.concat(F.lit("IMG_"), k, F.lit("_1")))
    at = lambda day, seconds: F.expr(f"timestamp_ntz'{day} 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    rows = spread(table(spark, sf_dir, "documents")).select(
        i.alias("file_id"), F.coalesce("text", F.lit("")).alias("content"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.concat(F.lit("/"), "source").alias("root"), ext.alias("ext"), base.alias("base"),
        F.concat(F.lit("/"), "source", F.when(i % 3 == 0, "/sub/").otherwise("/"), base, F.lit("."), ext).alias("path"),
        at("2024-01-01", (i * 37 % 1000 * 3600).cast("decimal(18,6)")).alias("last_write"),
        (1000 + n % 7 * 100).cast("int").alias("width"), (800 + n % 5 * 100).cast("int").alias("height"), (i % 4).cast("int").alias("richness"), (n * 7919 % 1000 / 10.0).cast("double").alias("sharpness"),
        F.when(i % 4 != 0, at("2024-05-01", (n % 4000 * 3).cast("decimal(18,6)"))).alias("taken_at"), F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("Cam|"), (i % 2).cast("string"))).alias("camera_key"),
        F.when(i % 5 != 0, F.lit(45.4) + i % 10 * F.lit(0.0005)).alias("latitude"), F.when(i % 5 != 0, F.lit(9.19)).alias("longitude"),
    )
    marked = rows.withColumn("_n", names.normalise(F.col("base")))
    return marked.withColumns({"is_video": F.col("ext") == "mp4", "normalized": F.col("_n.normalized"), "has_copy": F.col("_n.has_copy"), "has_edit": F.col("_n.has_edit")}).drop("_n")
