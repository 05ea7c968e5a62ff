"""Inventory of files: a listing of folders in parallel, or Spark's binary reader for remote stores."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import options as K
from ..functions import names
from ..options import Options
from . import listing

#: Folder names that are never scanned.
BIN_FOLDER, QUARANTINE_NAME = "$RECYCLE.BIN", ".QUARANTINE"


def wanted(files: DataFrame, options: Options) -> DataFrame:
    """Files of a wanted extension, in no bin or quarantine, not empty, each path once (in any case;
    the first in order).  Folders hidden below the file's root count as hidden, the root's own path
    does not."""
    ext, upper = names.extension(F.col("path")), F.upper("path")
    kind = ext.isin(*K.PHOTO_EXTENSIONS)
    if options.include_videos:
        kind = kind | ext.isin(*K.VIDEO_EXTENSIONS)
    apart = F.contains(upper, F.lit(BIN_FOLDER)) | F.contains(upper, F.lit(f"/{QUARANTINE_NAME}")) | F.coalesce(names.is_under(F.col("path"), F.lit(options.quarantine)), F.lit(False))
    out = files.where(kind & ~apart & (F.col("size") > 0))
    if not options.include_hidden:
        below = F.substr("path", F.length(F.coalesce("root", F.lit(""))) + 1) if "root" in files.columns else F.col("path")
        out = out.where(~below.rlike(r"(^|/)\.[^/]+"))
    first = F.row_number().over(W.partitionBy(upper).orderBy("path", *(["file_id"] if "file_id" in files.columns else [])))
    return out.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def attribute_roots(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Each file with the most specific added folder that holds it (root, null if none)."""
    held = [F.when(names.is_under(F.col("path"), F.lit(r)), F.lit(r)) for r in sorted(roots, key=lambda r: (-len(r.rstrip("/")), r))]
    return files.withColumn("root", F.coalesce(*held) if held else F.lit(None).cast("string"))


def with_names(files: DataFrame) -> DataFrame:
    """Files with is_video, normalized, has_copy and has_edit."""
    n = names.normalise(names.base_name(F.col("path")))
    return files.withColumn("_n", n).withColumns({"is_video": names.extension(F.col("path")).isin(*K.VIDEO_EXTENSIONS), "normalized": F.col("_n.normalized"), "has_copy": F.col("_n.has_copy"), "has_edit": F.col("_n.has_edit")}).drop("_n")


#: The scheme of an address (of two letters or more: a single one is a drive).
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]+:/+"


def from_reader(spark: SparkSession, roots: Sequence[str], options: Options, with_content: bool = False) -> DataFrame:
    """Inventory by the binary reader, for any store Spark reads; without contents the files are
    listed but not read.  Paths and roots are told without the scheme, ``uri`` has it.  Spark itself
    follows links, tells no hard links, and leaves out names that begin with a point or an
    underscore; ``from_listing`` does not."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(options.recursive).lower())
    rows = read.load(list(roots)).select(F.col("path").alias("uri"), F.regexp_replace("path", SCHEME, "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("last_write"), *(["content"] if with_content else []))
    rows = rows.withColumns({"file_id": F.xxhash64("path"), "mtime_ticks": F.unix_micros(F.col("last_write").cast("timestamp")) * 10, "device": F.lit(None).cast("long"), "inode": F.lit(None).cast("long")})
    return with_names(wanted(attribute_roots(rows, [re.sub(SCHEME, "/", r) for r in roots]), options))


def from_listing(spark: SparkSession, roots: Sequence[str], options: Options) -> DataFrame:
    """Inventory of folders that every executor can reach (see ``listing``): links are neither listed
    nor followed, and device and inode tell hard links."""
    listing.register(spark)
    rows = spark.read.format(listing.NAME).options(roots=json.dumps(list(roots)), recursive=str(options.recursive).lower()).load()
    micros = F.floor(F.col("mtime_ticks") / 10)
    rows = rows.withColumns({"file_id": F.xxhash64("path"), "last_write": F.timestamp_micros(micros).cast("timestamp_ntz")})
    return with_names(wanted(attribute_roots(rows, roots), options))
