"""Incremental rescan: a stored index of hashes and component labels that batches of new files extend.

Everything is stored in append-only tables below one folder, a part for each batch: ``files`` (what
scoring reads), ``entries`` (the index: bands of each hash and its variants, and the keys of exact
duplicates), ``labels`` (a file's component when it came) and ``moves`` (components that a later batch
merged).  A batch that is written again replaces its part, so a stream may repeat it.

A batch shuffles, scores and writes its own rows and those it meets.  Of the index it reads the
bands, which are slim; they are not shuffled while the batch's probes are few enough to be
broadcast (``PROBES``, counted first).
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import blocking, cluster, groups
from ..options import Options
from ..runtime import Scratch

#: Files for which the bands are laid out, and most probes of a batch that are broadcast.
PLANNED, PROBES = 10**8, 2_000_000
#: The band of the keys of exact duplicates.
EXACT = -1


class Rescan:
    """An index below ``root``, a folder of the shared storage.  ``columns`` names the file columns and
    their types that batches bring and scoring reads."""

    def __init__(self, spark: SparkSession, root: str, columns: dict[str, str], options: Options | None = None) -> None:
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns
        self.options = options or Options()
        self.bands = blocking.bands(self.options.perceptual_max_distance, PLANNED)

    def _place(self, name: str) -> str:
        return str(PurePosixPath(self.root) / name) if "://" not in self.root else f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._place(name))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """A stored table, without the parts of batch ``before`` and later ones."""
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(f"{schema}, batch long").parquet(self._place(name))
        return (out if before is None else out.where(F.col("batch") < before)).drop("batch")

    def _store(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self._place(name)}/batch={batch}")

    def _part(self, c: Column | str, shift: int, width: int) -> Column:
        return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    def _exact(self) -> Column:
        return F.when(F.col("full_hash").isNotNull(), F.xxhash64("full_hash", "size", "is_video"))

    def _entries(self, files: DataFrame) -> DataFrame:
        """Index rows (band, value, hash, upright, file_id): one for each band of each variant."""
        hashes = files.where("phash is not null").select("file_id", F.posexplode(F.col("phash")).alias("nth", "hash"))
        keys = F.array(*[F.struct(F.lit(k).alias("band"), self._part("hash", s, w).alias("value")) for k, (s, w, _) in enumerate(self.bands)])
        near = hashes.select("file_id", "hash", (F.col("nth") == 0).alias("upright"), F.explode(keys).alias("k")).select("k.band", "k.value", "hash", "upright", "file_id")
        same = files.select(F.lit(EXACT).alias("band"), self._exact().alias("value"), F.lit(None).cast("long").alias("hash"), F.lit(True).alias("upright"), "file_id").where("value is not null")
        return near.unionByName(same)

    def _probes(self, files: DataFrame) -> DataFrame:
        """(band, value, hash, upright, file_id) that meet the entries of all hashes near enough."""
        hashes = files.where("phash is not null").select("file_id", F.posexplode(F.col("phash")).alias("nth", "hash"))

        def masked(k: int, shift: int, width: int, masks: list[int]) -> Column:
            return F.transform(F.lit(masks), lambda m: F.struct(F.lit(k).alias("band"), self._part("hash", shift, width).bitwiseXOR(m.cast("long")).alias("value")))

        changed = [masked(k, *band) for k, band in enumerate(self.bands)]
        near = hashes.select("file_id", "hash", (F.col("nth") == 0).alias("upright"), F.explode(F.concat(*changed)).alias("k")).select("k.band", "k.value", "hash", "upright", "file_id")
        same = files.select(F.lit(EXACT).alias("band"), self._exact().alias("value"), F.lit(None).cast("long").alias("hash"), F.lit(True).alias("upright"), "file_id").where("value is not null")
        return near.unionByName(same)

    def _candidates(self, files: DataFrame, entries: DataFrame) -> DataFrame:
        """Pairs (a, b) of the batch's files with one another and with stored ones."""
        probes = self._probes(files).select("band", "value", F.col("hash").alias("h2"), F.col("upright").alias("u2"), F.col("file_id").alias("id2"))
        near = (F.col("band") == EXACT) | ((F.col("upright") | F.col("u2")) & (hashing.hamming(F.col("hash"), F.col("h2")) <= self.options.perceptual_max_distance))
        met = entries.join(F.broadcast(probes) if probes.count() <= PROBES else probes, ["band", "value"]).where((F.col("file_id") != F.col("id2")) & near)
        return met.select(F.least("file_id", "id2").alias("a"), F.greatest("file_id", "id2").alias("b")).distinct()

    def add(self, files: DataFrame, batch: int) -> None:
        """Takes a batch of new files in: the index, their pairs with what is known, and merged labels."""
        scratch = Scratch(self.spark, "rescan")
        fresh = scratch.cut(files.select(*[F.col(c).cast(t) for c, t in self.columns.items()]), "fresh")
        own = scratch.cut(self._entries(fresh), "entries")
        stored = self._table("entries", "band int, value long, hash long, upright boolean, file_id long", batch)
        pairs = scratch.cut(self._candidates(fresh, stored.unionByName(own)), "pairs")

        met = pairs.select(F.explode(F.array("a", "b")).alias("file_id")).distinct()
        known = self._table("files", ", ".join(f"{c} {t}" for c, t in self.columns.items()), batch).join(met, "file_id", "left_semi")
        edges = scratch.cut(groups.score_pairs(pairs, known.unionByName(fresh), self.options).select("a", "b"), "edges")

        # components of the batch's edges over the components that are stored
        ends = edges.select(F.explode(F.array("a", "b")).alias("file_id")).distinct()
        at = scratch.cut(self._resolved(ends, batch, scratch), "roots")
        root = lambda end: at.toDF(end, f"r{end}")
        linked = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        merged = scratch.cut(cluster.components(linked, scratch=scratch), "merged")
        self._store(merged.where("node <> root").join(at.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("root"), F.col("root").alias("to")), "moves", batch)
        self._store(fresh.select("file_id").join(merged.toDF("file_id", "_root"), "file_id", "left").select("file_id", F.coalesce("_root", "file_id").alias("root")), "labels", batch)
        self._store(fresh, "files", batch)
        self._store(own, "entries", batch)

    def _resolved(self, ids: DataFrame | None, before: int | None, scratch: Scratch) -> DataFrame:
        """(file_id, root) of stored files (those in ``ids``), with all moves followed."""
        held = self._table("labels", "file_id long, root long", before)
        held = scratch.cut(held if ids is None else held.join(ids, "file_id", "left_semi"), "held")
        moves = scratch.cut(self._table("moves", "root long, to long", before), "moves")
        while True:  # a round for each time a component was merged again
            moved = scratch.cut(held.join(moves, "root", "left").select("file_id", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "moved")
            held = moved.select("file_id", "root")
            if not moved.where("moved").limit(1).count():
                return held

    def labels(self) -> DataFrame:
        """(file_id, root) of all files taken in; a file alone is its own root."""
        return self._resolved(None, None, Scratch(self.spark, "labels"))

    def into(self) -> Callable[[DataFrame, int], None]:
        """``add`` for the micro-batches of a stream (``incremental.upsert``)."""
        return lambda files, batch: self.add(files, batch)
