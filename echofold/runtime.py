"""Session-level helpers shared by every operator: table access and shared-storage tables.

Nothing here keeps state on one machine.  Lineage is cut by writing a Parquet table below the
folder named in ``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's reader only (the path may be a remote store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs of so many bytes a core, or less, may lie in fewer blocks than there are cores.
SMALL_SHARE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt out to all cores, since a single block of a file is read by one task;
    a larger one as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SMALL_SHARE else df


#: Bytes of an Arrow batch with contents, and Spark's setting of it.
CONTENT_BATCH, _BATCH = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def contents_in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose contents go to Python: batches are bounded by bytes then, since ten thousand pictures
    would be one.  A narrower bound of the session stays."""
    spark = df.sparkSession
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < held <= CONTENT_BATCH:
        spark.conf.set(_BATCH, str(CONTENT_BATCH))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session.

    ``spark.checkpoint.dir`` is used as the cluster names it.  Only where it is unset and the
    master is local (tests, a laptop) a temporary folder is chosen; on a cluster that would be
    a folder other executors cannot see, so an unset value is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="echofold-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders of scratch tables made by this process, by session; they go when it ends.
_made: list[tuple[SparkSession, str]] = []


@atexit.register
def sweep() -> None:
    """Deletes the scratch tables of this process: nothing reads a lazy result past its end."""
    while _made:
        spark, root = _made.pop()
        with contextlib.suppress(Exception):  # the session may be gone, and then its folder is the cluster's to clear
            if not spark.sparkContext._jsc.sc().isStopped():
                where = spark._jvm.org.apache.hadoop.fs.Path(root)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one operator run, below one folder of the shared scratch space.

    ``cut`` writes a frame and returns it reread: lost executors then never trigger a recompute
    past this point.  ``drop`` removes tables that no later step reads, ``keep_only`` all but those
    a result still reads.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _made.append((spark, self.root))
        self._n = 0
        self._held: set[str] = set()

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self._held.add(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = getattr(frame, "scratch_path", None)
            if path:
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
                self._held.discard(path)

    def keep_only(self, *frames: DataFrame) -> None:
        stay = {frame.scratch_path for frame in frames}
        for path in self._held - stay:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self._held &= stay


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="echofold-")) / "echofold_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
