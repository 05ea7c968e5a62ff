"""Streams and batches against one full run."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echofold.operators import blocking, cluster, groups, similarity
from echofold.options import Options
from echofold.plans import engine
from echofold.streaming import bursts, incremental, rescan

START = datetime(2024, 5, 1)
CAPTURE = "file_id long, taken_at timestamp, camera_key string"


def streamed(spark, parts, tmp_path, seconds, **how):
    """Pairs of a stream that is fed part by part."""
    kept = tmp_path / "in"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, CAPTURE).coalesce(1).write.mode("append").parquet(str(kept))
        stream = spark.readStream.schema(CAPTURE).parquet(str(kept))
        out = bursts.burst_stream(stream, seconds, **how)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(bursts.PAIRS).parquet(str(tmp_path / "out")).collect())


def capped(rows, width, neighbours):
    """Pairs within some places of a camera's order."""
    out = []
    for camera in {c or "" for _, _, c in rows}:
        own = sorted((t, i) for i, t, c in rows if (c or "") == camera and t)
        for k, (t, i) in enumerate(own):
            out += [(min(i, j), max(i, j), (u - t) // timedelta(microseconds=1)) for u, j in own[k + 1 : k + 1 + neighbours] if u - t <= timedelta(seconds=width)]
    return sorted(out)


def test_burst_stream_equals_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("file_id"), F.col("ts").cast("timestamp").alias("taken_at"), F.col("user_id").cast("string").alias("camera_key"))
    rows = [tuple(r) for r in events.orderBy("taken_at", "file_id").collect()]
    want = sorted(tuple(r) for r in blocking.burst_pairs_capped(events, 1800, 10**6).collect())
    parts = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :]]
    assert streamed(spark, parts, tmp_path, 1800, neighbours=60) == want and want


def test_burst_stream_cap_and_late_rows(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(k, at(k * 0.5), "a" if k % 4 else None) for k in range(60)] + [(90, None, "a")]
    late = [(100, at(20.25), "a"), (101, at(-500), "a"), (5, at(2.5), "a")]  # allowed, too late, seen before
    got = streamed(spark, [rows[:30], rows[30:], [(99, at(40), "z")], late], tmp_path, 3.0, neighbours=4, lateness="30 seconds")
    want = capped(rows, 3.0, 4)
    mine = [p for p in got if 100 not in p[:2]]
    assert mine == want
    assert {p[0] for p in got if p[1] == 100} == {k for _, k in sorted((abs(k * 0.5 - 20.25), k) for k in range(60) if k % 4 and abs(k * 0.5 - 20.25) <= 3) if sum(1 for m in range(60) if m % 4 and min(k * 0.5, 20.25) < m * 0.5 < max(k * 0.5, 20.25)) < 4}


def files_of(spark, seed, count):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        v = [rng.getrandbits(63) for _ in range(8)] if k < 2 or rng.random() < 0.5 else list(next(v for _, v in rng.sample(rows, len(rows)) if v))
        if rng.random() < 0.5:
            v = [x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for x in v]
        if rng.random() < 0.2:
            v = v[4:] + v[:4]
        rows.append((k, v if k < 2 or rng.random() < 0.95 else None))
    kinds = engine.FILE_COLUMNS
    table = [{"file_id": k, "path": f"/r/{k}.jpg", "size": 100, "is_video": False, "normalized": str(k), "has_copy": False, "has_edit": False, "phash": v, "width": 10, "height": 10, "full_hash": "same" if k % 40 == 3 else None, "camera_key": ""} for k, v in rows]
    return spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in table], ", ".join(f"{c} {t}" for c, t in kinds.items()))


def full_run(files, options):
    near = similarity.hamming_pairs(files.where("phash is not null").select("file_id", F.get("phash", F.lit(0)).alias("hash"), "phash"), options.perceptual_max_distance, variants_col="phash")
    same = files.where("full_hash is not null").select(F.col("file_id").alias("a"), "full_hash")
    exact = same.join(same.toDF("b", "full_hash"), "full_hash").where("a < b")
    edges = groups.score_pairs(blocking.union_pairs(near.select("a", "b"), exact.select("a", "b")), files, options)
    root = {r.node: r.root for r in cluster.components(edges).collect()}
    return {r.file_id: root.get(r.file_id, r.file_id) for r in files.select("file_id").collect()}


@pytest.mark.parametrize("probes", [0, rescan.PROBES])
def test_batches_equal_one_run(spark, tmp_path, monkeypatch, probes):
    monkeypatch.setattr(rescan, "PROBES", probes)
    monkeypatch.setattr(rescan, "PLANNED", 1000)
    o = Options()
    files = spark.createDataFrame(files_of(spark, 6, 160).collect(), files_of(spark, 6, 1).schema)
    want = full_run(files, o)
    index = rescan.Rescan(spark, str(tmp_path / "index"), engine.FILE_COLUMNS, o)
    for k, part in enumerate(("file_id % 3 = 1", "file_id % 3 = 0 and file_id < 100", "file_id % 3 = 2 or file_id % 3 = 0 and file_id >= 100")):
        files.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
        incremental.upsert(index.into(), stream, str(tmp_path / "cp")).awaitTermination()
    got = {r.file_id: r.root for r in index.labels().collect()}
    assert got.keys() == want.keys()
    groups_of = lambda of: sorted(sorted(i for i in of if of[i] == r) for r in set(of.values()))
    assert groups_of(got) == groups_of(want) and any(len(g) > 3 for g in groups_of(want))
    index.add(files.where("file_id % 3 = 2 or file_id % 3 = 0 and file_id >= 100"), 2)  # a batch that is repeated replaces itself
    assert {r.file_id: r.root for r in index.labels().collect()} == got
