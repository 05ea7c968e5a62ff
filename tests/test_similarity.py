"""The Hamming join at any radius, classes of equal hashes, and links in capture time."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echofold import runtime
from echofold.functions import imaging, vectors
from echofold.operators import blocking, cluster, contents, groups, similarity
from echofold.options import Options
from echofold.plans import catalog, engine, pictures
from echofold.sources import ppm

START = datetime(2024, 5, 1)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def clustered(seed, centres, each, flips):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    return [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(flips))) for b in base for _ in range(each)]


@pytest.mark.parametrize(("distance", "block", "brute"), [(0, 50, 0), (8, 50, 10**6), (8, 1000, 0), (14, 50, 0), (20, 64, 0), (33, 100, 0), (64, 200, 0)])
def test_join_equals_brute_force(spark, monkeypatch, distance, block, brute):
    monkeypatch.setattr(similarity, "BLOCK", block)
    hashes = clustered(distance, 25, 12, 12) + [random.Random(9).getrandbits(64) for _ in range(60)]
    hashes += hashes[:40] + [hashes[5]] * 20
    want = sorted((i, j, d) for j in range(len(hashes)) for i in range(j) if (d := (hashes[i] ^ hashes[j]).bit_count()) <= distance)
    rows = [(i, signed(h)) for i, h in enumerate(hashes)] + [(10**6, None)]
    got = similarity.hamming_pairs(spark.createDataFrame(rows, "file_id long, hash long"), distance, options=Options(brute_force_hashes=brute)).collect()
    assert sorted((r.a, r.b, r.distance) for r in got) == want


@pytest.mark.parametrize(("distance", "brute"), [(8, 0), (8, 10**6), (16, 0)])
def test_join_with_variants_equals_brute_force(spark, monkeypatch, distance, brute):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    rng = random.Random(4)
    rows = []
    for k in range(120):
        v = [rng.getrandbits(64) for _ in range(4)] if k % 3 == 0 or not rows else list(rows[rng.randrange(len(rows))])
        if k % 3 == 1:
            v = [x ^ (1 << rng.randrange(64)) for x in v[1:] + v[:1]]
        rows.append(v)
    want = {}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            d = min((a[0] ^ x).bit_count() for x in b)
            if i != j and d <= distance:
                key = (min(i, j), max(i, j))
                want[key] = min(d, want.get(key, 99))
    frame = spark.createDataFrame([(i, signed(v[0]), [signed(x) for x in v]) for i, v in enumerate(rows)], "file_id long, hash long, v array<long>")
    got = similarity.hamming_pairs(frame, distance, variants_col="v", options=Options(brute_force_hashes=brute)).collect()
    assert {(r.a, r.b): r.distance for r in got} == want and len(got) == len(want)


def test_partitions_leave_far_cells_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 100)
    near = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(clustered(1, 40, 50, 4))], "file_id long, hash long")
    count = near.select("hash").distinct().count()
    work = similarity.compared(near, 6).agg(F.sum("compared"), F.sum("rows")).first()
    assert work[1] == count and work[0] < 0.1 * count * count


def row(k, us, path, phash=7, sides=(100, 80), pixel=None):
    at = None if us is None else START + timedelta(microseconds=us)
    return {"file_id": k, "path": path, "size": 1000 + k, "root": "/r", "is_video": False, "normalized": path, "has_copy": False, "has_edit": False, "phash": [phash] * 8, "dhash": 0, "sharpness": 1.0, "width": sides[0], "height": sides[1], "taken_at": at, "camera_key": f"c{k}", "pixel_hash": pixel}


def table(spark, rows):
    kinds = engine.FILE_COLUMNS
    return spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in rows], ", ".join(f"{c} {t}" for c, t in kinds.items()))


def crowd(seed, count, span, undated):
    """Files of three near hashes, taken close together, some RAW beside a picture of their name."""
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        base = rng.randrange(count // 2)
        us = None if rng.random() < undated else rng.randrange(span)
        rows.append(row(k, us, f"/r/IMG_{base}.{rng.choice(['jpg', 'png', 'cr2', 'dng', 'tif'])}", rng.choice([7, 7, 7, 6, 0])))
    return rows


@pytest.mark.parametrize(("seed", "span", "undated"), [(1, 2_000_000, 0), (2, 12_000_000, 0), (3, 9_000_000, 0.02), (4, 500_000, 0.3), (5, 20_000_000, 0.05)])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, seed, span, undated):
    files = table(spark, crowd(seed, 240, span, undated))
    o = Options(detect_bursts=False)

    def roots(most):
        monkeypatch.setattr(similarity, "EXPANDED", most)
        pairs, _ = similarity.candidates(files, 8, o)
        edges = groups.score_pairs(pairs, files, o)
        return pairs.count(), {r.node: r.root for r in cluster.components(edges).collect()}

    (every, want), (few, got) = roots(10**9), roots(10)
    assert got == want and want and few < every / 4


def test_three_thousand_equal_hashes(spark):
    """A blank picture many times over: rows stay linear, components as by all pairs (10 ms apart)."""
    files = table(spark, [row(k, k * 10_000 if k < 2900 else k * 1_000_000, f"/r/{k}.jpg", 0) for k in range(3000)])
    pairs, crowded = similarity.candidates(files, 8)
    assert pairs.count() <= 3 * 3000 and crowded.count() == 3000
    root = {r.node: r.root for r in cluster.components(groups.score_pairs(pairs, files)).collect()}
    assert root == {k: 0 for k in range(2900)}


def test_same_pixels_in_a_crowd_link_at_any_time(spark, monkeypatch):
    monkeypatch.setattr(similarity, "EXPANDED", 10)
    rows = [row(k, k * 60_000_000, f"/r/{k}.jpg", 0, (100, 80) if k < 20 else (200 + k, 80)) for k in range(40)]
    for r in rows:
        r["content"] = str(r["file_id"])
    names = list(engine.FILE_COLUMNS)
    files = spark.createDataFrame([(*(r.get(c) for c in names), r["content"]) for r in rows], ", ".join(f"{c} {engine.FILE_COLUMNS[c]}" for c in names) + ", content string")
    asked = []
    pixels = lambda f: (asked.extend(r.file_id for r in f.collect()), f.select("file_id", F.when(F.col("file_id") % 2 == 0, "even").otherwise(F.col("file_id").cast("string")).alias("pixel_hash")))[1]
    got = engine.run(files, pixels=pixels).members.collect()
    assert sorted(asked) == list(range(20))
    assert sorted(r.file_id for r in got) == list(range(0, 20, 2)) and {r.kind for r in got if r["rank"] > 1} == {"IdenticalPixels"}


@pytest.mark.parametrize(("rows", "probes"), [(3_000_000, 3_000_000), (15_000_000, 15_000_000)])
def test_bands_send_few_entries_a_hash(rows, probes):
    plan = blocking.band_plan(8, rows, probes)
    assert sum(most + 1 for *_, most in plan) > 8  # two hashes within 8 bits are within ``most`` of one band
    assert (rows * sum(len(masks) for _, _, masks, _ in plan) + probes * len(plan)) / rows < 100


@pytest.mark.parametrize("many", [0, 10**9])
@pytest.mark.parametrize("planned", [200, 10**7])
def test_bands_in_small_blocks_equal_brute_force(spark, monkeypatch, many, planned):
    monkeypatch.setattr(similarity, "CELL", 40)
    monkeypatch.setattr(similarity, "ENTRIES", 300)
    monkeypatch.setattr(similarity, "MANY", many)
    hashes = sorted({signed(h) for h in clustered(7, 6, 30, 9)} | {signed(random.Random(3).getrandbits(64)) for _ in range(40)})
    own = spark.createDataFrame(list(enumerate(hashes)), "node long, h long")
    plan = blocking.band_plan
    monkeypatch.setattr(blocking, "band_plan", lambda distance, rows, probes: plan(distance, planned, planned))
    want = sorted((i, j, d) for j in range(len(hashes)) for i in range(j) if (d := ((hashes[i] ^ hashes[j]) & (1 << 64) - 1).bit_count()) <= 8)
    got = similarity.banded_pairs(own, own.toDF("qid", "qh"), 8, True, len(hashes), len(hashes)).collect()
    assert sorted((r.a, r.b, r.distance) for r in got) == want and want


def test_median_bits_sort_a_row_once(spark):
    rng = random.Random(5)
    rows = [[rng.random() for _ in range(64)] for _ in range(20)]
    own = spark.createDataFrame([(i, v) for i, v in enumerate([*rows, [], None])], "i long, v array<double>").select("i", vectors.median_bits(F.col("v")).alias("h"))
    assert own._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1
    want = {i: signed(sum(1 << k for k, x in enumerate(v) if x > sum(sorted(v)[31:33]) / 2)) for i, v in enumerate(rows)}
    assert {r.i: r.h for r in own.collect()} == want | {20: 0, 21: None}


def test_pictures_are_drawn_a_few_at_a_time():
    """Ten thousand ids of a batch in one frame were a gigabyte."""
    frames = list(pictures.drawn(range(100)))
    assert max(map(len, frames)) <= 5 * pictures.TOGETHER and [i for f in frames for i in f["file_id"]] == [i * 8 + k for i in range(100) for k in range(5)]
    assert list(frames[3]["content"]) == [pictures.variant(i, k) for i in range(96, 100) for k in range(5)]


def test_pictures_are_drawn_where_they_are_read(spark, tmp_path, monkeypatch):
    """Written pictures were 36 KB a document; and tables of finished steps stayed until the session ended."""
    ids = spark.createDataFrame([(10,), (20,), (30,)], "doc_id long")
    ids.write.parquet(str(tmp_path / "documents.parquet"))
    whole, slim = pictures.draw(ids), pictures.listed(ids)
    assert sorted(map(tuple, whole.drop("content").select(sorted(slim.columns)).collect())) == sorted(map(tuple, slim.select(sorted(slim.columns)).collect()))
    reader = pictures.Drawn()
    assert sorted(map(tuple, reader.of(slim).collect())) == sorted(map(tuple, whole.select("file_id", "content").collect()))
    asked = slim.select("file_id", F.element_at(F.array(F.lit("partial"), F.lit("full"), F.lit("sample")), (F.col("file_id") % 3 + 1).cast("int")).alias("how"))
    assert sorted(map(str, reader.hashes(asked).collect())) == sorted(map(str, contents.InColumn(whole).hashes(asked).collect()))
    kept, real = [], runtime.Scratch.cut
    monkeypatch.setattr(runtime.Scratch, "cut", lambda self, df, name: kept.append((real(self, df, name), df)) or kept[-1][0])
    got = pictures.end_to_end(spark, str(tmp_path))
    assert kept and not any(f.dataType.simpleString() == "binary" for _, df in kept for f in df.schema)
    assert sum(os.path.isdir(out.scratch_path.removeprefix("file:")) for out, _ in kept) < len(kept) / 2
    want = engine.run(whole, analyse=lambda f: imaging.analyse(f, ppm.decode), pixels=lambda f: imaging.pixel_hashes(f, ppm.decode)).members
    assert sorted(map(tuple, got.drop("confidence").collect())) == sorted(map(tuple, want.select(got.drop("confidence").columns).collect())) and got.count() == 18


def test_contents_go_to_python_in_batches_of_bounded_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        own = spark.range(0, 40, 1, 1).select(F.col("id").alias("file_id"), F.expr("cast(repeat('x', 1048576) as binary)").alias("content"))
        imaging.pixel_hashes(own, None).collect()
        assert int(spark.conf.get(name)) <= runtime.CONTENT_BATCH
        sizes = [r.n for r in runtime.contents_in_batches(own).mapInPandas(lambda frames: (f.assign(n=len(f))[["n"]][:1] for f in frames), "n long").collect()]
        assert sum(sizes) == 40 and max(sizes) <= 17
    finally:
        spark.conf.set(name, before)


def test_the_first_file_of_a_pair_is_sent_with_its_upright_hash_only(spark):
    files = table(spark, [row(k, 0, f"/r/{k}.jpg", 7 + k) for k in range(4)])
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "a long, b long")
    scored = groups.score_pairs(pairs, files)
    assert scored._jdf.queryExecution().analyzed().toString().count("slice(phash") == 1
    assert {(r.a, r.b) for r in scored.collect()} == {(0, 1), (0, 2), (1, 3)}


def test_members_of_a_large_class_meet_in_several_tasks(spark):
    files = table(spark, [row(k, None, f"/r/{k}.jpg", 7) for k in range(60)])
    got = similarity.hamming_pairs(files, 8, hash_col="dhash", variants_col="phash")
    assert sorted((r.a, r.b) for r in got.collect()) == [(i, j) for i in range(60) for j in range(i + 1, 60)]
    assert "sequence(0, 15" in got._jdf.queryExecution().analyzed().toString()


def odd_vectors(hashes):
    """A vector of four places a hash, and some that are missing, empty, shorter or lack a value."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(len(hashes))]
    rows[3], rows[4], rows[5], rows[6], rows[7] = (3, None), (4, []), (5, rows[5][1][:3]), (6, [1.0, None, 0.5, 0.25]), (7, [float("nan"), 1.0, 0.0, 0.0])
    return rows[:-2]  # two files have no vector row


@pytest.mark.parametrize(("distance", "block", "kind"), [(0, 40, "double"), (6, 10**6, "double"), (12, 40, "float"), (20, 40, "double"), (64, 40, "float")])
def test_cosines_equal_the_join_of_pairs_with_vectors(spark, monkeypatch, distance, block, kind):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "PARTS", 3)
    monkeypatch.setattr(similarity, "TILE", (7, 5))
    monkeypatch.setattr(similarity, "TOGETHER", 50)
    hashes = clustered(distance, 12, 12, 12) + [7] * 30
    hashes[3:8] = [7] * 5  # the odd vectors are among the crowd of equal hashes
    own = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)] + [(10**6, None)], "file_id long, hash long")
    held = spark.createDataFrame([*odd_vectors(hashes), (10**6, [0.0] * 4)], f"file_id long, embedding array<{kind}>")
    pairs = similarity.hamming_pairs(own, distance)
    joined = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select("a", "b", "distance", vectors.cosine(F.col("x"), F.col("y")).alias("cosine"))
    got = similarity.cosine_pairs(own, held, distance)
    shown = lambda frame: sorted((r.a, r.b, r.distance, str(r.cosine)) for r in frame.collect())
    assert shown(got) == shown(joined) and {"None", "nan"} <= {r[3] for r in shown(got)}


def test_ids_held_twice_count_as_in_a_join(spark):
    own = spark.createDataFrame([(1, 7), (1, 6), (2, 7)], "file_id long, hash long")
    held = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (2, [3.0])], "file_id long, embedding array<double>")
    assert sorted((r.a, r.b, r.distance, r.cosine) for r in similarity.cosine_pairs(own, held, 8).collect()) == [(1, 2, 0, 3.0), (1, 2, 0, 6.0), (1, 2, 1, 3.0), (1, 2, 1, 6.0)]


def test_no_vector_is_sent_for_a_pair(spark, sf):
    """The tasks that meet hashes take the cosines: above them nothing is shuffled or joined, and a vector is
    sent a fixed number of times."""
    plan = catalog.cosine_pairs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    above, found, _ = plan.partition("FlatMapGroupsInArrow")
    assert found and "Join" not in above and "Exchange" not in above
    assert {similarity.vector_parts(n) for n in (10_256, 51_282, 615_384)} == {similarity.PARTS}
    assert similarity.vector_parts(100 * similarity.PART) == 100
