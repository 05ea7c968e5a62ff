"""The funnel: every catalogued query against its SQL, and the engine's own acceptance cases."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.functions import imaging, names, text, vectors
from echofold.operators import blocking, cluster, groups, keeper, policy, score, similarity
from echofold.options import Options
from echofold.plans import catalog, engine, pictures
from echofold.sources import inventory, journal, ppm, report_files

@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query_equals_sql(agree, name):
    agree(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize(("given", "want", "copy"), [("foto", "foto", False), ("IMG_1234", "img_1234", False), ("foto (12)", "foto", True), ("foto - Copia (2) (1)", "foto", True), ("Copia di foto", "foto", True), ("foto_copy", "foto", True), ("IMG_1234-2", "img_1234", False), ("IMG_1234 (modificata)", "img_1234", False), ("(1)", "(1)", True)])
def test_names(spark, given, want, copy):
    got = spark.createDataFrame([(given,)], "b string").select(names.normalise(F.col("b")).alias("n")).first().n
    assert (got.normalized, got.has_copy) == (want, copy)


def shot(i, phash=0, **more):
    base = {"file_id": i, "path": f"/p/f{i}.jpg", "size": 1000, "root": "/p", "is_video": False, "normalized": f"f{i}", "has_copy": False, "has_edit": False, "width": 4000, "height": 3000, "dhash": 0, "phash": [phash] * 8, "camera_key": "A|B"}
    return base | more


@pytest.mark.parametrize(
    ("a", "b", "kind", "low", "high"),
    [
        ({"full_hash": "h"}, {"full_hash": "h"}, "ExactBytes", 100, 100),
        ({"path": "/p/IMG_1.jpg", "pixel_hash": "x"}, {"path": "/p/img_1.CR3", "pixel_hash": "x"}, None, 0, 0),
        ({}, {"phash": [7] * 8}, "Perceptual", 90, 98),
        ({"taken_at": 0}, {"phash": [0xFFFF] * 8, "taken_at": 1}, "Burst", 60, 89),
        ({"taken_at": 0}, {"taken_at": 1}, "Burst", 60, 89),
        ({"taken_at": 0}, {"phash": [0xFFFF] * 8, "taken_at": 1, "camera_key": "C"}, None, 0, 0),
        ({"has_edit": True}, {}, "Perceptual", 80, 80),
        ({"pixel_hash": "x", "taken_at": 0}, {"pixel_hash": "x", "taken_at": 900}, "IdenticalPixels", 99, 99),
        ({"is_video": True, "sample_hash": "s"}, {"is_video": True, "sample_hash": "s"}, "VideoSampled", 99, 99),
        ({"is_video": True, "sample_hash": "s", "full_hash": "1"}, {"is_video": True, "sample_hash": "s", "full_hash": "2"}, None, 0, 0),
        ({"phash": None}, {}, None, 0, 0),
        ({"embedding": [1.0, 0.0]}, {"embedding": [0.5, 0.5]}, "Perceptual", 87, 89),
        ({"taken_at": 0, "latitude": 45.0, "longitude": 9.0}, {"taken_at": 1, "latitude": 46.0, "longitude": 9.0}, None, 0, 0),
    ],
)
def test_scorer_rules(spark, a, b, kind, low, high):
    from datetime import datetime, timedelta

    rows = [shot(1) | a, shot(2) | b]
    for r in rows:
        if "taken_at" in r:
            r["taken_at"] = datetime(2024, 5, 1) + timedelta(seconds=r["taken_at"])
    kinds = engine.FILE_COLUMNS
    files = spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in rows], ", ".join(f"{c} {t}" for c, t in kinds.items()))
    got = groups.score_pairs(spark.createDataFrame([(1, 2)], "a long, b long"), files).collect()
    assert (got[0].kind if got else None) == kind and (not got or low <= got[0].confidence <= high)


@pytest.mark.parametrize("brute", [0, 10**6])
def test_hamming_join_equals_brute_force(spark, brute):
    rng = random.Random(5)
    hashes = [rng.getrandbits(64) for _ in range(300)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 12))) for h in hashes]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    want = {(i, j) for j in range(len(hashes)) for i in range(j) if bin(hashes[i] ^ hashes[j]).count("1") <= 8}
    got = similarity.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "file_id long, hash long"), 8, options=Options(brute_force_hashes=brute))
    assert {(r.a, r.b) for r in got.collect()} == want


@pytest.mark.parametrize("count", [10, 10**5, 10**7, 10**10])
@pytest.mark.parametrize("distance", [0, 3, 8, 9])
def test_bands_lose_no_pair(distance, count):
    rng, plan = random.Random(distance), blocking.bands(distance, count)
    assert sum(w for _, w, _ in plan) == 64 and sum(len(m) for _, _, m in plan) <= blocking.PROBES * len(plan)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), distance))
        assert any((a >> s ^ m) & (1 << w) - 1 == b >> s & (1 << w) - 1 for s, w, masks in plan for m in masks)
    assert len(blocking.bands(8, 10**10)) < len(blocking.bands(8, 10**4))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1050)] + [(7000, 7000), (None, 3)]
    got = {r.node: r.root for r in cluster.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[k] == 1000 for k in range(1000, 1050)) and 7000 not in got
    assert cluster.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_image_hashes():
    a = imaging.luma(pictures.scene(10))
    h = imaging.phash_variants(a)
    distance = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert distance(h[0], imaging.phash_variants(imaging.resize_area(a, 48, 36))[0]) <= 6
    turned = imaging.phash_variants(imaging.luma(pictures.scene(10).transpose(1, 0, 2)[:, ::-1]))[0]
    assert min(distance(turned, v) for v in h) <= 4
    blurred = (a + np.roll(a, 1, 0) + np.roll(a, 1, 1) + np.roll(a, (1, 1), (0, 1))) / 4
    assert imaging.sharpness(a) > 1.5 * imaging.sharpness(blurred)
    grid = np.arange(32 * 32, dtype=float).reshape(32, 32) ** 1.1 % 91
    for k, v in enumerate(imaging.variants(grid)):
        g = grid.T if k & 4 else grid
        g = g[:, ::-1] if k & 1 else g
        assert v == imaging.hash_of(imaging.coefficients(g[::-1] if k & 2 else g))
    assert imaging.preprocess(pictures.scene(1), 14).shape == (3, 14, 14)
    with pytest.raises(ValueError, match="P6"):
        ppm.decode(b"JFIF")


def test_pictures_end_to_end(spark):
    ids = spark.createDataFrame([(10,), (20,), (30,)], "doc_id long")
    result = engine.run(pictures.draw(ids), analyse=lambda f: imaging.analyse(f, ppm.decode), pixels=lambda f: imaging.pixel_hashes(f, ppm.decode))
    got = {(r.file_id // 8 * 10, r.file_id % 8): r for r in result.members.where("rank > 1").collect()}
    for r in result.members.collect():
        assert r.group_id >= 1
    kinds = {(r.path.split("/")[2], r.path.split("/")[3]): (r.kind, r.confidence) for r in result.members.where("rank > 1").collect()}
    for i in ("10", "20", "30"):
        assert kinds[i, "original (1).ppm"] == ("ExactBytes", 100.0)
        assert kinds[i, "copy-renamed.ppm"] == ("IdenticalPixels", 99.0)
        assert kinds[i, "small.ppm"][0] == "Perceptual" and 80 <= kinds[i, "small.ppm"][1] <= 98
    assert got and result.groups.where("kind = 'ExactBytes'").count() == 3


def test_engine_drops_aliases_and_copies_visual_columns(spark):
    ids = spark.createDataFrame([(10,), (20,), (30,)], "doc_id long")
    inode = F.when(F.col("file_id").isin(80, 81), 7).when(F.col("file_id") >= 240, 0).otherwise(F.col("file_id")).cast("long")
    drawn = pictures.draw(ids).withColumns({"device": F.lit(1).cast("long"), "inode": inode, "richness": F.when(F.col("path").contains("(1)"), 1).otherwise(3)})
    result = engine.run(drawn, analyse=lambda f: imaging.analyse(f, ppm.decode))
    exact = {r.file_id: r for r in result.members.where("group_kind = 'ExactBytes'").collect()}
    assert sorted(exact) == [160, 161, 240, 241]
    assert result.files.where("file_id = 81").count() == 0 and result.members.where("file_id = 81").count() == 0
    assert result.files.where("file_id = 80").count() == 1
    seen = {r.file_id: r for r in result.files.collect()}
    for k in (160, 240):
        for c in ("width", "height", "phash", "dhash", "sharpness", "richness"):
            assert exact[k][c] == exact[k + 1][c] == seen[k][c] is not None, c


def test_cross_folder_keeps_one_root(spark):
    kinds = engine.FILE_COLUMNS
    rows = [shot(1, path="/a/mare.jpg", root="/a"), shot(2, path="/a/mare (1).jpg", root="/a", has_copy=True), shot(3, path="/b/x.jpg", root="/b"), shot(4, path="/b/y.jpg", root="/b"), shot(5, path="/b/z.jpg", root="/b"), shot(6, path="/b/z2.jpg", root="/b")]
    sets = spark.createDataFrame([tuple((r | {"full_hash": "m" if r["file_id"] < 5 else "z"}).get(c) for c in kinds) for r in rows], ", ".join(f"{c} {t}" for c, t in kinds.items())).withColumn("set_key", F.col("full_hash"))
    out = groups.set_aside(groups.exact_groups(sets, Options(cross_folder_only=True, preferred_folders=("/a",)))).collect()
    assert {(r.file_id, r.aside) for r in out if r.rank > 1} == {(2, True), (3, False), (4, False)} and {r.keeper_reason for r in out if r.rank == 1} == {"it is in the folder to keep"}


def test_space_guard_boundary(spark):
    plan = spark.createDataFrame([(1, 1, 4, "Planned")], "group_id long, seq long, size long, outcome string")
    assert [policy.space_guard(plan, free, 1_000_000).first().outcome for free in (100_003, 100_004)] == ["QuarantineFull", "Moved"]


def test_modes(spark):
    m = spark.createDataFrame([("ExactBytes", 100.0), ("Perceptual", 95.0), ("Burst", 99.0), ("IdenticalPixels", 99.0)], "kind string, confidence double")
    auto = lambda **o: [r[0] for r in m.select(policy.is_automatic(F.col("kind"), F.col("confidence"), Options(**o))).collect()]
    assert auto(mode="ReadOnly") == [False] * 4 and auto(mode="SemiAutomatic") == [True, False, False, False]
    assert auto(mode="Automatic") == [True, False, False, True] and auto(mode="Automatic", auto_threshold=10) == [True, True, False, True]


def test_keeper_prefers_the_specific_root(spark):
    rows = spark.createDataFrame([("/foto/x", "/foto"), ("/foto/cat/x", "/foto/cat"), ("/foto2/x", "/foto2")], "path string, root string")
    assert [r[0] for r in rows.select(keeper.in_preferred(F.col("path"), F.col("root"), ("/Foto",))).collect()] == [True, False, False]


def test_inventory(spark, tmp_path):
    for name, content in (("a.jpg", b"x"), ("b.txt", b"x"), ("empty.png", b""), (".hidden/c.jpg", b"x"), ("sub/d (1).JPG", b"xy"), ("e.mp4", b"v")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "link.jpg").symlink_to(tmp_path / "a.jpg")
    root = str(tmp_path)
    for rows in (inventory.from_listing(spark, [root, f"{root}/sub"], Options()), inventory.from_listing(spark, [root, f"{root}/sub"], Options(include_videos=True))):
        got = {r.path[len(root) + 1 :]: r for r in rows.collect()}
        assert {"a.jpg", "sub/d (1).JPG"} <= got.keys() <= {"a.jpg", "sub/d (1).JPG", "e.mp4"} and got["sub/d (1).JPG"].root.endswith("/sub") and got["sub/d (1).JPG"].has_copy
    read = inventory.from_reader(spark, [root], Options())
    assert {r.path.rsplit("/", 1)[1] for r in read.collect()} - {"link.jpg"} == {"a.jpg", "d (1).JPG"}  # the reader follows links


def test_journal_and_reports(spark, tmp_path, sf):
    path = str(tmp_path / "j")
    entry = spark.createDataFrame([("/a", "/q/a", 5)], "OriginalPath string, MovedTo string, Size long")
    journal.append(entry, path)
    journal.append(entry, path)
    (tmp_path / "j" / "bad.json").write_text("{broken\n\n" + json.dumps({"OriginalPath": "/b"}) + "\n")
    assert sorted(r.OriginalPath for r in journal.read(spark, path).collect()) == ["/a", "/a", "/b"]
    rows = catalog.report.report_rows(catalog._members(spark, sf))
    report_files.write_csv(rows, str(tmp_path / "r"), parts=3)
    report_files.join_parts(str(tmp_path / "r"), str(tmp_path / "r.csv"))
    lines = (tmp_path / "r.csv").read_bytes().decode("utf-8-sig").splitlines()
    assert lines[0] == report_files.HEADERS["en"] and len(lines) == rows.count() + 1 and lines[1].split(";")[1] == "KEEP"
    order = [(int(x.split(";")[0]), x.split(";")[1] != "KEEP") for x in lines[1:]]
    assert order == sorted(order) and len(list((tmp_path / "r").glob("part-*.csv"))) == 4 and len(list((tmp_path / "r").iterdir())) == 4
    report_files.write_html(rows, catalog.kind_stats_with_zeros(spark, sf), str(tmp_path / "h"), parts=2)
    pages = [p.read_text() for p in sorted((tmp_path / "h").glob("part-*.html"))]
    assert len(pages) == 2 and "<h2>1</h2>" in pages[0] and "part-00002.html" in (tmp_path / "h" / "index.html").read_text()
    assert sum(p.count("<h2>") for p in pages) == len({g for g, _ in order})
    with pytest.raises(Exception, match="no such group"):
        report_files.write_csv(rows.withColumn("reason", F.when(F.col("group") > 3, F.raise_error(F.lit("no such group"))).otherwise(F.col("reason"))), str(tmp_path / "f"), parts=3)
    assert not (tmp_path / "f").exists() or not [p for p in (tmp_path / "f").iterdir() if p.name.startswith("part-")]
    assert report_files.link("/a b/ü%.jpg") == "file:///a%20b/%C3%BC%25.jpg" and report_files.link("C:\\x y\\z.jpg") == "file:///C:/x%20y/z.jpg" and report_files.link("\\\\nas\\p q") == "file://nas/p%20q"


def test_texts(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    assert show(text.format_bytes(F.lit(3 << 29))) == "1.50 GB" and show(text.quarantine_path("/q/s", F.lit("C:\\x\\y"))) == "/q/s/C\\x\\y" and show(text.drive(F.lit("e:\\a"))) == "E:"
    assert show(text.csv_quote(F.lit('a"b'))) == '"a""b"' and abs(show(vectors.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111_194.9) < 1
    assert show(text.with_subseconds(F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.lit("25"))).microsecond == 250_000


def test_stream_of_arrivals(spark, tmp_path):
    from echofold.streaming import incremental

    src = tmp_path / "in"
    spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:00:05'), ('b', timestamp'2024-01-01 00:00:06') t(k, ts)").write.parquet(str(src))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(src))
    seen = []
    incremental.upsert(lambda df, _: seen.extend(r.k for r in df.collect()), incremental.first_arrivals(stream, "k", "ts"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_running_sums_over_ranges(spark):
    from echofold.operators import ranking

    rows = [(k, 7 if k % 3 else k, k % 11) for k in range(500)]
    got = {r.i: (r.total, r.n) for r in ranking.numbered(ranking.running(spark.createDataFrame(rows, "i long, a long, b long"), [F.desc("a"), "i"], F.col("b"), "total"), [F.desc("a"), "i"], "n").collect()}
    total = 0
    for n, (i, _, b) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += b
        assert got[i] == (total, n)


MEMBER = "group_id long, group_kind string, rank int, file_id long, keeper_id long, kind string, confidence double, size long, unchanged boolean, keeper_unchanged boolean, same_file boolean, still_identical boolean, cross_drive boolean"


def fold_by_hand(rows, mode, choices, space):
    """The run as a loop over groups, one member after the other."""
    sure = {"SemiAutomatic": lambda m: m[5] == "ExactBytes", "Automatic": lambda m: m[6] >= 99 and m[5] != "Burst", "Assisted": lambda m: False}[mode]
    out, removed, approved, quit_, stopped, free = [], set(), set(), False, False, space and space[0]
    by = {}
    for r in rows:
        if r[2] > 1:
            by.setdefault(r[0], []).append(r)
    for g in sorted(by):
        own = sorted(by[g], key=lambda m: (m[2], m[3]))
        auto, ask = [m for m in own if sure(m)], [m for m in own if not sure(m)]
        for part, asked in ((auto, False), (ask, True)):
            if not part:
                continue
            if quit_ or stopped:
                out += [(g, m[3], "AwaitingReview") for m in part]
                continue
            if asked and not (part[0][1] in approved and all(m[6] >= 60 for m in part)):
                choice = choices.get(g)
                if choice == "Quit":
                    quit_ = True
                if choice == "Skip":
                    out += [(g, m[3], "Skipped") for m in part]
                    continue
                if choice in (None, "Quit"):
                    out += [(g, m[3], "AwaitingReview") for m in part]
                    continue
                if choice == "ApplyToAllOfThisKind":
                    approved.add(part[0][1])
            for m in part:
                if stopped:
                    out.append((g, m[3], "AwaitingReview"))
                elif m[4] in removed or not m[9]:
                    out.append((g, m[3], "KeeperUnavailable"))
                elif m[3] in removed:
                    out.append((g, m[3], "AlreadyHandled"))
                elif not m[8]:
                    out.append((g, m[3], "ChangedSinceScan"))
                elif m[10]:
                    out.append((g, m[3], "SameFile"))
                elif space and m[12] and free - m[7] < space[1] * 0.1:
                    stopped = True
                    out.append((g, m[3], "QuarantineFull"))
                elif not m[11]:
                    out.append((g, m[3], "ByteCheckFailed"))
                else:
                    removed.add(m[3])
                    free = free - m[7] if space and m[12] else free
                    out.append((g, m[3], "Moved"))
    return out


@pytest.mark.parametrize(("mode", "space", "seed"), [("Automatic", None, 1), ("Assisted", (9000, 60_000), 2), ("SemiAutomatic", (12_000, 60_000), 3)])
def test_fold_equals_a_loop(spark, mode, space, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(1, 60):
        kind = rng.choice(["ExactBytes", "Perceptual", "Burst"])
        files = rng.sample(range(45), rng.randrange(2, 5))
        whole = rng.random() > 0.1
        for rank, f in enumerate(files, 1):
            rows.append((g, kind, rank, f, files[0], kind, float(rng.choice([100, 99, 80, 50])), rng.randrange(1, 400), rng.random() > 0.1, whole, rng.random() < 0.05, rng.random() > 0.1, rng.random() < 0.5))
    choices = {g: rng.choice(["Apply", "Skip", "Apply"]) for g in range(1, 60) if rng.random() < 0.6} | {20: "ApplyToAllOfThisKind", 55: "Quit"}
    decisions = spark.createDataFrame(list(choices.items()), "group_id long, choice string")
    got = policy.execute(spark.createDataFrame(rows, MEMBER), Options(mode=mode), decisions, space).orderBy("position").collect()
    want = fold_by_hand(rows, mode, choices, space)
    assert [(r.group_id, r.file_id, r.outcome) for r in got] == want and len({x[2] for x in want}) >= 6


@pytest.mark.parametrize(("turned", "moved"), [(False, 6), (True, 4)])
def test_fold_never_moves_the_last_copy(spark, turned, moved):
    """Three copies of a picture (1, 2, 3), three of its small version (4, 5, 6), and one with the
    same pixels (7); the small version that is kept is itself a duplicate of the picture."""
    parts = [("ExactBytes", 100.0, [1, 2, 3]), ("ExactBytes", 100.0, [4, 5, 6]), ("IdenticalPixels", 99.0, [1, 7, 4])]
    rows = [(g, kind, rank, f, files[0], kind, c, 1, True, True, False, True, False) for g, (kind, c, files) in enumerate(parts[::-1] if turned else parts, 1) for rank, f in enumerate(files, 1)]
    got = policy.execute(spark.createDataFrame(rows, MEMBER), Options(mode="Automatic", auto_threshold=90)).collect()
    kept = {r.file_id: r.keeper_id for r in got if r.outcome == "Moved"}
    assert len(kept) == moved
    for f in kept:
        for _ in kept:
            f = kept.get(f, f)
        assert f not in kept
    assert {r.outcome for r in policy.execute(spark.createDataFrame(rows, MEMBER), Options()).collect()} == {"ReportOnly"}


def test_second_scan_uses_the_cache(spark, tmp_path):
    from echofold.operators import cache
    from echofold.runtime import Scratch

    drawn = Scratch(spark, "t").cut(pictures.draw(spark.createDataFrame([(10,), (20,)], "doc_id long")), "drawn")
    asked = {"analyse": [], "pixels": [], "embed": []}
    network = lambda x: np.stack([x.mean((2, 3))[:, k % 3] for k in range(6)], 1)
    steps = {
        "analyse": lambda f: imaging.analyse(f, ppm.decode), "pixels": lambda f: imaging.pixel_hashes(f, ppm.decode), "embed": lambda f: imaging.embeddings(f, ppm.decode, network, 16),
    }

    def scan(known):
        for seen in asked.values():
            seen.clear()
        told = lambda name: lambda f: (asked[name].append(sorted(r.file_id for r in f.select("file_id").collect())), steps[name](f))[1]
        out = engine.run(drawn, told("analyse"), None, told("pixels"), told("embed"), known)
        return sorted(((r.file_id, r.kind, round(r.confidence or 0, 6), r.rank, r.group_id) for r in out.members.collect()), key=str), out

    first, result = scan(None)
    assert len(asked["analyse"][0]) == 8 and asked["pixels"][0] == [80, 82, 160, 162] and set(asked["embed"][0]) >= {80, 82, 83}
    assert {r.file_id: r.embedding for r in result.files.collect()}[80] is not None
    plain = engine.run(drawn, steps["analyse"])
    assert all(r.embedding is None and r.pixel_hash is None for r in plain.files.collect())
    place, kinds = str(tmp_path / "cache"), ", ".join(f"{c} {engine.FILE_COLUMNS[c]}" for c in ("path", "size", "mtime_ticks", *engine.CACHED))
    assert cache.load(spark, place, kinds).count() == 0
    cache.save(result.cache, place)
    cache.save(cache.load(spark, place, kinds), place)
    again, second = scan(cache.load(spark, place, kinds))
    assert again == first and asked["analyse"] == asked["pixels"] == [[]]  # vectors depend on the network, so they are asked for again
    assert second.cache.count() == result.cache.count() == 8 + 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet at all")
    assert cache.load(spark, str(tmp_path / "bad"), kinds).count() == 0


def test_known_hashes_are_taken(spark):
    rows = [(1, b"abc", 3, "same"), (2, b"abd", 3, "same"), (3, b"abe", 3, None)]
    files = spark.createDataFrame([(i, c, s, False, h, h) for i, c, s, h in rows], "file_id long, content binary, size long, is_video boolean, partial_hash string, full_hash string")
    assert sorted(r.file_id for r in blocking.exact_sets(files).collect()) == [1, 2]


def test_exif(spark):
    from datetime import datetime

    from echofold.sources import exif

    at = {exif.TAKEN: "2024:05:01 10:20:30", exif.SUBSECONDS: "25"}
    place = {exif.LATITUDE_REF: "N", exif.LATITUDE: [45, 27, 51.12], exif.LONGITUDE_REF: "W", exif.LONGITUDE: [9, 11, 24]}
    m = exif.read(exif.write({exif.MAKE: "Google", exif.MODEL: "Pixel 9", exif.ORIENTATION: 6}, at, place, jpeg=True))
    assert m["taken_at"] == datetime(2024, 5, 1, 10, 20, 30, 250_000) and (m["make"], m["model"], m["orientation"]) == ("Google", "Pixel 9", 6)
    assert abs(m["latitude"] - 45.4642) < 1e-3 and abs(m["longitude"] + 9.19) < 1e-3 and m["richness"] == 6
    whole = exif.write({exif.MODEL: "x" * 40}, at, place)
    for cut in range(len(whole)):
        exif.read(whole[:cut])
    for content in (None, b"", b"\xff\xd8\xff\xe1\0\x10Exif\0\0II*\0", b"no picture", b"II*\0\xff\xff\xff\x7f"):
        assert exif.read(content) == exif.EMPTY
    grid = np.arange(24).reshape(2, 4, 3)
    assert [imaging.oriented(grid, k).shape[:2] for k in (1, 3, 6, 8)] == [(2, 4), (2, 4), (4, 2), (4, 2)]
    assert (imaging.oriented(grid, 6) == np.rot90(grid, -1)).all() and (imaging.oriented(grid, 8) == np.rot90(grid)).all() and (imaging.oriented(grid, 3) == np.rot90(grid, 2)).all()
    assert imaging.upright_size(4000, 3000, 192, 256) == (3000, 4000) and imaging.upright_size(4000, 3000, 256, 192) == (4000, 3000)


def test_bins_and_drives(spark):
    rows = spark.createDataFrame([("C:\\a",), ("E:\\a",), ("\\\\nas\\p\\a",), ("/a",), (None,)], "path string")
    assert [r[0] for r in rows.select(policy.has_bin(F.col("path"), ["c:", "/", "\\\\nas\\p"])).collect()] == [True, False, False, False, False]
    assert [r[0] for r in rows.limit(2).select(policy.crosses_drives(F.lit("C:\\q"), F.col("path"))).collect()] == [False, True]


def test_hidden_folders_count_below_the_root_only(spark, tmp_path):
    base = tmp_path / ".sync" / "photos"
    for name in ("a.jpg", ".x/b.jpg", ".c.jpg"):
        (base / name).parent.mkdir(exist_ok=True, parents=True)
        (base / name).write_bytes(b"x")
    for read in (inventory.from_listing, inventory.from_reader):
        assert [r.path.rsplit("/", 1)[1] for r in read(spark, [str(base)], Options()).collect()] == ["a.jpg"]
    assert inventory.from_listing(spark, [str(base)], Options(include_hidden=True)).count() == 3


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from echofold import cli

    for locale, language in (("it_IT.UTF-8", "it"), ("C", "en")):
        monkeypatch.setenv("LC_ALL", locale)
        assert cli.parse(["/a"]).language == language
    assert cli.parse(["/a", "--lingua", "it"]).language == "it"
    got = cli.parse(["/a", "/b", "--modo", "auto", "--soglia", "95,5", "--raffica", "3.5", "--solo-tra-cartelle", "--preferisci", "/a", "--video-rapido"])
    assert got.roots == ("/a", "/b") and got.options == Options(mode="Automatic", auto_threshold=95.5, burst_window_seconds=3.5, cross_folder_only=True, preferred_folders=("/a",), include_videos=True, quick_video_check=True)
    for wrong in ([], ["/a", "--threshold", "89"], ["/a", "--burst", "x"], ["/a", "--across-folders"], ["/a", "--mode", "assisted", "--non-interactive"], ["/a", "--what"], ["/a", "--mode", "fast"]):
        with pytest.raises(SystemExit):
            cli.parse(wrong)
    for name, seed in (("a.jpg", 1), ("b.jpg", 1), ("c.jpg", 2)):
        (tmp_path / name).write_bytes(ppm.encode(pictures.scene(seed)))
    size = (tmp_path / "a.jpg").stat().st_size
    report, cache = str(tmp_path / "out" / "report"), str(tmp_path / "out" / "cache")
    (tmp_path / "out").mkdir()
    assert cli.main([str(tmp_path), "--report", report, "--cache", cache]) == {"total": size, "ExactBytes": size, "ReportOnly": 1}
    assert "KEEP" in (tmp_path / "out" / "report.csv").read_text() and (tmp_path / "out" / "report-html" / "index.html").exists()
    os.link(tmp_path / "a.jpg", tmp_path / "d.jpg")
    away = tmp_path.parent / f"{tmp_path.name}-away"
    assert cli.main([str(tmp_path), "--cache", cache, "--report", report, "--language", "it", "--mode", "auto", "--non-interactive", "--quarantine", str(away)]) == {"total": size, "ExactBytes": size, "Moved": 1}
    italian = (tmp_path / "out" / "report.csv").read_text("utf-8-sig")
    assert italian.startswith(report_files.HEADERS["it"]) and "TENERE" in italian and "copia identica" in italian and "Doppioni" in (tmp_path / "out" / "report-html" / "index.html").read_text()
    from echofold.sources import journal

    moved = journal.read(spark, f"{away}/journal").collect()
    names = [[f.rsplit("/", 1)[1] for f in (r.OriginalPath, r.KeptFile)] for r in moved]
    assert len(names) == 1 and sorted(names[0])[-2:] in (["a.jpg", "b.jpg"], ["b.jpg", "d.jpg"]) and (moved[0].Method, moved[0].Size) == (0, size)
    plan = spark.read.json(f"{away}/plan-*").collect()
    assert [(r.outcome, r.moved_to) for r in plan] == [("Moved", moved[0].MovedTo)] and moved[0].MovedTo.startswith(f"{away}/")
    (tmp_path / "answers.json").write_text('{"group_id": 1, "choice": "Apply"}\n')
    assert cli.main([str(tmp_path), "--mode", "assisted", "--quarantine", str(away)])["AwaitingReview"] == 1
    assert cli.main([str(tmp_path), "--mode", "assisted", "--quarantine", str(away), "--answers", str(tmp_path / "answers.json")])["Moved"] == 1


def test_sessions(spark, tmp_path):
    from echofold.streaming import incremental

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:08"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:01"), ("z", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    incremental.upsert(lambda df, _: seen.extend((r.k, r.n) for r in df.collect()), incremental.sessions(stream, "ts", "k"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("a", 1), ("a", 2), ("b", 1)]


def test_review_cursor_goes_round(spark):
    def step(states, read_only=False):
        rows = spark.createDataFrame([(k, s) for k, s in enumerate(states)], "file_id long, status string").repartition(3)
        return [(r.after_decision, r.forward, r.back) for r in policy.review_cursor(rows, ["file_id"], read_only).orderBy("position").collect()]

    p, m = "Pending", "Moved"
    assert step([m, p, m, p, m]) == [(2, 2, 4), (4, 4, 4), (4, 4, 2), (2, 2, 2), (2, 2, 4)]
    assert step([p]) == [(None, 1, 1)] and step([m, m, m]) == [(None, 2, 3), (None, 3, 1), (None, 1, 2)]
    assert [x[1:] for x in step([p, m, p], True)] == [(2, 3), (3, 1), (1, 2)] and step([]) == []
    rng, states = random.Random(2), []
    for _ in range(3):
        states += [rng.choice([p, m, "Skipped"]) for _ in range(60)]
    pend = [k for k, s in enumerate(states, 1) if s == p]
    assert step(states) == [(next((x for x in pend if x > k), next((x for x in pend if x < k), None)), next((x for x in pend if x > k), pend[0]), next((x for x in pend[::-1] if x < k), pend[-1])) for k in range(1, len(states) + 1)]


def test_review_actions(spark):
    rows = [(1, 11, "ExactBytes", 100.0, "Pending"), (1, 12, "Burst", 59.0, "Pending"), (2, 21, "ExactBytes", 55.0, "Pending"), (2, 22, "ExactBytes", 99.0, "Moved")]
    review = spark.createDataFrame(rows, "group_id long, file_id long, kind string, confidence double, status string")
    kept = policy.keep_both(review, spark.createDataFrame([(1, 12), (2, 22), (1, 12)], "group_id long, file_id long"))
    assert {r.file_id: r.status for r in kept.collect()} == {11: "Pending", 12: "Skipped", 21: "Pending", 22: "Moved"}
    assert {r.file_id for r in policy.all_of_kind(review, "ExactBytes").where("chosen").collect()} == {11}


def test_swap_makes_the_group_again(spark):
    kinds = engine.FILE_COLUMNS
    base = {"size": 5, "is_video": False, "normalized": "x", "has_copy": False, "has_edit": False, "full_hash": "h"}
    rows = [(f"g{i // 10}", n, *({**base, "file_id": i, "path": f"/{i}"}.get(c) for c in kinds)) for n, i in [(1, 10), (2, 11), (3, 12), (1, 20), (2, 21)]]
    members = spark.createDataFrame(rows, "group_key string, rank int, " + ", ".join(f"{c} {t}" for c, t in kinds.items())).withColumn("keeper_reason", F.lit("best"))
    old = groups.against_keeper(members)
    options = Options(mode="Assisted")
    review = policy.review_rows(old, options).withColumn("status", F.when(F.col("file_id") == 12, "Moved").otherwise("Skipped")).select("group_key", "file_id", "keeper_id", "kind", "confidence", "status")
    got = policy.swap(review, members, spark.createDataFrame([("g1", 11)], "group_key string, file_id long"), options).collect()
    assert {(r.group_key, r.file_id, r.keeper_id, r.status) for r in got} == {("g1", 10, 11, "Pending"), ("g1", 12, 11, "Moved"), ("g2", 21, 20, "Skipped")}


def test_a_network_that_fails_on_one_picture(spark):
    drawn = spark.createDataFrame([(k, ppm.encode(pictures.scene(k, 16, 12))) for k in range(20)] + [(20, b"no picture")], "file_id long, content binary").coalesce(1)
    bad = imaging.preprocess(ppm.decode(ppm.encode(pictures.scene(7, 16, 12))), 8)

    def network(x):
        if any(np.allclose(p, bad) for p in x):
            raise RuntimeError("out of range")
        return x.mean((2, 3))

    got = {r.file_id: r for r in imaging.embeddings(drawn, ppm.decode, network, 8, 8, with_errors=True).collect()}
    assert got.keys() == set(range(21)) and {k for k, r in got.items() if r.embedding is None} == {7, 20}
    assert got[7].vector_error == "RuntimeError: out of range" and abs(sum(x * x for x in got[3].embedding) - 1) < 1e-9
    assert sorted(r.file_id for r in imaging.embeddings(drawn, ppm.decode, network, 8, 8).collect()) == [k for k in range(20) if k != 7]
    asked = spark.sparkContext.accumulator(0)

    def broken(x):
        asked.add(1)
        raise OSError("no device")

    none = imaging.embeddings(drawn, ppm.decode, broken, 8, 4, with_errors=True).collect()
    assert len(none) == 21 and all(r.embedding is None for r in none) and asked.value == 14  # two batches of four, halved to the end
    values, errors = imaging.isolated(lambda x: np.where(x.sum((1, 2, 3))[:, None] > 2, np.nan, x.sum((1, 2, 3))[:, None]), np.ones((2, 1, 1, 1)) * np.array([1, 3])[:, None, None, None])
    assert values[0].tolist() == [1] and values[1] is None and errors == [None, "not finite"]


def test_progress(spark):
    from echofold import progress

    now, told = [0.0], []
    counter = progress.Counter(100_000, lambda *x: told.append(x), clock=lambda: now[0])
    for _ in range(100_000):
        now[0] += 40e-6  # four seconds in all
        counter.step(1, 10)
    assert len(told) < 20 and told[-1] == (100_000, 100_000, 1_000_000) and [t[0] for t in told] == sorted(t[0] for t in told)
    seen = []
    with progress.watched(spark, lambda *x: seen.append(x), spacing=0.05):
        spark.range(0, 4000, 1, 40).repartition(7).selectExpr("sum(id)").collect()
    assert seen and seen[-1][1] == seen[-1][2] >= 40 and all(a[1] <= b[1] for a, b in zip(seen, seen[1:], strict=False))


def test_reasons_in_italian(spark):
    known = {
        "byte-identical, same name": "copia identica, stesso nome", "richer metadata (date, GPS...)": "metadati più completi (data, GPS...)", "": "", "something else, matching name": "something else, nome compatibile",
        "perceptual hash at distance 3/64, rotated or mirrored, different proportions (perhaps cropped), dHash disagrees, the neural network sees differences (85% similar), matching name, one of the two is an edited version":
        "hash percettivo a distanza 3/64, ruotata o specchiata, proporzioni diverse (forse ritagliata), dHash discordante, la rete neurale vede differenze (somiglianza 85%), nome compatibile, una delle due è una versione modificata",
        "taken 2.5 s apart with the same camera, 97% neural similarity": "scattate a 2,5 s di distanza con la stessa fotocamera, somiglianza neurale 97%",
        "taken 3 s apart with the same camera, hash at distance 12/64": "scattate a 3 s di distanza con la stessa fotocamera, hash a distanza 12/64",
    }
    rows = spark.createDataFrame([(k, v) for k, v in known.items()] + [(None, None)], "r string, want string")
    for r in rows.select("r", "want", text.reason_in(F.col("r"), "it").alias("it"), text.reason_in(F.col("r")).alias("en")).collect():
        assert r.it == r.want and r.en == r.r
    assert [text.detect(x) for x in ("it_IT.UTF-8", "it", "IT-CH", "en_US", "C", "", None)] == ["it", "it", "it", "en", "en", "en", "en"]


def test_every_reason_has_its_translation(spark):
    """Reasons of the scorer and of keepers leave no English behind."""
    file = {"path": "/a/x.jpg", "size": 5, "is_video": False, "normalized": "x", "has_edit": False, "width": 4, "height": 3, "phash": [0] * 8, "dhash": 0, "embedding": None, "camera_key": "c"}
    cases = [
        ({}, {}), ({}, {"width": 9, "has_edit": True}), ({}, {"phash": [255, 1, 255, 255, 255, 255, 255, 255]}), ({"full_hash": "f"}, {"full_hash": "f"}), ({"pixel_hash": "p"}, {"pixel_hash": "p"}),
        ({"is_video": True, "sample_hash": "s"}, {"is_video": True, "sample_hash": "s"}), ({}, {"dhash": -1, "embedding": [0.6, 0.8]}),
    ]
    columns = "struct<path:string,size:long,is_video:boolean,normalized:string,has_edit:boolean,full_hash:string,sample_hash:string,pixel_hash:string,width:int,height:int,phash:array<bigint>,dhash:bigint,embedding:array<double>,taken_at:timestamp_ntz,camera_key:string,latitude:double,longitude:double>"
    sides = [({**file, "embedding": [1.0, 0.0] if "embedding" in b else None, **a}, {**file, **b}) for a, b in cases]
    pairs = spark.createDataFrame(sides, f"a {columns}, b {columns}")
    found = pairs.select(score.compare(F.col("a"), F.col("b")).alias("m")).select("m.reason", text.reason_in(F.col("m.reason"), "it").alias("it")).collect()
    assert len({r.reason for r in found}) == len(cases) and all(r.reason for r in found)
    for r in found:
        assert not set(r.reason.split(", ")) & set(r.it.split(", ")), r
