"""Readers of contents: ranges by path, hashes where contents lie, and what never is shuffled."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from echofold.operators import blocking, cache, policy
from echofold.operators import contents as C
from echofold.options import Options
from echofold.plans import engine
from echofold.sources import inventory, listing


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def hashed(spark, files, ways, options=None):
    reader = C.ByPath(spark.createDataFrame(files, "file_id long, path string, size long"), options)
    wanted = spark.createDataFrame([(f[0], how) for f in files for how in ways], "file_id long, how string")
    return {(r.file_id, r.how): r for r in reader.hashes(wanted).collect()}


def test_ranges_of_a_huge_file(spark, tmp_path):
    big = tmp_path / "film.mp4"
    with big.open("wb") as out:
        out.truncate(4 << 30)
        out.seek(0)
        out.write(b"head")
        out.seek((4 << 30) - 4)
        out.write(b"tail")
    o, size = Options(), 4 << 30
    got = hashed(spark, [(1, str(big), size)], [C.PARTIAL, C.SAMPLE], o)
    head, tail = b"head" + bytes(o.partial_hash_bytes - 4), bytes(o.partial_hash_bytes - 4) + b"tail"
    ends, blocks = got[1, C.PARTIAL], got[1, C.SAMPLE]
    assert (ends.size, ends.bytes_read, ends.hash) == (size, 2 * o.partial_hash_bytes, hashlib.md5(head + tail).hexdigest())
    between = bytes(o.partial_hash_bytes * (o.video_sample_blocks - 2))
    assert (blocks.bytes_read, blocks.hash) == (16 * o.partial_hash_bytes, hashlib.md5(f"{size}:".encode() + head + between + tail).hexdigest())


def test_whole_files_are_read_in_buffers(tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BUFFER", 1000)
    data = os.urandom(12_345)
    (tmp_path / "x").write_bytes(data)

    class Counted:
        def __init__(self, file):
            self.file, self.most = file, 0

        def read(self, n):
            self.most = max(self.most, n)
            return self.file.read(n)

        def __getattr__(self, name):
            return getattr(self.file, name)

    for how, read in ((C.FULL, 12_345), (C.PARTIAL, 4000), (C.SAMPLE, 12_345)):
        with C.opened(str(tmp_path / "x")) as file:
            counted = Counted(file)
            digest, size, total = C.hash_file(counted, how, 2000, 16)
        want = {C.FULL: data, C.PARTIAL: data[:2000] + data[-2000:], C.SAMPLE: b"12345:" + data}[how]
        assert (digest, size, total) == (hashlib.md5(want).hexdigest(), 12_345, read) and counted.most <= 1000


def test_unreadable_files_are_rows_with_an_error(spark, tmp_path):
    for name, text in (("a", b"same bytes"), ("b", b"same bytes"), ("c", b"same bytes"), ("d", b"other text")):
        (tmp_path / f"{name}.jpg").write_bytes(text)
    files = spark.createDataFrame(inventory.from_listing(spark, [str(tmp_path)], Options()).collect())
    (tmp_path / "c.jpg").unlink()
    (tmp_path / "d.jpg").unlink()
    (tmp_path / "d.jpg").mkdir()
    got = engine.run(files, reader=C.ByPath(files))
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    assert sorted(r.name for r in got.members.select(name).collect()) == ["a.jpg", "b.jpg"]
    errors = {r.name: r.error for r in got.files.select(name, "error").where("error is not null").collect()}
    assert errors.keys() == {"c.jpg", "d.jpg"} and errors["c.jpg"].startswith("FileNotFoundError") and errors["d.jpg"].startswith("IsADirectoryError")


def test_both_readers_agree(spark, tmp_path):
    o = Options(partial_hash_bytes=8, video_sample_blocks=4, include_videos=True, quick_video_check=True)
    texts = [b"x" * 40 + bytes([65 + k % 3]) + b"y" * 40 for k in range(9)] + [b"ab", b"ab", b""]
    rows = []
    for k, t in enumerate(texts):
        path = tmp_path / f"{k}.{'mp4' if k % 2 else 'jpg'}"
        path.write_bytes(t)
        rows.append((k, str(path), len(t), bool(k % 2), t.decode()))
    files = spark.createDataFrame(rows, "file_id long, path string, size long, is_video boolean, content string")
    read = [{tuple(r) for r in blocking.exact_sets(files, options=o, reader=reader).select("file_id", "partial_hash", "full_hash", "sample_hash", "set_key").collect()} for reader in (None, C.ByPath(files, o))]
    assert read[0] == read[1] and sorted(r[0] for r in read[0]) == [0, 1, 2, 3, 5, 6, 7, 8]  # the films differ between the blocks only


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_contents_are_not_shuffled(spark, monkeypatch, few):
    monkeypatch.setattr(C, "BROADCAST_IDS", few)
    rows = [(k, f"/r/{k}.jpg", 6, False, "abcdef" if k < 4 else f"abcd{k:02d}") for k in range(12)]
    files = spark.createDataFrame(rows, "file_id long, path string, size long, is_video boolean, content string")
    seen = []
    keep = blocking.Scratch.cut
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(blocking.Scratch, "cut", lambda self, df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df, name))[1])
    try:
        got = blocking.exact_sets(files)
        assert sorted(r.file_id for r in got.collect()) == [0, 1, 2, 3] and "content" not in got.columns
        seen.append(got._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in seen:
        lines = plan.split("\n")
        for at, line in enumerate(lines):
            if re.search(r"\bExchange (hash|range)partitioning", line):
                below = next((x for x in lines[at + 1 :] if re.search(r"Project|Aggregate|Scan|Filter", x)), "")
                assert "content" not in below.split("[", 1)[-1].split("]")[0], plan


def test_a_remembered_hash_of_other_blocks_finds_its_copy(spark):
    """Sampled hashes depend on the number of blocks, so the cache doesn't keep them."""
    quick = lambda n: Options(include_videos=True, quick_video_check=True, partial_hash_bytes=4, video_sample_blocks=n)
    film = "".join(chr(97 + i % 26) for i in range(300))
    row = lambda k: (k, f"/v/{k}.mp4", 300, True, film)
    schema = "file_id long, path string, size long, is_video boolean, content string"
    time = lambda df: df.withColumns({"last_write": F.expr("timestamp_ntz'2024-01-01 00:00:00'"), "root": F.lit("/v"), "normalized": F.col("path"), "has_copy": F.lit(False), "has_edit": F.lit(False)})
    first = engine.run(time(spark.createDataFrame([row(1), row(2)], schema)), options=quick(8))
    assert first.members.count() == 2
    again = engine.run(time(spark.createDataFrame([row(1), row(3)], schema)), options=quick(4), cache=first.cache)
    assert sorted(r.file_id for r in again.members.collect()) == [1, 3]


def test_any_number_of_roots_is_pruned(spark):
    roots = spark.range(10_001).select(F.format_string("/R%d/", "id").alias("root"))
    entries = spark.range(10_001).select(F.format_string("/r%d/x/gone.jpg", "id").alias("path")).unionByName(spark.createDataFrame([("/r7/here.jpg",), ("/r77777/far.jpg",), ("/r",), ("/r10/../r3",)], "path string"))
    left = cache.prune(entries, roots, spark.createDataFrame([("/R7/HERE.jpg",)], "path string"))
    assert sorted(r.path for r in left.collect()) == ["/r", "/r7/here.jpg", "/r77777/far.jpg"]
    assert cache.prune(entries, ["/"], entries.limit(0)).count() == 0


def test_roots_with_a_scheme(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jpg").write_bytes(b"x")
    files = inventory.from_reader(spark, [f"file://{tmp_path}", f"file:{tmp_path}/sub"], Options())
    got = files.collect()
    assert [(r.path, r.root) for r in got] == [(f"{tmp_path}/sub/a.jpg", f"{tmp_path}/sub")]
    read = C.ByPath(files).of(files.select("file_id")).collect()
    assert bytes(read[0].content) == b"x"


def test_listing_splits_the_tree(tmp_path):
    for a in range(5):
        for b in range(4):
            (tmp_path / str(a) / str(b)).mkdir(parents=True)
            (tmp_path / str(a) / str(b) / "f.jpg").write_bytes(b"x")
    (tmp_path / "top.jpg").write_bytes(b"x")
    (tmp_path / "away").symlink_to(tmp_path / "0")
    want = sorted(str(p) for p in tmp_path.rglob("*.jpg") if "away" not in str(p))
    for parts in (1, 3, 7, 1000):
        folders = listing.split([str(tmp_path), f"{tmp_path}/0/"], True, parts)
        reader = listing.FileReader({"roots": "[]"})
        assert sorted(p for f in folders for b in reader.read(f) for p in b.column(0).to_pylist()) == want
    assert len(listing.split([str(tmp_path)], True, 7)) >= 7 and [f.below for f in listing.split([str(tmp_path)], False)] == [False]


def test_recheck_by_path(spark, tmp_path):
    for name, text in (("a", b"head" + b"m" * 100 + b"tail"), ("b", b"head" + b"m" * 100 + b"tail"), ("c", b"head" + b"x" * 100 + b"tail"), ("d", b"gone")):
        (tmp_path / name).write_bytes(text)
    files = spark.createDataFrame([(k, str(tmp_path / n), 108) for k, n in enumerate("abcd")] , "file_id long, path string, size long")
    (tmp_path / "d").unlink()
    members = spark.createDataFrame([(1, k, 0, k + 1, "ExactBytes" if k else None, False) for k in range(4)], "group_id long, file_id long, keeper_id long, rank int, kind string, is_video boolean")
    o = Options(partial_hash_bytes=4)
    same = lambda o: {r.file_id: r.still_identical for r in policy.recheck(members, C.ByPath(files, o), o).collect()}
    assert same(o) == {0: True, 1: True, 2: True, 3: False}
    assert same(Options(partial_hash_bytes=4, verify_before_move=True)) == {0: True, 1: True, 2: False, 3: False}
