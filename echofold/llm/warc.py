"""WARC records and a Merkle fixity audit of their replicas.

``records`` lays pages out as WARC resource records in files of ``PER_FILE`` page ids.  ``leaves``
hashes every record and gives it a byte offset.  ``trees`` hashes ordered offset ranges: a node
covers ``BASE`` * ``FANOUT``^level bytes of one file, then the file, then ``FANOUT``^k files, up to one
root.  ``audit`` compares the roots of two replicas and descends only into the children of nodes
that differ, down to the records: a replica that is whole costs one comparison.  In the ranges
that differ, records are aligned by page id and hash, so one that merely lies at another offset
(behind a lost or altered one) is not called damaged.

Record bytes are hashed where they lie, once, and are never shuffled.  Equal records of a page are
one leaf with a number of copies, counted on the map side.  Offsets are sums over cells of a file
(page id and first byte of the hash), then within a cell, so a page id that holds many different
records is spread over tasks.  A node gathers at most ``FANOUT`` children, or the records of
``BASE`` bytes.

Defined results: null url or html counts as empty; pages with a null id lie in files of their own,
by a hash of their content, so an altered one is reported as missing and extra; negative ids are
ids like others; repeated pages are copies of one record, and a lost copy is reported with the
number lost; other columns are ignored; records of a file lie in the order of page id and hash, so
none can be out of order; with no pages on either side the audit is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch

PER_FILE = 256
#: Files of pages without an id, numbered down from the first.
NULL_FILES, FIRST_NULL_FILE = 4096, -(1 << 62)
BASE = 65_536
FANOUT = 16


def record_bytes(url: Column, html: Column, name: Column) -> Column:
    """One WARC/1.1 resource record as bytes."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(name.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(file_no, page_id, record): the records of an archive, without offsets."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("_u"), F.col(html_col).cast("string").alias("_h"))
    nameless = F.lit(FIRST_NULL_FILE) - F.pmod(F.xxhash64("_u", "_h"), F.lit(NULL_FILES))
    file_no = F.coalesce(F.floor(F.col("page_id") / per_file).cast("long"), nameless)
    return own.select(file_no.alias("file_no"), "page_id", record_bytes(F.col("_u"), F.col("_h"), F.col("page_id")).alias("record"))


def leaves(archive: DataFrame, scratch: Scratch) -> DataFrame:
    """(file_no, page_id, hash, length, copies, offset) of the distinct records, written."""
    slim = archive.select("file_no", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    one = slim.groupBy("file_no", "page_id", "hash", "length").agg(F.count(F.lit(1)).alias("copies"))
    one = scratch.cut(one.withColumns({"cell": F.substring("hash", 1, 2), "bytes": F.col("length") * F.col("copies")}), "records")
    earlier = lambda by, *order: F.coalesce(F.sum("bytes").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = one.groupBy("file_no", "page_id", "cell").agg(F.sum("bytes").alias("bytes"))
    cells = cells.select(F.col("file_no").alias("f"), F.col("page_id").alias("p"), F.col("cell").alias("c"), earlier(["file_no"], "page_id", "cell").alias("before"))
    within = one.withColumn("within", earlier(["file_no", "page_id", "cell"], "hash"))
    placed = within.join(cells, (F.col("file_no") == F.col("f")) & F.col("page_id").eqNullSafe(F.col("p")) & (F.col("cell") == F.col("c")))
    return scratch.cut(placed.select("file_no", "page_id", "hash", "length", "copies", (F.col("before") + F.col("within")).alias("offset")), "leaves")


def _combine(rows: DataFrame, keys: list[str], child: list[str]) -> DataFrame:
    """Nodes over ordered children: sha256 of the children's places and hashes."""
    listed = F.array_sort(F.collect_list(F.struct(*child, "hash")))
    line = F.transform(listed, lambda c: F.concat_ws(":", *[c[x].cast("string") for x in child], c["hash"]))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(line, "\n"), 256).alias("hash"))


def _range(hi: Column, lo: Column) -> tuple[Column, Column]:
    return hi, F.floor(lo / FANOUT).cast("long")


def _file(hi: Column, lo: Column) -> tuple[Column, Column]:
    return hi, F.lit(0).cast("long")


def _group(hi: Column, lo: Column) -> tuple[Column, Column]:
    return F.floor(hi / FANOUT).cast("long"), F.lit(0).cast("long")


def _root(hi: Column, lo: Column) -> tuple[Column, Column]:
    return F.lit(0).cast("long"), F.lit(0).cast("long")


def _up(level: DataFrame, to: Callable, scratch: Scratch) -> DataFrame:
    """The level above, each node over its children in order."""
    hi, lo = to(F.col("hi"), F.col("lo"))
    moved = level.select(hi.alias("hi_up"), lo.alias("lo_up"), "hi", "lo", "hash")
    return scratch.cut(_combine(moved, ["hi_up", "lo_up"], ["hi", "lo"]).select(F.col("hi_up").alias("hi"), F.col("lo_up").alias("lo"), "hash"), "level")


def trees(leaf_tables: list[DataFrame], scratch: Scratch) -> list[tuple[list[DataFrame], Callable]]:
    """Levels of several replicas, lowest first, each with the way to the level above.

    A node is (hi, lo, hash): the file or group of files, and the range within it.  All replicas
    get as many levels as the one with the largest file and the most files needs.
    """
    places = ["offset", "length", "copies"]
    lowest = [leaf.select(F.col("file_no").alias("hi"), F.floor(F.col("offset") / BASE).cast("long").alias("lo"), *places, "hash") for leaf in leaf_tables]
    tables = [scratch.cut(_combine(t, ["hi", "lo"], places), "range") for t in lowest]
    out = []
    last = max(t.agg(F.max("lo")).first()[0] or 0 for t in tables)
    while last >= FANOUT:
        out.append((tables, _range))
        tables = [_up(t, _range, scratch) for t in tables]
        last //= FANOUT
    out.append((tables, _file))
    tables = [_up(t, _file, scratch) for t in tables]
    while max(t.limit(FANOUT + 1).count() for t in tables) > FANOUT:
        out.append((tables, _group))
        tables = [_up(t, _group, scratch) for t in tables]
    out.append((tables, _root))
    out.append(([_up(t, _root, scratch) for t in tables], _root))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that are not alike in both, or in one only."""
    a, b = a.select("hi", "lo", F.col("hash").alias("ha")), b.select("hi", "lo", F.col("hash").alias("hb"))
    return a.join(b, ["hi", "lo"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("hi", "lo")


def _unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file_no, page_id, side, offset, hash, copies): records, by copies, of one side only."""
    r = right.select(F.col("file_no").alias("f"), F.col("page_id").alias("p"), F.col("hash").alias("h"), F.col("offset").alias("o"), F.col("copies").alias("c"))
    both = left.join(r, (F.col("file_no") == F.col("f")) & F.col("page_id").eqNullSafe(F.col("p")) & (F.col("hash") == F.col("h")), "full")
    more = F.coalesce("copies", F.lit(0)) - F.coalesce("c", F.lit(0))
    return both.where(more != 0).select(
        F.coalesce("file_no", "f").alias("file_no"), F.coalesce("page_id", "p").alias("page_id"), F.when(more > 0, "left").otherwise("right").alias("side"),
        F.when(more > 0, F.col("offset")).otherwise(F.col("o")).alias("offset"), F.coalesce("hash", "h").alias("hash"), F.abs(more).alias("copies"),
    )


def _paired(rows: DataFrame) -> DataFrame:
    """Unmatched records with an id: the n-th of the left and the n-th of the right of one page are
    one altered record; what is left over is missing or extra."""
    nth = F.row_number().over(W.partitionBy("file_no", "page_id", "side").orderBy("offset", "hash"))
    side = lambda name: F.first(F.when(F.col("side") == name, F.struct("offset", "hash", "copies")), ignorenulls=True).alias(name)
    pairs = rows.withColumn("nth", nth).groupBy("file_no", "page_id", "nth").agg(side("left"), side("right"))
    here, there = F.coalesce("left.copies", F.lit(0)), F.coalesce("right.copies", F.lit(0))
    case = lambda damage, copies: F.struct(F.lit(damage).alias("damage"), copies.cast("long").alias("copies"))
    cases = F.array(case("altered", F.least(here, there)), case("missing", here - F.least(here, there)), case("extra", there - F.least(here, there)))
    split = pairs.withColumn("case", F.explode(F.filter(cases, lambda x: x["copies"] > 0)))
    kind = F.col("case.damage")
    return split.select(
        "file_no", F.when(kind == "extra", F.col("right.offset")).otherwise(F.col("left.offset")).alias("offset"), "page_id", kind.alias("damage"), F.col("case.copies").alias("copies"),
        F.when(kind != "extra", F.col("left.hash")).alias("left_hash"), F.when(kind != "missing", F.col("right.hash")).alias("right_hash"),
    )


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """The damaged records of ``right`` against ``left`` (both: file_no, page_id, record).

    One row per damaged record: file_no, offset (in the left replica; of an extra record in the
    right), page_id, damage (altered, missing, extra), copies, left_hash, right_hash.  From the
    root down only children of differing nodes are compared.
    """
    scratch = Scratch(left.sparkSession, "fixity")
    leaf = [leaves(x, scratch) for x in (left, right)]
    levels = trees(leaf, scratch)
    wrong = scratch.cut(_differing(*levels[-1][0]), "wrong")
    for tables, to in reversed(levels[:-1]):
        bad = wrong.select(F.col("hi").alias("hi_up"), F.col("lo").alias("lo_up"))
        hi, lo = to(F.col("hi"), F.col("lo"))
        below = [t.withColumns({"hi_up": hi, "lo_up": lo}).join(bad, ["hi_up", "lo_up"], "left_semi") for t in tables]
        wrong = scratch.cut(_differing(*below), "wrong")
    bad = wrong.select(F.col("hi").alias("file_no"), F.col("lo").alias("range"))
    sides = [x.withColumn("range", F.floor(F.col("offset") / BASE).cast("long")).join(bad, ["file_no", "range"], "left_semi").drop("range") for x in leaf]
    rows = scratch.cut(_unmatched(*sides), "unmatched")
    on_left = F.col("side") == "left"
    nameless = rows.where("page_id is null").select(
        "file_no", "offset", "page_id", F.when(on_left, "missing").otherwise("extra").alias("damage"), F.col("copies").cast("long").alias("copies"),
        F.when(on_left, F.col("hash")).alias("left_hash"), F.when(~on_left, F.col("hash")).alias("right_hash"),
    )
    return _paired(rows.where("page_id is not null")).unionByName(nameless)
