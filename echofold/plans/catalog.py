"""Registered queries of the duplicate-resolution engine and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, imaging, names, text, vectors
from ..operators import blocking, cache, cluster, groups, keeper, links, policy, report, score, similarity
from ..options import Options
from ..runtime import Scratch, spread, table
from .inputs import BLOCKS, CHUNK, FILES_SQL, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with the SQL it must agree with."""
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


QUICK = Options(include_videos=True, partial_hash_bytes=CHUNK, video_sample_blocks=BLOCKS, quick_video_check=True)
FULL = Options(include_videos=True, partial_hash_bytes=CHUNK)
_PARTIAL = f"CASE WHEN size <= {2 * CHUNK} THEN md5(content) ELSE md5(left(content, {CHUNK}) || right(content, {CHUNK})) END"
_OFFSETS = f"CASE WHEN size <= {CHUNK * BLOCKS} THEN [0] ELSE [CAST(floor((size - {CHUNK})::DOUBLE * i / {BLOCKS - 1}) AS BIGINT) FOR i IN range({BLOCKS})] END"
_SAMPLED = f"CASE WHEN size <= {CHUNK * BLOCKS} THEN content ELSE array_to_string([substr(content, o + 1, {CHUNK}) FOR o IN {_OFFSETS}], '') END"
_KEYED = f"""{FILES_SQL}, keyed AS (SELECT *, {_PARTIAL} AS partial_hash, md5(content) AS full_hash FROM files WHERE size > 0)"""
_SETS = f"""{_KEYED}, sized AS (SELECT *, full_hash || ':' || size || ':' || is_video AS set_key, count(*) OVER (PARTITION BY size, is_video, full_hash) AS n FROM keyed),
    sets AS (SELECT * FROM sized WHERE n > 1)"""
_RANKED = f"""{_SETS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY set_key ORDER BY width::BIGINT * height DESC, richness DESC, has_copy, has_edit, last_write, length(path), upper(path), file_id) AS rank FROM sets)"""


def _once(df: DataFrame, name: str) -> DataFrame:
    """A frame that is read several times, evaluated once."""
    return Scratch(df.sparkSession, name).cut(df, name)


def _sets(spark: SparkSession, d: str, options: Options = FULL) -> DataFrame:
    return blocking.exact_sets(files(spark, d), options=options)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return _once(groups.exact_groups(_sets(spark, d).drop("content"), FULL), "ranked")


# --- exact sets -----------------------------------------------------------------------------


@query(f"WITH {FILES_SQL} SELECT size, is_video, count(*) AS files FROM files WHERE size > 0 GROUP BY ALL HAVING count(*) > 1")
def same_size_candidates(spark: SparkSession, d: str) -> DataFrame:
    near = blocking.with_peers(files(spark, d).where("size > 0").select("size", "is_video"), "size", "is_video")
    return near.groupBy("size", "is_video").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {_KEYED}, c AS (SELECT *, count(*) OVER (PARTITION BY size, is_video, partial_hash) AS n FROM keyed) SELECT file_id, partial_hash FROM c WHERE n > 1")
def partial_hash_survivors(spark: SparkSession, d: str) -> DataFrame:
    hashed = files(spark, d).where("size > 0").select("file_id", "size", "is_video", hashing.partial_hash(F.col("content"), CHUNK).alias("partial_hash"))
    return blocking.with_peers(_once(hashed, "partial"), "size", "is_video", "partial_hash").select("file_id", "partial_hash")


@query(f"WITH {_SETS} SELECT full_hash, is_video, count(*) AS copies, min(file_id) AS first_id, (count(*) - 1) * max(size) AS reclaimable_bytes FROM sets GROUP BY full_hash, is_video, size")
def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    out = _sets(spark, d).groupBy("full_hash", "is_video", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("file_id").alias("first_id"), ((F.count(F.lit(1)) - 1) * F.max("size")).alias("reclaimable_bytes"))
    return out.drop("size")


@query(f"WITH {_SETS} SELECT file_id, set_key FROM sets")
def exact_members(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d).select("file_id", "set_key")


@query(f"""WITH {_RANKED}, w AS (SELECT *, max(CASE WHEN rank > 1 THEN width::BIGINT * height END) OVER g AS mp, max(CASE WHEN rank > 1 THEN richness END) OVER g AS mr,
    bool_or(CASE WHEN rank > 1 THEN has_copy END) OVER g AS ac, min(CASE WHEN rank > 1 THEN last_write END) OVER g AS mw FROM ranked WINDOW g AS (PARTITION BY set_key))
    SELECT set_key, file_id AS keeper_id, path AS keeper_path, CASE WHEN width::BIGINT * height > mp THEN 'higher resolution' WHEN richness > mr THEN 'richer metadata (date, GPS...)'
    WHEN NOT has_copy AND ac THEN 'original name, without "(1)" or "Copy"' WHEN last_write <= mw THEN 'the oldest copy' ELSE 'shorter path' END AS keeper_reason FROM w WHERE rank = 1""")
def exact_keeper(spark: SparkSession, d: str) -> DataFrame:
    best = keeper.choose(_sets(spark, d).withColumnRenamed("set_key", "group_key")).where("rank = 1")
    return best.select(F.col("group_key").alias("set_key"), F.col("file_id").alias("keeper_id"), F.col("path").alias("keeper_path"), "keeper_reason")


@query(f"""WITH {_RANKED} SELECT m.file_id, k.file_id AS keeper_id, 'ExactBytes' AS kind, 100.0::DOUBLE AS confidence,
    CASE WHEN m.normalized <> k.normalized THEN 'byte-identical, different name' WHEN m.has_copy THEN 'byte-identical, the name has a copy marker' ELSE 'byte-identical, same name' END AS reason
    FROM ranked m JOIN ranked k ON m.set_key = k.set_key AND k.rank = 1 WHERE m.rank > 1""")
def exact_reason(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).where("rank > 1").select("file_id", "keeper_id", "kind", "confidence", "reason")


@query(f"""WITH {_SETS}, a AS (SELECT *, CASE WHEN file_id % 3 = 0 THEN 0 ELSE file_id % 2 + 1 END AS inode FROM sets),
    b AS (SELECT *, row_number() OVER (PARTITION BY set_key, CASE WHEN inode = 0 THEN 'r' || file_id ELSE 'i' || inode END ORDER BY file_id) AS nth FROM a) SELECT set_key, file_id, inode FROM b WHERE nth = 1""")
def alias_removal(spark: SparkSession, d: str) -> DataFrame:
    inode = F.when(F.col("file_id") % 3 == 0, 0).otherwise(F.col("file_id") % 2 + 1).cast("long")
    marked = _sets(spark, d).select("set_key", "file_id").withColumns({"device": F.lit(1).cast("long"), "inode": inode})
    return blocking.remove_aliases(marked).select("set_key", "file_id", "inode")


# --- names and folders ----------------------------------------------------------------------


@query(f"WITH {FILES_SQL} SELECT file_id, base, normalized, has_copy, has_edit FROM files")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file_id", "base", "normalized", "has_copy", "has_edit")


@query(f"WITH {FILES_SQL} SELECT ext, count(*) FILTER (has_copy) AS copies, count(*) FILTER (has_edit) AS edits FROM files GROUP BY ext")
def copy_edit_flags(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy("ext").agg(F.count_if("has_copy").alias("copies"), F.count_if("has_edit").alias("edits"))


@query(f"""WITH {_RANKED}, n AS (SELECT m.file_id, k.file_id AS keeper_id, m.base AS x, k.base AS y FROM ranked m JOIN ranked k ON k.set_key = m.set_key AND k.rank = 1 WHERE m.rank > 1)
    SELECT file_id, keeper_id, round(CASE WHEN x = y THEN 1.0 WHEN length(x) = 0 OR length(y) = 0 THEN 0.0 ELSE 1.0 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END, 6) AS similarity FROM n""")
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Names of exact duplicates against their keeper's."""
    own = _ranked(spark, d)
    keepers = own.where("rank = 1").select("group_key", F.col("base").alias("kept"))
    similar = F.round(names.similarity(F.col("base"), F.col("kept")), 6).alias("similarity")
    return own.where("rank > 1").join(keepers, "group_key").select("file_id", "keeper_id", similar)


@query(f"WITH {FILES_SQL} SELECT file_id, starts_with(upper(path), '/SRC1/') AS in_src1, starts_with(upper(path), '/SRC1/SUB/') AS in_sub, upper(root) = '/SRC1' AS is_src1 FROM files")
def path_containment(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return files(spark, d).select("file_id", names.is_under(p, F.lit("/src1")).alias("in_src1"), names.is_under(p, F.lit("/Src1/Sub/")).alias("in_sub"), names.same_folder(F.col("root"), F.lit("/SRC1/")).alias("is_src1"))


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN starts_with(path, '/src1/sub/') THEN '/src1/sub' WHEN starts_with(path, '/src1/') THEN '/src1' WHEN starts_with(path, '/src2/') THEN '/src2' END AS root FROM files")
def root_attribution(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.inventory import attribute_roots

    return attribute_roots(files(spark, d).select("file_id", "path"), ["/src1", "/src1/sub", "/src2"]).drop("path")


@query(f"WITH {FILES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY upper(path) ORDER BY file_id) AS n FROM files WHERE ext IN ('jpg', 'png', 'cr2') AND size > 0 AND NOT starts_with(path, '/src3/')) SELECT root, count(DISTINCT upper(path)) AS photos FROM w GROUP BY root")
def inventory_filter(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.inventory import wanted

    kept = wanted(files(spark, d).select("file_id", "path", "size", "root"), Options(quarantine="/src3"))
    return kept.groupBy("root").agg(F.count(F.lit(1)).alias("photos"))


# --- sampled checks -------------------------------------------------------------------------


@query(f"WITH {FILES_SQL} SELECT file_id, unnest({_OFFSETS}) AS block_offset FROM files WHERE is_video")
def sample_blocks(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where("is_video").select("file_id", F.explode(hashing.block_offsets(F.col("size"), CHUNK, BLOCKS)).alias("block_offset"))


@query(f"WITH {FILES_SQL}, s AS (SELECT file_id, size, md5(size || ':' || {_SAMPLED}) AS sample_hash FROM files WHERE is_video AND size > 0), c AS (SELECT *, count(*) OVER (PARTITION BY size, sample_hash) AS n FROM s) SELECT file_id, sample_hash FROM c WHERE n > 1")
def sample_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d, QUICK).where("is_video").select("file_id", "sample_hash")


@query(f"""WITH {FILES_SQL}, p AS (SELECT a.file_id AS a, b.file_id AS b, a.content AS x, b.content AS y FROM files a JOIN files b ON a.size = b.size AND a.file_id < b.file_id WHERE a.size > 0)
    SELECT a, b, left(x, {CHUNK}) = left(y, {CHUNK}) AND right(x, {CHUNK}) = right(y, {CHUNK}) AS ends_equal, x = y AS bytes_equal FROM p""")
def head_tail_check(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of one size, held against each other by the hashes of their ends and of all their bytes."""
    c = F.col("content")
    own = _once(files(spark, d).where("size > 0").select("file_id", "size", hashing.partial_hash(c, CHUNK).alias("ends"), hashing.full_hash(c).alias("bytes")), "hashed")
    a, b = own.toDF("a", "size", "x", "p"), own.toDF("b", "size", "y", "q")
    return a.join(b, "size").where("a < b").select("a", "b", (F.col("x") == F.col("y")).alias("ends_equal"), (F.col("p") == F.col("q")).alias("bytes_equal"))


@query(f"WITH {_SETS} SELECT set_key, bool_and(is_video) AS videos, bool_or(is_video) AND NOT bool_and(is_video) AS mixed, count(*) AS files FROM sets GROUP BY set_key")
def media_never_mixed(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("is_video")
    return _sets(spark, d).groupBy("set_key").agg(F.bool_and(v).alias("videos"), (F.bool_or(v) & ~F.bool_and(v)).alias("mixed"), F.count(F.lit(1)).alias("files"))


# --- features -------------------------------------------------------------------------------

_MEDIAN = "(list_sort({0})[32] + list_sort({0})[33]) / 2"


def _bits_sql(values: str) -> str:
    return f"CAST(list_sum([CASE WHEN {values}[i] > {_MEDIAN.format(values)} THEN CASE WHEN i = 64 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (i - 1)) END ELSE 0::HUGEINT END FOR i IN range(1, 65)]) AS BIGINT)"


@query(f"SELECT vec_id, {_bits_sql('v')} AS hash FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)")
def embedding_phash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.median_bits(F.transform("embedding", lambda x: x.cast("double"))).alias("hash"))


_TOKENS = """tokens AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\S+') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM tokens)),
    cells AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 6))::BIGINT % 1024 AS c, count(*) AS n FROM shingles GROUP BY ALL),
    basis AS (SELECT x, u, cos((2 * x + 1) * u * pi() / 64) AS b FROM range(32) tx(x), range(8) tu(u)),
    rowed AS (SELECT doc_id, c // 32 AS y, u, sum(n * b) AS s FROM cells JOIN basis ON basis.x = c % 32 GROUP BY ALL),
    coef AS (SELECT doc_id, u, basis.u_v AS v, round(sum(s * b), 6) AS c FROM rowed JOIN (SELECT x AS by, u AS u_v, b FROM basis) basis ON basis.by = y GROUP BY ALL),
    every AS (SELECT d.doc_id, o.o, u.u AS u, v.v AS v, coalesce(CASE WHEN o & 4 > 0 THEN t.c ELSE s.c END, 0.0) * CASE WHEN o & 1 > 0 AND u.u % 2 = 1 THEN -1 ELSE 1 END * CASE WHEN o & 2 > 0 AND v.v % 2 = 1 THEN -1 ELSE 1 END AS c
        FROM documents d CROSS JOIN range(8) o(o) CROSS JOIN range(8) u(u) CROSS JOIN range(8) v(v) LEFT JOIN coef s ON s.doc_id = d.doc_id AND s.u = u.u AND s.v = v.v LEFT JOIN coef t ON t.doc_id = d.doc_id AND t.u = v.v AND t.v = u.u),
    medians AS (SELECT doc_id, o, list(c ORDER BY c) AS l FROM every GROUP BY ALL),
    hashes AS (SELECT e.doc_id AS file_id, e.o AS variant, CAST(sum(CASE WHEN c > (l[32] + l[33]) / 2 THEN CASE WHEN v * 8 + u = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << CAST(v * 8 + u AS INTEGER)) END ELSE 0::HUGEINT END) AS BIGINT) AS hash
        FROM every e JOIN medians m ON e.doc_id = m.doc_id AND e.o = m.o GROUP BY ALL)"""
_PAIRS = """near AS (SELECT least(a.file_id, b.file_id) AS a, greatest(a.file_id, b.file_id) AS b, CAST(min(bit_count(xor(a.hash, b.hash))) AS INTEGER) AS distance
        FROM hashes a JOIN hashes b ON a.file_id <> b.file_id AND a.variant = 0 AND bit_count(xor(a.hash, b.hash)) <= 8 GROUP BY ALL)"""


@query(f"WITH {_TOKENS} SELECT file_id, hash FROM hashes WHERE variant = 0")
def document_phash(spark: SparkSession, d: str) -> DataFrame:
    return imaging.text_features(spread(table(spark, d, "documents"))).select(F.col("doc_id").alias("file_id"), F.get("phash", F.lit(0)).alias("hash"))


@query(f"WITH {_TOKENS} SELECT file_id, CAST(variant AS INTEGER) AS variant, hash FROM hashes")
def orientation_variants(spark: SparkSession, d: str) -> DataFrame:
    return imaging.text_features(spread(table(spark, d, "documents"))).select(F.col("doc_id").alias("file_id"), F.posexplode("phash").alias("variant", "hash"))


@query("""WITH g AS (SELECT vec_id, embedding AS e FROM embeddings) SELECT vec_id, CAST(list_sum([CASE WHEN e[y * 8 + x + 1] < e[y * 8 + x + 2] THEN (1::HUGEINT << (y * 7 + x)) ELSE 0::HUGEINT END FOR y IN range(8) FOR x IN range(7)]) AS BIGINT) AS hash FROM g""".replace("FOR y IN range(8) FOR x IN range(7)", "FOR p IN range(56)").replace("y * 8 + x + 1", "p // 7 * 8 + p % 7 + 1").replace("y * 8 + x + 2", "p // 7 * 8 + p % 7 + 2").replace("(y * 7 + x)", "CAST(p AS INTEGER)"))
def dhash_grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.gradient_bits(F.col("embedding"), 8, 8).alias("hash"))


_LAP = "[4 * e[c] - e[c - 1] - e[c + 1] - e[c - 8] - e[c + 8] FOR c IN [y * 8 + x + 1 FOR p IN range(36)]]".replace("y * 8 + x + 1", "(p // 6 + 1) * 8 + p % 6 + 2")


@query(f"SELECT vec_id, round(list_sum([x * x FOR x IN l]) / 36 - pow(list_sum(l) / 36, 2), 6) AS sharpness FROM (SELECT vec_id, {_LAP} AS l FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings))")
def laplacian_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.laplacian_variance(F.col("embedding"), 8, 8), 6).alias("sharpness"))


@query("SELECT vec_id, round(list_sum([x * x FOR x IN v]), 6) AS norm, round(v[1], 6) AS first FROM (SELECT vec_id, [x * 3 / sqrt(list_sum([y * y * 9 FOR y IN e])) FOR x IN e] AS v FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings))")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3))
    own = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return own.select("vec_id", F.round(vectors.total(F.transform("v", lambda x: x * x)), 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"))


@query("SELECT vec_id, CAST(p AS INTEGER) AS pixel, round(0.299 * e[3 * p + 1] + 0.587 * e[3 * p + 2] + 0.114 * e[3 * p + 3], 6) AS luma FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings), range(21) t(p)")
def luma_rec601(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as rows of pixels, three values each: 21 pixels, which leave the last of 64 values over."""
    at = lambda p, k: F.get("embedding", 3 * p + k).cast("double")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: vectors.luma(at(p, 0), at(p, 1), at(p, 2)))
    own = table(spark, d, "embeddings").select("vec_id", F.posexplode(pixels).alias("pixel", "luma"))
    return own.select("vec_id", "pixel", F.round("luma", 6).alias("luma"))


@query("SELECT vec_id, CAST(p AS INTEGER) AS cell, round((e[p // 4 * 16 + p % 4 * 2 + 1] + e[p // 4 * 16 + p % 4 * 2 + 2] + e[p // 4 * 16 + p % 4 * 2 + 9] + e[p // 4 * 16 + p % 4 * 2 + 10]) / 4, 6) AS mean FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings), range(16) t(p)")
def area_resize(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def resized(v: pd.Series) -> pd.Series:
        return v.map(lambda x: imaging.resize_area(np.asarray(x, float).reshape(8, 8), 4, 4).ravel().tolist())

    own = table(spark, d, "embeddings").select("vec_id", F.posexplode(resized(F.transform("embedding", lambda x: x.cast("double")))).alias("cell", "mean"))
    return own.select("vec_id", "cell", F.round("mean", 6).alias("mean"))


# --- candidates -----------------------------------------------------------------------------

_EHASH = f"e AS (SELECT vec_id AS id, {_bits_sql('v')} AS h FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings))"


def _ehash(spark: SparkSession, d: str) -> DataFrame:
    return embedding_phash(spark, d).select(F.col("vec_id").alias("file_id"), "hash")


@query(f"WITH {_EHASH} SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM e a JOIN e b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 20")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.hamming_pairs(_ehash(spark, d), 20)


@query("""WITH t AS (SELECT file_id, hash FROM (SELECT doc_id AS file_id, ('0x' || substr(md5(coalesce(text, '')), 2, 15))::BIGINT AS h0, doc_id FROM documents), LATERAL (SELECT xor(h0, 1::BIGINT << CAST(doc_id % 50 AS INTEGER)) AS hash))
    SELECT a.file_id AS a, b.file_id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM t a JOIN t b ON a.file_id < b.file_id AND bit_count(xor(a.hash, b.hash)) <= 8""")
def hamming_pairs_banded(spark: SparkSession, d: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 2, 15), 16, 10).cast("long")
    own = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), h.bitwiseXOR(F.expr("shiftleft(1L, cast(doc_id % 50 as int))")).alias("hash"))
    return similarity.hamming_pairs(own, 8, options=Options(brute_force_hashes=0))


def _text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _once(imaging.text_features(spread(table(spark, d, "documents"))).select(F.col("doc_id").alias("file_id"), "phash", F.get("phash", F.lit(0)).alias("hash")), "hashes")


@query(f"WITH {_TOKENS}, {_PAIRS} SELECT a, b, distance FROM near")
def oriented_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.hamming_pairs(_text_hashes(spark, d), 8, variants_col="phash")


@query(f"WITH {_TOKENS}, {_PAIRS}, r AS (SELECT p.a, p.b, g.variant, CAST(bit_count(xor(h.hash, g.hash)) AS INTEGER) AS distance FROM near p JOIN hashes h ON h.file_id = p.a AND h.variant = 0 JOIN hashes g ON g.file_id = p.b) SELECT a, b, min(distance) AS distance, CAST(arg_min(variant, distance * 8 + variant) AS INTEGER) AS variant FROM r GROUP BY ALL")
def best_orientation(spark: SparkSession, d: str) -> DataFrame:
    """The orientation in which the pairs of ``oriented_pairs`` agree best, first to second."""
    own = _text_hashes(spark, d)
    pairs = similarity.hamming_pairs(own, 8, variants_col="phash").select("a", "b")
    a, b = own.select(F.col("file_id").alias("a"), "hash"), own.select(F.col("file_id").alias("b"), "phash")
    best = hashing.best_orientation(F.col("hash"), F.col("phash"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", best.alias("m")).select("a", "b", "m.distance", "m.variant")


def _captures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("file_id"), F.col("ts").alias("taken_at"), F.col("user_id").alias("camera_key"))


@query("SELECT least(a.event_id, b.event_id) AS a, greatest(a.event_id, b.event_id) AS b, CAST(epoch_us(b.ts) - epoch_us(a.ts) AS BIGINT) AS delta_us FROM events a JOIN events b ON a.user_id = b.user_id AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND epoch_us(b.ts) - epoch_us(a.ts) <= 600000000")
def burst_pairs(spark: SparkSession, d: str) -> DataFrame:
    return blocking.burst_pairs(_captures(spark, d), 600)


@query("WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) SELECT least(a.event_id, b.event_id) AS a, greatest(a.event_id, b.event_id) AS b, CAST(epoch_us(b.ts) - epoch_us(a.ts) AS BIGINT) AS delta_us FROM n a JOIN n b ON a.user_id = b.user_id AND b.n > a.n AND b.n - a.n <= 5 AND epoch_us(b.ts) - epoch_us(a.ts) <= 1800000000")
def burst_pairs_capped(spark: SparkSession, d: str) -> DataFrame:
    return blocking.burst_pairs_capped(_captures(spark, d), 1800, 5)


_SHOTS = """shots AS (SELECT file_id, taken_at, camera_key, row_number() OVER (ORDER BY taken_at, file_id) AS n FROM files WHERE taken_at IS NOT NULL),
    bursts AS (SELECT least(a.file_id, b.file_id) AS a, greatest(a.file_id, b.file_id) AS b FROM shots a JOIN shots b ON b.n > a.n AND b.n - a.n <= 60 AND a.camera_key = b.camera_key AND epoch_us(b.taken_at) - epoch_us(a.taken_at) <= 10000000)"""


def _candidates(spark: SparkSession, d: str, hashes: DataFrame | None = None) -> DataFrame:
    near = similarity.hamming_pairs(_text_hashes(spark, d) if hashes is None else hashes, 8, variants_col="phash")
    return blocking.union_pairs(near, blocking.burst_pairs_capped(files(spark, d), 10.0))


@query(f"WITH {FILES_SQL}, {_TOKENS}, {_PAIRS}, {_SHOTS} SELECT a, b FROM near UNION SELECT a, b FROM bursts")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)


@query(f"""WITH {FILES_SQL}, p AS (SELECT file_id, '/p/' || (file_id // 2) || '.' || ext AS path, ext = 'cr2' AS raw FROM files)
    SELECT a.file_id AS a, b.file_id AS b, a.raw <> b.raw AS excluded FROM p a JOIN p b ON b.file_id = a.file_id + 1 AND a.file_id % 2 = 0""")
def raw_jpeg_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Files of one folder and base name (made-up paths), and whether the pair is RAW and not."""
    path = F.concat(F.lit("/p/"), F.floor(F.col("file_id") / 2).cast("string"), F.lit("."), "ext")
    own = files(spark, d).select("file_id", path.alias("path")).withColumns({"folder": F.upper(names.directory(F.col("path"))), "base": F.upper(names.base_name(F.col("path")))})
    a, b = (own.select("folder", "base", F.col("file_id").alias(x), F.struct("path").alias(f"f{x}")) for x in "ab")
    return a.join(b, ["folder", "base"]).where("a < b").select("a", "b", score.raw_sibling(F.col("fa"), F.col("fb")).alias("excluded"))


@query(f"WITH {_EHASH} SELECT a.id AS a, b.id AS b, round(list_sum([x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE FOR i IN range(1, 65)]), 5) AS cosine FROM e a JOIN e b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 20 JOIN embeddings x ON x.vec_id = a.id JOIN embeddings y ON y.vec_id = b.id")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the pairs of ``hamming_pairs``."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"), "embedding")
    return similarity.cosine_pairs(_ehash(spark, d), own, 20).select("a", "b", F.round("cosine", 5).alias("cosine"))


_HAV = "CASE WHEN a.latitude IS NOT NULL AND b.latitude IS NOT NULL THEN 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) END"


@query(f"WITH {FILES_SQL}, {_SHOTS} SELECT p.a, p.b, round({_HAV}, 3) AS metres FROM bursts p JOIN files a ON a.file_id = p.a JOIN files b ON b.file_id = p.b")
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How far apart the captures of a burst's pairs are."""
    own = files(spark, d).select("file_id", "latitude", "longitude")
    pairs = blocking.burst_pairs_capped(files(spark, d), 10.0).select("a", "b")
    met = pairs.join(own.toDF("a", "la", "lo"), "a").join(own.toDF("b", "lb", "lp"), "b")
    return met.select("a", "b", F.round(vectors.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), 3).alias("metres"))


# --- scores and groups ----------------------------------------------------------------------


def _analysed(spark: SparkSession, d: str, hashes: DataFrame) -> DataFrame:
    """Files with document hashes; no whole hash, so every visual rule is reached."""
    from .engine import complete

    return complete(files(spark, d).join(hashes.select("file_id", "phash"), "file_id").where("not is_video"))


def _scorer_sql(pairs: str, out: str) -> str:
    """CTEs that score the pairs (a, b) of the CTE ``pairs``: ``{out}_rated`` has both matches' surer one,
    ``out`` what is left of it after the cap for edited files."""
    metres = _HAV.replace("a.l", "x.l").replace("b.l", "y.l")
    return f"""{out}_both AS MATERIALIZED (SELECT p.a, p.b, x.width AS wa, x.height AS ha, y.width AS wb, y.height AS hb, x.normalized = y.normalized AS named, x.has_edit OR y.has_edit AS edited,
        abs(epoch_us(x.taken_at) - epoch_us(y.taken_at)) AS dus, x.camera_key = y.camera_key AS same_cam, x.ext AS ea, y.ext AS eb, x.path AS pa, y.path AS pb, {metres} AS metres
        FROM {pairs} p JOIN files x ON x.file_id = p.a JOIN files y ON y.file_id = p.b WHERE NOT x.is_video AND NOT y.is_video),
    {out}_dist AS MATERIALIZED (SELECT p.a, p.b, min(bit_count(xor(h.hash, g.hash))) AS d, arg_min(g.variant, bit_count(xor(h.hash, g.hash))::BIGINT * 8 + g.variant) AS v
        FROM {pairs} p JOIN hashes h ON h.file_id = p.a AND h.variant = 0 JOIN hashes g ON g.file_id = p.b GROUP BY ALL),
    {out}_ratio AS (SELECT f.*, d.d, d.v, wa / ha::DOUBLE AS ra, CASE WHEN d.v >= 4 THEN hb / wb::DOUBLE ELSE wb / hb::DOUBLE END AS rb FROM {out}_both f JOIN {out}_dist d ON f.a = d.a AND f.b = d.b
        WHERE NOT ((ea = 'cr2') <> (eb = 'cr2') AND regexp_replace(pa, '\\.[^.]*$', '') = regexp_replace(pb, '\\.[^.]*$', ''))),
    {out}_ruled AS (SELECT *, CASE WHEN d <= 8 AND NOT coalesce(dus > 50000, false) THEN greatest(50.0, least(98.0, 98.0 - d - (v <> 0)::INT - 10 * (abs(ra - rb) / greatest(ra, rb) > 0.02)::INT + named::INT)) END AS p,
        CASE WHEN same_cam AND dus <= 10000000 AND NOT coalesce(metres > 200, false) AND d <= 22 THEN 60 + 22 * greatest(0.0, least(1.0, 1 - d / 22.0::DOUBLE)) + 7 * (1 - dus / 10000000.0::DOUBLE) END AS s FROM {out}_ratio),
    {out}_rated AS (SELECT a, b, edited, CASE WHEN s IS NOT NULL AND (p IS NULL OR s > p) THEN 'Burst' WHEN p IS NOT NULL THEN 'Perceptual' END AS kind, CASE WHEN s IS NOT NULL AND (p IS NULL OR s > p) THEN least(s, 89.0) ELSE p END AS c FROM {out}_ruled),
    {out} AS MATERIALIZED (SELECT a, b, kind, CASE WHEN edited AND c > 80 THEN 80.0 ELSE c END::DOUBLE AS confidence FROM {out}_rated WHERE kind IS NOT NULL)"""


_SCORED = f"{FILES_SQL}, {_TOKENS}, {_PAIRS}, {_SHOTS}, cand AS MATERIALIZED (SELECT a, b FROM near UNION SELECT a, b FROM bursts), {_scorer_sql('cand', 'scored')}"


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hashes = _text_hashes(spark, d)
    own = _once(_analysed(spark, d, hashes), "analysed")
    return _once(groups.score_pairs(_candidates(spark, d, hashes), own), "scored"), own


@query(f"WITH {_SCORED} SELECT a, b, kind, round(confidence, 4) AS confidence FROM scored")
def score_full(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].select("a", "b", "kind", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_SCORED} SELECT a, b, round(confidence, 4) AS confidence FROM scored WHERE kind = 'Perceptual'")
def score_perceptual(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].where("kind = 'Perceptual'").select("a", "b", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_SCORED} SELECT a, b, round(confidence, 4) AS confidence FROM scored WHERE kind = 'Burst'")
def score_burst(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].where("kind = 'Burst'").select("a", "b", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_SCORED} SELECT s.a, s.b, s.kind FROM scored s JOIN scored_rated c ON c.a = s.a AND c.b = s.b WHERE c.edited AND c.c > 80")
def edited_cap(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].where(F.col("reason").endswith("one of the two is an edited version")).select("a", "b", "kind")


_COMPONENTS = """WITH RECURSIVE pairs AS (SELECT least(a.event_id, b.event_id) AS a, greatest(a.event_id, b.event_id) AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 1800000000),
    sym AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs), reach(node, root) AS (SELECT u, u FROM sym UNION SELECT s.v, r.root FROM reach r JOIN sym s ON s.u = r.node)
    SELECT node, min(root) AS root FROM reach GROUP BY node"""


@query(_COMPONENTS)
def components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the pairs of captures, by links between neighbours in time."""
    own = _captures(spark, d).select(F.col("camera_key").cast("string").alias("group"), F.col("file_id").alias("id"), text.micros(F.col("taken_at")).alias("us"), F.col("file_id").cast("string").alias("base"), F.lit(False).alias("raw"))
    return cluster.components(similarity.capture_links(own, 1_800_000_000))


@query(f"""WITH {_TOKENS}, c AS (SELECT list(hash ORDER BY variant) AS v, file_id FROM hashes GROUP BY file_id) SELECT min(file_id) AS node, v[1] AS hash, count(*) AS files FROM c GROUP BY v""")
def hash_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one hash and equal variants, which the similarity join compares once."""
    own = _text_hashes(spark, d).select(F.col("file_id").alias("id"), F.col("hash").alias("h"), F.col("phash").alias("v"))
    classes, _ = similarity.class_pairs(own, 8, True, Options(), Scratch(spark, "classes"))
    return classes.select("node", F.col("h").alias("hash"), F.col("n").alias("files"))


_SIM = f"""WITH RECURSIVE {_SCORED}, sym AS (SELECT a AS u, b AS v FROM scored UNION ALL SELECT b, a FROM scored), reach(node, root) AS (SELECT u, u FROM sym UNION SELECT s.v, r.root FROM reach r JOIN sym s ON s.u = r.node),
    comp AS (SELECT node, min(root) AS group_key FROM reach GROUP BY node), burst_of AS (SELECT group_key, bool_or(kind = 'Burst') AS is_burst FROM scored JOIN comp ON node = a GROUP BY ALL),
    ranked AS MATERIALIZED (SELECT c.group_key, f.*, is_burst, CASE WHEN is_burst THEN row_number() OVER (PARTITION BY c.group_key ORDER BY sharpness DESC, width::BIGINT * height DESC, richness DESC, upper(path), file_id)
        ELSE row_number() OVER (PARTITION BY c.group_key ORDER BY width::BIGINT * height DESC, richness DESC, has_copy, has_edit, last_write, length(path), upper(path), file_id) END AS rank FROM comp c JOIN files f ON f.file_id = c.node JOIN burst_of b ON b.group_key = c.group_key)"""


def _linked(spark: SparkSession, d: str, neighbours: int | None = 60) -> tuple[DataFrame, DataFrame]:
    """Links with the components and bursts of ``_scored``, without its pairs, and the files."""
    from .engine import complete

    own = _once(complete(files(spark, d).join(_text_hashes(spark, d).select("file_id", "phash"), "file_id", "left")), "analysed")
    return links.group_links(own, neighbours=neighbours), own.where("not is_video")


@query(f"{_SIM} SELECT group_key, file_id, is_burst, rank FROM ranked")
def similarity_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.ranked_components(*_linked(spark, d)).select("group_key", "file_id", "is_burst", F.col("rank").cast("long").alias("rank"))


@query(f"{_SIM} SELECT group_key, file_id AS keeper_id, sharpness FROM ranked WHERE rank = 1 AND is_burst")
def burst_keeper(spark: SparkSession, d: str) -> DataFrame:
    return groups.ranked_components(*_linked(spark, d)).where("rank = 1 and is_burst").select("group_key", F.col("file_id").alias("keeper_id"), "sharpness")


def _against_sql(rank: int) -> str:
    """The members' SQL with each scored against the member of that rank, the keeper first."""
    return f"""{_SIM}, kp AS MATERIALIZED (SELECT m.group_key, k.file_id AS a, m.file_id AS b FROM ranked m JOIN ranked k ON k.group_key = m.group_key AND k.rank = {rank} WHERE m.rank <> {rank}), {_scorer_sql("kp", "k_scored")}"""


_MEMBERS = _against_sql(1)


@query(f"{_MEMBERS} SELECT kp.b AS file_id, kp.a AS keeper_id, coalesce(k.kind, 'Burst') AS kind, round(coalesce(k.confidence, 50.0), 4) AS confidence FROM kp LEFT JOIN k_scored k ON k.a = kp.a AND k.b = kp.b")
def member_confidence(spark: SparkSession, d: str) -> DataFrame:
    return groups.similarity_groups(*_linked(spark, d)).where("rank > 1").select("file_id", "keeper_id", "kind", F.round("confidence", 4).alias("confidence"))


#: The members' SQL with all captures of a camera within ten seconds as candidates, however many lie between.
_EVERY_MEMBER = _MEMBERS.replace("b.n > a.n AND b.n - a.n <= 60 AND", "b.n > a.n AND")


@query(f"{_EVERY_MEMBER} SELECT kp.b AS file_id FROM kp LEFT JOIN k_scored k ON k.a = kp.a AND k.b = kp.b WHERE k.kind IS NULL")
def indirect_members(spark: SparkSession, d: str) -> DataFrame:
    return groups.similarity_groups(*_linked(spark, d, neighbours=None)).where("rank > 1 and reason = 'linked through other members'").select("file_id")


_GROUPS = f"""{_RANKED}, summed AS (SELECT set_key AS group_key, 'ExactBytes' AS kind, 100.0::DOUBLE AS confidence, CAST(sum(CASE WHEN rank > 1 THEN size ELSE 0 END) AS BIGINT) AS reclaimable_bytes, count(*) - 1 AS duplicates, max(CASE WHEN rank = 1 THEN path END) AS keeper_path, max(CASE WHEN rank = 1 THEN file_id END) AS keeper_id FROM ranked GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, reclaimable_bytes DESC, upper(keeper_path), keeper_id) AS group_id FROM summed)"""


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return groups.number(groups.summarise(_ranked(spark, d)))


@query(f"WITH {_GROUPS} SELECT group_id, kind, confidence, reclaimable_bytes, duplicates, keeper_path, keeper_id FROM numbered")
def group_rank(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("group_id", "kind", "confidence", "reclaimable_bytes", "duplicates", "keeper_path", "keeper_id")


@query(f"{_against_sql(2)} SELECT r.group_key, r.file_id, r.rank = 2 AS is_keeper, CASE WHEN r.rank <> 2 THEN coalesce(k.kind, 'Burst') END AS kind, round(CASE WHEN r.rank <> 2 THEN coalesce(k.confidence, 50.0) END, 4) AS confidence FROM ranked r LEFT JOIN kp ON kp.b = r.file_id LEFT JOIN k_scored k ON k.a = kp.a AND k.b = kp.b")
def change_keeper(spark: SparkSession, d: str) -> DataFrame:
    """The second member of each group as its keeper."""
    members = groups.ranked_components(*_linked(spark, d))
    changed = groups.change_keeper(members, members.where("rank = 2").select("group_key", "file_id"))
    return changed.select("group_key", "file_id", (F.col("rank") == 1).alias("is_keeper"), "kind", F.round("confidence", 4).alias("confidence"))


_CROSS = f"""{_SETS}, wide AS (SELECT set_key FROM sets GROUP BY set_key HAVING count(DISTINCT upper(root)) > 1),
    ranked AS (SELECT s.*, row_number() OVER (PARTITION BY set_key ORDER BY width::BIGINT * height DESC, richness DESC, has_copy, has_edit, last_write, length(path), upper(path), file_id) AS rank FROM sets s SEMI JOIN wide USING (set_key)),
    aside AS (SELECT *, rank > 1 AND upper(root) = max(CASE WHEN rank = 1 THEN upper(root) END) OVER (PARTITION BY set_key) AS aside FROM ranked)"""
CROSS = Options(include_videos=True, partial_hash_bytes=CHUNK, cross_folder_only=True)


@query(f"WITH {_CROSS} SELECT set_key AS group_key, file_id, rank FROM ranked")
def cross_folder_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.exact_groups(_sets(spark, d), CROSS).select("group_key", "file_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_CROSS} SELECT set_key AS group_key, file_id, aside FROM aside QUALIFY count(*) FILTER (rank > 1 AND NOT aside) OVER (PARTITION BY set_key) > 0")
def set_aside(spark: SparkSession, d: str) -> DataFrame:
    return groups.set_aside(groups.exact_groups(_sets(spark, d), CROSS)).select("group_key", "file_id", "aside")


# --- policy ---------------------------------------------------------------------------------


@query(f"WITH {_SCORED} SELECT a, b, kind = 'ExactBytes' AS semi, confidence >= 90 AND kind <> 'Burst' AS automatic FROM scored")
def automatic_rule(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("kind"), F.col("confidence")
    return _scored(spark, d)[0].select("a", "b", policy.is_automatic(k, c, Options(mode="SemiAutomatic")).alias("semi"), policy.is_automatic(k, c, Options(mode="Automatic", auto_threshold=10)).alias("automatic"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    own = _ranked(spark, d)
    ids = groups.number(groups.summarise(own)).select("group_key", "group_id", F.col("kind").alias("group_kind"))
    return _once(own.join(ids, "group_key"), "members")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    flags = {"unchanged": F.col("file_id") % 11 != 0, "keeper_unchanged": F.col("keeper_id") % 13 != 0, "same_file": F.col("file_id") % 17 == 0}
    members = _members(spark, d)
    journal = members.where("rank > 1 and file_id % 7 = 0").select("file_id")
    return policy.move_plan(members.withColumns(flags), Options(mode="SemiAutomatic"), journal)


_PLAN = f"""{_GROUPS}, dups AS (SELECT n.group_id, r.file_id, n.keeper_id, r.size, r.rank FROM ranked r JOIN numbered n ON n.group_key = r.set_key WHERE r.rank > 1), moved AS (SELECT file_id FROM dups WHERE file_id % 7 = 0),
    plan AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY rank, file_id) AS seq, file_id, size, CASE WHEN file_id IN (FROM moved) THEN 'AlreadyHandled' WHEN keeper_id IN (FROM moved) OR keeper_id % 13 = 0 THEN 'KeeperUnavailable'
        WHEN file_id % 11 = 0 THEN 'ChangedSinceScan' WHEN file_id % 17 = 0 THEN 'SameFile' ELSE 'Planned' END AS outcome FROM dups)"""


@query(f"WITH {_PLAN} SELECT group_id, seq, file_id, outcome FROM plan")
def move_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("group_id", "seq", "file_id", "outcome")


@query(f"WITH {_PLAN} SELECT count(*) FILTER (outcome = 'Planned') AS moved, CAST(coalesce(sum(size) FILTER (outcome = 'Planned'), 0) AS BIGINT) AS moved_bytes, count(*) FILTER (outcome = 'AwaitingReview') AS awaiting, count(*) FILTER (outcome NOT IN ('Planned', 'AwaitingReview')) AS blocked FROM plan")
def action_summary(spark: SparkSession, d: str) -> DataFrame:
    return policy.summary(_plan(spark, d))


@query(f"WITH {_PLAN}, run AS (SELECT *, CAST(sum(size) OVER (ORDER BY group_id, seq) AS BIGINT) AS used_after FROM plan WHERE outcome = 'Planned') SELECT group_id, seq, used_after, CASE WHEN 60000 - used_after < 400000 * 0.1 THEN 'QuarantineFull' ELSE 'Moved' END AS outcome FROM run")
def space_guard(spark: SparkSession, d: str) -> DataFrame:
    return policy.space_guard(_plan(spark, d), 60_000, 400_000).select("group_id", "seq", "used_after", "outcome")


_FOLD = f"""{_GROUPS}, d AS (SELECT n.group_id, r.file_id, n.keeper_id, r.size, row_number() OVER (ORDER BY n.group_id, r.rank, r.file_id) AS position,
        CASE WHEN n.group_id >= 7 OR n.group_id % 5 = 0 THEN 'Apply' WHEN n.group_id % 5 = 1 THEN 'Skip' ELSE 'Wait' END AS choice FROM ranked r JOIN numbered n ON n.group_key = r.set_key WHERE r.rank > 1),
    o AS (SELECT *, CASE WHEN choice = 'Skip' THEN 'Skipped' WHEN choice = 'Wait' THEN 'AwaitingReview' WHEN keeper_id % 13 = 0 THEN 'KeeperUnavailable' WHEN file_id % 11 = 0 THEN 'ChangedSinceScan'
        WHEN file_id % 17 = 0 THEN 'SameFile' WHEN file_id % 19 = 0 THEN 'ByteCheckFailed' ELSE 'Moved' END AS outcome FROM d),
    u AS (SELECT *, sum(CASE WHEN outcome = 'Moved' AND file_id % 2 = 0 THEN size ELSE 0 END) OVER (ORDER BY position) AS used FROM o),
    f AS (SELECT min(position) AS full_at FROM u WHERE outcome IN ('Moved', 'ByteCheckFailed') AND file_id % 2 = 0 AND 60000 - (used + CASE WHEN outcome = 'Moved' THEN 0 ELSE size END) < 40000)"""


@query(f"WITH {_FOLD} SELECT group_id, position, file_id, CASE WHEN position = full_at THEN 'QuarantineFull' WHEN position > full_at THEN 'AwaitingReview' ELSE outcome END AS outcome FROM u, f")
def action_fold(spark: SparkSession, d: str) -> DataFrame:
    """A run with answers: every fifth group is taken, the ones after those skipped, and from the
    seventh on all of its kind are taken, until the quarantine's disk is nearly full."""
    i, g = F.col("file_id"), F.col("group_id")
    members = _members(spark, d).withColumns({"unchanged": i % 11 != 0, "keeper_unchanged": F.col("keeper_id") % 13 != 0, "same_file": i % 17 == 0, "still_identical": i % 19 != 0, "cross_drive": i % 2 == 0})
    choice = F.when(g == 7, "ApplyToAllOfThisKind").when(g % 5 == 0, "Apply").when(g % 5 == 1, "Skip")
    decisions = members.select("group_id").distinct().withColumn("choice", choice).where("choice is not null")
    return policy.execute(members, Options(mode="Assisted"), decisions, (60_000, 400_000)).select("group_id", "position", "file_id", "outcome")


@query(f"""WITH {FILES_SQL}, p AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'C:' ELSE '' END || '/pics/' || (file_id // 3) || CASE WHEN file_id % 3 = 1 THEN '.JPG' WHEN file_id % 4 = 1 THEN '' ELSE '.jpg' END AS path FROM files),
    q AS (SELECT *, '/q/s1/' || ltrim(replace(path, ':', ''), '/') AS place FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY upper(place) ORDER BY file_id) AS nth FROM q)
    SELECT file_id, CASE WHEN nth = 1 THEN place ELSE regexp_extract(place, '^(.*?)(\\.[^./]*)?$', 1) || ' ~' || nth || regexp_extract(place, '^(.*?)(\\.[^./]*)?$', 2) END AS moved_to FROM n""")
def quarantine_places(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("file_id")
    drive, ending = F.when(i % 2 == 0, "C:").otherwise(""), F.when(i % 3 == 1, ".JPG").when(i % 4 == 1, "").otherwise(".jpg")
    moves = files(spark, d).select("file_id", F.concat(drive, F.lit("/pics/"), F.floor(i / 3).cast("string"), ending).alias("path"))
    return policy.destinations(moves, "/q/s1", "file_id").select("file_id", "moved_to")


@query("""SELECT doc_id AS file_id, TIMESTAMP '2024-05-01 10:00:00' + to_seconds(doc_id % 3600) + to_milliseconds(CASE WHEN doc_id % 2 = 0 THEN 250 ELSE 0 END) AS taken_at, CASE WHEN doc_id % 7 <> 0 THEN 'Maker' END AS make, 'Model ' || doc_id % 3 AS model,
    CASE WHEN doc_id % 4 <> 0 THEN (CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END) * (doc_id % 80 + 0.5::DOUBLE) END AS latitude, CASE WHEN doc_id % 4 <> 0 THEN -(doc_id % 170 + 0.25::DOUBLE) END AS longitude,
    CAST(4 + CASE WHEN doc_id % 4 <> 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS richness, CAST(doc_id % 8 + 1 AS INTEGER) AS orientation FROM documents WHERE doc_id % 6 <> 5
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, 0, 1 FROM documents WHERE doc_id % 6 = 5""")
def exif_fields(spark: SparkSession, d: str) -> DataFrame:
    """Headers written from the documents' ids, every sixth no picture at all, read again."""
    from ..sources import exif

    @F.pandas_udf("binary")
    def header(ids: pd.Series) -> pd.Series:
        def one(i: int) -> bytes:
            if i % 6 == 5:
                return b"\xff\xd8\xff\xe0\0\x04ab\xff\xda" if i % 2 else b"no picture"
            main = {exif.MODEL: f"Model {i % 3}", exif.ORIENTATION: i % 8 + 1} | ({exif.MAKE: "Maker"} if i % 7 else {})
            own = {exif.TAKEN: f"2024:05:01 10:{i % 3600 // 60:02d}:{i % 60:02d}"} | ({0xC000 + k: k for k in range(60)} if i % 5 == 0 else {}) | ({exif.SUBSECONDS: "25"} if i % 2 == 0 else {})
            gps = {exif.LATITUDE_REF: "S" if i % 3 == 0 else "N", exif.LATITUDE: [i % 80, 30, 0], exif.LONGITUDE_REF: "W", exif.LONGITUDE: [i % 170, 15, 0]} if i % 4 else {}
            return exif.write(main, own, gps, jpeg=i % 2 == 1)

        return ids.map(one)

    return exif.metadata(table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), header("doc_id").alias("content")))


@query(f"WITH {FILES_SQL} SELECT file_id, file_id % 10 <> 3 AND file_id % 9 <> 2 AND file_id % 8 <> 1 AS unchanged FROM files")
def changed_since_scan(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("path", F.lit("#"), F.col("file_id").cast("string"))
    scan = files(spark, d).select("file_id", key.alias("path"), "size", "last_write")
    fresh = scan.where("file_id % 10 <> 3").select(F.lower("path").alias("path"), F.when(F.col("file_id") % 9 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("file_id") % 8 == 1, F.expr("last_write + interval 1 second")).otherwise(F.col("last_write")).alias("last_write"))
    return policy.unchanged(scan, fresh).select("file_id", "unchanged")


@query(f"""WITH {FILES_SQL} SELECT file_id AS seq, CASE WHEN file_id % 11 = 0 THEN 'DeletedForGood' WHEN file_id % 11 = 1 OR file_id % 13 = 0 THEN 'InBin' WHEN file_id % 5 = 0 THEN 'Missing' WHEN file_id % 3 = 0 THEN 'Occupied' ELSE 'Restore' END AS outcome FROM files""")
def undo_plan(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("file_id")
    own = files(spark, d).select(i, F.concat("path", F.lit("#"), i.cast("string")).alias("path"))
    journal = own.select(i.alias("seq"), F.when(i % 11 == 0, "PermanentlyDeleted").when(i % 11 == 1, "RecycleBin").otherwise("Quarantine").alias("method"), F.col("path").alias("original_path"), F.when(i % 13 != 0, text.quarantine_path("/q/s1", F.col("path"))).alias("moved_to"))
    present = journal.where("seq % 5 <> 0 and moved_to is not null").select(F.col("moved_to").alias("path")).unionByName(journal.where("seq % 3 = 0").select(F.col("original_path").alias("path")))
    return policy.undo_plan(journal, present).select("seq", "outcome")


def _review(spark: SparkSession, d: str) -> DataFrame:
    rows = policy.review_rows(_ranked(spark, d), Options(mode="Assisted"))
    return rows.withColumn("status", F.when(F.col("file_id") % 5 == 0, "Moved").when(F.col("file_id") % 5 == 1, "Skipped").otherwise(F.col("status")))


_REVIEW = f"{_RANKED}, review AS (SELECT file_id, size, 'ExactBytes' AS kind, CASE file_id % 5 WHEN 0 THEN 'Moved' WHEN 1 THEN 'Skipped' ELSE 'Pending' END AS status FROM ranked WHERE rank > 1)"


@query(f"WITH {_REVIEW} SELECT 'Pending' AS which, file_id FROM review WHERE status = 'Pending' UNION ALL SELECT 'Exact', file_id FROM review UNION ALL SELECT 'Moved', file_id FROM review WHERE status = 'Moved'")
def review_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _review(spark, d).select("file_id", "kind", "status")
    parts = [policy.review_filter(rows, w).select(F.lit(w).alias("which"), "file_id") for w in ("Pending", "Exact", "Moved", "Burst")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_REVIEW} SELECT count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Moved') AS moved, count(*) FILTER (status = 'Skipped') AS skipped, CAST(coalesce(sum(size) FILTER (status = 'Moved'), 0) AS BIGINT) AS moved_bytes, CAST(coalesce(sum(size) FILTER (status = 'Pending'), 0) AS BIGINT) AS reclaimable_bytes FROM review")
def review_counters(spark: SparkSession, d: str) -> DataFrame:
    return policy.review_counters(_review(spark, d))


@query(f"""WITH {_REVIEW}, r AS (SELECT *, row_number() OVER (ORDER BY file_id) AS position, count(*) OVER () AS n FROM review), p AS (SELECT *, CASE WHEN status = 'Pending' THEN position END AS mark FROM r),
    q AS (SELECT *, min(mark) OVER (ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following, max(mark) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS preceding, min(mark) OVER () AS first_mark, max(mark) OVER () AS last_mark FROM p)
    SELECT file_id, position, coalesce(following, CASE WHEN first_mark < position THEN first_mark END) AS after_decision, coalesce(following, first_mark, position % n + 1) AS forward, coalesce(preceding, last_mark, (position + n - 2) % n + 1) AS back FROM q""")
def review_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Where a review of all duplicates goes from each row."""
    rows = policy.review_cursor(_review(spark, d), ["file_id"])
    return rows.select("file_id", "position", "after_decision", "forward", "back")


_PLACES = "p AS (SELECT doc_id AS file_id, CASE doc_id % 5 WHEN 0 THEN 'C:\\a\\' WHEN 1 THEN 'e:\\b\\' WHEN 2 THEN '\\\\nas\\share\\' WHEN 3 THEN '/home/' ELSE 'D:/x/' END || source AS path FROM documents)"


@query(f"""WITH {_PLACES}, d AS (SELECT *, upper(regexp_extract(path, '^([A-Za-z]:|\\\\\\\\[^\\\\]+\\\\[^\\\\]+)', 1)) AS found FROM p)
    SELECT file_id, CASE WHEN found = '' THEN '/' ELSE found END <> 'C:' AS crosses, found IN ('C:', 'E:') AS bin FROM d""")
def drive_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which moves to a quarantine on C: are copies between drives, and which files go to a recycle bin."""
    i = F.col("doc_id")
    folder = F.when(i % 5 == 0, "C:\\a\\").when(i % 5 == 1, "e:\\b\\").when(i % 5 == 2, "\\\\nas\\share\\").when(i % 5 == 3, "/home/").otherwise("D:/x/")
    own = table(spark, d, "documents").select(i.alias("file_id"), F.concat(folder, "source").alias("path"))
    return own.select("file_id", policy.crosses_drives(F.lit("C:\\quarantine"), F.col("path")).alias("crosses"), policy.has_bin(F.col("path"), ["C:", "e:", "/", "\\\\nas\\share"]).alias("bin"))


@query(f"WITH {_REVIEW} SELECT file_id, status = 'Pending' AS chosen FROM review")
def all_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return policy.all_of_kind(_review(spark, d), "ExactBytes").select("file_id", "chosen")


@query(f"WITH {_REVIEW} SELECT file_id, CASE WHEN status = 'Pending' AND file_id % 2 = 0 THEN 'Skipped' ELSE status END AS status FROM review")
def keep_both(spark: SparkSession, d: str) -> DataFrame:
    """Pending rows with an even id are skipped."""
    review = _review(spark, d).withColumn("group_id", F.lit(1).cast("long"))
    return policy.keep_both(review, review.where("file_id % 2 = 0")).select("file_id", "status")


@query(f"WITH {_REVIEW} SELECT count(*) FILTER (status = 'Pending') AS same_kind FROM review")
def same_kind(spark: SparkSession, d: str) -> DataFrame:
    return policy.same_kind_count(_review(spark, d), "ExactBytes")


_EDIT = "CASE file_id % 4 WHEN 1 THEN left(content, size - 1) || '~' WHEN 2 THEN left(content, size // 2) || '~' || substr(content, size // 2 + 2) WHEN 3 THEN content || '~' ELSE content END"
_SIDE = _SAMPLED.replace("content", "{0}").replace("size", "length({0})")


@query(f"""WITH {_RANKED}, fresh AS (SELECT file_id, {_EDIT} AS content FROM files),
    p AS (SELECT m.file_id, m.is_video, f.content AS x, k.content AS y FROM ranked m JOIN ranked g ON g.set_key = m.set_key AND g.rank = 1 JOIN fresh f ON f.file_id = m.file_id JOIN fresh k ON k.file_id = g.file_id WHERE m.rank > 1)
    SELECT file_id, length(x) = length(y) AND CASE WHEN is_video THEN {_SIDE.format('x')} = {_SIDE.format('y')} WHEN length(x) <= {2 * CHUNK} THEN x = y ELSE left(x, {CHUNK}) = left(y, {CHUNK}) AND right(x, {CHUNK}) = right(y, {CHUNK}) END AS quick, x = y AS whole FROM p""")
def recheck_members(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates whose contents were edited since the scan: at the end, in the middle, or made longer."""
    from dataclasses import replace

    c, n = F.col("content"), F.col("size").cast("int")
    half = F.floor(n / 2).cast("int")
    cut = lambda at, length: F.substr(c, at, length)
    edited = (
        F.when(F.col("file_id") % 4 == 1, F.concat(cut(F.lit(1), n - 1), F.lit("~")))
        .when(F.col("file_id") % 4 == 2, F.concat(cut(F.lit(1), half), F.lit("~"), cut(half + 2, n)))
        .when(F.col("file_id") % 4 == 3, F.concat(c, F.lit("~")))
        .otherwise(c)
    )
    fresh = _once(files(spark, d).select("file_id", edited.alias("content")), "fresh")
    members = _ranked(spark, d).where("rank > 1")
    options = replace(FULL, video_sample_blocks=BLOCKS)
    quick = policy.recheck(members, fresh, options).select("file_id", F.col("still_identical").alias("quick"))
    whole = policy.recheck(members, fresh, replace(options, verify_before_move=True)).select("file_id", F.col("still_identical").alias("whole"))
    return quick.join(whole, "file_id")


@query(f"WITH {_REVIEW} SELECT file_id, CASE status WHEN 'Pending' THEN 'ReportOnly' ELSE status END AS status FROM review")
def mode_switch(spark: SparkSession, d: str) -> DataFrame:
    return policy.switch_mode(_review(spark, d), read_only=True).select("file_id", "status")


@query(f"WITH {_REVIEW} SELECT file_id, CASE WHEN status = 'Moved' THEN 'Moved' ELSE 'Pending' END AS status FROM review WHERE file_id % 4 <> 0 OR status = 'Moved'")
def review_rebuild(spark: SparkSession, d: str) -> DataFrame:
    old = _review(spark, d).select("file_id", "kind", "status")
    new = old.where("file_id % 4 <> 0").withColumn("status", F.lit("Pending"))
    return policy.rebuild_review(old, new).select("file_id", "status")


# --- reports and cache ----------------------------------------------------------------------


@query(f"""WITH {_GROUPS} SELECT n.group_id AS "group", CASE WHEN r.rank = 1 THEN 'KEEP' ELSE 'duplicate' END AS role, 'Byte-identical' AS kind, CASE WHEN r.rank = 1 THEN '' ELSE '100' END AS confidence, r.path, r.size AS size_bytes, r.width, r.height,
    coalesce(strftime(r.taken_at, '%Y-%m-%d %H:%M:%S') || '.00', '') AS taken_at FROM ranked r JOIN numbered n ON n.group_key = r.set_key""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.report_rows(_members(spark, d)).select("group", "role", "kind", "confidence", "path", "size_bytes", "width", "height", "taken_at")


@query(f"""WITH {_RANKED}, w AS (SELECT *, max(CASE WHEN rank = 1 THEN normalized END) OVER g AS kn, max(CASE WHEN rank > 1 THEN width::BIGINT * height END) OVER g AS mp, max(CASE WHEN rank > 1 THEN richness END) OVER g AS mr,
    bool_or(CASE WHEN rank > 1 THEN has_copy END) OVER g AS ac, min(CASE WHEN rank > 1 THEN last_write END) OVER g AS mw FROM ranked WINDOW g AS (PARTITION BY set_key))
    SELECT path, CASE WHEN rank = 1 THEN 'TENERE' ELSE 'doppione' END AS role, 'Identici al byte' AS kind, CASE
    WHEN rank > 1 AND normalized <> kn THEN 'copia identica con nome diverso' WHEN rank > 1 AND has_copy THEN 'copia identica (nome con "(1)"/"Copia")' WHEN rank > 1 THEN 'copia identica, stesso nome'
    WHEN width::BIGINT * height > mp THEN 'risoluzione più alta' WHEN richness > mr THEN 'metadati più completi (data, GPS...)' WHEN NOT has_copy AND ac THEN 'nome originale, senza "(1)" o "Copia"'
    WHEN last_write <= mw THEN 'la copia più vecchia' ELSE 'percorso più breve' END AS reason FROM w""")
def report_rows_italian(spark: SparkSession, d: str) -> DataFrame:
    return report.report_rows(_members(spark, d), "it").select("path", "role", "kind", "reason")


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """Numbered groups with kinds varied by their keeper, to exercise every class."""
    return _numbered(spark, d).withColumn("kind", groups.kind_name(F.col("keeper_id") % 4))


_KINDS = f"{_GROUPS}, kinds AS (SELECT *, ['ExactBytes', 'IdenticalPixels', 'Perceptual', 'Burst'][keeper_id % 4 + 1] AS k FROM numbered)"


@query(f"WITH {_KINDS} SELECT k AS kind, count(*) AS groups, CAST(sum(reclaimable_bytes) AS BIGINT) AS bytes FROM kinds GROUP BY ROLLUP (k)")
def kind_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.kind_summary(_kinds(spark, d))


@query(f"WITH {_KINDS} SELECT CAST(o - 1 AS INTEGER) AS kind_ord, name AS kind, (SELECT count(*) FROM kinds WHERE k = name) AS groups FROM (SELECT o, ['ExactBytes', 'IdenticalPixels', 'Perceptual', 'Burst', 'VideoSampled'][o] AS name FROM range(1, 6) t(o))")
def kind_stats_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    return report.kind_stats(_kinds(spark, d))


@query(f"WITH {FILES_SQL} SELECT count(*) FILTER (NOT is_video) AS photos, count(*) FILTER (is_video) AS videos, count(*) FILTER (file_id % 9 = 4) AS unreadable, CAST(sum(size) FILTER (file_id % 3 <> 0) AS BIGINT) AS bytes_to_hash FROM files")
def media_counts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("file_id")
    return report.media_counts(files(spark, d).withColumns({"error": F.when(i % 9 == 4, "not readable"), "full_hash": F.when(i % 3 == 0, F.md5("content"))}))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) * (CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 64 ELSE 65536 END) AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', round(n / 1073741824.0::DOUBLE, 2)) WHEN n >= 1048576 THEN printf('%.1f MB', round(n / 1048576.0::DOUBLE, 1)) WHEN n >= 1024 THEN printf('%.0f KB', round(n / 1024.0::DOUBLE)) ELSE n || ' B' END AS shown FROM t""")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    size = F.floor("l_extendedprice").cast("long") * F.when(n == 0, 0).when(n == 1, 1).when(n == 2, 64).otherwise(65536)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.format_bytes(size).alias("shown"))


@query(f"WITH {_SCORED} SELECT CAST(floor(confidence / 10) * 10 AS BIGINT) AS band, kind, count(*) AS pairs FROM scored GROUP BY ALL")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].groupBy((F.floor(F.col("confidence") / 10) * 10).cast("long").alias("band"), "kind").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT event_id, trim(coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, '') || '|' || coalesce(CASE WHEN event_id % 4 <> 0 THEN user_id::VARCHAR END, ''), '|') AS camera FROM events")
def camera_keys(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", text.camera_key(F.when(i % 3 != 0, F.col("event_type")), F.when(i % 4 != 0, F.col("user_id").cast("string"))).alias("camera"))


def _cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = F.concat("path", F.lit("#"), F.col("file_id").cast("string"))
    own = files(spark, d).select("file_id", key.alias("path"), "size", (F.col("file_id") * 10).alias("mtime_ticks"), "content", "sharpness")
    entries = own.where("file_id % 3 <> 0").select(F.upper("path").alias("path"), "size", F.when(F.col("file_id") % 7 == 0, F.col("mtime_ticks") + 1).otherwise(F.col("mtime_ticks")).alias("mtime_ticks"), "sharpness")
    return own.drop("content", "sharpness"), entries


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN file_id % 3 <> 0 AND file_id % 7 <> 0 THEN sharpness END AS sharpness, file_id % 3 <> 0 AND file_id % 7 <> 0 AS cache_hit FROM files")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    own, entries = _cache(spark, d)
    return cache.apply(own, entries, ["sharpness"]).select("file_id", "sharpness", "cache_hit")


@query(f"WITH {FILES_SQL} SELECT file_id FROM files WHERE file_id % 3 = 0 OR file_id % 7 = 0")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return cache.misses(*_cache(spark, d)).select("file_id")


@query(f"WITH {FILES_SQL} SELECT upper(path || '#' || file_id) AS path FROM files WHERE file_id % 3 <> 0 AND NOT (starts_with(path, '/src1/') AND file_id % 4 = 1)")
def cache_prune(spark: SparkSession, d: str) -> DataFrame:
    own, entries = _cache(spark, d)
    return cache.prune(entries, ["/src1"], own.where("file_id % 4 <> 1")).select("path")


@query()
def ppm_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Generated pictures, five of each document id, through the whole engine."""
    from . import pictures

    return pictures.end_to_end(spark, d)
