"""Progressive content hashes as column expressions.  128-bit values are hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head_tail(content: Column, chunk: int) -> Column:
    """The first and last ``chunk`` units of a content, or all of it where they would meet."""
    size = F.length(content)
    ends = F.concat(F.substring(content, 1, chunk), F.substring(content, -chunk, chunk))
    return F.when(size <= 2 * chunk, content).otherwise(ends)


def partial_hash(content: Column, chunk: int) -> Column:
    """Hash of head and tail: equal contents agree, most others do not."""
    return F.md5(head_tail(content, chunk))


def full_hash(content: Column) -> Column:
    return F.md5(content)


def block_offsets(size: Column, chunk: int, blocks: int) -> Column:
    """Places of the sampled blocks: one block for a small content, else evenly spread."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.floor((size - chunk).cast("double") * i / (blocks - 1)).cast("long"))
    return F.when(size <= chunk * blocks, F.array(F.lit(0).cast("long"))).otherwise(spread)


def sampled(content: Column, chunk: int, blocks: int) -> Column:
    """The sampled blocks on end (all of a small content)."""
    size = F.length(content).cast("long")
    parts = F.transform(block_offsets(size, chunk, blocks), lambda o: F.substr(content, (o + 1).cast("int"), F.lit(chunk)))
    return F.when(size <= chunk * blocks, content).otherwise(F.array_join(parts, ""))


def sample_hash(content: Column, chunk: int, blocks: int) -> Column:
    """Hash of the size and the sampled blocks."""
    return F.md5(F.concat(F.length(content).cast("string"), F.lit(":"), sampled(content, chunk, blocks)))


def blocks_identical(a: Column, b: Column, chunk: int, blocks: int) -> Column:
    """Whether two contents agree in length and in every sampled block; null never agrees."""
    return F.coalesce((F.length(a) == F.length(b)) & (sampled(a, chunk, blocks) == sampled(b, chunk, blocks)), F.lit(False))


def ends_identical(a: Column, b: Column, chunk: int) -> Column:
    """Whether two contents agree in length, head and tail; null never agrees."""
    return F.coalesce((F.length(a) == F.length(b)) & (head_tail(a, chunk) == head_tail(b, chunk)), F.lit(False))


def still_identical(a: Column, b: Column, is_video: Column, chunk: int, blocks: int, whole: bool = False) -> Column:
    """The check before a duplicate is moved: whole contents if asked for, else a video's sampled
    blocks and the ends of other files."""
    if whole:
        return F.coalesce(a == b, F.lit(False))
    return F.when(is_video, blocks_identical(a, b, chunk, blocks)).otherwise(ends_identical(a, b, chunk))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit values differ."""
    return F.bit_count(a.bitwiseXOR(b))


def best_orientation(upright: Column, variants: Column) -> Column:
    """struct(distance, variant): the least distance of a hash to any of the variants, first wins."""
    return F.array_min(F.transform(variants, lambda v, i: F.struct(hamming(upright, v).alias("distance"), i.alias("variant"))))
