"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the budget by weight; a share above ``max_epochs`` times the
source's size is clamped there and the excess is shared again by weight among the others until
none is above.  A source at e epochs takes each document floor(e) times and the documents below
a cut in a seeded order once more, so its taken words miss the target by half a document at most.

Words are counted in one pass and written as a slim table (id, source, size, order).  Sums over
(source, order cell) find the cell with the cut; only that cell, 1/``CELLS`` of a source, is
ordered row by row.  A source that holds a third of all rows is thus never gathered in one task.

Defined results: null text has size 0; null source is a source of its own, last in order; rows
with equal ids or repeated rows are documents of their own with the same place in the order,
ties ending by size; a source of size 0 takes its documents floor(max_epochs) times (0 words);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
CELLS = 4096
#: Most sources whose table is broadcast (about 60 bytes each); beyond it the join is shuffled.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_col: str, seed: str = SEED) -> Column:
    """The seeded order of documents: 48 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn.  With sources
    ordered by the level at which they clamp (cap / weight), the water level is the first where
    the rest, at that level, can hold what remains: the fixed point of clamping and resharing.
    The table has a row per source, so its windows run over sources, never over documents.
    """
    every = W.partitionBy()
    listed = F.array(*[F.lit(float(w)) for w in weights])
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    fit = W.orderBy("_level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return (
        sources.withColumn("weight", F.element_at(listed, (number % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("_level", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.lit(float(budget)) * F.sum("source_size").over(every))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(fit), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fit), F.lit(0.0)))
        # the level if this source and those after it are open, where this one does not clamp: the
        # first such source has the right level, and it is the highest
        .withColumn("_water", F.max(F.when(F.col("_level") * F.col("_open") >= F.col("_left"), F.col("_left") / F.col("_open"))).over(every))
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("weight"), F.col("_cap"))))
        .select("source", "source_size", "weight", "target")
    )


def _near(small: DataFrame, count: int) -> DataFrame:
    return F.broadcast(small) if count <= BROADCAST_SOURCES else small


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """Every row with doc_id, source, size, source_size, target, repeats and taken; ``carry``
    names further columns to keep (they are written along with the slim table)."""
    scratch = Scratch(docs.sparkSession, "mix")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), place(id_col, seed).alias("_place"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    slim = scratch.cut(slim, "sizes")
    cell = F.shiftright("_place", 36).alias("_cell")
    cells = scratch.cut(slim.groupBy("source", cell).agg(F.sum("size").alias("_words")), "cells")
    sources = water_fill(cells.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, budget, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(float(max_epochs)))
    sources = scratch.cut(
        sources.withColumn("_whole", F.floor(epochs).cast("long")).withColumn("_need", F.when(F.col("source_size") > 0, F.col("target") - F.floor(epochs) * F.col("source_size")).otherwise(F.lit(0.0))),
        "sources",
    )
    many = sources.count()
    # the cell where the running sum passes what a source still needs
    run = W.partitionBy("source").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    before = cells.withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0)))
    cut = (
        before.join(_near(sources, many), cells["source"].eqNullSafe(sources["source"]))
        .where("_before <= _need and _before + _words > _need")
        .select(cells["source"].alias("_s"), F.col("_cell").alias("_cut"), F.col("_before").alias("_cut_before"))
    )
    plan = scratch.cut(sources.join(cut, sources["source"].eqNullSafe(cut["_s"]), "left").drop("_s").withColumnRenamed("source", "_s"), "plan")
    rows = slim.join(_near(plan, many), slim["source"].eqNullSafe(plan["_s"])).drop("_s").withColumn("_cell", F.shiftright("_place", 36))
    inside = W.partitionBy("source", "_cell").orderBy("_place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    more = F.col("_cut_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2 <= F.col("_need")
    clear = rows.where("_cut is null or _cell <> _cut").withColumn("_more", F.col("_cell") < F.coalesce("_cut", F.lit(-1)))
    edge = rows.where("_cell = _cut").withColumn("_more", more)
    repeats = F.least(F.col("_whole") + F.col("_more").cast("long"), F.lit(int(max_epochs)).cast("long") if max_epochs == int(max_epochs) else F.lit(int(max_epochs) + 1).cast("long"))
    back = [F.col(f"_c_{c}").alias(c) for c in carry]
    return clear.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"), *back)


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    names = {c: f"_row_{k}" for k, c in enumerate(docs.columns)}
    whole = [F.col(c).alias(n) for c, n in names.items()]
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), *whole)
    taken = mix(given, carry=list(names.values()), **how).where("repeats > 0")
    copies = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return copies.select(*[F.col(n).alias(c) for c, n in names.items()])
