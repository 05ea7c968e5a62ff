"""Vectors, geography and grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; null where one is missing, empty or of another length."""
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, null if a coordinate is missing."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.when(h.isNotNull(), 2 * EARTH_METRES * F.asin(F.least(F.lit(1.0), F.sqrt(h))))  # least() skips nulls


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def median_bits(values: Column) -> Column:
    """64-bit value with bit i set where value i is above the median of the 64 values."""

    def bits(own: Column) -> Column:
        above = F.transform(own["v"], lambda v, i: F.when(v > own["median"], _bit(i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(above, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    # the sorted values and their median are bound once a row; named in the loop they would be found again for every value
    median = lambda s: (F.get(s, F.lit(31)) + F.get(s, F.lit(32))) / 2
    bound = F.transform(F.array(F.array_sort(values)), lambda s: F.struct(values.alias("v"), median(s).alias("median")))
    return F.element_at(F.transform(bound, bits), 1)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 brightness."""
    return r * 0.299 + g * 0.587 + b * 0.114


def laplacian_variance(grid: Column, width: int, height: int) -> Column:
    """Sharpness of a row-major grid: variance of the four-neighbour Laplacian inside it."""
    if width < 3 or height < 3:
        return F.lit(0.0)
    inside = F.array(*[F.lit(y * width + x) for y in range(1, height - 1) for x in range(1, width - 1)])
    at = lambda i: F.get(grid, i).cast("double")
    lap = F.transform(inside, lambda i: 4 * at(i) - at(i - 1) - at(i + 1) - at(i - width) - at(i + width))
    n = float((width - 2) * (height - 2))
    return total(F.transform(lap, lambda x: x * x)) / n - F.pow(total(lap) / n, 2)


def gradient_bits(grid: Column, width: int, height: int) -> Column:
    """Row-major bits: set where a cell is darker than its right neighbour (dHash)."""
    cells = F.array(*[F.lit(y * width + x) for y in range(height) for x in range(width - 1)])
    bits = F.transform(cells, lambda i, k: F.when(F.get(grid, i) < F.get(grid, i + 1), _bit(k)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
