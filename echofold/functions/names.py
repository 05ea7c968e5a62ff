"""File names: copy and edit markers, normal form, similarity.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of copy and edit markers (Java syntax, Unicode classes).
PAREN_NUMBER = r"(?U)\s*\(\d{1,3}\)$"
DASH_COPY = r"(?iuU)\s*[-–]\s*(copia|copy|kopie|copie|kopia|cópia)(\s*\(\d{1,3}\))?$"
SPACE_COPY = r"(?iuU)[\s_]+(copy|copia|kopie)(\s*\d{1,3})?$"
PREFIX_COPY = r"(?iuU)^(copia\s+di|copy\s+of|kopie\s+von|copie\s+de)\s+"
NUMERIC_DUP = r"(?U)(?<=\d)[_-]\d{1,2}$"
EDIT_SUFFIX = r"(?iuU)[\s_\-(]*(edited|modificat[ao]|bearbeitet|modifi[ée]e?)\)?$"
OUTER_SPACE = r"(?U)^\s+|\s+$"
PASSES = 6


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_SPACE, "")


def _strip_once(c: Column) -> Column:
    for pattern in (PREFIX_COPY, DASH_COPY, SPACE_COPY, PAREN_NUMBER):
        c = F.regexp_replace(c, pattern, "")
    return _trim(c)


def normalise(base: Column) -> Column:
    """struct(normalized, has_copy, has_edit) of a base name.

    An edit suffix goes once, then copy markers pass after pass while something goes; a number
    after a digit goes for comparison only.  The result is never empty; null gives null.
    """
    def finish(trimmed: Column, plain: Column, bare: Column) -> Column:
        compared = F.regexp_replace(bare, NUMERIC_DUP, "")
        safe = F.when(F.length(bare) == 0, base).otherwise(bare)
        return F.struct(
            F.lower(F.when(F.length(compared) > 0, compared).otherwise(safe)).alias("normalized"),
            (bare != plain).alias("has_copy"),
            trimmed.rlike(EDIT_SUFFIX).alias("has_edit"),
        )

    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    stripped = lambda plain: F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), plain, lambda s, _: _strip_once(s))
    out = let(_trim(base), lambda t: let(F.regexp_replace(t, EDIT_SUFFIX, ""), lambda p: let(stripped(p), lambda b: finish(t, p, b))))
    return F.when(base.isNotNull(), out)


def similarity(a: Column, b: Column) -> Column:
    """1 less the relative edit distance: 1 when equal, 0 when one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def clean_folder(folder: Column) -> Column:
    """Folders compare by upper case and without a slash at the end."""
    return F.regexp_replace(F.upper(folder), r"[/\\]+$", "")


def same_folder(a: Column, b: Column) -> Column:
    return clean_folder(a) == clean_folder(b)


def is_under(path: Column, folder: Column) -> Column:
    """Whether a path is the folder or lies in it; a longer sibling name does not count."""
    p, f = clean_folder(path), clean_folder(folder)
    return (p == f) | F.startswith(p, F.concat(f, F.lit("/")))
