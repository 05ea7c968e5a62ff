"""Quality rules: a threshold table compiled into one native projection.

``THRESHOLDS`` lists (measure, least, most).  ``measures`` turns a text into all measures with
built-in functions only, ``compile_rules`` turns the table into one Boolean column, and ``apply``
puts both into a single projection: one scan, no shuffle, no user function.

Work per text is n log n in its words (window hashes are sorted to find equal ones); nothing
leaves the row.  Windows of five words are compared by a 64-bit hash within one text.

Defined results: null text has no words and counts as empty; a text without words has zero
ratios and fails the base rule; repeated rows get equal results; other columns pass through and a
column named like a measure is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import unused

WINDOW = 5
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in is that it was for on with as at by this from are be have not or an you "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de et un une que est dans pour qui sur par du au avec pas en il elle ne se ce "
    "el los las y en que un una por con no para su al lo como más pero del".split()
)

#: (measure, least, most); None leaves a side open.  A text is kept if every measure is inside.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 10, None),
    ("mean_word_length", 2.0, 16.0),
    ("symbol_ratio", None, 0.25),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.30),
    ("short_line_ratio", None, 0.90),
    ("upper_ratio", None, 0.50),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words lying in a run of ``width`` words that occurs twice or more, first one included."""
    def run(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(width)])

    def marked(h: Column) -> Column:
        runs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        twice = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        starts = _let(F.sort_array(runs), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return _let(starts, lambda p: _total(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))).cast("long"))))

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: run(w, i))
        # most texts repeat no run: a hash set tells, and only the others are sorted
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(marked(h)))

    return F.when(F.size(words) < width + 1, F.lit(0).cast("long")).otherwise(counted(words))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    plain = F.coalesce(text, F.lit(""))
    split_words = F.filter(F.split(plain, SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def all_of(w: Column, ls: Column) -> Column:
        n, chars = F.size(w).cast("long"), F.length(F.array_join(w, "")).cast("long")
        n_lines = F.size(ls).cast("long")
        n_symbols = F.regexp_count(plain, F.lit(f"[{SYMBOLS}]")).cast("long")
        stops = F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS, *[s.capitalize() for s in STOP_WORDS]))).cast("long")
        uppers = F.regexp_count(plain, F.lit("[A-Z]")).cast("long")
        shorts = F.size(F.filter(ls, lambda x: F.length(x) < 12)).cast("long")
        dups = (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), n_symbols.alias("n_symbols"), dups.alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"),
            n_lines.alias("n_lines"), ratio(chars, n).alias("mean_word_length"), ratio(n_symbols, n).alias("symbol_ratio"), ratio(stops, n).alias("stop_ratio"),
            ratio(dups, n_lines).alias("dup_line_ratio"), ratio(shorts, n_lines).alias("short_line_ratio"), ratio(uppers, chars).alias("upper_ratio"),
        )

    return _let(split_words, lambda w: _let(lines, lambda ls: all_of(w, ls)))


def base_failed() -> Column:
    """Under ten words, or over a fifth of the words in repeated runs."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def compile_rules(thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """The table as one Boolean column over the measures."""
    out = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            out = out & (F.col(name) >= F.lit(least))
        if most is not None:
            out = out & (F.col(name) <= F.lit(most))
    return out


def apply(docs: DataFrame, text_col: str = "text", thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """Every row with its measures, base_failed and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "mean_word_length", "symbol_ratio", "stop_ratio", "dup_line_ratio", "short_line_ratio", "upper_ratio"]
    rest = [c for c in docs.columns if c not in (*names, "base_failed", "kept")]
    (m,) = unused(docs.columns, "_m")
    measured = docs.select(*rest, measures(F.col(text_col)).alias(m)).select(*rest, *[F.col(m)[n].alias(n) for n in names])
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(thresholds))
