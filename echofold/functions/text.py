"""Report texts: sizes, labels, quoting, camera keys, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the kinds, English and Italian.
KIND_LABELS = {
    "ExactBytes": ("Byte-identical", "Identici al byte"),
    "IdenticalPixels": ("Same pixels", "Stessi pixel"),
    "Perceptual": ("Same picture", "Stessa immagine"),
    "Burst": ("Burst shots", "Scatti multipli"),
    "VideoSampled": ("Videos, quick check", "Video, verifica rapida"),
}

# Reasons as a whole, English and Italian.
REASONS = {
    "byte-identical": "identici al byte",
    "byte-identical, the name has a copy marker": 'copia identica (nome con "(1)"/"Copia")',
    "byte-identical, same name": "copia identica, stesso nome",
    "byte-identical, different name": "copia identica con nome diverso",
    "same pixels, only the metadata differ": "stessi pixel, cambiano solo i metadati",
    "same size and sampled blocks": "stesso peso e stessi byte nei blocchi campione",
    "linked through other members": "simile ad altre foto del gruppo, ma non direttamente a quella da tenere",
    "the sharpest shot": "lo scatto più nitido",
    "it is in the folder to keep": "si trova nella cartella da tenere",
    "higher resolution": "risoluzione più alta",
    "richer metadata (date, GPS...)": "metadati più completi (data, GPS...)",
    'original name, without "(1)" or "Copy"': 'nome originale, senza "(1)" o "Copia"',
    "the oldest copy": "la copia più vecchia",
    "shorter path": "percorso più breve",
    "chosen by you": "scelta da te",
}
# Parts of the reasons that a comma joins, as patterns, English and Italian.
REASON_PARTS = {
    r"perceptual hash at distance (\d+)/64": "hash percettivo a distanza $1/64",
    r"rotated or mirrored": "ruotata o specchiata",
    r"different proportions \(perhaps cropped\)": "proporzioni diverse (forse ritagliata)",
    r"dHash disagrees": "dHash discordante",
    r"the neural network sees differences \((\d+)% similar\)": "la rete neurale vede differenze (somiglianza $1%)",
    r"matching name": "nome compatibile",
    r"taken (\d+) s apart with the same camera": "scattate a $1 s di distanza con la stessa fotocamera",
    r"taken (\d+)\.(\d) s apart with the same camera": "scattate a $1,$2 s di distanza con la stessa fotocamera",
    r"(\d+)% neural similarity": "somiglianza neurale $1%",
    r"hash at distance (\d+)/64": "hash a distanza $1/64",
    r"one of the two is an edited version": "una delle due è una versione modificata",
}


def detect(locale: str | None) -> str:
    """The language of reports for a locale ("it_IT.UTF-8"): Italian for Italian ones, else English."""
    return "it" if locale and locale.replace("-", "_").split(".")[0].split("_")[0].lower() == "it" else "en"


def reason_in(reason: Column, language: str = "en") -> Column:
    """A reason in the language of a report.  Reasons are stored in English and put into Italian when
    shown, so groups found earlier follow the language too.  Null stays null, and what is none of
    the known texts stays as it is."""
    if language == "en":
        return reason

    def part(p: Column) -> Column:
        for english, italian in REASON_PARTS.items():
            p = F.regexp_replace(p, f"^{english}$", italian)
        return p

    whole = F.create_map(*[F.lit(t) for pair in REASONS.items() for t in pair])[reason]
    return F.when(reason.isNotNull(), F.coalesce(whole, F.concat_ws(", ", F.transform(F.split(reason, ", "), part))))


def format_bytes(n: Column) -> Column:
    """Bytes with a unit: two decimals of GB, one of MB, none of KB."""
    def shown(unit: int, digits: int, name: str) -> Column:
        return F.concat(F.format_string(f"%.{digits}f", F.round(n / float(unit), digits)), F.lit(f" {name}"))

    return F.when(n >= 1 << 30, shown(1 << 30, 2, "GB")).when(n >= 1 << 20, shown(1 << 20, 1, "MB")).when(n >= 1 << 10, shown(1 << 10, 0, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def kind_label(kind: Column, language: str = "en") -> Column:
    k, out = 0 if language == "en" else 1, kind
    for name, labels in KIND_LABELS.items():
        out = F.when(kind == name, labels[k]).otherwise(out)
    return out


def csv_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))


def camera_key(make: Column, model: Column) -> Column:
    """Make, a pipe, model, without outer pipes; empty when both are missing."""
    return F.regexp_replace(F.concat(F.coalesce(make, F.lit("")), F.lit("|"), F.coalesce(model, F.lit(""))), r"^\|+|\|+$", "")


def with_subseconds(taken: Column, subsec: Column) -> Column:
    """A capture time with its sub-second digits ('25' is 0.25 s)."""
    digits = F.regexp_extract(F.coalesce(subsec, F.lit("")), r"^\s*(\d+)\s*$", 1)
    us = F.when(digits != "", F.round(F.concat(F.lit("0."), digits).cast("double") * 1_000_000).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.timestamp_add("MICROSECOND", us, taken)


def quarantine_path(session_root: str, path: Column) -> Column:
    """Place of a moved file: the session folder, then the original path, its drive's letter as a
    folder."""
    return F.concat(F.lit(session_root.rstrip("/") + "/"), F.regexp_replace(F.replace(path, F.lit(":"), F.lit("")), r"^[/\\]+", ""))


def drive(path: Column) -> Column:
    """Upper-case drive of a path ("E:" or a network share), "/" otherwise."""
    found = F.upper(F.regexp_extract(path, r"^([A-Za-z]:|\\\\[^\\]+\\[^\\]+)", 1))
    return F.when(found == "", "/").otherwise(found)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)
