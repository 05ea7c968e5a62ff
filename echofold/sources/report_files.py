"""Report files, written by the tasks that hold their rows: ``df.write.format("echofold_report")``.

Rows are dealt out by ranges of groups, and each task writes a part beside the others.  On commit the
parts get their names in the order of their groups; a CSV gets a first part with its header and
mark (parts in the order of their names are one file), an HTML report a page that lists its parts.
A run that fails leaves no part behind.  The folder must be one that driver and executors share.
"""

from __future__ import annotations

import html
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "echofold_report"
# Header of the CSV report, English and Italian.
HEADERS = {
    "en": "group;role;kind;confidence;reason;path;size_bytes;width;height;taken_at;sharpness",
    "it": "gruppo;ruolo;tipo;affidabilita;motivo;percorso;peso_byte;larghezza;altezza;data_scatto;nitidezza",
}
TITLES = {"en": "Duplicates", "it": "Doppioni"}
FIELDS = HEADERS["en"].split(";")
QUOTED = ("reason", "path")


def link(path: str) -> str:
    """The address of a local file, with all but plain characters encoded; a drive or share keeps
    its form."""
    plain = path.replace("\\", "/")
    if plain.startswith("//"):
        return "file:" + quote(plain, safe="/")
    return "file://" + ("" if plain.startswith("/") else "/") + quote(plain, safe="/:" if plain[1:2] == ":" else "/")


def csv_line(r: dict) -> str:
    """A row with semicolons, reason and path quoted."""
    return ";".join('"' + str(r[f] if r[f] is not None else "").replace('"', '""') + '"' if f in QUOTED else str(r[f] if r[f] is not None else "") for f in FIELDS) + "\n"


def html_row(r: dict) -> str:
    path = r["path"] or ""
    return f"<p>{html.escape(r['role'])} {html.escape(r['kind'] or '')} {r['confidence']} <a href='{html.escape(link(path), quote=True)}'>{html.escape(path)}</a> {html.escape(r['reason'] or '')}</p>\n"


def _page(title: str) -> str:
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>\n"


@dataclass
class Part(WriterCommitMessage):
    """A written part: its place, its first and last group, and its rows."""

    path: str
    first: tuple
    last: tuple
    rows: int


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.folder, self.kind = options["path"], options.get("kind", "csv")
        self.language, self.title, self.stats = options.get("language", "en"), options.get("title", "Duplicates"), options.get("stats", "")
        self.names, self.run = names, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part | None:
        place = Path(self.folder) / f".{self.run}-{uuid.uuid4().hex}"
        place.parent.mkdir(parents=True, exist_ok=True)
        count, first, last = 0, (), ()
        with place.open("w", encoding="utf-8", newline="") as out:
            if self.kind == "html":
                out.write(_page(self.title))
            for row in rows:
                r = dict(zip(self.names, row, strict=True))
                key = (r["group"], r["_rank"])
                if self.kind == "html" and (not count or r["group"] != last[0]):
                    out.write(f"<h2>{r['group']}</h2>\n")
                out.write(csv_line(r) if self.kind == "csv" else html_row(r))
                first, last, count = first or key, key, count + 1
        return Part(str(place), first, last, count)

    def commit(self, messages: list[Part | None]) -> None:
        folder, ending = Path(self.folder), self.kind
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        for m in messages:
            if m and not m.rows:
                os.unlink(m.path)
        for old in folder.glob(f"part-*.{ending}"):
            old.unlink()
        for k, m in enumerate(parts, 1):
            os.replace(m.path, folder / f"part-{k:05d}.{ending}")
        if ending == "csv":
            (folder / "part-00000.csv").write_text(HEADERS[self.language] + "\n", encoding="utf-8-sig")
        else:
            listed = "".join(f"<li><a href='part-{k:05d}.html'>{m.first[0]} – {m.last[0]}</a></li>\n" for k, m in enumerate(parts, 1))
            (folder / "index.html").write_text(f"{_page(self.title)}<p>{self.stats}</p>\n<ul>\n{listed}</ul>\n", encoding="utf-8")

    def abort(self, messages: list[Part | None]) -> None:
        for left in Path(self.folder).glob(f".{self.run}-*"):
            left.unlink(missing_ok=True)


class ReportSink(DataSource):
    """Parts of a report in a folder (``path``); options kind (csv or html), language, title, stats."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> ReportWriter:  # noqa: ANN001, FBT001  a type of pyspark
        return ReportWriter(dict(self.options), schema.fieldNames())


def _write(rows: DataFrame, path: str, parts: int | None, **options: str) -> None:
    rows.sparkSession.dataSource.register(ReportSink)
    by = ["group", "_rank"]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by, "path").write.format(NAME).mode("append").options(path=path, **options).save()


def write_csv(rows: DataFrame, path: str, language: str = "en", parts: int | None = None) -> None:
    """A folder of CSV parts: UTF-8 with a mark, semicolons, reason and path quoted."""
    _write(rows, path, parts, kind="csv", language=language)


def write_html(rows: DataFrame, stats: DataFrame, path: str, title: str = "Duplicates", parts: int | None = None) -> None:
    """A folder of HTML parts with a section per group, and an index page with a card per kind."""
    cards = " ".join(f"<b>{html.escape(s['kind'])}</b>: {s['groups']}" for s in stats.orderBy("kind_ord").collect())  # a row per kind
    _write(rows, path, parts, kind="html", title=title, stats=cards)


def join_parts(folder: str, path: str) -> None:
    """The parts of a CSV as one file, copied as bytes."""
    with Path(path).open("wb") as out:
        for part in sorted(Path(folder).glob("part-*.csv")):
            with part.open("rb") as one:
                shutil.copyfileobj(one, out)
