"""Command line: ``python -m echofold <folders> [options]``, a scan with its report and plan."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from . import options as K
from .functions.text import detect
from .options import Options
from .sources import report_files

# Names of the modes and ways of disposal, English and Italian.
MODES = {
    "ReadOnly": ("read-only", "readonly", "sola-lettura", "lettura"), "Assisted": ("assisted", "assistita"),
    "SemiAutomatic": ("semi-auto", "semi-automatic", "semiautomatica", "semi-automatica"), "Automatic": ("auto", "automatic", "automatica"),
}
DISPOSALS = {"Quarantine": ("quarantine", "quarantena"), "RecycleBin": ("recycle-bin", "recyclebin", "bin", "cestino")}


@dataclass(frozen=True)
class Request:
    """A parsed command line."""

    roots: tuple[str, ...]
    options: Options
    report: str | None
    cache: str | None
    answers: str | None
    fixed_drives: tuple[str, ...]
    language: str


def number(least: float, most: float) -> Callable[[str], float]:
    """Reads a number with a point or a comma, within limits."""

    def read(text: str) -> float:
        try:
            value = float(text.strip().replace(",", "."))
        except ValueError:
            raise argparse.ArgumentTypeError(f"{text!r} is not a number") from None
        if not least <= value <= most:
            raise argparse.ArgumentTypeError(f"the value must be between {least:g} and {most:g}")
        return value

    return read


def _one_of(names: dict[str, tuple[str, ...]]) -> Callable[[str], str]:
    def read(text: str) -> str:
        for value, known in names.items():
            if text.lower() in known:
                return value
        raise argparse.ArgumentTypeError(f"unknown: {text}")

    return read


def parse(arguments: Sequence[str]) -> Request:
    """The request of a command line; a wrong one ends with a message."""
    p = argparse.ArgumentParser("echofold", allow_abbrev=False)
    folder = lambda text: str(Path(text).absolute())
    p.add_argument("roots", nargs="+", type=folder)
    p.add_argument("--mode", "--modo", type=_one_of(MODES), default="ReadOnly")
    p.add_argument("--threshold", "--soglia", type=number(K.AUTO_FLOOR, 100), default=Options.auto_threshold)
    p.add_argument("--action", "--azione", type=_one_of(DISPOSALS), default="Quarantine")
    p.add_argument("--quarantine", "--quarantena", type=folder, default=Options.quarantine)
    p.add_argument("--full-check", "--verifica-completa", action="store_true")
    p.add_argument("--report", type=folder)
    p.add_argument("--cache", type=folder)
    p.add_argument("--no-subfolders", "--no-sottocartelle", action="store_true")
    p.add_argument("--hidden", "--nascosti", action="store_true")
    p.add_argument("--burst", "--raffica", type=number(0.1, 3600), default=Options.burst_window_seconds)
    p.add_argument("--no-bursts", "--no-raffiche", action="store_true")
    p.add_argument("--videos", "--video", action="store_true")
    p.add_argument("--videos-quick", "--video-quick", "--video-rapido", action="store_true")
    p.add_argument("--keep", "--prefer", "--preferisci", type=folder, action="append", default=[])
    p.add_argument("--across-folders", "--solo-tra-cartelle", action="store_true")
    p.add_argument("--non-interactive", "--non-interattivo", action="store_true")
    p.add_argument("--answers", type=folder)
    p.add_argument("--fixed-drive", action="append", default=[])
    p.add_argument("--language", "--lingua", choices=tuple(report_files.HEADERS), default=detect(os.environ.get("LC_ALL") or os.environ.get("LC_MESSAGES") or os.environ.get("LANG")))
    a = p.parse_args(arguments)
    if a.across_folders and len(a.roots) < 2:
        p.error("--across-folders compares different folders: give at least two")
    if a.mode == "Assisted" and a.non_interactive:
        p.error("the assisted mode asks questions: leave --non-interactive out")
    if a.answers and a.non_interactive:
        p.error("answers are not read with --non-interactive")
    options = Options(
        recursive=not a.no_subfolders, include_hidden=a.hidden, include_videos=a.videos or a.videos_quick, quick_video_check=a.videos_quick, burst_window_seconds=a.burst, detect_bursts=not a.no_bursts,
        mode=a.mode, auto_threshold=a.threshold, disposal=a.action, verify_before_move=a.full_check, preferred_folders=tuple(a.keep), cross_folder_only=a.across_folders, quarantine=a.quarantine,
    )
    return Request(tuple(a.roots), options, a.report, a.cache, a.answers, tuple(a.fixed_drive), a.language)


def main(arguments: Sequence[str]) -> dict[str, int]:
    """Scans, writes the report (one CSV file, and a folder of pages) and the cache if asked for, decides what each duplicate's
    fate is, and prints the bytes of each kind and the number of each outcome.

    In all modes but the read-only one the plan goes to ``plan-<time>`` in the quarantine folder and
    its moves to ``journal`` beside it.  Files themselves stay where they are: moving them is left to
    whoever reads the plan.  Questions of the assisted modes have their answers in ``--answers``, a
    JSON file with group_id and choice; without an answer a group awaits its review.
    """
    from pyspark.sql import SparkSession

    from .functions import imaging
    from .operators import cache as cached
    from .operators import report
    from .operators.contents import ByPath
    from .plans import actions, engine
    from .runtime import Scratch
    from .sources import decoders, inventory, journal

    request = parse(arguments)
    spark = SparkSession.builder.appName("echofold").getOrCreate()
    files = Scratch(spark, "scan").cut(inventory.from_listing(spark, request.roots, request.options), "files")
    kinds = ", ".join(f"{c} {engine.FILE_COLUMNS[c]}" for c in ("path", "size", "mtime_ticks", *engine.CACHED))
    known = cached.load(spark, request.cache, kinds) if request.cache else None
    reader = ByPath(files, request.options)
    side = request.options.thumbnail_side
    small = lambda content: decoders.reduced(content, side)
    result = engine.run(files, lambda f: imaging.analyse(f, small, side), request.options, lambda f: imaging.pixel_hashes(f, decoders.decode), cache=known, reader=reader)
    if request.report:
        rows = report.report_rows(result.members, request.language)
        report_files.write_csv(rows, f"{request.report}-parts", request.language)
        report_files.join_parts(f"{request.report}-parts", f"{request.report}.csv")
        report_files.write_html(rows, report.kind_stats(result.groups), f"{request.report}-html", report_files.TITLES[request.language])
    if request.cache:
        cached.save(result.cache, request.cache)
    found = {r["kind"] or "total": int(r["bytes"] or 0) for r in report.kind_summary(result.groups).collect()}
    quarantine, stamp = request.options.quarantine, time.strftime("%Y%m%d-%H%M%S", time.gmtime())
    answers = spark.read.schema("group_id long, choice string").json(request.answers) if request.answers else None
    fresh = inventory.from_listing(spark, request.roots, request.options)
    plan = actions.decide(result.members, fresh, reader, request.options, f"{quarantine}/{stamp}", answers, _space(quarantine), request.fixed_drives)
    plan = Scratch(spark, "plan").cut(plan, "plan")
    if request.options.mode != "ReadOnly":
        plan.orderBy("position").write.json(f"{quarantine}/plan-{stamp}")
        journal.append(actions.entries(plan), f"{quarantine}/journal")
    found |= {r["outcome"]: r["count"] for r in plan.groupBy("outcome").count().collect()}
    print(json.dumps(found))
    return found


def _space(folder: str) -> tuple[int, int]:
    """Free and all bytes of the disk of a folder, or of the nearest one above it that exists."""
    place = Path(folder)
    while not place.exists() and place != place.parent:
        place = place.parent
    disk = shutil.disk_usage(place)
    return disk.free, disk.total
