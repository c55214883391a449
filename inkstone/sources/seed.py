"""Fill an archive with generated records: python -m inkstone.sources.seed --dir PATH [--count N] [--wipe] [--no-index]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from inkstone.engine import Engine
from inkstone.schema import KINDS
from inkstone.session import local_session
from inkstone.sources.files import Folder
from inkstone.sources.generators import seeded_archive

#: Searches whose hits and times are shown after an index is built.
PROBES = ("虫蛀孔", "TP-清", "地方碑刻", "撕裂", "2025年")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    out = argparse.ArgumentParser(description=__doc__)
    out.add_argument("--count", type=int, default=100_000, help="records of all kinds")
    out.add_argument("--wipe", action="store_true", help="remove what stands there first")
    out.add_argument("--dir", default="data-perf", help="the archive's folder")
    out.add_argument("--no-index", action="store_true", help="leave the index to the first start")
    return out.parse_args(argv)


def seed(spark: SparkSession, args: argparse.Namespace) -> dict:
    """What was made: records, seq, docs indexed, and (hits, ms) of each probe."""
    if args.wipe:
        Folder(spark, args.dir).remove("")
    with Engine(spark, args.dir) as engine:
        tables = dict(zip(KINDS, seeded_archive(spark, args.count), strict=True))
        out: dict = {"seq": engine.log.load(tables), "docs": 0, "probes": {}}
        if not args.no_index:
            engine.rebuild()
            out["docs"] = engine.status()["docs"]
            for q in PROBES:
                page = engine.search_paged({"q": q})
                out["probes"][q] = page["total"], page["tookMs"]
                engine.end_session(page["page"]["sessionId"])
        return out


def main(argv: list[str] | None = None) -> None:
    print(seed(local_session(app="seed"), arguments(argv)))


if __name__ == "__main__":
    main()
