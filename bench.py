"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from inkstone.operators.search import SearchIndex, SearchQuery
from inkstone.plans.docs import build_docs, field_dictionary
from inkstone.plans.queries import ALL
from inkstone.session import local_session
from inkstone.sources.generators import closed_form_archive, seeded_archive

ARCHIVE = {
    "search_free_text": (seeded_archive, {"q": "虫蛀孔"}),
    "search_latin_cjk": (seeded_archive, {"q": "TP-清"}),
    "search_one_typo": (seeded_archive, {"q": "蟲柱孔"}),
    "search_type": (closed_form_archive, {"type": "撕裂"}),
    "search_type_range": (closed_form_archive, {"type": "撕裂", "dateFrom": "2024-01-01", "dateTo": "2024-12-31"}),
    "search_everything": (seeded_archive, {}),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4)), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    index: dict = {}
    folder = tempfile.mkdtemp(prefix="bench-")
    for name, (make, params) in ARCHIVE.items():
        if make not in index:
            # Docs and dictionary are written once, as a rebuild does; queries read them from memory.
            at = f"{folder}/{make.__name__}"
            build_docs(*make(spark)).write.parquet(f"{at}/docs")
            docs = spark.read.parquet(f"{at}/docs").repartition(spark.sparkContext.defaultParallelism).cache()
            field_dictionary(docs).write.parquet(f"{at}/dictionary")
            docs.count()
            index[make] = SearchIndex(docs, spark.read.parquet(f"{at}/dictionary"))
        best = []
        for _ in range(5):
            began = time.time()
            index[make].page(SearchQuery.from_params(params), 20)  # rows with reasons, and the total
            best.append(time.time() - began)
        took[name] = round(min(best), 3)
    for name, (query, _) in ALL.items():
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
