"""Times the headline queries and the yardstick of the analysis operators (files and MB a second); prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession

from tessera.plans import catalog, corpus

HEADLINE = ("pricing_summary", "inner_join", "left_join", "semi_join", "anti_join", "asof_join", "overlaps", "cube", "distinct_aggregate", "percentile_within_group", "window_rank", "window_range_interval", "qualify", "cte_chain", "exists_subquery", "test_relationship", "test_unique")
#: Timed too, but not part of the sum, which stays that of the same queries in every round.
OTHERS = ("match_recognize", "merge_tables", "session_window", "window_distribution", "top_with_ties", "json_path", "lint_files", "lex_files", "syntax_trees", "lineage_origins")


def analysis_rates(spark: SparkSession, folder: str) -> dict[str, dict[str, float]]:
    """Files and MB a second of lexing, parsing, linting and fixing a corpus of one SQL file for each part."""
    from tessera.operators import analysis, lint

    files = corpus.files(spark, folder).repartition(spark.sparkContext.defaultParallelism).cache()
    n, size = files.count(), files.selectExpr("sum(octet_length(source)) AS n").collect()[0]["n"]
    out = {}
    for name, run in (("lex", lint.tokens), ("parse", analysis.trees), ("lint", lambda f: lint.violations(f, "core")), ("fix", lambda f: lint.fixed(f, "core"))):
        began = time.perf_counter()
        run(files).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        out[name] = {"sec": round(took, 3), "files_per_sec": round(n / took), "mb_per_sec": round(size / took / 1e6, 3)}
    files.unpersist()
    return out


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    queries[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # the session's own start doesn't count
    for name in (*HEADLINE, *OTHERS):
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    rates = analysis_rates(spark, folder)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took[x] for x in HEADLINE), 3), "unit": "sec", "queries": took, "rates": rates, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
