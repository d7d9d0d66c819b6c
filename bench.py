"""Headline queries, timed warm on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Every query runs once to warm up (dropped, like the first run of the reference protocol) and then
REPEATS times; the mean counts.  ``cells_per_sec`` is instances * samples * features / second of the
end-to-end explanations, so that runs with different sizes compare.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from localexplain.operators import report
from localexplain.operators.fit import SOLVERS
from localexplain.plans import explain as ex
from localexplain.plans import queries as q
from localexplain.sources import models

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("localexplain-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)) if CPUS.isdigit() else "16")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cases(spark):
    """name -> (plan, samples * features per instance, instances)"""
    lines, line_model, line_bg = q.lines(spark, SF_DIR)
    vecs, vec_model, vec_bg = q.embeddings(spark, SF_DIR)
    orders, order_model, order_bg = q.orders(spark, SF_DIR)
    n_lines, n_vecs, n_orders = lines.count(), vecs.count(), orders.count()

    # one point of the reference's own sweep: a single synthetic instance, D = 512, B = 131072
    grid_model, grid_bg, grid = models.synthetic_params(spark, 512)
    sweep = {d: models.synthetic_params(spark, d) for d in (128, 256)}

    def registered(name):
        return lambda: q.QUERIES[name](spark, SF_DIR)

    return {
        "top_features": (lambda: report.top_k(ex.explain(lines, line_model, line_bg, 64), 3), 64 * 4, n_lines),
        "score_means": (
            lambda: q.score.run_means(ex.scored_samples(orders, order_model, order_bg, 64)), 64 * 2, n_orders,
        ),
        "explain_lines_256": (lambda: ex.explain(lines, line_model, line_bg, 256), 256 * 4, n_lines),
        "explain_wide_1024": (lambda: ex.explain(vecs, vec_model, vec_bg, 1024), 1024 * 64, n_vecs),
        "explain_wide_ranges": (
            lambda: ex.explain(vecs, vec_model, vec_bg, 1024, chunk=256), 1024 * 64, n_vecs,
        ),
        "grid_point_scores": (
            lambda: q.score.run_means(ex.scored_samples(grid, grid_model, grid_bg, 131072, keep_vectors=False)),
            131072 * 512, 1,
        ),
        "grid_point_explain": (lambda: ex.explain(grid, grid_model, grid_bg, 131072), 131072 * 512, 1),
        **{
            f"grid_explain_{d}": (lambda p=p: ex.explain(p[2], p[0], p[1], 131072), 131072 * d, 1) for d, p in sweep.items()
        },
        # the stages one after the other: samples, then with scores, then with weights
        "stage_gen": (lambda: q.perturb.perturb(orders, order_bg, 64), 64 * 2, n_orders),
        "stage_infer": (
            lambda: q.score.score(q.perturb.perturb(orders, order_bg, 64), order_model), 64 * 2, n_orders,
        ),
        "stage_weights": (lambda: ex.scored_samples(orders, order_model, order_bg, 64), 64 * 2, n_orders),
        "three_solvers": (
            lambda: ex.explain(orders, order_model, order_bg, 32, solver=SOLVERS), 32 * 2, n_orders,
        ),
        "ablation_curve": (registered("ablation_curve"), 0, 0),
        "compare_seeds": (registered("compare_seeds"), 0, 0),
        "stratified_split": (registered("stratified_split"), 0, 0),
        "timing_means": (registered("timing_means"), 0, 0),
    }


def run(plan) -> float:
    start = time.perf_counter()
    plan().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    seconds, rates = {}, {}
    for name, (plan, cells, instances) in cases(spark).items():
        run(plan)
        mean = sum(run(plan) for _ in range(REPEATS)) / REPEATS
        seconds[name] = round(mean, 3)
        if cells:
            rates[name] = round(cells * instances / mean)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cells_per_sec": rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
