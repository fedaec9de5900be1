"""Time the headline jobs and print one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS``
the local cores. Samples are persisted once, as every iterative job would.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


from graticule.catalog import queries as catalog  # noqa: E402
from graticule.plans import evaluate as E  # noqa: E402
from graticule.plans import som_quality as Q  # noqa: E402
from graticule.plans.forest import predict_forest, train_forest  # noqa: E402
from graticule.plans.som import train_som  # noqa: E402
from graticule.plans.tree import train_trees  # noqa: E402
from graticule.session import build_session  # noqa: E402
from graticule.sources.tables import uniform_table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = build_session(
        "graticule-bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        # A file of one row group is read by one task; the samples are spread once below.
        spark__sql__execution__arrow__maxRecordsPerBatch=20000,
    )
    spark.sparkContext.setLogLevel("ERROR")
    cores = int(CPUS)
    raw = catalog.lines(spark, SF_DIR).repartition(cores).persist()
    scaled = catalog.scaled_lines(spark, SF_DIR).repartition(cores).persist()
    rows = raw.count()
    scaled.count()
    # Start the Python workers and compile the first plans outside the timings.
    train_som(scaled.limit(1000), 2, 2, 1, width=4)
    train_trees(raw.limit(1000), max_depth=2)
    train_trees(raw, max_depth=2)

    times: dict[str, float] = {}

    def timed(name, job):
        start = time.perf_counter()
        out = job()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def catalog_query(name):
        timed(name, lambda: run(getattr(catalog, name)(spark, SF_DIR)))

    som = timed("som_8x7_10_iterations", lambda: train_som(scaled, 8, 7, 10, width=4, sigma_0=4.0, tau=10.0, seed=1))
    timed("som_quality", lambda: Q.quality(scaled, som).collect())
    timed("tree_depth_4", lambda: train_trees(raw, max_depth=4))
    timed("tree_depth_8", lambda: train_trees(raw, max_depth=8))
    forest = timed("forest_12_trees_depth_4", lambda: train_forest(raw, catalog.LINE_KEY, 12, 0, max_depth=4))
    timed("forest_12_trees_depth_10", lambda: train_forest(raw, catalog.LINE_KEY, 12, 0, max_depth=10))
    timed("cross_validation_10_folds", lambda: E.cross_validate(raw, catalog.LINE_KEY, 10, 1, max_depth=4)[0].collect())
    timed("forest_accuracy", lambda: E.accuracy(predict_forest(raw, forest)).collect())
    faces = catalog.embedding_samples(spark, SF_DIR).repartition(cores).persist()
    timed("som_5x6_embeddings_10_iterations", lambda: train_som(faces, 5, 6, 10, width=64, sigma_0=3.0, tau=50.0, seed=2))
    # The published map size on as many uniform rows as one of its data points: 1 M x 18.
    uniform = uniform_table(spark, 1_000_000, 18, seed=1, partitions=cores).persist()
    uniform.count()
    timed("som_8x7_uniform_1m_18_10_iterations", lambda: train_som(uniform, 8, 7, 10, width=18, sigma_0=4.0, tau=10.0, seed=1))
    uniform.unpersist()
    for name in (
        "standard_scale", "attribute_profile", "prefix_sum_by_row", "stable_partition", "gather", "poisson_sample",
        "word_frequencies", "char_frequencies", "capital_runs", "incremental_som", "value_roc",
    ):
        catalog_query(name)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1], "rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
