"""Times the headline queries: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from meshweave.plans import catalog

QUERIES = ["degree_total", "closeness", "betweenness", "edge_betweenness", "page_rank", "eigenvector", "clustering", "clustering_directed", "assortativity", "modularity", "diameter", "components", "random_geometric", "flood_first_receptions"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalog.queries(), {}
    catalog.queries()["degree_total"](spark, folder).count()  # warm-up
    for name in QUERIES:
        start = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 2)
    print(json.dumps({"metric": "graph queries, wall time", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
