"""Times the headline queries, the lesser of two runs each; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tensorloom.queries import QUERIES

NAMES = ["coo_contract", "coo_contract_multi", "coo_block_prefix", "coo_block_tail", "block_block_prefix", "block_block_multi", "block_dense_tail", "coo_dense_aliased", "tensor_add", "fuse_axes", "canonical_sort", "norm_block", "chain_product"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["coo_contract"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
