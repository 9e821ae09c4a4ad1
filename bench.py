"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores. Each
query's whole result is computed and dropped (the noop sink).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from bipath.registry.queries import QUERIES  # noqa: E402
from bipath.runtime import intermediates  # noqa: E402

HEADLINE = [
    "amount_interactions",
    "topk_per_drug",
    "rank_per_drug",
    "two_hop_paths",
    "symmetrize_ppi",
    "clean_ppi_text",
    "split_drug_ids",
    "degree_total",
    "degree_frequency",
    "network_summary",
    "graph_nodes",
    "ego_network_2hop",
    "dti_of_edges",
    "sql_complete_profile",
    "sql_amount_match",
    "pivot_amount",
    "mask_current_target",
    "feature_join",
    "assemble_features",
    "feedback_join",
    "index_entities",
    "xml_protein_sequences",
    "copy_edges",
    "rmse_eval",
    "als_recommend",
    "fm_fit_grid",
    "fm_rank_all",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "20g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The JVM, the shuffle and a Python worker are started outside the timings.
    warm = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count()
    warm.mapInArrow(lambda batches: batches, warm.schema).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        with intermediates(spark):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
