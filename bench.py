"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. The session
and its Python workers are started by one untimed query; every timed query runs once, to the end.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadgrove.queries import all_queries
from threadgrove.session import builder

HEADLINE = [
    "b3_attach", "b6_depth", "c5_edge_similarity", "c7_overall_similarity_distribution", "d5_forest_stats",
    "d11_overall_size_distribution", "d15_threshold_sweep", "e1_clean_text", "e5_vocabulary", "e6_encode_tokens",
    "f1_parent_child_pairs", "f3_single_texts", "f6_cross_thread_negatives", "f7_batches", "g2_confidence_weighted_dot",
    "g7_score_statistics", "g8_noise_injection", "h6_append_history", "i3_infonce_in_batch", "j2_fixed_split",
    "k8_closest_to_mean", "l2_precision_at_k", "l3_mrr", "l4_intra_class", "l6_inter_class_exact", "l9_nmi",
    "l17_pair_metrics", "m1_curation_round", "m2_variant_sweep",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (builder(f"local[{cpus}]", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    todo = all_queries()
    todo["d5_forest_stats"](spark, sf).collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        todo[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf.rsplit("sf", 1)[-1]), "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
