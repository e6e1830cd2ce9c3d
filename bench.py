"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line.

Every query is run to the end (a write to the no-op sink) after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "P03_min_tokens",
    "P13_clip_and_squash",
    "P14_assign_ids",
    "U01_dedup_by_title",
    "X12_html_parts",
    "J01_enrich_by_key",
    "J10_page_chapter",
    "A03_seed_summary",
    "A08_describe",
    "A10_flatten_lists",
    "W01_best_per_group",
    "W03_sentence_window",
    "W09_moving_average",
    "D01_doc_collection",
    "D02_recursive_chunks",
    "R01_bm25",
    "R02_dense",
    "R04_hybrid_fusion",
    "R07_grouped_search",
    "E03_map_ndcg",
    "E04_kendall",
    "M01_tf_idf",
    "M07_class_words",
    "M20_feature_difference",
    "M21_coherence",
    "G05_degree",
    "G06_pagerank",
    "G08_components",
    "G11_distances",
    "R03_dense_approximate",
    "R05_hybrid_sum",
    "R06_late_interaction",
    "M02_lda",
    "M10_kmeans",
    "M15_spectral_clusters",
    "G08_strong_components",
    "G13_biconnected",
    "G14_hyperbolicity",
    "G16_neighbour_samples",
    "G20_near_set",
    "J11_pairwise_join",
    "S07_load_wiki_dump",
]


def main() -> None:
    from textloom.plans import registered
    from textloom.scale import release_all
    from textloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registered.QUERIES["A01_value_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.time()
        registered.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        release_all(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
