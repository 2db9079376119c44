"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores; ``BENCH_QUERIES`` may
list query names, or ``all``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "marker_genes", "celltype_mean_profile", "library_normalize", "gene_zscore", "drop_lowest_45pct", "renorm_reference",
    "overlap_weighted_mean", "group_stats", "percentile_clip", "standardize_features", "top_interactions",
    "pseudo_mixtures", "ari", "nmi", "enrichment_ratio", "knn_euclid", "knn_cosine", "knn_in_class",
    "knn_orders_in_class", "radius_neighbors_l1", "stacked_graph", "neighbor_cosine_weights", "lpa_rounds",
    "lpa_likelihood_refine", "impute_in_class", "impute_protein", "spatial_balance", "polygon_measures",
    "nearest_spot_join", "overlap_matrix", "hull_shape_features", "tissue_mask_filter", "image_warp", "stain_stretch",
    "count_likelihood", "spot_weights", "candidate_types", "potts_prior",
]


def main() -> None:
    from tissuegrid.plans import catalog
    from tissuegrid.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["library_size"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
