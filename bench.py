"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds per query."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "ordinal_metrics metrics_by_phone spearman_by_fold calibration_curve group_statistics paired_bootstrap threshold_grid speaker_profiles leave_one_out_profiles shrunk_residual_calibrator"
    " disagreement_queue equal_error_rate fold_leakage record_offsets cluster_quality impostor_similarities krippendorff_alpha latest_decisions prompt_folds constrained_alignment"
).split()


def main() -> None:
    from assaykit.plans import registry
    from assaykit.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
