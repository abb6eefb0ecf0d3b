"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder (default sf0.1), BENCH_CPUS the local cores.
Each query is written to the noop sink, so every row is produced and none is collected.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from voxmill.catalog import QUERIES, runner

HEADLINE = [
    "class_scores", "frame_scores", "pooled_levels", "completion_by_class", "misses_by_region", "visibility_split",
    "protocol_matrix", "class_presence", "viewpoint_statistics", "viewpoint_correlations", "voxel_to_pixel", "sight_test",
    "surface_distance", "tsdf_blocks", "painted_solids", "label_volume", "downsampled_labels", "points_in_cubes",
    "observe_frames", "sweep_map", "verdict_counts", "latest_colour", "gather_prediction", "rest_mask", "still_stretches",
    "asof_pose_error", "run_differences", "belief_gate", "nearest_within", "cloud_residual", "exposed_faces", "surface_edges",
    "depth_triangles", "label_runs", "volume_files", "greedy_batches",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("voxmill-bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    seconds = {}
    for name in names:
        t0 = time.time()
        runner(name)(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t0, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus), "shuffle_partitions": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
