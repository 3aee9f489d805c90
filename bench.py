"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

from voxelmill.catalog import load_all
from voxelmill.session import local_session

HEADLINE = """agg_dice_per_class agg_percentiles agg_hd95 join_pair_id src_series_catalog win_early_stop
morph_close morph_clean knee_laterality knee_bh_pct int_clip_z geo_stitch tex_glcm knee_record""".split()


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load_all()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 2), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
