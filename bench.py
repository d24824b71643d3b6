"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The first query runs once untimed, so that the timings do not include the start of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from firegrid import build_session  # noqa: E402
from workload.all import QUERIES  # noqa: E402

HEADLINE = (
    "flame_length_change",
    "sdi_stats_by_zone",
    "burn_probability_change",
    "landscape_value",
    "treated_landscape",
    "suppression_difficulty",
    "suppression_difficulty_smoothed",
    "focal_mean",
    "touched_zones",
    "points_in_polygons",
    "dominant_regions",
    "nearest_wind_points",
    "season_erc",
    "erc_class_table",
    "scenario_cache",
    "scenario_fuel_moistures",
    "wind_rose",
    "sdi_boxplots",
    "buffer_distance_curve",
    "ascii_grid_pixels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(names[0])
    timings = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
