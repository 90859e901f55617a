"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
Points come from ``lineitem``; each query runs once to warm up and is then
timed while all its rows are computed (the noop sink).
"""

import json
import os
import time

from pyspark.sql import SparkSession

from pointloom.catalog import by_place
from pointloom.operators import neighbors, points, tiling
from pointloom.plans import labelling
from pointloom.sources import views

CPUS = os.environ.get("BENCH_CPUS", "8")
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
# the tasks' Python imports the package too, whatever folder this is started from
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))


def queries(spark):
    """name -> (run, points handled)."""
    cloud = views.pts_big(spark, SF)
    n = cloud.count()
    grid = tiling.tile_grid(cloud, n // 200)
    rect, _ = tiling.plane_extent(cloud)
    some = cloud.where("idx % 100 = 0").select("idx")
    return {
        "tile_assign": (lambda: tiling.assign_tiles(cloud.select("idx", "x", "y", "z"), grid, 10.0), n),
        "voxel_downsample": (lambda: points.voxel_downsample(cloud.select("idx", "x", "y", "z"), 5.0), n),
        "count_grid": (lambda: tiling.count_grid(cloud, tiling.cell_grid(rect)), n),
        "knn_radius": (lambda: neighbors.knn_crops(cloud, some, 32, 25.0), some.count()),
        "label_tiled": (lambda: labelling.label_tiles(cloud, grid, by_place, 10.0), n),
    }


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", str(2 * int(CPUS))).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, rates = {}, {}
    for name, (run, n) in queries(spark).items():
        for _ in range(2):
            began = time.time()
            run().write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        rates[name] = round(n / took[name])
    print(json.dumps({"metric": "seconds for the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "points_per_second": rates, "sf": SF}))


if __name__ == "__main__":
    main()
