"""Z-order cells: ranges cover their boxes, and a scan by cell skips row groups."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from bidscope.operators import spatial as S
from bidscope.operators.predicates import in_bounds


def points(spark, n=4000):
    r = random.Random(3)
    rows = [(k, r.uniform(1, 7), r.uniform(99, 104)) for k in range(n)] + [(n, None, 101.0), (n + 1, 3.0, None), (n + 2, 90.0, 180.0), (n + 3, -90.0, -180.0)]
    return spark.createDataFrame(rows, "id long, lat double, lng double")


def test_ranges_hold_every_point_of_their_box(spark):
    df = points(spark).withColumn("cell", S.cell()).cache()
    assert df.where("cell is null").count() == 2
    r = random.Random(5)
    for _ in range(12):
        south, west = r.uniform(1, 6), r.uniform(99, 103)
        box = (south, west, south + r.choice([0.0, 0.01, 0.5, 3]), west + r.choice([0.0, 0.02, 1.0]))
        ranges = S.box_ranges(*box)
        assert len(ranges) <= S.MAX_RANGES and all(a <= b < c for (a, b), (c, _) in zip(ranges, ranges[1:]))
        assert sorted(x.id for x in S.boxed(df, *box).collect()) == sorted(x.id for x in in_bounds(df, *box).collect())
    assert S.boxed(df, 3.0, 101.0, 2.0, 102.0).count() == 0 and S.boxed(df, -90.0, -180.0, 90.0, 180.0).count() == 4002


def test_a_box_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "by_cell")
    S.write_by_cell(points(spark, 20_000), path, partitions=16)
    box = (3.0, 101.0, 3.4, 101.5)
    read = spark.read.parquet(path)
    plan = S.boxed(read, *box)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(cell" in plan
    ranges, groups, met = S.box_ranges(*box), 0, 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("cell")
        for k in range(meta.num_row_groups):
            stats = meta.row_group(k).column(at).statistics
            groups += 1
            met += any(stats.has_min_max and stats.min <= b and a <= stats.max for a, b in ranges)
    assert groups >= 16 and met <= groups / 4
    assert S.boxed(read, *box).count() == read.where(F.col("lat").between(3.0, 3.4) & F.col("lng").between(101.0, 101.5)).count() > 0
