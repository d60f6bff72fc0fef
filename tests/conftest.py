import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def small_plans(spark):
    """For many jobs over a handful of rows: one task a stage, plans fixed beforehand."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def one(spark, expr, **cols):
    """Evaluate a Column expression on a one-row DataFrame built from keyword string columns."""
    from pyspark.sql import types as T

    names = list(cols) or ["_dummy"]
    vals = [cols[n] for n in cols] or [None]
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    df = spark.createDataFrame([tuple(vals)], schema)
    return df.select(expr.alias("v")).first()["v"]
