"""Small helpers shared by the tests."""

import datetime as dt

from pyspark.sql import functions as F


def values(spark, column, inputs):
    """The results of a column expression over text inputs, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v")).alias("x")).collect()]


def at(minute, day=1):
    return dt.datetime(2024, 1, day, minute // 60, minute % 60)


def dicts(df, *order):
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
