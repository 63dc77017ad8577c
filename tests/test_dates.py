"""PDF dates as timestamps, whatever the session's time zone."""

import pytest
from pyspark.sql import functions as F

from foliograph.operators.scalars import parse_pdf_date, write_pdf_date

CASES = [("D:20260710143000+02'00'", 1783686600), ("D:199812231952-08'00'", 914471520), ("D:20040229", 1078012800), ("D:20200101000000Z", 1577836800), ("junk", None), (None, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_zones(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = spark.createDataFrame(CASES, "s string, want long").withColumn("ts", parse_pdf_date(F.col("s")))
        got = t.select("want", F.unix_seconds("ts"), F.unix_seconds(parse_pdf_date(write_pdf_date(F.col("ts"))))).collect()
        assert all(tuple(r) == (r.want,) * 3 for r in got), got
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
