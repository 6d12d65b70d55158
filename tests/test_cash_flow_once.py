"""Cash-flow rows in one pass, and text functions that look at each text once."""

from pyspark.sql import functions as F

from finstmt.functions import text
from finstmt.operators import depreciation


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cash_flow_rows_are_read_once(spark):
    t = spark.createDataFrame([
        ("a", 1, 3, [["구분", "당기"], ["감가상각비", "5"], ["투자부동산감가상각비", "2"], ["무형자산상각비", "9"]]), ("a", 1, 7, [["구분", "당기"], ["감가상각비", "50"], ["사용권자산상각비", "4"]]),
        ("b", 1, 2, [["구분", "당기"], ["감가상각비 및 무형자산상각비", "8"], ["감가상각비", "1"]]), ("c", 1, 2, [["구분", "당기"], ["감가상각비", "-"]]),
    ], "corp string, year int, pos int, rows array<array<string>>").selectExpr("*", "10L AS unit")
    out = depreciation.cash_flow_buckets(t)
    assert "Join" not in plan_of(out)
    assert sorted(map(tuple, out.collect())) == [("a", 1, 70.0, 40.0, 90.0, False), ("b", 1, 80.0, None, None, True)]


def test_trim_and_row_labels_as_by_pattern(spark):
    said = ["", " ", "　a b​﻿", "x\n\n", "1.가.감가상각비", "(3)", "감가상각비", " 1) ", None, "\x1c\x85 q "]
    df = spark.createDataFrame([(x,) for x in said], "x string")
    by_pattern = F.regexp_replace("x", f"^{text.WS}+|{text.WS}+$", "")
    start = F.regexp_replace(F.translate("x", " 　 ", ""), f"^{text.WS}+|{text.WS}+$", "")
    steps = F.sequence(F.lit(1), F.greatest(F.length(start), F.lit(1)))
    label = F.aggregate(steps, start, lambda a, _: text._without_prefix(a))
    assert df.where(~text.trim(F.col("x")).eqNullSafe(by_pattern) | ~text.row_label(F.col("x")).eqNullSafe(label)).collect() == []
