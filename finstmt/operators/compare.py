"""A second opinion against extracted items, its adjudication, and differences to golden values.

Model answers are input relations; without them nothing is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts


def disagrees(a: Column, b: Column, relative: float = 0.001, absolute: float = 1.0) -> Column:
    """One is null, or they differ by more than both tolerances."""
    diff = F.abs(a - b)
    far = (diff > absolute) & (diff / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) > relative)
    return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).otherwise(far)


def compare(items: DataFrame, opinion: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, ours, theirs, disagree; full outer, so an item of either side is there."""
    both = items.select(*keys, "item", F.col("value").alias("ours")).join(opinion.select(*keys, "item", F.col("value").alias("theirs")), [*keys, "item"], "full")
    return both.withColumn("disagree", disagrees(F.col("ours"), F.col("theirs")))


def whole(v: Column) -> Column:
    """Without decimals, halves to even; a dash for null."""
    r = F.bround(v, 0)
    return F.when(v.isNull(), "-").when((r == 0) & (v < 0), "-0").otherwise(r.cast("decimal(38,0)").cast("string"))


def disagreement(a: Column, b: Column) -> Column:
    """The text of a disagreement: both values, whole."""
    return F.concat(whole(a), F.lit(" vs "), whole(b))


def adjudicate(compared: DataFrame, verdict: DataFrame, keys: list[str]) -> DataFrame:
    """Final values: ours where both agree, else the verdict; an unreadable verdict gives theirs, and a null
    never displaces a value of ours. verdict: keys, item, answer (text as the model gave it)."""
    v = verdict.select(*keys, "item", F.col("answer"), F.lit(True).alias("answered"))
    number = F.col("answer").try_cast("double")
    said = F.when(F.col("answer").isNull(), F.lit(None).cast("double")).when(number.isNull(), F.col("theirs")).otherwise(number)
    out = compared.join(v, [*keys, "item"], "left")
    return out.select(*keys, "item", "ours", "theirs", "disagree", F.when(~F.col("disagree"), F.col("ours")).otherwise(F.coalesce(said, "ours")).alias("final"))


def outcome(compared: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """How a comparison ended, and the values it gives. asked: keys, first_ok, second_ok (calls that worked).

    First call failed: python_fallback, 0 calls. All agree: agreed, 1 call. Second call failed:
    ai_extract_only, 1 call, theirs fill only what is null in ours. Else adjudicated, 2 calls.
    """
    n = compared.groupBy(*keys).agg(F.count_if("disagree").alias("n_disagree"), F.sort_array(F.collect_list(F.when(F.col("disagree"), F.col("item")))).alias("disagreements"))
    out = n.join(asked, keys)
    source = F.when(~F.col("first_ok"), "python_fallback").when(F.col("n_disagree") == 0, "agreed").when(~F.col("second_ok"), "ai_extract_only").otherwise("adjudicated")
    calls = F.when(source == "python_fallback", 0).when(source == "adjudicated", 2).otherwise(1)
    return out.select(*keys, source.alias("source"), calls.alias("ai_calls"), F.when(F.col("first_ok"), F.array_join("disagreements", ",")).otherwise(F.lit("")).alias("disagreements"))


def reconcile(before: Column, after: Column, state: Column) -> Column:
    """Confidence of a final value: unchanged keeps its own, removed is missing, changed is unverified."""
    return F.when(amounts.same(before, after), state).when(after.isNull(), F.lit("missing")).otherwise(F.lit("unverified_ai_value"))


def golden_diff(actual: DataFrame, golden: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in which actual and golden values differ: numbers by more than max(1, 1e-6 of the golden)."""
    a, g = (df.select(*(F.col(k).alias(k) for k in keys), F.col("value").alias(n), F.lit(True).alias(f"has_{n}")) for df, n in ((actual, "actual"), (golden, "golden")))
    both = a.join(g, keys, "full")
    close = F.abs(F.col("actual") - F.col("golden")) <= F.greatest(F.lit(1.0), F.abs("golden") * 1e-6)
    equal = F.when(F.col("actual").isNull() | F.col("golden").isNull(), F.col("actual").isNull() & F.col("golden").isNull()).otherwise(close)
    there = F.coalesce("has_actual", F.lit(False)) & F.coalesce("has_golden", F.lit(False))
    return both.where(~(there & equal)).select(*keys, "actual", "golden", F.when(F.col("has_actual").isNull(), "missing").when(F.col("has_golden").isNull(), "extra").otherwise("differs").alias("kind"))
