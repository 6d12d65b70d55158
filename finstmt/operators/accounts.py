"""Items from structured account rows: keys, pos, account_id, account_nm, sj_div, fs_div, thstrm_amount, currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts, text
from ..sources.settled import large

KEYS = ["corp", "year"]
SECTION = {"BS": "BS", "IS": "IS", "CIS": "IS", "CF": "CF", "SCE": "SCE"}


def infer_division(rows: DataFrame, requested: str = "CFS") -> DataFrame:
    """fs_div: the one most rows have, of equally frequent ones the first seen, else the requested; and the
    first currency that is not KRW."""
    div = F.upper(text.trim(F.coalesce("fs_div", F.lit(""))))
    counted = rows.withColumn("div", F.when(div.isin("CFS", "OFS"), div)).groupBy(*KEYS, "div").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    most = counted.groupBy(*KEYS).agg(F.expr("min_by(div, struct(-n, first)) FILTER (WHERE div IS NOT NULL)").alias("fs_div"))
    other = F.upper(text.trim(F.coalesce("currency", F.lit("KRW"))))
    money = rows.withColumn("cur", F.when(~other.isin("KRW", ""), other)).groupBy(*KEYS).agg(F.expr("min_by(cur, pos) FILTER (WHERE cur IS NOT NULL)").alias("non_krw"))
    return most.join(large(money), KEYS).select(*KEYS, F.coalesce("fs_div", F.lit(requested)).alias("fs_div"), "non_krw")


def choose_division(available: DataFrame) -> DataFrame:
    """Of answers (keys, request_no, fs_div, ...) the later of one division, and CFS before OFS."""
    last = Window.partitionBy(*KEYS, "fs_div").orderBy(F.desc("request_no"))
    best = Window.partitionBy(*KEYS).orderBy(F.when(F.col("fs_div") == "CFS", 0).otherwise(1))
    once = available.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


#: What a row tells of itself besides its match; columns that rows lack are null.
ORIGIN = ("thstrm_amount", "fs_div", "sj_div", "account_id", "account_nm", "currency", "thstrm_nm", "ord")


def extract(rows: DataFrame, catalogue: DataFrame, origin: bool = False) -> DataFrame:
    """keys, item, value, method, keyword, confidence for each of the items found; with ``origin`` also the fields of
    the matching row, which go through the aggregation with it, ``currency_code`` and whether its sign was ``turned``.

    First by account id, then by name: the first row, and in it the first keyword that the name holds, that
    has an amount and no excluding word. The catalogue is small and broadcast; each row is compared with its
    keywords where it is read, and one aggregation picks the first match of every item.
    """
    amount = amounts.account_amount(F.col("thstrm_amount"))
    of_row = [F.struct(*((F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in ORIGIN)).alias("origin")] if origin else []
    extra = ["origin"] if origin else []
    named = rows.select(*KEYS, "pos", text.trim(F.coalesce("account_id", F.lit(""))).alias("id"), text.nospace(F.coalesce("account_nm", F.lit(""))).alias("nm"), "currency", amount.alias("amount"), *of_row).where("amount is not null")
    by_id = F.col("id") == F.col("want")
    word = F.get(F.filter("keywords", lambda k: F.col("nm").contains(k)), F.lit(0))
    by_name = F.exists("keywords", lambda k: F.col("nm").contains(k)) & ~F.exists("excluded", lambda x: F.col("nm").contains(x))
    each = named.join(F.broadcast(catalogue.withColumnRenamed("account_id", "want")), F.coalesce(by_id, F.lit(False)) | by_name)
    match = F.struct(F.when(by_id, 1).otherwise(2).alias("stage"), "pos")
    each = each.select(*KEYS, "item", match.alias("at"), word.alias("keyword"), "amount", "negated", "currency", *extra)
    first = each.groupBy(*KEYS, "item").agg(F.min_by(F.struct("at", "keyword", "amount", "negated", "currency", *extra), "at").alias("m"))
    m = F.col("m")
    named_so = m["at"]["stage"] == 2
    turned = named_so & F.array_contains(m["negated"], m["keyword"]) & (m["amount"] > 0)
    money = F.upper(text.trim(F.coalesce(m["currency"], F.lit("KRW"))))
    return first.select(
        *KEYS, "item", F.when(turned, -m["amount"]).otherwise(m["amount"]).alias("value"),
        F.when(named_so, "account_nm").otherwise("account_id").alias("method"), F.when(named_so, m["keyword"]).alias("keyword"),
        F.when(named_so | ~money.isin("KRW", ""), "low_confidence").otherwise("verified").alias("confidence"),
        *([m["origin"].alias("origin"), F.when(money == "", None).otherwise(money).alias("currency_code"), turned.alias("turned")] if origin else []),
    )


def text_bundle(rows: DataFrame, most: int = 8000) -> DataFrame:
    """keys and one text: sections BS, IS, CF, SCE with their lines in order, cut at ``most`` characters."""
    section = F.create_map(*(F.lit(x) for kv in SECTION.items() for x in kv))[F.upper(text.trim(F.coalesce("sj_div", F.lit(""))))]
    nm, amount = text.trim(F.coalesce("account_nm", F.lit(""))), text.trim(F.coalesce("thstrm_amount", F.lit("")))
    lines = rows.select(*KEYS, "pos", section.alias("section"), nm.alias("nm"), amount.alias("amount")).where("section is not null and nm <> '' and amount not in ('', '-')")
    order = F.array_position(F.array(*map(F.lit, ("BS", "IS", "CF", "SCE"))), F.col("section"))
    line = F.struct(order.alias("order"), "pos", F.concat("nm", F.lit(": "), "amount").alias("line"))
    head = lines.groupBy(*KEYS, "section").agg(F.sort_array(F.collect_list(line)).alias("l"))
    block = F.concat(F.lit("["), F.col("section"), F.lit("]\n"), F.array_join(F.col("l.line"), "\n"))
    whole = head.select(*KEYS, F.get("l", F.lit(0))["order"].alias("order"), block.alias("block")).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("order", "block"))).alias("b"))
    return whole.select(*KEYS, F.left(F.array_join(F.col("b.block"), "\n"), F.lit(most)).alias("text"))
