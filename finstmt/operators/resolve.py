"""Companies by name, and the filing to use for each company and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.settled import large

#: Filing types in the order in which they are preferred.
PRIORITY = {"A001": 1, "F002": 2, "F001": 3}


#: Lengths of the substrings that are indexed; a name is looked up by those of the longest length that it has.
GRAMS = (0, *(1 << i for i in range(13)))
HINTS = 3


def _grams(c: Column, size: Column) -> Column:
    starts = F.sequence(F.lit(1), F.when(size == 0, 1).otherwise(F.length(c) - size + 1))
    return F.transform(starts, lambda i: F.substring(c, i, size))


def containing(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows (all their columns) whose corp_name holds a name (distinct, not null), with that ``name``.

    An inverted index of substrings: corp_name is listed under all its substrings of 1, 2, 4, 8, ... characters, a name
    asks for those of its own of the longest such length, and only of these are there postings. A name with a substring
    that nothing has is done; the others meet the postings of their rarest one, and ``contains`` confirms. A name of
    exactly such a length is its own substring, so short names are no special case; the empty name is in everything.
    """
    size = F.array_max(F.filter(F.array(*map(F.lit, GRAMS)), lambda s: s <= F.length("name")))
    asked = names.select("name", F.explode(F.array_distinct(_grams(F.col("name"), size))).alias("gram"))
    sizes = F.filter(F.array(*map(F.lit, GRAMS)), lambda s: s <= F.length("corp_name"))
    has = F.array_distinct(F.flatten(F.transform(sizes, lambda s: _grams(F.col("corp_name"), s))))
    listed = registry.where("corp_name IS NOT NULL").select(F.struct(*registry.columns).alias("row"), F.explode(has).alias("gram"))
    postings = listed.join(asked.select("gram").distinct(), "gram", "left_semi")
    counted = asked.join(postings.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = counted.groupBy("name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("lacking")).where("lacking = 0")
    hits = rarest.select("name", "gram").join(postings, "gram").where(F.contains(F.col("row.corp_name"), F.col("name")))
    return hits.select("name", "row.*")


def search(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows (corp_code, corp_name, pos) for each name: the exact ones, else those that contain it."""
    exact = names.join(registry, F.col("name") == F.col("corp_name")).withColumn("exact", F.lit(True))
    return exact.unionByName(containing(_unmatched(names, registry), registry).withColumn("exact", F.lit(False)))


def _unmatched(names: DataFrame, registry: DataFrame) -> DataFrame:
    return names.select("name").where("name IS NOT NULL").distinct().join(large(registry.select(F.col("corp_name").alias("name"))), "name", "left_anti")


def resolve(names: DataFrame, registry: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """name, corp_code, status (ok, no_corp, ambiguous_corp), hints (first three similar names, null if ok).

    An override (name, corp_code) wins over any search. However many rows a name finds, no task holds more than three
    of them at once for it: exact ones are counted, of similar ones each task keeps its first three before the shuffle.
    """
    exact = registry.join(large(names.select(F.col("name").alias("corp_name")).distinct()), "corp_name", "left_semi").groupBy(F.col("corp_name").alias("name")).agg(F.count("*").alias("n_exact"), F.min_by("corp_code", "pos").alias("code"))
    by_place = Window.partitionBy("name").orderBy("pos", "corp_name")
    first = containing(_unmatched(names, registry), registry).withColumn("_n", F.row_number().over(by_place)).where(F.col("_n") <= HINTS)
    near = first.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("_n", "corp_name")))["corp_name"].alias("near"))
    out = names.join(large(exact), "name", "left").join(large(near), "name", "left")
    chosen = overrides if overrides is not None else names.select("name", F.lit(None).cast("string").alias("corp_code")).limit(0)
    out = out.join(chosen.select("name", F.col("corp_code").alias("chosen")), "name", "left")
    n = F.coalesce("n_exact", F.lit(0))
    status = F.when(F.col("chosen").isNotNull() | (n == 1), "ok").when(n > 1, "ambiguous_corp").otherwise("no_corp")
    code = F.coalesce("chosen", F.when(n == 1, F.col("code")))
    hints = F.when(n > 0, F.array_repeat("name", F.least(n, F.lit(HINTS)).cast("int"))).otherwise(F.col("near"))
    return out.select("name", code.alias("corp_code"), status.alias("status"), F.when(status != "ok", hints).alias("hints"))


def first_code(names: DataFrame, registry: DataFrame) -> DataFrame:
    """The first exact match in registry order, null if there is none."""
    exact = registry.groupBy(F.col("corp_name").alias("name")).agg(F.min_by("corp_code", "pos").alias("corp_code"))
    return names.join(exact, "name", "left")


def choose_report(filings: DataFrame, years: DataFrame, page: int = 10) -> DataFrame:
    """The filing of each (corp, year): best type, then newest, among those of the year.

    Filings of a type count from 1 January of the year to 30 June two years on; only the newest ``page`` of
    them are looked at, and a title's own year, where it has one, must be the year. filings: corp, kind,
    rcept_no, report_nm, rcept_dt (YYYYMMDD), pos.
    """
    y = F.col("year").cast("string")
    due = F.col("rcept_dt").between(F.concat(y, F.lit("0101")), F.concat((F.col("year") + 2).cast("string"), F.lit("0630")))
    rank = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    among = filings.where(F.col("kind").isin(*PRIORITY)).join(large(years), "corp").where(due).withColumn("priority", rank[F.col("kind")])
    newest = Window.partitionBy("corp", "year", "priority").orderBy(F.desc("rcept_dt"), "pos")
    titled = text.report_year(F.col("report_nm"))
    fits = among.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= page).where(titled.isNull() | (titled == F.col("year")))
    best = F.min_by(F.struct("kind", "rcept_no", "report_nm", "rcept_dt"), F.struct("priority", "n"))
    return fits.groupBy("corp", "year").agg(best.alias("r")).select("corp", "year", "r.*")


def with_company_info(candidates: DataFrame, info: DataFrame) -> DataFrame:
    """Candidates with details where there are any, '' elsewhere."""
    columns = [c for c in info.columns if c != "corp_code"]
    return candidates.join(info, "corp_code", "left").select(*candidates.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in columns))
