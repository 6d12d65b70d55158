"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each document gets the base counts of its own text. Its lines are normalised (lower case, digit runs to one
0, white space to one space) and hashed; for each host the distinct documents (by doc_id) that hold a line are
counted, lines in more than ``max_docs`` of them are removed, and a document of which more than ``max_removed`` of
the line characters go is depleted and rejected. Counts are summed before they are shuffled, and lines that very
many documents hold are broadcast, so the commonest line of the largest host meets in no single task.

Cases
- null or empty text: no words, all counts 0, base_failed, not kept.
- rows that share a doc_id on one host are one document for the counts; each still gets a row. Copies under
  doc_ids of their own are documents of their own. A row without doc_id is one, too, and keeps its null.
- a null source is the host ''. Very long texts are read whole; a line may be of any length.
- empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MAX_DOCS, MAX_REMOVED = 10, 0.5


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines(text: Column) -> Column:
    """\\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]+", "0"))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words of array ``words`` that lie in a 3-word window found twice or more in it.

    Windows are compared by 64-bit hash within their own document. Each step is a column of its own, so that
    it is computed once for a row, and the sort is over longs unless a window does repeat.
    """
    hashed = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.when(F.size("_h") >= 3, F.transform(
        F.slice("_h", 1, F.size("_h") - 2), lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2))
    )).otherwise(F.array().cast("array<bigint>"))
    grams = hashed.withColumn("_g", windows).withColumn("_s", F.sort_array("_g"))
    twice = F.exists(F.arrays_zip(F.col("_s").alias("a"), F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))).alias("b")), lambda z: z["a"] == z["b"])
    placed = F.when(twice, F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("p")))))
    found = grams.withColumn("_o", placed)
    again = F.filter("_o", lambda x, i: F.coalesce(x["g"] == F.get("_o", i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("_o", i + 1)["g"], F.lit(False)))
    at = found.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["p"])))
    cover = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    return at.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("bigint"))).drop("_h", "_g", "_s", "_o", "_p")


def base_counts(documents: DataFrame) -> DataFrame:
    """One row for each document with the base counts, and its lines as (hash, characters)."""
    docs = shared.pick(documents, doc_id="bigint", text="string", source="string").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text")
    )
    split = docs.withColumn("words", words(F.col("text"))).withColumn("lines", lines(F.col("text")))
    long = lambda c: c.cast("bigint")
    counted = with_repeats(split)
    n_words, repeated = long(F.size("words")), F.col("n_repeat_words")
    return counted.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "host",
        n_words.alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(SYMBOL))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated,
        ((n_words < 50) | (100 * repeated > 50 * n_words)).alias("base_failed"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), long(F.length(x)).alias("c"))).alias("lines"),
    )


def line_frequency(counted: DataFrame, max_docs: int) -> DataFrame:
    """(host, h, n_docs) of the lines above the limit."""
    who = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("rid")).alias("rid"))
    each = counted.select("host", who.alias("who"), F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).distinct()
    return each.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


@shared.sized
def score(documents: DataFrame, max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Base counts, n_removed_chars, n_line_chars and the verdict ``kept``."""
    counted = shared.settle(base_counts(documents), "line-quality")
    common = shared.settle(line_frequency(counted, max_docs), "common-lines")
    each = counted.select("rid", "host", F.explode("lines").alias("x")).select("rid", "host", "x.h", "x.c")
    removed = shared.join_counted(each, common, ["host", "h"], "n_docs").groupBy("rid").agg(F.sum("c").alias("n_removed_chars"))
    total = F.aggregate(F.col("lines.c"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    gone = F.coalesce("n_removed_chars", F.lit(0).cast("bigint"))
    return counted.join(removed, "rid", "left").select(
        *(c for c in counted.columns if c not in ("rid", "host", "lines")),
        gone.alias("n_removed_chars"), total.alias("n_line_chars"),
        (~F.col("base_failed") & (gone <= max_removed * total)).alias("kept"),
    )


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(shared.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3
), gg AS (
  SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS gram FROM g
), rep AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS n FROM gg) WHERE n >= 2
), cov AS (
  SELECT rid, count(DISTINCT p + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid
), l AS (
  SELECT rid, unnest(ls) AS line FROM w
), ln AS (
  SELECT l.rid, host, coalesce('id ' || doc_id, 'row ' || l.rid) AS who, length(line) AS c,
    trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS nl
  FROM l JOIN d USING (rid)
), common AS (
  SELECT host, nl FROM ln GROUP BY host, nl HAVING count(DISTINCT who) > 10
), rm AS (
  SELECT rid, sum(c) AS n_removed_chars FROM ln JOIN common USING (host, nl) GROUP BY rid
), tot AS (
  SELECT rid, sum(c) AS n_line_chars FROM ln GROUP BY rid
), b AS (
  SELECT d.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_removed_chars, 0) AS BIGINT) AS n_removed_chars,
    CAST(coalesce(n_line_chars, 0) AS BIGINT) AS n_line_chars
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN rm USING (rid) LEFT JOIN tot USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_removed_chars, n_line_chars,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_removed_chars <= n_line_chars AS kept
FROM b
"""
