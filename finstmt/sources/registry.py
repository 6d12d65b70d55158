"""The company registry in versions: what it said at a time, and only while that was fresh.

Each snapshot is kept with the time it was taken and answers requests from then until the next one, for LIFE_H hours at
most; a request that no version covers has no answer and asks for a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIFE_H = 24
COLUMNS = "corp_code string, corp_name string, pos bigint"


def take(rows: DataFrame, taken_at: str, root: str) -> None:
    """Keep a snapshot (corp_code, corp_name, pos) as of taken_at (YYYY-MM-DD HH:MM:SS, UTC). Taken again, it is replaced."""
    stamp = rows.sparkSession.sql("SELECT unix_micros(timestamp(:t || '+00:00')) AS t", args={"t": taken_at}).first().t
    rows.selectExpr("corp_code", "corp_name", "bigint(pos) AS pos").write.mode("overwrite").parquet(f"{root}/taken={stamp}")


def _versions(spark: SparkSession, root: str) -> DataFrame:
    """taken and until (micros) of every version, from the names of the folders."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in there.listStatus(path)] if there.exists(path) else []
    taken = sorted(int(n.removeprefix("taken=")) for n in names if n.startswith("taken="))
    life = LIFE_H * 3_600_000_000
    return spark.createDataFrame([(t, min([t + life, *taken[i + 1 : i + 2]])) for i, t in enumerate(taken)], "taken bigint, until bigint")


def as_of(requests: DataFrame, root: str) -> DataFrame:
    """requests (name, at, ...) with ``taken_at`` of the version that answers (null: none is fresh), and of its exact
    matches ``n_exact`` and the first ``corp_code`` by place.

    A version lives LIFE_H hours, so it lies in few spans of that length; a request meets the versions of its own span.
    """
    spark = requests.sparkSession
    life = F.lit(LIFE_H * 3_600_000_000)
    at = F.unix_micros(F.col("at").cast("timestamp"))
    span = lambda c: F.floor(c / life).cast("bigint")
    versions = _versions(spark, root).withColumn("span", F.explode(F.sequence(span(F.col("taken")), span(F.col("until") - 1))))
    asked = requests.withColumn("_at", at).withColumn("_span", span(F.col("_at")))
    fits = (F.col("_span") == F.col("span")) & (F.col("_at") >= F.col("taken")) & (F.col("_at") < F.col("until"))
    dated = asked.join(versions.select("span", "taken", "until"), fits, "left").select(*requests.columns, "taken")
    rows = spark.read.schema(f"{COLUMNS}, taken bigint").parquet(root)
    named = rows.groupBy("taken", F.col("corp_name").alias("name")).agg(F.count("*").alias("n_exact"), F.min_by("corp_code", "pos").alias("corp_code"))
    found = dated.join(named, ["taken", "name"], "left")
    return found.select(*requests.columns, F.timestamp_micros("taken").alias("taken_at"), F.when(F.col("taken").isNotNull(), F.coalesce("n_exact", F.lit(0))).alias("n_exact"), "corp_code")


def answer_stream(requests: DataFrame, root: str, path: str):
    """A writer of as_of() for a stream of requests: every batch looks at the versions that are there by then."""
    return requests.writeStream.foreachBatch(lambda batch, i: as_of(batch, root).write.mode("overwrite").parquet(f"{path}/batch={i}"))
