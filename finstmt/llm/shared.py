"""What the operators of this subpackage have in common."""

from __future__ import annotations

import contextlib
import functools
import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters to lower case, nothing else changed.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: As LOWER, and every ASCII byte that is no letter or digit to a space; bytes of other characters stay.
LOWER_ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)

#: Words that a Python worker remembers something about; beyond it forgets all and starts anew.
REMEMBERED = 100_000
#: Bytes and rows of one Arrow batch, so that a Python worker's memory does not follow the length of the texts.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000
#: Rows of one key that may meet in one task; and how many keys may be heavier than that and so be broadcast.
HEAVY, MOST_HEAVY = 1_000, 100_000

#: Documents whose share of a settled table one task writes.
ROWS_A_TASK = 20_000

_own_dir: list[str] = []
_tasks: ContextVar[int | None] = ContextVar("tasks", default=None)


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters (null: none)."""
    return text.encode().translate(LOWER_ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs between ASCII white space (null: none)."""
    return text.encode().translate(LOWER).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, one of our own, but only if all runs on this machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="finstmt-shared-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/finstmt-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def about(documents: DataFrame) -> Iterator[None]:
    """Inside, settled tables are written by as many tasks as these documents take (and cores there are), not by one
    for each shuffle partition: a table that is small beside them is a few files."""
    needed = -(-documents.count() // ROWS_A_TASK)
    before = _tasks.set(max(documents.sparkSession.sparkContext.defaultParallelism, needed))
    try:
        yield
    finally:
        _tasks.reset(before)


def sized(f: Callable) -> Callable:
    """f(documents, ...) inside about(documents)."""

    @functools.wraps(f)
    def run(documents: DataFrame, *args, **named):
        with about(documents):
            return f(documents, *args, **named)

    return run


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Later jobs start from these files, so a lost executor costs only the task at hand, and rows, once
    written, cannot change between two readings of them.
    """
    spark = df.sparkSession
    path, tasks = new_path(spark, name), _tasks.get()
    (df.coalesce(tasks) if tasks else df).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, documents: DataFrame) -> DataFrame:
    """df, of about a row for each of documents, in as many partitions as settle takes: its writer makes few files."""
    with about(documents):
        return df.coalesce(_tasks.get())


def discard(*settled: DataFrame) -> None:
    """Remove the tables of settled frames that no later frame reads."""
    for df in settled:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/finstmt-" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) in batches of bounded bytes; a session that has bounds of its own keeps them."""
    conf = df.sparkSession.conf
    for key, ours, usual in (("maxBytesPerBatch", BATCH_BYTES, 64 << 20), ("maxRecordsPerBatch", BATCH_ROWS, 10_000)):
        if conf.get(f"spark.sql.execution.arrow.{key}", str(usual)).rstrip("b") == str(usual):
            conf.set(f"spark.sql.execution.arrow.{key}", str(ours))
    return df.mapInArrow(f, schema)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names and types: ``pick(df, doc_id="bigint")``.

    Extra columns, whatever their names, do not go further.
    """
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()))


def with_text(columns: list[str]) -> list[Column]:
    """The columns of struct ``row`` with ``text`` in place of its own; n_chars, where a text has changed, follows."""
    same = F.col("text").eqNullSafe(F.col("row.text"))
    put = {"text": F.col("text"), "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("text"))}
    return [put.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns]


def join_counted(rows: DataFrame, keyed: DataFrame, key: list[str], n: str = "n", how: str = "inner", total: int | None = None) -> DataFrame:
    """Rows, of which any key may hold any share, joined with ``keyed``: one row for each key, ``n`` its rows at most.

    Up to MOST_HEAVY keys are broadcast. Of more, those of over HEAVY rows (and so many that there cannot be more than
    MOST_HEAVY of them, as their rows
    add up to ``total``, counted where it is not given) are, and their rows stay where they are; the rest is an
    ordinary join.
    """
    if total is None:  # keyed is settled, so its size costs little
        total, keys = keyed.agg(F.coalesce(F.sum(n), F.lit(0)), F.count("*")).first()
        if keys <= MOST_HEAVY:
            return rows.join(F.broadcast(keyed), key, how)
    elif total <= MOST_HEAVY:  # and so are the keys: one exchange in place of five, each of which costs the driver a thread for a minute
        return rows.join(F.broadcast(keyed), key, how)
    limit = max(HEAVY, total // MOST_HEAVY)
    above = F.broadcast(keyed.where(F.col(n) > limit))
    light = rows.join(above.select(*key), key, "left_anti").join(keyed.where(F.col(n) <= limit), key, how)
    return light.unionByName(rows.join(above, key))


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, n: str, by: str) -> DataFrame:
    """Inner join of rows, whose ``n`` says how many of them have their key, with ``keyed``: one row for each key.

    The rows of a key are dealt by a hash of ``by`` into parts of about HEAVY; ``keyed``, which has ``n`` too, is
    copied to each of its key's parts, which adds a row for every HEAVY of the others.
    """
    parts = F.ceil(F.col(n) / HEAVY).cast("int")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int"))
    copies = keyed.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return dealt.join(copies, [key, "_part"]).drop("_part")


def small(settled: DataFrame) -> DataFrame:
    """To be broadcast where it has no more than MOST_HEAVY rows, which are counted first."""
    return F.broadcast(settled) if settled.count() <= MOST_HEAVY else settled


def numbered(rows: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows (settled) with the number of rows of their key."""
    return join_counted(rows, rows.groupBy(key).agg(F.count("*").alias(n)), [key], n, total=rows.count())
