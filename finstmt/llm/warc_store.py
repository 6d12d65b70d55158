"""Content-addressed WARC archive.

Payload bytes are stored once for each SHA-256 digest (``payloads``), record headers are stored byte for
byte in a table of their own (``headers``), and original records come back by a join on the digest. Both tables
know how many records a digest has: one that very many records share (an empty or error page) is dealt out.

Cases
- null payload: empty payload (0 bytes), stored under the digest of nothing.
- payloads under ``min_revisit_bytes``: every record is a response, the bytes are still stored once.
- equal larger payloads: the rows with the smallest id are responses, the others revisits of that id;
  a repeated row (same id, same payload) is a response again. A null id counts after every number; a group
  of null ids only holds responses.
- very long payloads are stored and hashed whole.
- null url: an empty target; CR and LF in a url are percent-encoded, so that a header stays well formed.
- empty table: empty archive. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

CRLF = "\r\n"
MIN_REVISIT_BYTES = 100


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def headers_of(records: DataFrame, date: str) -> Column:
    """The exact header block of a record, ending with its empty line."""
    revisit = F.col("refers_to").isNotNull()
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", ident("page_id")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            _line("WARC-Refers-To", ident("refers_to")),
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF),
    ).cast("binary")


@shared.sized
def write_archive(pages: DataFrame, root: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``root/headers`` and ``root/payloads`` from pages (page_id, url, html).

    A digest is trusted only after it has been verified: all rows that share one must agree in length and in
    an independent 64-bit hash, otherwise the write fails.
    """
    body = shared.pick(pages, page_id="bigint", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    small = shared.settle(body.select("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("n_bytes"), F.xxhash64("payload").alias("check")), "warc-meta")
    same = (F.min("n_bytes") == F.max("n_bytes")) & (F.min("check") == F.max("check"))
    groups = small.groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("copies"), F.when(same, F.lit(True)).otherwise(F.raise_error("one digest for two payloads").cast("boolean")).alias("verified")
    ).where("verified")
    groups = shared.settle(groups, "warc-digests")
    refers = F.when((F.col("n_bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    records = shared.join_counted(small, groups, ["digest"], "copies").withColumn("refers_to", refers)
    headers = records.select(F.monotonically_increasing_id().alias("n"), "page_id", "digest", "copies", headers_of(records, date).alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{root}/headers")
    payloads = body.groupBy("digest").agg(F.count("*").alias("copies"), F.first("payload").alias("payload"))
    payloads.write.option("compression", "zstd").parquet(f"{root}/payloads")
    shared.discard(small, groups)


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """page_id, record, payload of every record.

    ``record`` is the original record as WARC has it, header, block and end (a revisit's block is empty);
    ``payload`` is the full one, for a revisit that of the response it refers to.
    """
    headers, payloads = spark.read.parquet(f"{root}/headers"), spark.read.parquet(f"{root}/payloads")
    both = shared.join_spread(headers, payloads, "digest", "copies", "n")
    revisit = F.col("header").cast("string").contains(f"WARC-Type: revisit{CRLF}")
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return both.select("page_id", F.concat("header", block, F.lit(CRLF + CRLF).cast("binary")).alias("record"), "payload")


def parse(records: DataFrame) -> DataFrame:
    """Fields read from the bytes of the records; the job fails if a record's length, block or digest is wrong."""
    head = F.substring_index(F.col("record").cast("string"), CRLF + CRLF, 1)
    fields = F.concat(head, F.lit(CRLF))
    field = lambda pattern: F.nullif(F.regexp_extract(fields, pattern, 1), F.lit(""))
    kind, digest = field(r"\r\nWARC-Type: (\w+)\r\n"), field(r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n")
    start, length = F.octet_length(head) + 4, field(r"\r\nContent-Length: ([0-9]+)\r\n").cast("int")
    block = F.when(kind == "revisit", F.col("payload")).otherwise(F.substring(F.col("record"), start + 1, length))
    fine = (F.octet_length("record") == start + length + 4) & (block == F.col("payload")) & (digest == F.sha2(block, 256))
    return records.select(
        "page_id",
        F.octet_length(block).cast("bigint").alias("payload_bytes"),
        F.when(fine, digest).otherwise(F.raise_error("a record does not match its length or digest")).alias("payload_digest"),
        kind.alias("record_type"),
        field(r"\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n").cast("bigint").alias("refers_to"),
    )


def op8_warc_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared.new_path(spark, "warc")
    write_archive(shared.table(spark, sf_dir, "pages"), root)
    return parse(read_archive(spark, root))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
