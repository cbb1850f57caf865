"""Content-addressed WARC archive: payloads stored once by digest, exact record headers apart.

An archive is two tables in one folder. ``payloads`` holds each payload once under
its SHA-256, confirmed by SHA-1 and length: payloads are equal if all three are.
``records`` holds, per page, the exact header of its WARC record, the HTTP header of
its block and the key of its payload. Joining them on the key gives the records back.

Of records with equal payloads of at least ``min_bytes``, that with the largest id is
a response, others are revisits of it; smaller ones are all responses.

Defined results: a null payload is the empty payload; a null URL is written as
``urn:unknown``; control characters and spaces in a URL are percent-encoded; a row
with a null id is always a response; repeated rows of the largest id are responses
alike; an id may come again with another payload; an empty table gives an empty
archive; extra columns are ignored, whatever their names; a payload is handled whole. Reading a record whose payload is missing fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, scratch_path, small, table

MIN_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"

#: Names of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    path: str

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/records")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/payloads")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*(x for name, value in pairs for x in (F.lit(f"\r\n{name}: "), value.cast("string"))))


def _safe(url: Column) -> Column:
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.coalesce(F.nullif(url, F.lit("")), F.lit("urn:unknown"))


def write(pages: DataFrame, path: str, *, min_bytes: int = MIN_BYTES, date: str = DATE, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Write an archive of ``pages`` to the folder ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    key = F.unhex(F.sha2("payload", 256))
    light = materialise(rows.select("page", "url", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), key.alias("key")), "hashed")

    same = ["key", "sha1", "n"]
    kept = light.groupBy(*same).agg(F.max("page").alias("last"), F.count("*").alias("copies")).filter("copies > 1")
    typed = materialise(light.join(kept, same, "left"), "typed")
    revisit = F.coalesce((F.col("n") >= min_bytes) & (F.col("page") < F.col("last")), F.lit(False))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    body = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    header = F.concat(
        F.lit(VERSION),
        _lines(("WARC-Type", kind), ("WARC-Record-ID", _urn(F.col("page"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", _safe(F.col("url"))), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))),
        F.when(revisit, _lines(("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _urn(F.col("last"))))).otherwise(F.lit("")),
        _lines(("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", body)),
        F.lit(END),
    )
    typed.select("page", header.alias("header"), http.alias("http"), *same).write.parquet(f"{path}/records")

    # payloads that another page stores, with their page: an id may come again with another payload.
    # Where they are few, the join needs no shuffle of payloads
    spare = materialise(typed.filter("page < last").select("page", *same).distinct(), "spare")
    keyed = rows.select("page", "payload", key.alias("key"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n"))
    stored = keyed.join(spare, ["page", *same], "left_anti")
    again = materialise(light.groupBy("page", *same).agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "again")
    if not again.isEmpty():  # repeated rows of the page that stores a payload
        again = small(again)
        stored = stored.join(again, ["page", *same], "left_anti").unionByName(stored.join(again, ["page", *same], "left_semi").dropDuplicates(same))
    stored.select("key", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    return Archive(path)


def _present(column: str, kind: str) -> Column:
    """``column`` of the stored payload; an error where the record's payload is missing."""
    return F.coalesce(F.col(column), F.raise_error(F.concat(F.lit("no payload is stored for the record of page "), F.regexp_extract("header", r"WARC-Record-ID: (\S+)", 1))).cast(kind))


def read(archive: Archive, spark: SparkSession) -> DataFrame:
    """Per record: what its header says and what its payload is: ``page``, ``payload_bytes``, ``payload_digest``
    (recomputed from the stored bytes), ``record_type``, ``refers_to``, ``intact`` (the two agree)."""
    name = lambda field, value: F.regexp_extract("header", rf"\r\n{field}: {value}\r\n", 1)
    stored = archive.payloads(spark).select("key", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")).distinct()
    told = archive.records(spark).select(
        name("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").alias("id"), name("WARC-Type", "([a-z]+)").alias("record_type"),
        name("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").alias("to"), name("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("told"),
        F.regexp_extract("http", r"Content-Length: ([0-9]+)", 1).alias("size"), "key", "header",
    )
    both = told.join(stored, "key", "left").withColumn("payload_bytes", _present("payload_bytes", "long"))
    return both.select(
        F.nullif("id", F.lit("")).cast("long").alias("page"), "payload_bytes", "payload_digest", "record_type", F.nullif("to", F.lit("")).cast("long").alias("refers_to"),
        ((F.col("told") == F.col("payload_digest")) & (F.col("size").cast("long") == F.col("payload_bytes"))).alias("intact"),
    )


def reconstruct(archive: Archive, spark: SparkSession) -> DataFrame:
    """Per record: ``page`` and ``record``, the bytes of its WARC record as first written."""
    stored = archive.payloads(spark).dropDuplicates(["key"])
    both = archive.records(spark).join(stored, "key", "left").withColumn("payload", _present("payload", "binary"))
    body = F.when(F.col("header").contains("\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return both.select("page", F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), body, F.lit(END.encode())).alias("record"))


def export(archive: Archive, spark: SparkSession, path: str, *, records_per_file: int = 10_000) -> None:
    """Write the records as ``.warc`` files, one after another."""
    whole = reconstruct(archive, spark).select(F.col("record").cast("string").alias("value"))
    # each record already ends in the blank lines that the writer would put between two
    whole.select(F.expr(f"substring(value, 1, length(value) - {len(END)})").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    broken = F.raise_error(F.concat(F.lit("the payload is not that of the record of page "), F.col("page").cast("string")))
    digest = F.when(F.col("intact"), F.col("payload_digest")).otherwise(broken.cast("string"))
    return read(archive, spark).select(F.col("page").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
             max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM q
"""
