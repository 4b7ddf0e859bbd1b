"""The test tables seen as a corpus: files, manifests, sheets, payloads, index records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_id(number: str = "doc_id") -> Column:
    return F.concat(F.lit("doc-"), F.col(number).cast("string"))


def remote_files(documents: DataFrame) -> DataFrame:
    """One text file for each document; its source is its root."""
    path = F.struct(
        F.coalesce("source", F.lit("none")).alias("root_id"),
        F.array(F.coalesce("source", F.lit("none"))).alias("parent_ids"),
        F.array(F.coalesce("lang", F.lit("xx")), F.concat(file_id(), F.lit(".txt"))).alias("parts"),
    )
    body = F.coalesce("text", F.lit(""))
    return documents.select(
        file_id().alias("file_id"), F.concat(file_id(), F.lit(".txt")).alias("name"), F.lit("text/plain").alias("mime_type"), F.lit("1").alias("revision"),
        F.lit("2024-01-01T00:00:00Z").alias("modified_time"), F.concat(F.lit("https://files.example.org/d/"), file_id()).alias("drive_url"),
        F.md5(body).alias("checksum"), F.octet_length(body).cast("long").alias("size"), F.array(path).alias("paths"), F.lit(None).cast("string").alias("native_kind"), "doc_id",
    )


def inventory_now(documents: DataFrame) -> DataFrame:
    """The snapshot: all files but those whose number is divisible by 13."""
    return remote_files(documents).where("doc_id % 13 <> 0")


def manifest_before(documents: DataFrame) -> DataFrame:
    """The committed rows: without each tenth file, and with another checksum for each seventh."""
    rows = remote_files(documents).where("doc_id % 10 <> 0")
    return rows.withColumn("checksum", F.when(F.col("doc_id") % 7 == 0, F.md5(F.lit("before"))).otherwise(F.col("checksum")))


def manifest_rows(documents: DataFrame) -> DataFrame:
    """Committed manifest rows with chunk ids: one chunk for a file, none for those that stay unindexed."""
    status = F.when(F.col("doc_id") % 11 == 0, "unindexed").otherwise("indexed")
    reason = F.when(F.col("doc_id") % 11 != 0, F.lit(None).cast("string")).when(F.col("doc_id") % 2 == 0, "UNSUPPORTED_FORMAT").otherwise("EXTRACTION_LIMIT_EXCEEDED")
    chunk = F.concat("file_id", F.lit(":"), F.sha2("file_id", 256))
    ids = F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(chunk))
    return remote_files(documents).select(
        "file_id", "revision", "checksum", "paths", ids.alias("active_chunk_ids"), "native_kind", status.alias("index_status"), reason.alias("index_reason"), "doc_id"
    )


def index_records(embeddings: DataFrame, roots: int = 1) -> DataFrame:
    """Pre-embedded records: a chunk for each vector, its label as root; with two roots, a copy under the next label."""
    chunk = F.concat(F.lit("vec-"), F.col("vec_id").cast("string"))
    base = embeddings.select(F.col("vec_id"), "label", F.col("embedding").alias("vector"), F.explode(F.sequence(F.lit(0), F.lit(roots - 1))).alias("copy"))
    root = F.concat(F.lit("root-"), ((F.col("label") + F.col("copy")) % 10).cast("string"))
    text = F.concat(F.lit("vector "), F.col("vec_id").cast("string"))
    return base.select(
        F.to_json(F.array(chunk, root)).alias("record_id"), chunk.alias("chunk_id"), root.alias("root_id"), chunk.alias("file_id"), root.alias("folder_alias"),
        F.concat(root, F.lit("/"), chunk, F.lit(".txt")).alias("drive_path"), F.concat(F.lit("https://files.example.org/d/"), chunk).alias("drive_url"),
        F.concat(F.lit("mirror/"), root, F.lit("/"), chunk).alias("local_path"), F.lit("text:1").alias("locator"), F.lit("1").alias("revision"),
        F.sha2(text, 256).alias("content_hash"), F.lit("text/plain").alias("mime_type"), text.alias("document"), "vector", "vec_id",
    )


def question_vector(embeddings: DataFrame, vec_id: int = 0) -> list[float]:
    """The stored vector of one record, as a question; one row reaches the driver."""
    row = embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []
