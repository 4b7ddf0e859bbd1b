"""The vector index as a table of records (chunk x root), and checks on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, content_hash, record_id
from ..functions.vectors import close, finite

#: Columns that a root gives to a record; repathing changes these only.
ROOT_FIELDS = ("folder_alias", "drive_path", "drive_url", "local_path")


def file_roots(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """(file_id, root_id, folder_alias, drive_path): the first path of a file in each enabled root."""
    first = Window.partitionBy("file_id", "root_id").orderBy("parts")
    one = paths.withColumn("place", F.row_number().over(first)).where("place = 1")
    enabled = folders.where("enabled").select(F.col("folder_id").alias("root_id"), F.col("alias").alias("folder_alias"))
    return one.join(enabled, "root_id").select("file_id", "root_id", "folder_alias", F.array_join("parts", "/").alias("drive_path"))


def build_records(chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """Every chunk of a file under each of the file's roots, with record id and content hash.

    ``chunks``: file_id, revision, chunk_id, locator, text, mime_type, vector;
    ``roots``: file_id, root_id and the root fields that are known.
    """
    fields = [c for c in ROOT_FIELDS if c in roots.columns]
    extra = [c for c in ("mime_type", "vector") if c in chunks.columns]
    return chunks.join(roots, "file_id").select(
        record_id(F.col("chunk_id"), F.col("root_id")).alias("record_id"),
        "chunk_id", "root_id", "file_id", *fields, "locator", "revision",
        content_hash(F.col("text")).alias("content_hash"), *extra, F.col("text").alias("document"),
    )


def record_count(manifest: DataFrame) -> DataFrame:
    """One row: how many records the manifest asks for (active chunks times distinct roots)."""
    roots = F.size(F.array_distinct(F.transform("paths", lambda p: p["root_id"])))
    return manifest.agg(F.coalesce(F.sum(F.size("active_chunk_ids") * roots), F.lit(0)).cast("long").alias("records"))


def file_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("file_id").agg(F.count("*").alias("records"))


def expected_records(manifest: DataFrame) -> DataFrame:
    roots = F.array_distinct(F.transform("paths", lambda p: p["root_id"]))
    return manifest.select("file_id", F.explode("active_chunk_ids").alias("chunk_id"), roots.alias("roots")).select(
        "file_id", "chunk_id", F.explode("roots").alias("root_id")
    )


def consistency_violations(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(chunk_id, root_id, violation): what the manifest asks for against what the index holds."""
    want = expected_records(manifest).select(F.col("chunk_id").alias("c"), F.col("root_id").alias("r"), F.lit(1).alias("wanted")).distinct()
    have = records.groupBy("chunk_id", "root_id").agg(F.count("*").alias("n"))
    met = want.join(have, (F.col("c") == F.col("chunk_id")) & (F.col("r") == F.col("root_id")), "full_outer")
    rule = F.when(F.col("n").isNull(), "record_missing").when(F.col("wanted").isNull(), "record_unexpected").when(F.col("n") > 1, "record_repeated")
    return met.select(F.coalesce("c", "chunk_id").alias("chunk_id"), F.coalesce("r", "root_id").alias("root_id"), rule.alias("violation")).where("violation is not null")


def record_violations(records: DataFrame, dimension: int) -> DataFrame:
    """(record_id, violation): identities recomputed, vectors checked, roots complete."""
    c = F.col
    rules = F.array(
        F.when(c("record_id") != record_id(c("chunk_id"), c("root_id")), "record_id_differs"),
        F.when(~c("chunk_id").startswith(F.concat(c("file_id"), F.lit(":"))), "chunk_id_of_other_file"),
        F.when(c("content_hash") != content_hash(c("document")), "content_hash_differs"),
        F.when(c("document").isNull() | ~c("document").rlike("(?U)[^\\s]"), "document_blank"),
        F.when(F.size("vector") != dimension, "dimension_differs"),
        F.when(~finite(c("vector")), "vector_not_finite"),
    )
    return records.select("record_id", F.explode(F.array_compact(rules)).alias("violation"))


def chunk_id_violations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, violation) of chunks whose id is not that of their content and ordinal."""
    fresh = chunk_id(F.col("file_id"), F.col("revision"), F.col("locator"), F.col("ordinal"), F.col("text"))
    return chunks.where(F.col("chunk_id") != fresh).select("chunk_id", F.lit("chunk_id_differs").alias("violation"))


def vector_disagreements(records: DataFrame) -> DataFrame:
    """(chunk_id) whose records under several roots do not carry the same vector."""
    before = F.lag("vector").over(Window.partitionBy("chunk_id").orderBy("record_id"))
    return records.withColumn("before", before).where(F.col("before").isNotNull() & ~close(F.col("vector"), F.col("before"))).select("chunk_id").distinct()


def changed_vectors(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """(record_id) whose live vector is not that of the snapshot, within tolerance."""
    met = snapshot.select("record_id", F.col("vector").alias("old")).join(live.select("record_id", "vector"), "record_id")
    return met.where(~close(F.col("old"), F.col("vector"))).select("record_id")


def upsert(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fresh records replace all records of their files."""
    return base.join(fresh.select("file_id").distinct(), "file_id", "left_anti").unionByName(fresh)


def stage_upsert(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fresh records beside the old ones; a record of the same id is replaced."""
    return base.join(fresh.select("record_id"), "record_id", "left_anti").unionByName(fresh)


def retire(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Only the records that the manifest asks for."""
    want = expected_records(manifest).select("chunk_id", "root_id").distinct()
    return records.join(want, ["chunk_id", "root_id"], "left_semi")


def delete_files(records: DataFrame, files: DataFrame) -> DataFrame:
    return records.join(files.select("file_id"), "file_id", "left_anti")


def delete_root(records: DataFrame, root_id: str) -> DataFrame:
    return records.where(F.col("root_id") != root_id)


def repath(records: DataFrame, roots: DataFrame) -> DataFrame:
    """The records of the files in ``roots`` under their new roots; text and vector are reused.

    Records of other files stay. One chunk's records are collapsed to one before they
    meet the new roots, so nothing is embedded again.
    """
    fields = [c for c in ROOT_FIELDS if c in roots.columns]
    own = [c for c in records.columns if c not in ("record_id", "root_id", *ROOT_FIELDS)]
    moved = records.join(roots.select("file_id").distinct(), "file_id", "left_semi")
    one = moved.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy("record_id"))).where("place = 1").select(*own)
    fresh = one.join(roots.select("file_id", "root_id", *fields), "file_id").withColumn("record_id", record_id(F.col("chunk_id"), F.col("root_id")))
    stay = records.join(roots.select("file_id").distinct(), "file_id", "left_anti")
    return stay.unionByName(fresh.select(*[c for c in records.columns if c in fresh.columns]), allowMissingColumns=True)


def exact_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookup: the records of ``ids`` (record_id), with a violation row for each id not there exactly once."""
    met = ids.select("record_id").distinct().join(records, "record_id", "left")
    count = F.count("chunk_id").over(Window.partitionBy("record_id"))
    return met.withColumn("violation", F.when(count != 1, F.lit("not_exactly_once")))
