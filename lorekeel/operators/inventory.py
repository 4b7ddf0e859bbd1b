"""Inventory snapshots: validation, merging, planning, name collisions.

All of it is relational: rules are predicates that name their violations, merging is
a grouped aggregation, the plan is one full outer join, collisions are resolved by
set-based rounds.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorpusError
from ..functions.text import rfc3339, suffixed_name
from ..session import settled

#: The MIME form, native types and their kinds, and where a file's address leads.
MIME = "^[A-Za-z0-9][A-Za-z0-9!#$%&'*+.^_`|~-]*/[A-Za-z0-9][A-Za-z0-9!#$%&'*+.^_`|~-]*$"
NATIVE = {
    "application/vnd.google-apps.document": "document",
    "application/vnd.google-apps.spreadsheet": "spreadsheet",
    "application/vnd.google-apps.presentation": "presentation",
}
CONTROL = "\\p{Cc}"


def _blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike("(?U)[^\\s]")


def path_violations(paths: Column, root_ids: Column) -> Column:
    """Names of the path rules that a file breaks."""

    def any_path(test) -> Column:
        return F.coalesce(F.exists(paths, test), F.lit(False))

    unsafe_part = lambda p: _blank(p) | p.isin(".", "..") | p.contains("/") | p.contains("\\") | p.rlike(CONTROL)
    return F.array_compact(
        F.array(
            F.when(paths.isNull() | (F.size(paths) == 0), "paths_missing"),
            F.when(any_path(lambda p: ~F.array_contains(root_ids, p["root_id"])), "root_unknown"),
            F.when(any_path(lambda p: (F.size(p["parent_ids"]) == 0) | (F.get(p["parent_ids"], F.lit(0)) != p["root_id"])), "parents_do_not_start_at_root"),
            F.when(any_path(lambda p: F.size(p["parts"]) == 0), "parts_missing"),
            F.when(any_path(lambda p: F.exists(p["parts"], unsafe_part)), "part_unsafe"),
        )
    )


def file_violations(files: DataFrame, root_ids: list[str]) -> DataFrame:
    """(file_id, violation), one row for each rule that a remote file breaks."""
    c = F.col
    kind = F.create_map(*[F.lit(x) for pair in NATIVE.items() for x in pair])
    expected = F.get(F.array(F.try_element_at(kind, c("mime_type"))), F.lit(0))
    rules = F.array(
        F.when(_blank(c("file_id")), "file_id_blank"),
        F.when(_blank(c("name")), "name_blank"),
        F.when(_blank(c("revision")), "revision_blank"),
        F.when(c("mime_type").isNull() | ~c("mime_type").rlike(MIME), "mime_type_malformed"),
        F.when(rfc3339(c("modified_time")).isNull(), "modified_time_malformed"),
        F.when(c("checksum").isNotNull() & ~c("checksum").rlike("^[0-9a-f]{32}$"), "checksum_malformed"),
        F.when(c("size") < 0, "size_negative"),
        F.when(c("native_kind").isNotNull() & ~c("native_kind").isin(*NATIVE.values()), "native_kind_unknown"),
        F.when(~expected.eqNullSafe(c("native_kind")), "native_kind_does_not_match_mime_type"),
        F.when(~F.coalesce(c("drive_url").rlike("^https://[^/?#@]+/") & c("drive_url").contains(c("file_id")), F.lit(False)), "drive_url_malformed"),
    )
    roots = F.array(*[F.lit(r) for r in root_ids]).cast("array<string>")
    every = F.concat(F.array_compact(rules), path_violations(c("paths"), roots))
    return files.select("file_id", F.explode(every).alias("violation"))


def manifest_violations(files: DataFrame) -> DataFrame:
    """(file_id, violation) of committed manifest rows."""
    c = F.col
    scoped = F.forall("active_chunk_ids", lambda x: x.rlike("^.+:[0-9a-f]{64}$") & (F.substring_index(x, ":", -1) != x))
    rules = F.array(
        F.when(_blank(c("file_id")), "file_id_blank"),
        F.when(_blank(c("revision")), "revision_blank"),
        F.when(~F.coalesce(c("index_status").isin("indexed", "unindexed"), F.lit(False)), "index_status_unknown"),
        F.when((c("index_status") == "indexed") & c("index_reason").isNotNull(), "indexed_with_reason"),
        F.when((c("index_status") == "unindexed") & ~F.coalesce(c("index_reason").isin("UNSUPPORTED_FORMAT", "EXTRACTION_LIMIT_EXCEEDED"), F.lit(False)), "reason_unknown"),
        F.when((c("index_status") == "unindexed") & (F.size("active_chunk_ids") > 0), "unindexed_with_chunks"),
        F.when(~F.coalesce(scoped, F.lit(False)), "chunk_id_malformed"),
        F.when(F.exists("active_chunk_ids", lambda x: ~x.startswith(F.concat(c("file_id"), F.lit(":")))), "chunk_id_of_other_file"),
        F.when(F.size(F.array_distinct("active_chunk_ids")) != F.size("active_chunk_ids"), "chunk_id_repeated"),
    )
    return files.select("file_id", F.explode(F.array_compact(rules)).alias("violation"))


def key_violations(raw: DataFrame, shape: T.StructType, column: str = "value") -> DataFrame:
    """(place, violation) of JSON objects whose keys are not exactly those of ``shape``, in objects of its arrays too.

    Missing and unexpected keys are named. A level's objects are looked at as text, so
    a key that the declared schema does not know is seen and not dropped.
    """
    found = []

    def look(objects: DataFrame, fields: T.StructType, place: str) -> None:
        wanted, keys = F.array(*[F.lit(n) for n in fields.fieldNames()]), F.json_object_keys("o")
        named = lambda what, some: F.when(F.size(some) > 0, F.concat(F.lit(f"{what} keys: "), F.array_join(F.array_sort(some), ", ")))
        rules = F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(named("missing", F.array_except(wanted, keys)), named("unexpected", F.array_except(keys, wanted)))))
        found.append(objects.select(F.lit(place).alias("place"), F.explode(rules).alias("violation")))
        for field in fields:
            if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
                items = F.from_json("o", f"struct<`{field.name}`:array<string>>")[field.name]
                look(objects.select(F.explode(items).alias("o")), field.dataType.elementType, f"{place}.{field.name}")

    look(raw.select(F.col(column).alias("o")), shape, "inventory")
    return functools.reduce(DataFrame.unionByName, found)


def header_violations(heads: DataFrame) -> DataFrame:
    """(run_id, violation) of snapshot headers (run_id, complete, root_ids, generated_at, incomplete_reason)."""
    c = F.col
    rules = F.array(
        F.when(_blank(c("run_id")), "run_id_blank"),
        F.when(c("complete").isNull(), "complete_missing"),
        F.when(rfc3339(c("generated_at")).isNull(), "generated_at_malformed"),
        F.when(c("root_ids").isNull() | F.exists("root_ids", lambda r: _blank(r) | r.rlike(CONTROL)), "root_id_malformed"),
        F.when(F.size(F.array_distinct("root_ids")) != F.size("root_ids"), "root_id_repeated"),
        F.when(c("complete") & c("incomplete_reason").isNotNull(), "complete_with_reason"),
        F.when(~c("complete") & _blank(c("incomplete_reason")), "incomplete_without_reason"),
    )
    return heads.select("run_id", F.explode(F.array_compact(rules)).alias("violation"))


def require_none(violations: DataFrame, code: str) -> None:
    """Stop with a typed error that names a few violations, if there are any."""
    if some := violations.limit(5).collect():
        raise CorpusError("; ".join(f"{r[0]}: {r[1]}" for r in some), code)


def require_scope(root_ids: list[str], expected: list[str]) -> None:
    if set(root_ids) != set(expected):
        raise CorpusError("the snapshot's roots are not the expected ones", "INVENTORY_INCOMPLETE")


def require_complete(complete: bool, root_ids: list[str], expected: list[str], reason: str | None = None) -> None:
    """Completeness proof: only such a snapshot may delete."""
    if not complete:
        raise CorpusError(f"the snapshot is not complete: {reason or 'no reason given'}", "INVENTORY_INCOMPLETE")
    require_scope(root_ids, expected)


def require_newer(spark, generated_at: str, last: str | None) -> None:
    """The snapshot must be strictly newer than the last one committed."""
    row = spark.range(1).select(rfc3339(F.lit(generated_at)).alias("now"), rfc3339(F.lit(last).cast("string")).alias("before")).first()
    if row["now"] is None:
        raise CorpusError("generated_at is no RFC 3339 UTC time", "INVALID_INVENTORY")
    if last is not None and (row["before"] is None or row["now"] <= row["before"]):
        raise CorpusError("the snapshot is not newer than the last committed one", "INVENTORY_INCOMPLETE")


_ATTRIBUTES = ("name", "mime_type", "revision", "modified_time", "drive_url", "checksum", "size", "native_kind")


def merge_files(files: DataFrame) -> DataFrame:
    """One row for each file_id: paths united, distinct and sorted; ``conflict`` where other attributes differ."""
    kept = [a for a in _ATTRIBUTES if a in files.columns]
    attributes = F.struct(*[F.col(a) for a in kept])
    grouped = files.groupBy("file_id").agg(
        F.min(attributes).alias("low"),
        F.max(attributes).alias("high"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths"),
    )
    return grouped.select("file_id", *[F.col(f"low.{a}").alias(a) for a in kept], "paths", (F.col("low") != F.col("high")).alias("conflict"))


def plan_sync(current: DataFrame, manifest: DataFrame, complete: bool) -> DataFrame:
    """(file_id, action): download, unchanged, and delete where the snapshot is complete.

    A file is unchanged if revision and checksum are the committed ones, nulls being
    equal. One full outer join; both sides have one row for each file.
    """
    now = current.select("file_id", F.struct("revision", "checksum").alias("new"))
    was = manifest.select(F.col("file_id").alias("old_id"), F.struct("revision", "checksum").alias("old"))
    met = now.join(was, F.col("file_id") == F.col("old_id"), "full_outer" if complete else "left")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNotNull() & F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("download")
    return met.select(F.coalesce("file_id", "old_id").alias("file_id"), action.alias("action"))


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("files"))


def resolve_collisions(paths: DataFrame, rename=None) -> DataFrame:
    """(file_id, root_id, parts, target_parts): every target of a root belongs to one file.

    ``paths`` has file_id, root_id, parts. Files that share a place get a suffix of
    their id before the extension; should that meet another file's name, that one
    gets its own too, and so on until nothing collides: every round suffixes a file
    more, so there is an end. A round is one window over the targets. Two targets of one file that fall together are an error. ``rename``
    maps a part before it is placed (the rendered names of native files).
    """
    last = F.element_at("parts", -1)
    base = paths.select("file_id", "root_id", "parts", *([c for c in ("native_kind",) if c in paths.columns])).distinct()
    base = base.withColumn("plain", rename(last) if rename is not None else last)
    place = lambda name: F.concat(F.slice("parts", F.lit(1), F.size("parts") - 1), F.array(name))
    with_suffix = place(suffixed_name(F.col("plain"), F.col("file_id")))
    now = base.withColumn("target_parts", place(F.col("plain"))).withColumn("suffixed", F.lit(False))
    at = Window.partitionBy("root_id", "target_parts")
    while True:
        seen = now.withColumn("lowest", F.min("file_id").over(at)).withColumn("highest", F.max("file_id").over(at)).withColumn("n", F.count("*").over(at))
        seen = seen.withColumn("clash", F.col("n") > 1)
        state = seen.agg(
            F.count_if("clash").alias("clashes"),
            F.count_if(F.col("clash") & ((F.col("lowest") == F.col("highest")) & F.col("suffixed"))).alias("own"),
            F.count_if(F.col("clash") & ~F.col("suffixed")).alias("open"),
        ).first()
        if not state["clashes"]:
            return now.select("file_id", "root_id", "parts", "target_parts")
        if state["own"] or not state["open"]:
            raise CorpusError("names still collide after suffixing", "INVALID_INVENTORY")
        moved = seen.select(
            *[c for c in now.columns if c not in ("target_parts", "suffixed")],
            F.when(F.col("clash"), with_suffix).otherwise(F.col("target_parts")).alias("target_parts"),
            (F.col("suffixed") | F.col("clash")).alias("suffixed"),
        )
        now = settled(moved)


def first_collision_names(paths: DataFrame) -> DataFrame:
    """(file_id, root_id, name, target_name): the first round alone, for one-part paths."""
    at = Window.partitionBy("root_id", "parts")
    shared = paths.withColumn("shared", F.min("file_id").over(at) != F.max("file_id").over(at))
    name = F.element_at("parts", -1)
    return shared.select("file_id", "root_id", name.alias("name"), F.when(F.col("shared"), suffixed_name(name, F.col("file_id"))).otherwise(name).alias("target_name"))


def target_manifest(base: DataFrame, observed: DataFrame, complete: bool) -> DataFrame:
    """Manifest rows after a run: what was observed, and, unless complete, the rest of the base."""
    if complete:
        return observed
    return base.join(observed.select("file_id"), "file_id", "left_anti").unionByName(observed)


def chunk_lists(chunks: DataFrame) -> DataFrame:
    """(file_id, active_chunk_ids): the chunk ids of each file in order of their ordinal."""
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id")))
    return chunks.groupBy("file_id").agg(F.transform(pairs, lambda x: x["chunk_id"]).alias("active_chunk_ids"))


def artifact_violations(downloads: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(file_id, violation): downloads and artifacts must match one to one, revisions included.

    With the columns native_kind and structured_path at hand, a native download needs a
    structured file and others must have none, and no file may serve two artifacts.
    """
    routed = "native_kind" in downloads.columns and "structured_path" in artifacts.columns
    extra = [F.min("structured_path").alias("structured")] if routed else []
    many = artifacts.groupBy("file_id").agg(F.count("*").alias("n"), F.min("revision").alias("revision"), F.min("payload_sha256").alias("sha"), *extra)
    kind = [F.col("native_kind").alias("kind")] if routed else []
    met = downloads.select("file_id", F.col("revision").alias("wanted"), *kind).join(many, "file_id", "full_outer")
    both = F.col("wanted").isNotNull() & F.col("n").isNotNull()
    rules = [
        F.when(F.col("n").isNull(), "artifact_missing"),
        F.when(F.col("wanted").isNull(), "artifact_unexpected"),
        F.when(F.col("n") > 1, "artifact_repeated"),
        F.when(both & (F.col("wanted") != F.col("revision")), "revision_differs"),
        F.when(F.col("n").isNotNull() & ~F.coalesce(F.col("sha").rlike("^[0-9a-f]{64}$"), F.lit(False)), "payload_sha256_malformed"),
    ]
    if not routed:
        return met.select("file_id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))
    rules += [
        F.when(both & F.col("kind").isNotNull() & F.col("structured").isNull(), "structured_file_missing"),
        F.when(both & F.col("kind").isNull() & F.col("structured").isNotNull(), "structured_file_unexpected"),
    ]
    places = artifacts.select("file_id", F.explode(F.array_compact(F.array("payload_path", "structured_path"))).alias("path"))
    shared = places.groupBy("path").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id")).where("n > 1")
    found = met.select("file_id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))
    return found.unionByName(shared.select("file_id", F.lit("path_repeated").alias("violation")))


def inventory_counts(files: DataFrame) -> DataFrame:
    """One row: roots that files lie under, and distinct files."""
    placed = files.select("file_id", F.explode_outer("paths").alias("p"))
    return placed.agg(F.count_distinct("p.root_id").alias("roots"), F.count_distinct("file_id").alias("files"))


def status_summary(manifest: DataFrame) -> DataFrame:
    """One row: files, indexed, unindexed, distinct active chunks."""
    chunks = manifest.select(F.explode("active_chunk_ids").alias("c")).agg(F.count_distinct("c").alias("chunks"))
    counts = manifest.agg(F.count("*").alias("files"), F.count_if(F.col("index_status") == "indexed").alias("indexed"), F.count_if(F.col("index_status") == "unindexed").alias("unindexed"))
    return counts.join(chunks, F.lit(True))  # one row each


def unindexed_reasons(manifest: DataFrame) -> DataFrame:
    return manifest.where("index_status = 'unindexed'").groupBy("index_reason").agg(F.count("*").alias("files"))
