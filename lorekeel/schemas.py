"""Declared schemas of the data model; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1"


_PLAIN = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "binary": T.BinaryType()}


def _split(text: str) -> list[str]:
    """Pieces between the commas outside of any brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _type(text: str) -> T.DataType:
    kind, _, inner = text.strip().partition("<")
    if not inner:
        return _PLAIN[kind]
    parts = _split(inner[:-1])
    if kind == "array":
        return T.ArrayType(_type(parts[0]))
    if kind == "map":
        return T.MapType(_type(parts[0]), _type(parts[1]))
    return T.StructType([T.StructField(name.strip(), _type(rest)) for name, _, rest in (p.partition(":") for p in parts)])


def struct(ddl: str) -> T.StructType:
    """A schema from ``name type, …``; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _type(rest)) for name, _, rest in (p.partition(" ") for p in _split(ddl))])


PATH = "struct<root_id:string,parent_ids:array<string>,parts:array<string>>"
FOLDERS = struct("folder_id string, url string, alias string, enabled boolean")
REMOTE_FILES = struct(
    f"file_id string, name string, mime_type string, revision string, modified_time string, drive_url string, "
    f"checksum string, size long, paths array<{PATH}>, native_kind string"
)
INVENTORY = struct(
    "schema_version string, run_id string, complete boolean, root_ids array<string>, "
    "files array<struct<file_id:string,name:string,mime_type:string,revision:string,modified_time:string,drive_url:string,"
    f"checksum:string,size:long,paths:array<{PATH}>,native_kind:string>>, incomplete_reason string, generated_at string"
)
MANIFEST_FILES = struct(
    f"file_id string, revision string, checksum string, object_sha256 string, paths array<{PATH}>, "
    "active_chunk_ids array<string>, native_kind string, index_status string, index_reason string"
)
ARTIFACTS = struct("file_id string, revision string, payload_path string, payload_sha256 string, structured_path string")
BLOCKS = struct("file_id string, revision string, block_pos int, locator string, text string, metadata map<string,string>")
CHUNKS = struct("file_id string, revision string, ordinal int, chunk_id string, locator string, text string, metadata map<string,string>")
INDEX_RECORDS = struct(
    "record_id string, chunk_id string, root_id string, file_id string, folder_alias string, drive_path string, drive_url string, "
    "local_path string, locator string, revision string, content_hash string, mime_type string, document string, vector array<float>"
)
EVIDENCE = struct(
    "excerpt string, file_id string, file_name string, folder_alias string, drive_path string, drive_url string, local_path string, "
    "locator string, revision string, content_hash string, mime_type string, distance double"
)

#: Index states of a file and the native kinds.
INDEX_STATUSES = ("indexed", "unindexed")
NATIVE_KINDS = ("document", "spreadsheet", "presentation")
PHASES = ("planned", "verified", "indexed", "promoted", "deleted", "activating", "committed")
