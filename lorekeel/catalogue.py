"""All registered queries of the engine, with their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as fx
from .functions.vectors import close, cosine_distance, literal
from .operators import chunking, embedding, index, inventory, retrieve
from .plans import projection as P
from .sources import native, tabular
from .sources import text as text_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


# Retrieval

_DIST = "round(greatest(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0.0), 6)"


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", "root_id", F.round("distance", 6).alias("distance"))


@query(f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
d AS (SELECT 'vec-' || e.vec_id AS chunk_id, 'root-' || (e.label % 10) AS root_id, '["vec-' || e.vec_id || '","root-' || (e.label % 10) || '"]' AS record_id,
      greatest(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0.0) AS dist FROM embeddings e, q),
k AS (SELECT * FROM d ORDER BY dist, record_id LIMIT 32)
SELECT chunk_id, root_id, round(dist, 6) AS distance FROM k WHERE dist <= 0.8 ORDER BY dist, record_id LIMIT 8""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    near = retrieve.nearest(P.index_records(e), P.question_vector(e))
    return _ranked(retrieve.evidence(near, threshold=0.8))


@query("""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
d AS (SELECT 'vec-' || e.vec_id AS chunk_id, 'root-' || (e.label % 10) AS root_id, '["vec-' || e.vec_id || '","root-' || (e.label % 10) || '"]' AS record_id,
      greatest(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0.0) AS dist FROM embeddings e, q WHERE e.label % 10 IN (0, 1, 2)),
k AS (SELECT * FROM d ORDER BY dist, record_id LIMIT 32)
SELECT chunk_id, root_id, round(dist, 6) AS distance FROM k WHERE dist <= 0.9 ORDER BY dist, record_id LIMIT 8""")
def vector_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    roots = ["root-0", "root-1", "root-2"]
    near = retrieve.require_scope(retrieve.nearest(P.index_records(e), P.question_vector(e), roots), roots)
    return _ranked(retrieve.evidence(near, threshold=0.9))


@query("""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
r AS (SELECT 'vec-' || e.vec_id AS chunk_id, 'root-' || ((e.label + c.copy) % 10) AS root_id, e.embedding FROM embeddings e, (VALUES (0), (1)) c(copy)),
d AS (SELECT chunk_id, root_id, '["' || chunk_id || '","' || root_id || '"]' AS record_id,
      greatest(list_cosine_distance(r.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0.0) AS dist FROM r, q),
k AS (SELECT * FROM d ORDER BY dist, record_id LIMIT 32),
b AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY dist, record_id) AS place FROM k)
SELECT chunk_id, root_id, round(dist, 6) AS distance FROM b WHERE place = 1 AND dist <= 1.0 ORDER BY dist, record_id LIMIT 8""")
def vector_topk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    return _ranked(retrieve.evidence(retrieve.nearest(P.index_records(e, roots=2), P.question_vector(e)), threshold=1.0, limit=99))


@query("""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
d AS (SELECT 'vec-' || e.vec_id AS chunk_id, '["vec-' || e.vec_id || '","root-' || (e.label % 10) || '"]' AS record_id, 'root-' || (e.label % 10) AS root_id,
      greatest(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0.0) AS dist FROM embeddings e, q),
k AS (SELECT * FROM d ORDER BY dist, record_id LIMIT 32)
SELECT chunk_id, root_id, round(dist, 6) AS distance FROM k WHERE dist <= 0.45 ORDER BY dist, record_id LIMIT 8""")
def vector_threshold_045(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    return _ranked(retrieve.evidence(retrieve.nearest(P.index_records(e), P.question_vector(e))))


@query("""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
d AS (SELECT 'vec-' || e.vec_id AS f, 'root-' || (e.label % 10) AS r, '["vec-' || e.vec_id || '","root-' || (e.label % 10) || '"]' AS record_id, 'vector ' || e.vec_id AS doc,
      greatest(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0.0) AS dist FROM embeddings e, q),
k AS (SELECT * FROM d ORDER BY dist, record_id LIMIT 32)
SELECT left(doc, 1000) AS excerpt, f AS file_id, f || '.txt' AS file_name, r AS folder_alias, r || '/' || f || '.txt' AS drive_path,
  'https://files.example.org/d/' || f AS drive_url, 'mirror/' || r || '/' || f AS local_path, 'text:1' AS locator, '1' AS revision,
  sha256(doc) AS content_hash, 'text/plain' AS mime_type, round(dist, 6) AS distance
FROM k WHERE dist <= 0.8 ORDER BY dist, record_id LIMIT 8""")
def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    rows = retrieve.evidence(retrieve.nearest(P.index_records(e), P.question_vector(e)), threshold=0.8)
    return retrieve.cited(rows).withColumn("distance", F.round("distance", 6))


@query(f"""SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(cosine_distance(F.col("embedding"), literal(P.question_vector(e))), 6).alias("distance"))


_HASHED = """
w AS (SELECT id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM src),
c AS (SELECT id, ('0x' || left(md5(w), 8))::BIGINT % 256 AS dim, count(*)::DOUBLE AS n FROM w WHERE w <> '' GROUP BY 1, 2),
l AS (SELECT id, sqrt(sum(n * n)) AS length FROM c GROUP BY id),
v AS (SELECT c.id, c.dim, c.n / l.length AS value FROM c JOIN l USING (id))"""


@query(f"""WITH src AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {_HASHED}
SELECT id, dim, round(value, 6) AS value FROM v""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return embedding.sparse_hash_vectors(docs).withColumn("value", F.round("value", 6))


@query(f"""WITH src AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'q' || item_id, coalesce(text, '') FROM benchmark), {_HASHED},
n AS (SELECT q.id AS question_id, p.id AS chunk_id, round(greatest(1 - sum(q.value * p.value), 0.0), 9) AS distance
  FROM v q JOIN v p ON q.dim = p.dim WHERE q.id LIKE 'q%' AND p.id LIKE 'd%' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS place FROM n)
SELECT question_id, chunk_id, round(distance, 6) AS distance, place FROM r WHERE place <= 8 AND distance <= 0.45""")
def retrieve_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = P.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = retrieve.sparse_retrieve(embedding.sparse_hash_vectors(docs), embedding.sparse_hash_vectors(asked), 256)
    return found.withColumn("distance", F.round("distance", 6))


# Snapshots, plans, manifests

_NOW = "now AS (SELECT 'doc-' || doc_id AS file_id, md5(coalesce(text, '')) AS checksum FROM documents WHERE doc_id % 13 <> 0)"
_WAS = "was AS (SELECT 'doc-' || doc_id AS file_id, CASE WHEN doc_id % 7 = 0 THEN md5('before') ELSE md5(coalesce(text, '')) END AS checksum FROM documents WHERE doc_id % 10 <> 0)"
_ACTION = "CASE WHEN now.file_id IS NULL THEN 'delete' WHEN was.file_id IS NOT NULL AND now.checksum = was.checksum THEN 'unchanged' ELSE 'download' END"
_PLAN = f"plan AS (SELECT coalesce(now.file_id, was.file_id) AS file_id, {_ACTION} AS action FROM now FULL JOIN was ON now.file_id = was.file_id)"


def _plan(spark: SparkSession, sf_dir: str, complete: bool) -> DataFrame:
    docs = P.table(spark, sf_dir, "documents")
    return inventory.plan_sync(P.inventory_now(docs), P.manifest_before(docs), complete)


@query(f"WITH {_NOW}, {_WAS}, {_PLAN} SELECT file_id, action FROM plan")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, True)


@query(f"WITH {_NOW}, {_WAS}, {_PLAN} SELECT file_id, action FROM plan WHERE action <> 'delete'")
def sync_plan_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, False)


@query(f"WITH {_NOW}, {_WAS}, {_PLAN} SELECT action, count(*) AS files FROM plan GROUP BY action")
def sync_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.plan_counts(_plan(spark, sf_dir, True))


@query("""
WITH p AS (SELECT 'doc-' || (doc_id % 100) AS file_id, coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/doc-' || doc_id || '.txt' AS path FROM documents)
SELECT file_id, string_agg(DISTINCT path, '|' ORDER BY path) AS paths, count(DISTINCT path) AS n_paths FROM p GROUP BY file_id""")
def merge_duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = P.remote_files(P.table(spark, sf_dir, "documents"))
    again = files.withColumn("file_id", F.concat(F.lit("doc-"), (F.col("doc_id") % 100).cast("string")))
    for same in ("name", "checksum", "drive_url"):
        again = again.withColumn(same, F.lit("same"))
    merged = inventory.merge_files(again.drop("size").unionByName(again.drop("size")))
    shown = F.array_sort(F.transform("paths", lambda p: F.concat_ws("/", p["root_id"], F.array_join(p["parts"], "/"))))
    return merged.select("file_id", F.array_join(shown, "|").alias("paths"), F.size("paths").cast("long").alias("n_paths"))


@query("""
WITH p AS (SELECT 'doc-' || doc_id AS file_id, coalesce(source, 'none') AS root_id, 'note.' || (doc_id % 7) || '.txt' AS name FROM documents),
o AS (SELECT *, min(file_id) OVER w <> max(file_id) OVER w AS shared FROM p WINDOW w AS (PARTITION BY root_id, name))
SELECT file_id, root_id, name,
  CASE WHEN shared THEN left(name, length(name) - 4) || '__' || left(sha256(file_id), 8) || '.txt' ELSE name END AS target_name FROM o""")
def collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("note."), (F.col("doc_id") % 7).cast("string"), F.lit(".txt"))
    docs = P.table(spark, sf_dir, "documents").select(P.file_id().alias("file_id"), F.coalesce("source", F.lit("none")).alias("root_id"), F.array(name).alias("parts"))
    found = inventory.resolve_collisions(docs)
    return found.select("file_id", "root_id", F.element_at("parts", -1).alias("name"), F.element_at("target_parts", -1).alias("target_name"))


_BAD_FILE = """
  CASE WHEN doc_id % 5 = 0 THEN 'size_negative' END, CASE WHEN doc_id % 6 = 0 THEN 'mime_type_malformed' END,
  CASE WHEN doc_id % 9 = 0 THEN 'checksum_malformed' END, CASE WHEN doc_id % 14 = 0 THEN 'modified_time_malformed' END,
  CASE WHEN doc_id % 17 = 0 THEN 'native_kind_does_not_match_mime_type' END, CASE WHEN doc_id % 19 = 0 THEN 'part_unsafe' END"""


@query(f"""
SELECT file_id, violation FROM (SELECT 'doc-' || doc_id AS file_id, unnest([{_BAD_FILE}]) AS violation FROM documents) WHERE violation IS NOT NULL""")
def validate_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.table(spark, sf_dir, "documents")
    files = P.remote_files(docs)
    broken = (
        files.withColumn("size", F.when(F.col("doc_id") % 5 == 0, F.lit(-1)).otherwise(F.col("size")))
        .withColumn("mime_type", F.when(F.col("doc_id") % 6 == 0, "text plain").otherwise(F.col("mime_type")))
        .withColumn("checksum", F.when(F.col("doc_id") % 9 == 0, "abc").otherwise(F.col("checksum")))
        .withColumn("modified_time", F.when(F.col("doc_id") % 14 == 0, "2024-01-01").otherwise(F.col("modified_time")))
        .withColumn("native_kind", F.when(F.col("doc_id") % 17 == 0, "document").otherwise(F.col("native_kind")))
        .withColumn("paths", F.transform("paths", lambda p: F.struct(p["root_id"].alias("root_id"), p["parent_ids"].alias("parent_ids"), F.when(F.col("doc_id") % 19 == 0, F.array(F.lit(".."))).otherwise(p["parts"]).alias("parts"))))
    )
    roots = [r[0] for r in files.select(F.explode("paths").alias("p")).select("p.root_id").distinct().collect()]
    return inventory.file_violations(broken, roots)


@query("""
WITH m AS (SELECT doc_id % 11 <> 0 AS ok, doc_id FROM documents)
SELECT count(*) AS files, count(*) FILTER (ok) AS indexed, count(*) FILTER (NOT ok) AS unindexed, count(DISTINCT doc_id) FILTER (ok) AS chunks FROM m""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.status_summary(P.manifest_rows(P.table(spark, sf_dir, "documents")))


@query("""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'UNSUPPORTED_FORMAT' ELSE 'EXTRACTION_LIMIT_EXCEEDED' END AS index_reason, count(*) AS files
FROM documents WHERE doc_id % 11 = 0 GROUP BY 1""")
def unindexed_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.unindexed_reasons(P.manifest_rows(P.table(spark, sf_dir, "documents")))


@query(f"""WITH {_NOW}, {_WAS}
SELECT file_id, checksum FROM now UNION ALL SELECT file_id, checksum FROM was WHERE file_id NOT IN (SELECT file_id FROM now)""")
def target_manifest_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.table(spark, sf_dir, "documents")
    return inventory.target_manifest(P.manifest_before(docs), P.inventory_now(docs), complete=False).select("file_id", "checksum")


@query("""
SELECT 'doc-' || doc_id AS file_id, CASE WHEN doc_id % 8 = 0 THEN 'artifact_missing' WHEN doc_id % 12 = 5 THEN 'revision_differs' ELSE 'artifact_repeated' END AS violation
FROM documents WHERE doc_id % 8 = 0 OR doc_id % 12 = 5 OR doc_id % 15 = 2
UNION ALL SELECT 'doc-' || doc_id, 'artifact_repeated' FROM documents WHERE doc_id % 8 <> 0 AND doc_id % 12 = 5 AND doc_id % 15 = 2""")
def artifact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = P.remote_files(P.table(spark, sf_dir, "documents"))
    got = files.where("doc_id % 8 <> 0").select("doc_id", "file_id", F.when(F.col("doc_id") % 12 == 5, "0").otherwise(F.col("revision")).alias("revision"), F.sha2("file_id", 256).alias("payload_sha256"))
    twice = got.unionByName(got.where("doc_id % 15 = 2"))
    return inventory.artifact_violations(files, twice)


@query("SELECT count(DISTINCT coalesce(source, 'none')) AS roots, count(DISTINCT doc_id) AS files FROM documents WHERE doc_id % 13 <> 0")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory_counts(P.inventory_now(P.table(spark, sf_dir, "documents")))


@query("""
WITH m AS (SELECT doc_id, 'doc-' || doc_id AS file_id, doc_id % 11 = 0 AS out FROM documents)
SELECT file_id, 'revision_blank' AS violation FROM m WHERE doc_id % 5 = 0
UNION ALL SELECT file_id, 'index_status_unknown' FROM m WHERE doc_id % 7 = 0
UNION ALL SELECT file_id, 'indexed_with_reason' FROM m WHERE doc_id % 7 <> 0 AND NOT out AND doc_id % 4 = 0
UNION ALL SELECT file_id, 'reason_unknown' FROM m WHERE doc_id % 7 <> 0 AND out AND doc_id % 4 = 0
UNION ALL SELECT file_id, 'unindexed_with_chunks' FROM m WHERE doc_id % 7 <> 0 AND out AND doc_id % 6 = 0
UNION ALL SELECT file_id, 'chunk_id_malformed' FROM m WHERE doc_id % 6 = 0
UNION ALL SELECT file_id, 'chunk_id_of_other_file' FROM m WHERE doc_id % 6 = 0
UNION ALL SELECT file_id, 'chunk_id_repeated' FROM m WHERE doc_id % 9 = 0 AND doc_id % 6 <> 0 AND NOT out""")
def validate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = P.manifest_rows(P.table(spark, sf_dir, "documents")), F.col("doc_id")
    ids = F.when(n % 6 == 0, F.array(F.lit("other:x"))).when(n % 9 == 0, F.concat("active_chunk_ids", "active_chunk_ids")).otherwise(F.col("active_chunk_ids"))
    broken = rows.withColumns({
        "active_chunk_ids": ids,
        "revision": F.when(n % 5 == 0, " ").otherwise(F.col("revision")),
        "index_status": F.when(n % 7 == 0, "done").otherwise(F.col("index_status")),
        "index_reason": F.when(n % 4 == 0, "LATER").otherwise(F.col("index_reason")),
    })
    return inventory.manifest_violations(broken)


# The index under changes

_RECORD = "'[\"vec-' || vec_id || '\",\"root-' || label || '\"]'"


@query(f"""
WITH r AS (SELECT vec_id, {_RECORD} AS record_id FROM embeddings)
SELECT record_id, 'chunk_id_of_other_file' AS violation FROM r
UNION ALL SELECT record_id, 'content_hash_differs' FROM r WHERE vec_id % 5 = 0
UNION ALL SELECT record_id, 'document_blank' FROM r WHERE vec_id % 5 = 0
UNION ALL SELECT record_id, 'dimension_differs' FROM r WHERE vec_id % 7 = 0
UNION ALL SELECT record_id, 'vector_not_finite' FROM r WHERE vec_id % 8 = 0 AND vec_id % 7 <> 0""")
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = P.table(spark, sf_dir, "embeddings")
    n, size = F.col("vec_id"), embeddings.select(F.size("embedding")).first()[0]
    odd = F.transform("vector", lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x))
    vector = F.when(n % 7 == 0, F.slice("vector", 2, size)).when(n % 8 == 0, odd).otherwise(F.col("vector"))
    return index.record_violations(P.index_records(embeddings).withColumns({"document": F.when(n % 5 == 0, " ").otherwise(F.col("document")), "vector": vector}), size)


@query("SELECT 'vec-' || vec_id AS chunk_id, 'root-' || label AS root_id FROM embeddings WHERE vec_id % 3 <> 0 AND label <> 1")
def delete_files_and_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = P.index_records(P.table(spark, sf_dir, "embeddings"))
    return index.delete_root(index.delete_files(records, records.where("vec_id % 3 = 0")), "root-1").select("chunk_id", "root_id")


@query("SELECT 'vec-' || vec_id AS chunk_id FROM embeddings WHERE vec_id % 9 = 0")
def vector_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = P.index_records(P.table(spark, sf_dir, "embeddings"), roots=2)
    moved = F.transform("vector", lambda x: x + F.when(F.col("vec_id") % 9 == 0, 0.01).otherwise(1e-9).cast("float"))
    second = F.row_number().over(Window.partitionBy("chunk_id").orderBy("record_id")) == 2
    return index.vector_disagreements(records.withColumn("second", second).withColumn("vector", F.when(F.col("second"), moved).otherwise(F.col("vector"))))


# Extraction

def _sheet_sql(table: str, columns: list[str], order: str, sheet: str) -> str:
    cells = " || chr(9) || ".join(f"coalesce({c}::VARCHAR, '')" for c in columns)
    head = " || chr(9) || ".join(f"'{c}'" for c in columns)
    return f"""
WITH r AS (SELECT {sheet} AS sheet, row_number() OVER (PARTITION BY {sheet} ORDER BY {order}) + 1 AS row_no, {cells} AS line FROM {table}),
g AS (SELECT sheet, ((row_no - 2) // 25)::INTEGER AS grp, string_agg(line, chr(10) ORDER BY row_no) AS body, max(row_no) AS row_end FROM r GROUP BY 1, 2)
SELECT sheet, grp, 'sheet:' || sheet || '!A' || (CASE WHEN grp = 0 THEN 1 ELSE 2 + grp * 25 END) || ':{chr(64 + len(columns))}' || row_end AS locator,
  {head} || chr(10) || body AS text FROM g"""


def _sheets(name: str, columns: list[str], order: str, sheet: str | None, sheet_sql: str) -> None:
    @query(_sheet_sql(name, columns, order, sheet_sql), name=f"sheet_blocks_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tabular.table_rows(P.table(spark, sf_dir, name), columns, order, name, sheet)
        return tabular.sheet_blocks(rows).select("sheet", "grp", "locator", "text")


_sheets("nation", ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey", None, "'nation'")
_sheets("supplier", ["s_suppkey", "s_name", "s_nationkey"], "s_suppkey", None, "'supplier'")
_sheets("part", ["p_partkey", "p_name", "p_type", "p_size"], "p_partkey", "p_brand", "p_brand")
_sheets("customer", ["c_custkey", "c_name", "c_mktsegment"], "c_custkey", "c_nationkey", "c_nationkey::VARCHAR")

@query(_sheet_sql("supplier", ["s_suppkey", "s_name", "s_acctbal"], "s_suppkey", "s_nationkey::VARCHAR"))
def native_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workbook with a sheet for each nation, its rows in nested columns."""
    row = F.struct("s_suppkey", F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("s_suppkey", "s_name", "s_acctbal")]).alias("cells"))
    sheets = P.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("name")).agg(F.array_sort(F.collect_list(row)).alias("data"))
    header = F.array(F.array(F.lit("s_suppkey"), F.lit("s_name"), F.lit("s_acctbal")))
    books = sheets.select("name", F.concat(header, F.transform("data", lambda x: x["cells"])).alias("rows")).groupBy(F.lit("book").alias("file_id"), F.lit("1").alias("revision")).agg(F.collect_list(F.struct("name", "rows")).alias("sheets"))
    return native.spreadsheet_blocks(books).select("sheet", "grp", "locator", "text")


_WORDS = "string_split(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')), ' ')"


@query(f"""
WITH d AS (SELECT 'doc-' || doc_id AS file_id, {_WORDS} AS w FROM documents WHERE regexp_matches(coalesce(text, ''), '[A-Za-z]')),
c AS (SELECT file_id, w, unnest(range(0, (len(w) + 39) // 40)) AS ordinal FROM d),
t AS (SELECT file_id, ordinal, array_to_string(w[ordinal * 40 + 1:(ordinal + 1) * 40], ' ') AS text FROM c)
SELECT file_id, ordinal, text, file_id || ':' || sha256(file_id || chr(0) || '1' || chr(0) || 'text:1' || chr(0) || ordinal || chr(0) || text) AS chunk_id FROM t""")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose without sentence ends, in chunks of 40 words and no overlap."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    docs = P.table(spark, sf_dir, "documents").select(
        P.file_id().alias("file_id"), F.lit("1").alias("revision"), F.lit(0).alias("block_pos"), F.lit("text:1").alias("locator"), words.alias("text"), F.create_map().cast("map<string,string>").alias("metadata")
    )
    return chunking.chunk_blocks(docs, max_tokens=40, overlap_tokens=0).select("file_id", F.col("ordinal").cast("long").alias("ordinal"), "text", "chunk_id")


_NORMAL = "trim(regexp_replace(regexp_replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"


@query(f"SELECT 'conv-' || conv_id AS file_id, turn AS block_pos, 'section:' || role AS locator, {_NORMAL.format('text')} AS text FROM conversations")
def native_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = P.table(spark, sf_dir, "conversations")
    section = F.struct(F.col("turn"), F.concat(F.lit("section:"), "role").alias("locator"), F.col("text"))
    talks = turns.groupBy(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("file_id")).agg(F.array_sort(F.collect_list(section)).alias("sections"))
    talks = talks.withColumn("revision", F.lit("1"))
    blocks = native.document_blocks(talks)
    return blocks.select("file_id", F.col("block_pos").cast("long").alias("block_pos"), "locator", "text")


@query(f"""
WITH t AS (SELECT 'conv-' || conv_id AS file_id, turn, {_NORMAL.format("text")} AS a, role AS b FROM conversations)
SELECT file_id, 'slide:' || (turn + 1) AS locator, CASE WHEN a <> '' AND b <> '' THEN a || chr(10) || 'Notes:' || chr(10) || b ELSE a || b END AS text FROM t""")
def native_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = P.table(spark, sf_dir, "conversations")
    slide = F.struct((F.col("turn") + 1).alias("number"), F.col("text"), F.col("role").alias("notes"))
    decks = turns.groupBy(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("file_id")).agg(F.array_sort(F.collect_list(slide)).alias("slides"))
    return native.presentation_blocks(decks.withColumn("revision", F.lit("1"))).select("file_id", "locator", "text")


@query("SELECT 'event-' || event_id AS file_id, 'json:$' AS locator, props AS text FROM events")
def json_blocks_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.table(spark, sf_dir, "events").select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("file_id"), F.lit("1").alias("revision"), F.col("props").alias("text"))
    return text_source.json_blocks(events).select("file_id", "locator", "text")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select(P.file_id().alias("file_id"), F.lit("1").alias("revision"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"SELECT 'doc-' || doc_id AS file_id, 'text:1' AS locator, {_NORMAL.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS text FROM documents")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_source.text_blocks(_payloads(spark, sf_dir)).select("file_id", "locator", "text")


@query("""
WITH t AS (SELECT doc_id, chr(9) || ' ' || replace(coalesce(text, ''), ' ', '  ' || chr(9)) || chr(13) || chr(10) || chr(10) || chr(10) || 'end ' AS raw FROM documents),
n AS (SELECT doc_id, replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS raw FROM t)
SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS extracted,
  trim(regexp_replace(raw, ' +', ' ', 'g'), ' ' || chr(9) || chr(10)) AS chunked FROM n""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.table(spark, sf_dir, "documents")
    spaced = F.concat(F.lit("\t "), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("  \t")), F.lit("\r\n\n\nend "))
    return docs.select("doc_id", fx.normalize_extracted(spaced).alias("extracted"), fx.normalize_chunk(spaced).alias("chunked"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
t AS (SELECT doc_id, n, n % 3 = 1 AND trim(line) <> '' AS head, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS line FROM l),
h AS (SELECT 'doc-' || doc_id AS file_id, n, CASE WHEN head THEN regexp_replace(line, '^(.+?)\\s*#*\\s*$', '\\1') ELSE line END AS line, head FROM t),
s AS (SELECT *, count(*) FILTER (head AND line <> '') OVER (PARTITION BY file_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM h WHERE line <> '')
SELECT file_id, CASE WHEN section = 0 THEN 'section:Document' ELSE 'section:' || max(line) FILTER (head) END AS locator, string_agg(line, chr(10) ORDER BY n) AS text
FROM s GROUP BY file_id, section""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.col("text"), "\n", -1)
    marked = F.transform(lines, lambda x, i: F.when((i % 3 == 0) & x.rlike("[^\\s]"), F.concat(F.lit("## "), x, F.lit(" "))).otherwise(x))
    return text_source.heading_blocks(_payloads(spark, sf_dir).withColumn("text", F.array_join(marked, "\n"))).select("file_id", "locator", "text")


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("file_id"), F.lit("1").alias("revision"), F.col("html").alias("text"))
    return text_source.html_blocks(pages)


# Chunks and index records

@query("""
SELECT 'doc-' || doc_id AS file_id, 'doc-' || doc_id || ':' || sha256('doc-' || doc_id || chr(0) || '1' || chr(0) || 'text:1' || chr(0) || '0' || chr(0) || coalesce(text, '')) AS chunk_id
FROM documents""")
def chunk_fixed_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select("file_id", fx.chunk_id(F.col("file_id"), F.col("revision"), F.lit("text:1"), F.lit(0), F.col("text")).alias("chunk_id"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = text_source.text_blocks(_payloads(spark, sf_dir)).withColumn("metadata", F.create_map().cast("map<string,string>"))
    return chunking.chunk_blocks(blocks).drop("metadata")


_RECORD = """'["vec-' || e.vec_id || '","root-' || ((e.label + c.copy) % 10) || '"]'"""


@query(f"""
SELECT {_RECORD} AS record_id, 'vec-' || e.vec_id AS chunk_id, 'root-' || ((e.label + c.copy) % 10) AS root_id, sha256('vector ' || e.vec_id) AS content_hash
FROM embeddings e, (VALUES (0), (1)) c(copy)""")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    chunk = F.concat(F.lit("vec-"), F.col("vec_id").cast("string"))
    chunks = e.select(chunk.alias("file_id"), F.lit("1").alias("revision"), chunk.alias("chunk_id"), F.lit("text:1").alias("locator"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"))
    roots = e.select(chunk.alias("file_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("copy"), "label").select("file_id", F.concat(F.lit("root-"), ((F.col("label") + F.col("copy")) % 10).cast("string")).alias("root_id"))
    return index.build_records(chunks, roots).select("record_id", "chunk_id", "root_id", "content_hash")


@query("SELECT count(*) FILTER (doc_id % 11 <> 0) AS records FROM documents")
def record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.record_count(P.manifest_rows(P.table(spark, sf_dir, "documents")))


@query("""
WITH d AS (SELECT doc_id, 'doc-' || doc_id AS f, coalesce(source, 'none') AS r FROM documents WHERE doc_id % 11 <> 0)
SELECT f || ':' || sha256(f) AS chunk_id, r AS root_id, 'record_missing' AS violation FROM d WHERE doc_id % 6 = 0
UNION ALL SELECT f || ':' || sha256(f), 'elsewhere', 'record_unexpected' FROM d WHERE doc_id % 6 = 1""")
def consistency_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = P.manifest_rows(P.table(spark, sf_dir, "documents"))
    held = manifest.select("doc_id", F.explode("active_chunk_ids").alias("chunk_id"), F.get(F.transform("paths", lambda p: p["root_id"]), F.lit(0)).alias("root_id"))
    stray = held.where("doc_id % 6 = 1").withColumn("root_id", F.lit("elsewhere"))
    return index.consistency_violations(manifest, held.where("doc_id % 6 <> 0").unionByName(stray))


@query("""
SELECT CASE WHEN e.vec_id % 4 = 0 THEN '["vec-' || e.vec_id || '","moved"]' ELSE '["vec-' || e.vec_id || '","root-' || (e.label % 10) || '"]' END AS record_id,
  'vec-' || e.vec_id AS chunk_id, CASE WHEN e.vec_id % 4 = 0 THEN 'moved' ELSE 'root-' || (e.label % 10) END AS root_id,
  CASE WHEN e.vec_id % 4 = 0 THEN 'moved/vec-' || e.vec_id ELSE 'root-' || (e.label % 10) || '/vec-' || e.vec_id || '.txt' END AS drive_path, round(e.embedding[1]::DOUBLE, 6) AS first_value
FROM embeddings e""")
def repath_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = P.index_records(P.table(spark, sf_dir, "embeddings"))
    roots = records.where("vec_id % 4 = 0").select("file_id", F.lit("moved").alias("root_id"), F.concat(F.lit("moved/"), "file_id").alias("drive_path"))
    moved = index.repath(records, roots)
    return moved.select("record_id", "chunk_id", "root_id", "drive_path", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first_value"))


@query("""
SELECT '["vec-' || vec_id || '","root-' || (label % 10) || '"]' AS record_id FROM embeddings WHERE vec_id % 5 = 0""")
def changed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = P.index_records(P.table(spark, sf_dir, "embeddings"))
    live = records.withColumn("vector", F.transform("vector", lambda x: F.when(F.col("vec_id") % 5 == 0, x + F.lit(0.01)).otherwise(x * F.lit(1 + 1e-8))))
    return index.changed_vectors(records, live)


@query("""SELECT vec_id, vec_id % 4 <> 0 AS same FROM embeddings""")
def vector_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "embeddings")
    moved = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 4 == 0) & (i == 1), x + 0.01).otherwise(x * F.lit(1 + 1e-7)))
    return e.select("vec_id", close(F.col("embedding"), moved).alias("same"))


@query("""
SELECT 'vec-' || vec_id AS file_id, '["vec-' || vec_id || '","root-' || (label % 10) || '"]' AS record_id, CASE WHEN vec_id % 3 = 0 THEN 'fresh' ELSE 'vector ' || vec_id END AS document FROM embeddings""")
def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = P.index_records(P.table(spark, sf_dir, "embeddings"))
    fresh = records.where("vec_id % 3 = 0").withColumn("document", F.lit("fresh"))
    return index.upsert(records, fresh).select("file_id", "record_id", "document")


@query("""
SELECT 'vec-' || vec_id AS file_id, count(*) AS records FROM (SELECT vec_id, unnest([label % 10, (label + 1) % 10]) AS root FROM embeddings)
WHERE vec_id % 3 <> 0 OR root < 5 GROUP BY 1""")
def file_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = P.index_records(P.table(spark, sf_dir, "embeddings"), roots=2)
    return index.file_counts(records.where("vec_id % 3 <> 0 OR root_id < 'root-5'"))


# Folders

@query("""
WITH RECURSIVE edges AS (
  SELECT 'region-' || n_regionkey AS parent, 'nation-' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'nation-' || s_nationkey, 'supplier-' || s_suppkey FROM supplier),
t AS (SELECT 'region-' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN edges e ON e.parent = t.node)
SELECT node, depth FROM t""")
def folder_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.folders import traverse

    nation, supplier = P.table(spark, sf_dir, "nation"), P.table(spark, sf_dir, "supplier")
    name = lambda kind, key: F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"))
    edges = nation.select(name("region", "n_regionkey").alias("parent"), name("nation", "n_nationkey").alias("child")).unionByName(
        supplier.select(name("nation", "s_nationkey").alias("parent"), name("supplier", "s_suppkey").alias("child"))
    )
    roots = P.table(spark, sf_dir, "region").select(name("region", "r_regionkey").alias("node"))
    return traverse(roots, edges)


@query("""
WITH p AS (SELECT 'doc-' || doc_id AS file_id, coalesce(source, 'none') AS root_id, coalesce(lang, 'xx') || '/doc-' || doc_id || '.txt' AS drive_path FROM documents)
SELECT file_id, root_id, 'Alias ' || root_id AS folder_alias, drive_path FROM p WHERE root_id <> 'src3'""")
def file_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.table(spark, sf_dir, "documents")
    paths = P.remote_files(docs).select("file_id", F.explode("paths").alias("p")).select("file_id", "p.root_id", "p.parts")
    roots = paths.select("root_id").distinct()
    folders = roots.select(F.col("root_id").alias("folder_id"), F.concat(F.lit("Alias "), "root_id").alias("alias"), (F.col("root_id") != "src3").alias("enabled"))
    return index.file_roots(paths, folders)
