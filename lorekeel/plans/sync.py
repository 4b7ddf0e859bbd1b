"""Synchronisation: a snapshot and its payloads become a committed version.

State is immutable version folders and one pointer file. A run writes its folders
beside the current ones, phase by phase, with a journal on the side; the pointer is
renamed over last. A crash before that leaves the old version in force, and
``recover`` takes the run up at its phase, so nothing needs to be rolled back.

    current.json             header of the version in force
    journal.json             the run under way, with its phase
    versions/<run>/manifest  manifest rows
    versions/<run>/index     index records
    versions/<run>/mirror    (file_id, root_id, local_path, object_sha256)
    objects/                 payload bytes by SHA-256, each once
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DEGRADING, CorpusError
from ..functions.text import native_name
from ..operators import chunking, embedding, index, inventory, retrieve
from ..schemas import INDEX_RECORDS, MANIFEST_FILES, PHASES
from ..sources import extract as extraction
from .folders import Registry
from .storage import Storage

MIRROR = "file_id string, root_id string, local_path string, object_sha256 string"
OBJECTS = "object_sha256 string, content binary"
#: At most so many file ids are broadcast to pick payloads.
BROADCAST_FILES = 1_000_000


@dataclass(frozen=True)
class Snapshot:
    """An inventory: its header, and its files as a table (schemas.REMOTE_FILES)."""

    run_id: str
    complete: bool
    root_ids: tuple[str, ...]
    generated_at: str
    files: DataFrame
    incomplete_reason: str | None = None

    def header(self) -> dict:
        return {"run_id": self.run_id, "complete": self.complete, "root_ids": sorted(self.root_ids), "generated_at": self.generated_at, "incomplete_reason": self.incomplete_reason}


def _digest(frame: DataFrame) -> str:
    """An order-free fingerprint of a table's rows."""
    names = sorted(frame.columns)
    row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"}))
    seen = frame.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{names} {seen['n']} {seen['h']}".encode()).hexdigest()


class SyncEngine:
    """Applies snapshots to a state root and answers questions from the version in force."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        embedder: embedding.Embedder | None = None,
        on_phase: Callable[[str], None] | None = None,
        hooks: dict[str, extraction.Hook] | None = None,
        max_tokens: int = chunking.MAX_TOKENS,
        overlap_tokens: int = chunking.OVERLAP_TOKENS,
    ):
        self.spark, self.storage = spark, Storage(spark, root)
        self.registry = Registry(self.storage)
        self.embedder = embedder or embedding.HashingEmbedder()
        self.on_phase, self.hooks, self.limits = on_phase or (lambda phase: None), hooks, (max_tokens, overlap_tokens)

    # State

    def header(self) -> dict:
        return self.storage.read_json("current.json") or {
            "version": None, "model_identity": None, "last_success": None, "last_failure": None, "root_ids": [], "generated_at": None, "coverage": "complete", "coverage_reason": None, "input": None,
        }

    def _read(self, version: str | None, name: str, schema) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.storage.path(f"versions/{version}/{name}"))

    def manifest(self) -> DataFrame:
        return self._read(self.header()["version"], "manifest", MANIFEST_FILES)

    def records(self) -> DataFrame:
        return self._read(self.header()["version"], "index", INDEX_RECORDS)

    def mirror(self) -> DataFrame:
        return self._read(self.header()["version"], "mirror", MIRROR)

    def objects(self) -> DataFrame:
        if not self.storage.exists("objects"):
            return self.spark.createDataFrame([], OBJECTS)
        return self.spark.read.schema(OBJECTS).parquet(self.storage.path("objects"))

    # Runs

    def plan(self, snapshot: Snapshot) -> DataFrame:
        """(file_id, action) of a snapshot against the version in force, after all header checks."""
        header, roots = self.header(), self.registry.enabled_ids()
        inventory.require_scope(list(snapshot.root_ids), roots)
        inventory.require_newer(self.spark, snapshot.generated_at, header["generated_at"])
        inventory.require_none(inventory.file_violations(snapshot.files, list(snapshot.root_ids)), "INVALID_INVENTORY")
        merged = inventory.merge_files(snapshot.files)
        inventory.require_none(merged.where("conflict").select("file_id", F.lit("attributes differ")), "INVALID_INVENTORY")
        return inventory.plan_sync(merged, self.manifest(), snapshot.complete)

    def apply(self, snapshot: Snapshot, artifacts: DataFrame, payload_folder: str) -> str:
        """Run a snapshot; ``artifacts`` (schemas.ARTIFACTS) name the payloads of its downloads."""
        stamp = hashlib.sha256(json.dumps([snapshot.header(), _digest(snapshot.files), _digest(artifacts)]).encode()).hexdigest()
        journal = self.storage.read_json("journal.json")
        if journal is not None:
            if journal["run_id"] == snapshot.run_id and journal["input"] != stamp:
                raise CorpusError("the run under way has other input", "INVALID_JOURNAL")
            status = self.recover()
            if journal["run_id"] == snapshot.run_id:
                return status
        header = self.header()
        if header["input"] == stamp:
            self._require_consistent()
            return "SYNC_OK_NO_CHANGES"
        try:
            plan = self.plan(snapshot)
            version = hashlib.sha256(f"{snapshot.run_id} {stamp}".encode()).hexdigest()[:16]
            folder = f"versions/{version}"
            self.storage.delete(folder)
            plan.write.parquet(self.storage.path(f"{folder}/plan"))
            merged = inventory.merge_files(snapshot.files).drop("conflict")
            merged.write.parquet(self.storage.path(f"{folder}/files"))
            artifacts.write.parquet(self.storage.path(f"{folder}/artifacts"))
            wanted = merged.join(self._staged(folder, "plan").where("action = 'download'"), "file_id", "left_semi")
            inventory.require_none(inventory.artifact_violations(wanted, artifacts), "INVALID_ARTIFACT")
            self._targets(merged).write.parquet(self.storage.path(f"{folder}/targets"))
        except CorpusError:
            self._failed(snapshot.generated_at)
            raise
        journal = {"run_id": snapshot.run_id, "input": stamp, "version": version, "base": header["version"], "phase": "planned", "snapshot": snapshot.header(), "payload_folder": payload_folder}
        self.storage.write_json("journal.json", journal)
        self.on_phase("planned")
        return self._resume(journal)

    def recover(self) -> str:
        """Finish the run under way, if there is one."""
        journal = self.storage.read_json("journal.json")
        if journal is None:
            return "SYNC_OK_NO_CHANGES"
        if journal.get("phase") not in PHASES:
            raise CorpusError("the journal has an unknown phase", "INVALID_JOURNAL")
        return self._resume(journal)

    def _resume(self, journal: dict) -> str:
        steps = {"planned": ("verified", self._prepare), "verified": ("indexed", self._index), "indexed": ("promoted", self._promote), "promoted": ("deleted", self._mirror), "deleted": ("activating", self._check), "activating": ("committed", self._commit)}
        try:
            while journal["phase"] != "committed":
                phase, step = steps[journal["phase"]]
                step(journal)
                journal = journal | {"phase": phase}
                self.storage.write_json("journal.json", journal)
                self.on_phase(phase)
        except CorpusError:
            self._failed(journal["snapshot"]["generated_at"])
            self.storage.delete("journal.json")
            self.storage.delete(f"versions/{journal['version']}")
            raise
        changed = self.storage.read_json(f"versions/{journal['version']}/changed.json") or {"changed": True}
        self.storage.delete("journal.json")
        if not journal["snapshot"]["complete"]:
            return "PARTIAL_INDEX"
        return "SYNC_OK_CHANGED" if changed["changed"] else "SYNC_OK_NO_CHANGES"

    def _staged(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.storage.path(f"{folder}/{name}"))

    def _write(self, frame: DataFrame, folder: str, name: str) -> None:
        frame.write.mode("overwrite").parquet(self.storage.path(f"{folder}/{name}"))

    def _targets(self, files: DataFrame) -> DataFrame:
        """(file_id, root_id, parts, target_parts): places under the roots, native files with their rendered name."""
        paths = files.select("file_id", "native_kind", F.explode("paths").alias("p")).select("file_id", "native_kind", "p.root_id", "p.parts")
        rename = lambda name: F.when(F.col("native_kind").isNotNull(), native_name(name)).otherwise(name)
        return inventory.resolve_collisions(paths, rename=rename).drop("native_kind")

    def _prepare(self, journal: dict) -> None:
        """Verify, extract, chunk and embed the downloads: the one stage that reads payloads."""
        folder = f"versions/{journal['version']}"
        plan, files = self._staged(folder, "plan"), self._staged(folder, "files")
        wanted = plan.where("action = 'download'").select("file_id").join(files, "file_id").join(self._staged(folder, "artifacts").drop("revision"), "file_id")
        # read once: what follows checks and extracts the written copy
        self._write(extraction.read_payloads(self.spark, wanted, journal["payload_folder"]), folder, "payloads")
        payloads = self._staged(folder, "payloads")
        native = F.col("native_kind").isNotNull()
        wrong = (F.col("payload_hash") != F.col("payload_sha256")) | (native & (F.substring("content", 1, 5) != F.lit(b"%PDF-")))
        wrong = wrong | (~native & ((F.col("payload_md5") != F.col("checksum")) | (F.col("length") != F.col("size"))))
        inventory.require_none(payloads.where(F.col("payload_hash").isNotNull() & wrong).select("file_id", F.lit("the payload is not the one announced")), "INVALID_ARTIFACT")
        structured = extraction.read_structured(self.spark, wanted.where(native), journal["payload_folder"])
        found = extraction.extract_found(payloads.where(~native), self.hooks).unionByName(extraction.extract_native(structured))
        self._write(found, folder, "found")
        blocks, failures = extraction.split_found(self._staged(folder, "found"))
        fatal = failures.join(files.select("file_id", "native_kind"), "file_id").where(~F.col("code").isin(*DEGRADING) | F.col("native_kind").isNotNull())
        if first := fatal.first():
            raise CorpusError(f"{first['file_id']} cannot be extracted", first["code"])
        chunks = chunking.chunk_blocks(blocks.withColumn("metadata", F.create_map().cast("map<string,string>")), self.embedder.count, *self.limits)
        self._write(embedding.embed_chunks(chunks, self.embedder), folder, "chunks")
        self._write(failures, folder, "failures")
        fresh, failed = self._staged(folder, "chunks"), self._staged(folder, "failures")
        lists = inventory.chunk_lists(fresh)
        none = F.array().cast("array<string>")
        prepared = (
            wanted.select("file_id", "revision", "checksum", F.col("payload_sha256").alias("object_sha256"), "paths", "native_kind")
            .join(lists, "file_id", "left")
            .join(failed.withColumnRenamed("code", "index_reason"), "file_id", "left")
            .withColumn("active_chunk_ids", F.coalesce("active_chunk_ids", none))
            .withColumn("index_status", F.when(F.col("index_reason").isNull(), "indexed").otherwise("unindexed"))
        )
        same = plan.where("action = 'unchanged'").select("file_id")
        kept = self._base(journal, "manifest", MANIFEST_FILES).drop("paths").join(same, "file_id", "left_semi").join(files.select("file_id", "paths"), "file_id")
        columns = MANIFEST_FILES.fieldNames()
        observed = prepared.select(*columns).unionByName(kept.select(*columns))
        target = inventory.target_manifest(self._base(journal, "manifest", MANIFEST_FILES), observed, journal["snapshot"]["complete"])
        self._write(target, folder, "manifest")

    def _base(self, journal: dict, name: str, schema) -> DataFrame:
        return self._read(journal["base"], name, schema)

    def _index(self, journal: dict) -> None:
        """The next index: fresh records of downloads, the rest under the places they have now."""
        folder = f"versions/{journal['version']}"
        manifest, files = self._staged(folder, "manifest"), self._staged(folder, "files")
        spots = manifest.select("file_id", F.explode("paths").alias("p")).select("file_id", "p.root_id", "p.parts")
        folders = self.registry.table(self.spark)
        roots = index.file_roots(spots, folders)
        urls = files.select("file_id", "drive_url", "mime_type")
        target = self._staged(folder, "targets").select("file_id", "root_id", F.array_join("target_parts", "/").alias("local_path"))
        first = target.groupBy("file_id", "root_id").agg(F.min("local_path").alias("local_path"))
        roots = roots.join(first, ["file_id", "root_id"], "left").join(urls.select("file_id", "drive_url"), "file_id", "left")
        chunks = self._staged(folder, "chunks").join(urls.select("file_id", "mime_type"), "file_id")
        fresh = index.build_records(chunks, roots)
        old = index.delete_files(self._base(journal, "index", INDEX_RECORDS), chunks.select("file_id").distinct())
        observed = roots.join(files.select("file_id"), "file_id", "left_semi")
        moved = index.repath(old, observed.join(old.select("file_id").distinct(), "file_id", "left_semi"))
        names = INDEX_RECORDS.fieldNames()
        everything = moved.select(*names).unionByName(fresh.select(*names))
        self._write(index.retire(everything, manifest).select(*names), folder, "index")

    def _promote(self, journal: dict) -> None:
        """Payloads not held yet join the objects, each content once."""
        folder = f"versions/{journal['version']}"
        payloads = self._staged(folder, "payloads").where("content is not null")
        # chosen by narrow rows: bytes are copied, not exchanged
        new = payloads.groupBy("payload_hash").agg(F.min("file_id").alias("file_id"))
        new = new.join(self.objects().select("object_sha256"), F.col("payload_hash") == F.col("object_sha256"), "left_anti").select("file_id")
        new = F.broadcast(new) if new.count() <= BROADCAST_FILES else new
        chosen = payloads.join(new, "file_id", "left_semi").select(F.col("payload_hash").alias("object_sha256"), "content")
        chosen.write.mode("append").parquet(self.storage.path("objects"))

    def _mirror(self, journal: dict) -> None:
        """Places of the version and, beside them, the old ones that it gives up."""
        folder = f"versions/{journal['version']}"
        held = self._staged(folder, "manifest").select("file_id", "object_sha256")
        places = self._staged(folder, "targets").select("file_id", "root_id", F.concat_ws("/", "root_id", F.array_join("target_parts", "/")).alias("local_path"))
        old = self._base(journal, "mirror", MIRROR)
        if not journal["snapshot"]["complete"]:
            places = places.unionByName(old.join(places.select("file_id").distinct(), "file_id", "left_anti").select("file_id", "root_id", "local_path"))
        self._write(places.join(held, "file_id"), folder, "mirror")
        stale = old.join(self._staged(folder, "mirror"), ["root_id", "local_path"], "left_anti").select("file_id", "root_id", "local_path")
        self._write(stale, folder, "stale")

    def _check(self, journal: dict) -> None:
        """Nothing is put in force that does not prove itself."""
        folder = f"versions/{journal['version']}"
        manifest = self._staged(folder, "manifest")
        records = self.spark.read.schema(INDEX_RECORDS).parquet(self.storage.path(f"{folder}/index"))
        inventory.require_none(inventory.manifest_violations(manifest), "INVALID_STATE")
        inventory.require_none(index.consistency_violations(manifest, records).select("chunk_id", "violation"), "INDEX_WRITE_FAILED")
        inventory.require_none(index.record_violations(records, self.embedder.dimension), "INDEX_WRITE_FAILED")
        inventory.require_none(index.chunk_id_violations(self._staged(folder, "chunks")), "INDEX_WRITE_FAILED")
        inventory.require_none(index.vector_disagreements(records).select("chunk_id", F.lit("vectors differ")), "INDEX_WRITE_FAILED")
        plan = self._staged(folder, "plan")
        moved = self._staged(folder, "mirror").exceptAll(self._base(journal, "mirror", MIRROR))
        changed = not plan.where("action <> 'unchanged'").isEmpty() or not moved.isEmpty() or not self._staged(folder, "stale").isEmpty()
        self.storage.write_json(f"{folder}/changed.json", {"changed": changed})

    def _commit(self, journal: dict) -> None:
        shot = journal["snapshot"]
        self.storage.write_json(
            "current.json",
            {
                "version": journal["version"], "model_identity": embedding.model_identity(self.embedder), "last_success": shot["generated_at"], "last_failure": None, "root_ids": shot["root_ids"],
                "generated_at": shot["generated_at"], "coverage": "complete" if shot["complete"] else "partial", "coverage_reason": shot["incomplete_reason"] or (None if shot["complete"] else "the snapshot is partial"), "input": journal["input"],
            },
        )

    def _failed(self, when: str) -> None:
        """The version in force stays; only its header learns of the failure."""
        self.storage.write_json("current.json", self.header() | {"last_failure": when})

    # Questions

    def _require_consistent(self) -> None:
        inventory.require_none(index.consistency_violations(self.manifest(), self.records()).select("chunk_id", "violation"), "INDEX_STALE")

    def require_ready(self, aliases: list[str] | None = None) -> list[str]:
        """The roots to ask; cheap gates come first, so a stale index fails before a model is used."""
        if self.storage.exists("journal.json"):
            raise CorpusError("a run is under way", "INDEX_STALE")
        roots = [f.folder_id for f in self.registry.select(aliases)]
        header = self.header()
        if header["version"] is None or header["last_success"] is None or header["last_failure"] is not None:
            raise CorpusError("no successful run is in force", "INDEX_STALE")
        if header["model_identity"] != embedding.model_identity(self.embedder):
            raise CorpusError("the index was made with another model", "INDEX_MODEL_MISMATCH")
        if set(header["root_ids"]) != set(self.registry.enabled_ids()):
            raise CorpusError("the enabled folders are not those of the index", "INDEX_STALE")
        self._require_consistent()
        return roots

    def ask(self, question: str, aliases: list[str] | None = None, threshold: float = retrieve.THRESHOLD, limit: int = retrieve.MOST) -> DataFrame:
        if not question.strip():
            raise CorpusError("the question is empty", "INVALID_REQUEST")
        roots = self.require_ready(aliases)
        return retrieve.answer(self.records(), self.embedder.embed_query(embedding.QUERY + question), roots, threshold, limit)

    def status(self) -> dict:
        header, manifest = self.header(), self.manifest()
        summary = inventory.status_summary(manifest).first().asDict()
        reasons = {r["index_reason"]: r["files"] for r in inventory.unindexed_reasons(manifest).collect()}
        return summary | {"folders": len(self.registry.folders), "unindexed_reasons": reasons, "pending": self.storage.exists("journal.json")} | {k: header[k] for k in ("last_success", "last_failure", "model_identity", "coverage", "coverage_reason")}
