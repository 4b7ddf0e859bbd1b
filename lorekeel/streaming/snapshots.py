"""Snapshots as a stream: each new inventory file is applied once, in order of its time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import inventory
from ..plans.sync import Snapshot, SyncEngine
from ..schemas import INVENTORY, SCHEMA_VERSION


def read_inventory(spark: SparkSession, path: str) -> Snapshot:
    """A strict scan of one inventory file: declared schema, no stray keys, no malformed rows."""
    raw = spark.read.text(path, wholetext=True)
    inventory.require_none(inventory.key_violations(raw, INVENTORY), "INVALID_INVENTORY")
    return _snapshots(spark.read.schema(INVENTORY).option("multiLine", True).option("mode", "FAILFAST").json(path))[0]


def _snapshots(rows: DataFrame) -> list[Snapshot]:
    known = F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))
    inventory.require_none(rows.where(~known).select("run_id", F.lit("another schema version")), "UNSUPPORTED_SCHEMA")
    inventory.require_none(inventory.header_violations(rows), "INVALID_INVENTORY")
    heads = rows.select("schema_version", "run_id", "complete", "root_ids", "generated_at", "incomplete_reason").orderBy("generated_at").collect()
    out = []
    for h in heads:
        files = rows.where(F.col("run_id") == h["run_id"]).select(F.explode("files").alias("f")).select("f.*")
        out.append(Snapshot(h["run_id"], h["complete"], tuple(h["root_ids"]), h["generated_at"], files, h["incomplete_reason"]))
    return out


def follow(
    spark: SparkSession, folder: str, engine: SyncEngine, artifacts: Callable[[str], tuple[DataFrame, str]], checkpoint: str, on_status: Callable[[str, str], None] | None = None
) -> StreamingQuery:
    """Apply all inventory files that lie in ``folder`` and are new; ends when they are done.

    ``artifacts`` gives a run's artifacts and payload folder. A batch that is run again
    after a failure meets the engine's idempotent retry.
    """

    def batch(rows: DataFrame, _: int) -> None:
        for shot in _snapshots(rows):
            made, payloads = artifacts(shot.run_id)
            status = engine.apply(shot, made, payloads)
            if on_status:
                on_status(shot.run_id, status)

    stream = spark.readStream.schema(INVENTORY).option("multiLine", True).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
