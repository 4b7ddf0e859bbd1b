"""Folders: traversal of the remote tree and the registry of watched roots."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.text import alias_key, canonical_alias
from ..schemas import FOLDERS, SCHEMA_VERSION
from ..session import settled
from .storage import Storage

#: Fixed value: the host of folder addresses.
FOLDER_HOST = "drive.google.com"


def traverse(roots: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, depth) of everything below ``roots`` (node) along ``edges`` (parent, child).

    One join a level; nodes reached before are left out, so cycles end.
    """
    level = roots.select("node").distinct().withColumn("depth", F.lit(0))
    seen = level
    for depth in range(1, most + 1):
        below = level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        level = settled(below.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
    raise CorpusError("the folder tree is too deep", "INVALID_INVENTORY")


@dataclass(frozen=True)
class Folder:
    folder_id: str
    url: str
    alias: str
    enabled: bool = True


def canonical_folder(folder: Folder) -> Folder:
    """Stripped id, canonical alias and address; typed errors for all that is not a single folder."""
    number, alias = folder.folder_id.strip(), canonical_alias(folder.alias)
    if alias is None:
        raise CorpusError("the alias is unsafe", "INVALID_ALIAS")
    if not number:
        raise CorpusError("the folder id is empty", "INVALID_FOLDER_ID")
    try:
        url = urlsplit(folder.url)
        plain = url.scheme == "https" and url.hostname == FOLDER_HOST and url.username is None and url.password is None
    except (TypeError, ValueError):
        plain = False
    if not plain:
        raise CorpusError("the folder address is malformed", "INVALID_FOLDER_URL")
    steps = [unquote(s) for s in url.path.split("/") if s]
    # drive, anything such as u/0, folders, the id
    if len(steps) < 3 or steps[0] != "drive" or steps[-2] != "folders" or "folders" in steps[:-2] or steps[-1] != number:
        raise CorpusError("the folder address does not lead to this folder", "INVALID_FOLDER_URL")
    return replace(folder, folder_id=number, alias=alias, url=f"https://{FOLDER_HOST}/drive/folders/{quote(number, safe='-_')}")


class Registry:
    """The watched folders: a small JSON file on the driver, a table for joins."""

    def __init__(self, storage: Storage, name: str = "registry.json"):
        self.storage, self.name = storage, name
        held = storage.read_json(name)
        if held is not None and (set(held) != {"schema_version", "folders"} or held["schema_version"] != SCHEMA_VERSION):
            raise CorpusError("the registry has another schema", "UNSUPPORTED_SCHEMA")
        self.folders = [Folder(**f) for f in (held or {}).get("folders", [])]
        for f in self.folders:
            if canonical_folder(f) != f:
                raise CorpusError("the registry holds a folder that is not canonical", "INVALID_STATE")

    def list(self) -> list[Folder]:
        return sorted(self.folders, key=lambda f: (f.alias.casefold(), f.alias))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.folder_id, f.url, f.alias, f.enabled) for f in self.list()], FOLDERS)

    def _keep(self, folders: list[Folder]) -> None:
        self.folders = folders
        self.storage.write_json(self.name, {"schema_version": SCHEMA_VERSION, "folders": [asdict(f) for f in self.list()]})

    def add(self, folder: Folder) -> Folder:
        fresh = canonical_folder(folder)
        if any(f.folder_id == fresh.folder_id for f in self.folders):
            raise CorpusError("the folder is registered already", "DUPLICATE_FOLDER_ID")
        self._free(fresh.alias)
        self._keep([*self.folders, fresh])
        return fresh

    def _free(self, alias: str, but: Folder | None = None) -> None:
        if any(alias_key(f.alias) == alias_key(alias) for f in self.folders if f != but):
            raise CorpusError("the alias is taken", "DUPLICATE_ALIAS")

    def find(self, identifier: str) -> Folder:
        """By id, or by alias whatever its case."""
        key = alias_key(identifier)
        found = [f for f in self.folders if f.folder_id == identifier or key is not None and alias_key(f.alias) == key]
        if not found:
            raise CorpusError(f"no folder {identifier}", "FOLDER_NOT_FOUND")
        if len(found) > 1:
            raise CorpusError(f"{identifier} names several folders", "AMBIGUOUS_FOLDER")
        return found[0]

    def _change(self, identifier: str, **to) -> Folder:
        old = self.find(identifier)
        new = canonical_folder(replace(old, **to))
        self._free(new.alias, but=old)
        self._keep([new if f == old else f for f in self.folders])
        return new

    def enable(self, identifier: str) -> Folder:
        return self._change(identifier, enabled=True)

    def disable(self, identifier: str) -> Folder:
        return self._change(identifier, enabled=False)

    def rename(self, identifier: str, alias: str) -> Folder:
        return self._change(identifier, alias=alias)

    def remove(self, identifier: str) -> Folder:
        gone = self.find(identifier)
        self._keep([f for f in self.folders if f != gone])
        return gone

    def enabled_ids(self) -> list[str]:
        return sorted(f.folder_id for f in self.folders if f.enabled)

    def select(self, aliases: list[str] | None) -> list[Folder]:
        """Enabled folders by exact alias, whatever its case; none named: all. Unknown ones are an error."""
        enabled = {alias_key(f.alias): f for f in self.folders if f.enabled}
        if not enabled:
            raise CorpusError("no folder is enabled", "CONFIGURATION_REQUIRED")
        if not aliases:
            return [enabled[k] for k in sorted(enabled)]
        missing = [a for a in aliases if alias_key(a) not in enabled]
        if missing:
            raise CorpusError(f"no enabled folder {missing[0]}", "FOLDER_NOT_FOUND")
        return [enabled[k] for k in dict.fromkeys(map(alias_key, aliases))]


def describe(folders: list[Folder]) -> str:
    return json.dumps([asdict(f) for f in folders], sort_keys=True)
