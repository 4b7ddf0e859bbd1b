import hashlib
import json

import pytest

from lorekeel.errors import CorpusError
from lorekeel.operators import inventory
from lorekeel.plans.sync import Snapshot
from lorekeel.schemas import ARTIFACTS, REMOTE_FILES
from lorekeel.sources import native

from .test_engine import engine_at, remote

KINDS = {"document": "application/vnd.google-apps.document", "spreadsheet": "application/vnd.google-apps.spreadsheet", "presentation": "application/vnd.google-apps.presentation"}
CONTENT = {
    "document": {"kind": "document", "sections": [{"locator": "section:Goals", "text": "the  travel budget\r\nis ten"}, {"locator": "section:Rest", "text": "more"}]},
    "spreadsheet": {"kind": "spreadsheet", "sheets": [{"name": "Plan", "rows": [["a", "b"], [1, None], [True, 1.5], ["x"]]}]},
    "presentation": {"kind": "presentation", "slides": [{"number": 2, "text": "Title", "notes": "say this"}, {"number": 1, "text": "End", "notes": ""}]},
}


def pieces(content, kind):
    return list(native.structured_pieces(json.dumps(content).encode(), kind))


def test_items_of_each_kind():
    assert pieces(CONTENT["spreadsheet"], "spreadsheet") == [("sheet:Plan!A1:B4", "a\tb\n1\nTRUE\t1.5\nx", None)]
    assert [p[0] for p in pieces(CONTENT["presentation"], "presentation")] == ["slide:2", "slide:1"]
    assert [p[0] for p in pieces(CONTENT["document"], "document")] == ["section:Goals", "section:Rest"]


@pytest.mark.parametrize(
    "bad",
    [
        [], {"kind": "drawing"}, {"kind": "document"}, {"kind": "document", "sections": [], "more": 1}, {"kind": "document", "sections": [{"locator": "Goals", "text": "x"}]},
        {"kind": "document", "sections": [{"locator": "section:x", "text": None}]}, {"kind": "spreadsheet", "sheets": [{"name": "A", "rows": [1]}]},
        {"kind": "spreadsheet", "sheets": [{"name": "A", "rows": []}, {"name": "A", "rows": []}]}, {"kind": "spreadsheet", "sheets": [{"name": " ", "rows": []}]},
        {"kind": "spreadsheet", "sheets": [{"name": "A", "rows": [[{}]]}]}, {"kind": "spreadsheet", "sheets": [{"name": "A", "rows": [["x"] * 50_001]}]},
        {"kind": "presentation", "slides": [{"number": 0, "text": "", "notes": ""}]}, {"kind": "presentation", "slides": [{"number": True, "text": "", "notes": ""}]},
        {"kind": "presentation", "slides": [{"number": 1, "text": "", "notes": ""}] * 2},
    ],
)
def test_content_of_another_shape_is_refused(bad):
    with pytest.raises(CorpusError) as error:
        pieces(bad, bad.get("kind", "document") if isinstance(bad, dict) else "document")
    assert error.value.code == "INVALID_STRUCTURED_CONTENT"


def run(spark, tmp_path, engine, contents, clock=1, payload=b"%PDF-1.7 shown"):
    folder = tmp_path / "payloads"
    folder.mkdir(exist_ok=True)
    rows, artifacts = [], []
    for kind, content in contents.items():
        (folder / kind).write_bytes(payload)
        beside = None
        if content is not None:
            beside = folder / f"{kind}.json"
            beside.write_text(json.dumps(content))
        # a native file's announced size and checksum are not those of its rendered payload
        rows.append(remote(kind, name=kind, mime_type=KINDS[kind], native_kind=kind, size=None, revision=str(clock)))
        artifacts.append((kind, str(clock), str(folder / kind), hashlib.sha256(payload).hexdigest(), beside and str(beside)))
    shot = Snapshot(f"run-{clock}", True, ("root-a",), f"2024-01-01T00:00:{clock:02}Z", spark.createDataFrame(rows, REMOTE_FILES))
    return engine.apply(shot, spark.createDataFrame(artifacts, ARTIFACTS), str(folder))


def test_native_files_are_synchronised(spark, tmp_path):
    engine = engine_at(spark, tmp_path)
    assert run(spark, tmp_path, engine, CONTENT) == "SYNC_OK_CHANGED"
    records = {(r["file_id"], r["locator"]): r["document"] for r in engine.records().collect()}
    assert records[("document", "section:Goals")] == "the travel budget\nis ten"
    assert records[("presentation", "slide:2")] == "Title\nNotes:\nsay this" and records[("presentation", "slide:1")] == "End"
    assert records[("spreadsheet", "sheet:Plan!A1:B4")].startswith("a\tb")
    assert {r["local_path"].rpartition("/")[2] for r in engine.records().collect()} == {"document.pdf", "spreadsheet.pdf", "presentation.pdf"}
    assert engine.objects().count() == 1


@pytest.mark.parametrize(
    ("contents", "payload", "code"),
    [
        ({"document": None}, b"%PDF-1", "INVALID_ARTIFACT"),
        ({"document": CONTENT["presentation"]}, b"%PDF-1", "INVALID_ARTIFACT"),
        ({"document": {"kind": "document", "sections": [{}]}}, b"%PDF-1", "INVALID_STRUCTURED_CONTENT"),
        ({"document": CONTENT["document"]}, b"no pdf", "INVALID_ARTIFACT"),
    ],
)
def test_wrong_native_artifacts_stop_the_run(spark, tmp_path, contents, payload, code):
    engine = engine_at(spark, tmp_path)
    with pytest.raises(CorpusError) as error:
        run(spark, tmp_path, engine, contents, payload=payload)
    assert error.value.code == code and engine.header()["version"] is None
    assert run(spark, tmp_path, engine, {"document": CONTENT["document"]}, clock=2) == "SYNC_OK_CHANGED"


def test_artifact_rules_for_structured_files(spark):
    downloads = spark.createDataFrame([("a", "1", "document"), ("b", "1", None), ("c", "1", None)], "file_id string, revision string, native_kind string")
    sha = "0" * 64
    made = spark.createDataFrame([("a", "1", "/p/a", sha, None), ("b", "1", "/p/b", sha, "/p/b.json"), ("c", "1", "/p/a", sha, None)], ARTIFACTS)
    got = {(r["file_id"], r["violation"]) for r in inventory.artifact_violations(downloads, made).collect()}
    assert got == {("a", "structured_file_missing"), ("b", "structured_file_unexpected"), ("a", "path_repeated")}
