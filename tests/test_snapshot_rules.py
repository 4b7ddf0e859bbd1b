import json

import pytest

from lorekeel.errors import CorpusError
from lorekeel.operators import inventory
from lorekeel.schemas import INVENTORY
from lorekeel.streaming.snapshots import read_inventory

FILE = {
    "file_id": "f", "name": "f.txt", "mime_type": "text/plain", "revision": "1", "modified_time": "2024-01-01T00:00:00Z", "drive_url": "https://drive.example.org/f", "checksum": None, "size": None,
    "paths": [{"root_id": "r", "parent_ids": ["r"], "parts": ["f.txt"]}], "native_kind": None,
}
SHOT = {"schema_version": "1", "run_id": "run-1", "complete": True, "root_ids": ["r"], "files": [FILE], "incomplete_reason": None, "generated_at": "2024-01-01T00:00:00Z"}


def test_keys_are_closed_at_every_level(spark):
    stray = json.loads(json.dumps(SHOT))
    stray["more"] = 1
    del stray["files"][0]["size"]
    stray["files"][0]["paths"][0]["shortcut"] = {}
    raw = spark.createDataFrame([(json.dumps(SHOT),), (json.dumps(stray),), ("[1]",)], "value string")
    got = sorted((r["place"], r["violation"]) for r in inventory.key_violations(raw, INVENTORY).collect())
    assert got == [("inventory", "no object"), ("inventory", "unexpected keys: more"), ("inventory.files", "missing keys: size"), ("inventory.files.paths", "unexpected keys: shortcut")]


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"schema_version": "2"}, "UNSUPPORTED_SCHEMA"), ({"run_id": " "}, "INVALID_INVENTORY"), ({"generated_at": "2024-01-01"}, "INVALID_INVENTORY"), ({"root_ids": ["r", "r"]}, "INVALID_INVENTORY"),
        ({"root_ids": ["\n"]}, "INVALID_INVENTORY"), ({"incomplete_reason": "cap"}, "INVALID_INVENTORY"), ({"complete": False}, "INVALID_INVENTORY"), ({"files": [FILE | {"more": 1}]}, "INVALID_INVENTORY"),
    ],
)
def test_headers_and_keys_are_checked_on_reading(spark, tmp_path, change, code):
    path = tmp_path / "shot.json"
    path.write_text(json.dumps(SHOT))
    shot = read_inventory(spark, str(path))
    assert shot.run_id == "run-1" and inventory.inventory_counts(shot.files).first().asDict() == {"roots": 1, "files": 1}
    path.write_text(json.dumps(SHOT | change))
    with pytest.raises(CorpusError) as error:
        read_inventory(spark, str(path))
    assert error.value.code == code


def test_validate_command(spark, tmp_path, capsys):
    from lorekeel.__main__ import main

    (tmp_path / "shot.json").write_text(json.dumps(SHOT))
    assert main([str(tmp_path / "state"), "validate", str(tmp_path / "shot.json")]) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 1
    (tmp_path / "shot.json").write_text(json.dumps(SHOT | {"files": [FILE | {"revision": ""}]}))
    assert main([str(tmp_path / "state"), "validate", str(tmp_path / "shot.json")]) == 2
    assert json.loads(capsys.readouterr().out)["status"] == "INVALID_INVENTORY"
