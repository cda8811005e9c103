"""Backups: both kinds, whatever their name, streamed and coerced."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from agora.sources import backup

DOCUMENT = {
    "schemaVersion": 2,
    "metadata": {"jobs": [1, 2], "note": "}]"},
    "jobs": [{"id": "j1", "status": "", "candidateMode": "research", "source_job_ids": [" a ", "", 7], "total_urls": "7", "created_at": "2024-01-02T03:04:05Z"}, {"id": "j2", "status": "running", "failed_count": -1.5, "finished_at": "bad"}, 5],
    "jobItems": [{"id": f"i{k}", "row_number": k, "input_url": "é\"\\" * k, "manual_capture_required": "Yes", "candidate_reviews": [{"a": [1, {"b": "]"}]}] if k % 2 else "no"} for k in range(300)],
    "jobEvents": [{"id": "e", "message": None, "level": False}],
    "other": -12.5e3,
}


def written(tmp_path, kind, name):
    text = json.dumps(DOCUMENT, ensure_ascii=kind == "ascii", indent=2 if kind == "indented" else None).encode()
    text = b"\xef\xbb\xbf" + text if kind == "marked" else text
    path = tmp_path / name
    path.write_bytes(gzip.compress(text) if kind == "gzip" else gzip.compress(text[:99]) + gzip.compress(text[99:]) if kind == "parts" else text)
    return str(path)


@pytest.mark.parametrize("kind, name", [("plain", "a.json"), ("gzip", "a.db"), ("gzip", "a.json"), ("plain", "a.db"), ("indented", "b"), ("marked", "c.json"), ("ascii", "d.json"), ("parts", "e.db")])
def test_round_trip(spark, tmp_path, monkeypatch, kind, name):
    monkeypatch.setattr(backup, "PIECE", 7)  # in this process: every value meets a piece's end
    path = written(tmp_path, kind, name)
    for table in backup.TABLES:
        got = [json.loads(r) for r in backup.records(backup._bytes(path), table)]
        assert got == [r if isinstance(r, dict) else {} for r in DOCUMENT.get(table, [])]
    rows = backup.read(spark, path)
    assert rows.rdd.getNumPartitions() == 4
    assert {r.table: r.n for r in rows.groupBy("table").agg(F.count("*").alias("n")).collect()} == {"jobs": 3, "jobItems": 300, "jobEvents": 1}
    held = [json.loads(r.record) for r in backup.read(spark, f"file://{path}", "jobItems").orderBy("position").collect()]
    assert held == DOCUMENT["jobItems"]


def test_defaults(spark, tmp_path):
    now = F.lit("2024-05-05").cast("timestamp")
    rows = backup.read(spark, written(tmp_path, "plain", "a.json"))
    jobs = {r.id: r for r in backup.normalized(rows, "jobs", now).collect()}
    assert (jobs["j1"].status, jobs["j1"].total_urls, jobs["j1"].failed_count) == ("queued", 7, 0) and jobs["j1"].updated_at == jobs["j1"].created_at
    assert (jobs["j2"].status, jobs["j2"].failed_count, jobs["j2"].finished_at) == ("running", -1, None) and str(jobs["j2"].created_at) == "2024-05-05 00:00:00"
    assert "" in jobs and jobs["j1"].candidate_mode == "research" and jobs["j1"].source_job_ids == ["a", "7"] and jobs["j2"].source_job_ids == []
    items = {r.id: r for r in backup.normalized(rows, "jobItems", now).collect()}
    assert items["i1"].candidate_reviews == '[{"a":[1,{"b":"]"}]}]' and items["i2"].candidate_reviews == "[]" and items["i2"].status == "queued" and items["i2"].analysis_source == "automated" and items["i2"].manual_capture_required is True
    event = backup.normalized(rows, "jobEvents", now).first()
    assert (event.level, event.scope, event.message) == ("info", "job", "")
    assert backup.normalized(rows, "manualReviewTargets", now).count() == 0


@pytest.mark.parametrize("text", ["", "  ", "[1]", '{"jobs": [1, 2', '{"jobs": [{"a": 1} {"b": 2}]', '{"jobs" 1}', "{nope}"])
def test_what_is_no_backup(tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    with pytest.raises(ValueError):
        list(backup.records(backup._bytes(str(path)), "jobs"))
