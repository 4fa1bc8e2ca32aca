"""Stream operators fed from files."""

import json

from tessera.streaming import stateful

SCHEMA = "person string, ts timestamp, kind string"


def _write(path, name, rows):
    (path / name).write_text("".join(json.dumps({"person": p, "ts": f"2026-01-01T00:{t // 60:02d}:{t % 60:02d}Z", "kind": k}) + "\n" for p, t, k in rows))


def test_stretches_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src, "1.json", [("a", 0, "in"), ("a", 60, "out"), ("a", 100, "in"), ("a", 200, "out"), ("b", 5, "in"), ("b", 10, "out"), ("c", 30, "out")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    q = stateful.stretches(stream).writeStream.format("memory").queryName("stretches").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q2 = stateful.windowed_counts(stream, "ts", "1 minute").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        q.processAllAvailable()
        _write(src, "2.json", [("z", 1800, "in")])
        q.processAllAvailable()
        _write(src, "3.json", [("z", 3000, "out")])
        q.processAllAvailable()
        q2.processAllAvailable()
    finally:
        q.stop()
        q2.stop()
    got = {(r["person"], r["end"] - (r["start"] if r["start"] is not None else r["end"]), r["complete"]) for r in spark.table("stretches").collect()}
    assert ("a", 200.0, True) in got and ("c", 0.0, False) in got
    assert not any(p == "b" for p, _, _ in got)
    assert sum(r["n"] for r in spark.table("windows").collect()) == 8
