"""Frame clocks and tick files: what dropped frames and cut-off files do."""

import gzip
import json

import pytest

from tessera.operators import frame_clock
from tessera.sources.ticks import read_ticks

SEG, STEP = 900_000_000, 40_000


@pytest.fixture(scope="module")
def recording(spark):
    """Two segments of 900 s; the second lost 250 frames in one burst a third of the way in. A third one's times go backwards."""
    full = [k * STEP for k in range(22_500)]
    lossy = [k * STEP for k in range(7_500)] + [310_000_000 + k * STEP for k in range(14_750)]
    rows = [("cam1", seg, k, off) for seg, times in ((0, full), (1, lossy)) for k, off in enumerate(times)] + [("cam2", 0, 0, 0), ("cam2", 0, 1, 80_000), ("cam2", 0, 2, 40_000)]
    segments = spark.createDataFrame([("cam1", 0, 0), ("cam1", 1, SEG), ("cam2", 0, 0), ("cam3", 0, 0)], "cam string, seg int, start bigint")
    return segments, spark.createDataFrame(rows, "cam string, seg int, k int, off bigint")


def _walls(spark, recording, clip, ks):
    clips = spark.createDataFrame([(1, *clip)], "clip int, cam string, start bigint, landed bigint")
    found = frame_clock.walls(*recording, clips, spark.createDataFrame([(1, k) for k in ks], "clip int, k int"), SEG, STEP)
    return {r["k"]: r["wall"] for r in found.collect()}, found


def test_time_comes_from_the_recording(spark, recording):
    got, found = _walls(spark, recording, ("cam1", SEG, None), [0, 7_499, 7_500, 14_999, 22_249, 22_250])
    assert got == {0: SEG, 7_499: SEG + 299_960_000, 7_500: SEG + 310_000_000, 14_999: SEG + 609_960_000, 22_249: SEG + 310_000_000 + 14_749 * STEP, 22_250: None}
    (d,) = frame_clock.drift(found.where("k <= 14999"), STEP).collect()
    assert (d["last"], d["largest"]) == (10_000_000, 10_000_000)


def test_a_clip_runs_on_into_the_next_segment(spark, recording):
    got, _ = _walls(spark, recording, ("cam1", 880_000_000, None), [499, 500, 10_000_000])
    assert got == {499: SEG - STEP, 500: SEG, 10_000_000: None}
    assert _walls(spark, recording, ("cam1", 880_000_000, 22_499), [0, 1])[0] == {0: SEG - STEP, 1: SEG}  # where the reader really landed


def test_nothing_is_invented(spark, recording):
    for clip in (("cam1", -SEG, None), ("cam9", 0, None), ("cam2", 0, None), ("cam3", 0, None)):
        assert _walls(spark, recording, clip, [0, 1])[0] == {0: None, 1: None}
    assert [tuple(r) for r in frame_clock.disordered(recording[1]).collect()] == [("cam2", 0)]


def _ticks(path, name, head, rows, cut=None, more=b""):
    data = gzip.compress("".join(json.dumps(r) + "\n" for r in [head, *rows]).encode()) + more
    (path / name).write_bytes(data[:cut])


def test_whole_stretches_of_cut_off_files(spark, tmp_path):
    rows = [{"s": s, "t": s + k / 1000, "p": [{"w": k}]} for s in range(4) for k in range(500)]
    spans = {"spans": [[s, s + 1] for s in range(4)]}
    _ticks(tmp_path, "whole.gz", spans, rows)
    _ticks(tmp_path, "longer.gz", {"spans": [*spans["spans"], [9, 10]]}, rows)
    _ticks(tmp_path, "cut.gz", spans, rows, cut=-2500)
    _ticks(tmp_path, "done.gz", spans | {"sam_done": [0, 2]}, rows)
    _ticks(tmp_path, "members.gz", spans, rows[:700], more=gzip.compress("".join(json.dumps(r) + "\n" for r in rows[700:]).encode()))
    _ticks(tmp_path, "broken.gz", spans, [*rows[:1200], "nonsense", *rows[1200:]])
    (tmp_path / "empty.gz").write_bytes(b"")
    (tmp_path / "noise.gz").write_bytes(b"not gzip at all")
    got = {}
    for r in read_ticks(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["s"], r["t"], json.loads(r["line"])["p"][0]["w"]))
    want = lambda *s: [(x["s"], x["t"], x["p"][0]["w"]) for x in rows if x["s"] in s]
    assert set(got) == {"whole.gz", "longer.gz", "cut.gz", "done.gz", "members.gz", "broken.gz"}
    assert sorted(got["whole.gz"]) == sorted(got["members.gz"]) == want(0, 1, 2, 3)
    assert sorted(got["longer.gz"]) == want(0, 1, 2) and sorted(got["done.gz"]) == want(0, 2) and sorted(got["broken.gz"]) == want(0, 1)
    assert sorted(got["cut.gz"]) in (want(0), want(0, 1), want(0, 1, 2)) and got["cut.gz"]
