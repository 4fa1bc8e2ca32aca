"""Operation logs and film edits: what a person does, step by step, and random logs against a plain fold."""

import time

import numpy as np
import pytest

from tessera.operators import film_edits, review_log

PIECES = "doc string, piece int, det bigint, t double"
OPS = "doc string, seq bigint, action string, pieces array<int>, value string, other string, at double, expected bigint"
TRACKS = "day int, track string, first double, last double, fp string"
EDITS = "day int, seq bigint, action string, track string, part string, target string, at double, kind string, print string"


def _folded(spark, pieces, ops):
    rows = review_log.fold_reviews(spark.createDataFrame(pieces, PIECES), spark.createDataFrame(ops, OPS)).collect()
    done = {(r["doc"], r["seq"]): (r["accepted"], r["revision"], r["reason"]) for r in rows if r["kind"] == "op"}
    state = {(r["doc"], r["piece"]): (r["value"], r["quality"], r["dets"]) for r in rows if r["kind"] == "piece"}
    return done, state, {(r["doc"], r["piece"], r["other"]): r["value"] for r in rows if r["kind"] == "relation"}


def test_operations_of_a_document(spark):
    pieces = [("a", p, 10 * p + k, float(k)) for p in (0, 1, 2) for k in range(4)] + [("b", 0, 1, 0.5)]
    ops = [
        ("a", 1, "label", [0, 1], "NEW", None, None, 0), ("a", 2, "label", [2], "P7", None, None, 0), ("a", 3, "label", [2], "P7", None, None, 1), ("a", 4, "relation", [2, 1], "same", None, None, None),
        ("a", 5, "split", [0], None, None, 2.0, None), ("a", 6, "split", [0], None, None, 9.0, None), ("a", 7, "label", [3], "NEW", None, None, None), ("a", 8, "merge", None, "P1", "P8", None, None),
        ("a", 9, "relation", [1, 2], "different", None, None, None), ("a", 10, "quality", [1], "good", None, None, None), ("a", 11, "quality", [1], "odd", None, None, None), ("a", 12, "undo", None, None, None, None, None),
        ("a", 13, "undo", None, None, None, None, None), ("b", 1, "relation", [0, 0], "same", None, None, None), ("b", 2, "label", [5], "P1", None, None, None), ("c", 1, "label", [0], "P1", None, None, None),
    ]
    done, state, relations = _folded(spark, pieces, ops)
    assert [done["a", k][0] for k in range(1, 14)] == [True, False, True, True, True, False, True, True, True, True, False, True, False]
    assert done["a", 2] == (False, 1, "stale revision") and done["a", 13] == (False, 9, "nothing to undo") and done["c", 1][2] == "unknown piece"
    assert [done["b", k][:2] for k in (1, 2)] == [(False, 0), (False, 0)]
    # the split took what was said of the whole, "different" the label of the second, the undo the quality
    assert state["a", 0] == (None, "unreviewed", [0, 1]) and state["a", 3][2] == [2, 3]
    assert [state["a", k][0] for k in (1, 2, 3)] == ["P8", None, "P2"]
    assert state["a", 1][1] == "unreviewed" and relations == {("a", 1, 2): "different"}


def test_random_logs_are_whole_and_repeatable(spark):
    rng = np.random.default_rng(4)
    pieces, ops = [], []
    for doc in "abcdef":
        pieces += [(doc, p, 100 * p + k, float(k)) for p in range(4) for k in range(6)]
        for seq in range(60):
            action = str(rng.choice(["label", "quality", "merge", "split", "relation", "undo"]))
            value = {"label": str(rng.choice(["NEW", "P1", "P2", ""])), "quality": str(rng.choice([*review_log.QUALITIES, "x"])), "merge": "P1", "relation": str(rng.choice(review_log.DECISIONS))}.get(action)
            ops.append((doc, seq, action, [int(x) for x in rng.integers(0, 6, 2 if action == "relation" else 1)], value, "P2" if action == "merge" else None, float(rng.integers(0, 7)), int(rng.integers(0, 40)) if rng.random() < 0.2 else None))
    done, state, _ = _folded(spark, pieces, ops)
    for doc in "abcdef":
        dets = sorted(d for (k, _), (_, _, x) in state.items() if k == doc for d in x)
        assert dets == sorted(d for k, _, d, _ in pieces if k == doc)  # splits lose and repeat no detection
        accepted = [done[doc, s] for s in range(60)]
        assert [r for ok, r, _ in accepted if ok] == list(range(1, 1 + sum(ok for ok, *_ in accepted)))
    shuffled = [ops[k] for k in rng.permutation(len(ops))]
    assert _folded(spark, pieces[::-1], shuffled)[:2] == (done, state)


def test_operations_on_a_large_document_cost_what_they_change():
    """A copy of all detections for every operation took over a minute here."""
    log, began = review_log.Log({p: [(float(k), 5000 * p + k) for k in range(5000)] for p in range(20)}), time.process_time()
    before = log.state
    for k in range(600):
        log.apply("label", [k % 20], f"P{k}", None, None, None)
    log.apply("split", [3], None, None, 100.0, None)
    assert time.process_time() - began < 5 and log.revision == 601
    assert len(before.pieces[3]) == 5000 and not before.labels and len(log.state.pieces[20]) == 4900
    log.apply("undo", [], None, None, None, None)
    assert len(log.state.pieces[3]) == 5000 and log.state.labels[3] == "P583" and 20 not in log.state.pieces


@pytest.fixture
def shop(spark):
    """Two people over two windows: A goes on in the second one, B and C have one track each."""
    tracks = spark.createDataFrame([(1, "w1:0", 40.0, 629.0, "f0"), (1, "w1:1", 50.0, 90.0, "f1"), (1, "w1:2", 60.0, 200.0, "f2"), (1, "w2:0", 630.0, 700.0, "f3")], TRACKS)
    return tracks, spark.createDataFrame([(1, "w1:0", "w2:0")], "day int, a string, b string")


def _people(spark, shop, *edits):
    prints = {"w1:0": "f0", "w1:1": "f1", "w1:2": "f2", "w2:0": "f3"}
    rows = [(1, k, e.get("action"), e.get("part", "@").split("@")[0] or None, e.get("part"), e.get("target"), e.get("at"), e.get("kind"), e.get("print") or prints.get(e.get("part", "@").split("@")[0])) for k, e in enumerate(edits)]
    return {r["part"]: r for r in film_edits.people(*shop, spark.createDataFrame(rows, EDITS)).collect()}


def test_split_join_false_kind_and_undo(spark, shop):
    got = _people(spark, shop)
    assert got["w1:0@"]["person"] == got["w2:0@"]["person"] != got["w1:1@"]["person"]
    split = {"action": "split", "part": "w2:0@", "at": 650.0}
    got = _people(spark, shop, split)
    assert got["w2:0@"]["person"] == got["w1:0@"]["person"] != got["w2:0@650.00"]["person"] and got["w2:0@"]["last"] == 650.0
    same = {"action": "same", "part": "w2:0@650.00", "target": "w1:2@"}
    got = _people(spark, shop, split, same)
    assert got["w2:0@650.00"]["person"] == got["w1:2@"]["person"]
    got = _people(spark, shop, split, same, {"action": "false", "part": "w1:1@"}, {"action": "kind", "part": "w1:0@", "kind": "staff"})
    assert got["w1:1@"]["false"] and got["w1:1@"]["person"] is None and got["w1:1@"]["kind"] is None
    assert got["w2:0@"]["kind"] == "staff" and got["w1:2@"]["kind"] == "customer"  # said once, it covers the person
    got = _people(spark, shop, split, {"action": "kind", "part": "w1:0@", "kind": "staff"}, {"action": "kind", "part": "w2:0@", "kind": "customer"})
    assert got["w1:0@"]["kind"] == "customer"  # the same person, any part
    got = _people(spark, shop, split, {"action": "undo"})
    assert set(got) == {"w1:0@", "w1:1@", "w1:2@", "w2:0@"}
    got = _people(spark, shop, {"action": "false", "part": "w1:1@"}, {"action": "false", "part": "w1:1@"})
    assert not got["w1:1@"]["false"]  # a second word takes it back
    got = _people(spark, shop, {"action": "false", "part": "w1:1@"}, {"action": "same", "part": "w1:1@", "target": "w1:2@"})
    assert not got["w1:1@"]["false"] and got["w1:1@"]["person"] == got["w1:2@"]["person"]


def test_a_cut_at_the_start_gives_the_whole_track_away(spark, shop):
    got = _people(spark, shop, {"action": "split", "part": "w2:0@", "at": 630.5})
    assert "w2:0@630.50" not in got and got["w2:0@"]["person"] != got["w1:0@"]["person"]


def test_edits_of_a_track_computed_anew_stop_counting(spark, shop):
    got = _people(spark, shop, {"action": "false", "part": "w1:2@", "print": "older"})
    assert got["w1:2@"]["stale"] and not got["w1:2@"]["false"] and not got["w1:0@"]["stale"]


def test_a_second_mark_on_the_spot_takes_the_first_back(spark, shop):
    rows = [(1, 0, "missed", None, "cam1", 700.0, 300.0, 200.0), (1, 1, "missed", None, "cam1", 700.5, 305.0, 210.0), (1, 2, "missed", None, "cam2", 700.0, 1.0, 1.0), (1, 3, "missed", None, "cam1", 700.0, 300.0, 200.0), (1, 4, "missed", None, "cam1", 702.0, 300.0, 200.0), (1, 5, "badmask", "w1:0", "w1:0@", 50.0, None, None), (1, 6, "badmask", "w1:0", "w1:0@", 51.0, None, None), (1, 7, "badmask", "w1:1", "w1:1@", 51.0, None, None)]
    marks = film_edits.marks(spark.createDataFrame(rows, "day int, seq bigint, action string, track string, part string, at double, x double, y double"))
    assert sorted((r["kind"], r["place"], r["at"]) for r in marks.collect()) == [("badmask", "w1:1@", 51.0), ("missed", "cam1", 700.0), ("missed", "cam1", 702.0), ("missed", "cam2", 700.0)]


def test_edits_and_tracks_are_derived_once(spark, shop):
    """Windows over the whole log stand behind them: they were derived again for every use."""
    tracks, links = shop
    edits = spark.createDataFrame([(1, 0, "split", "w2:0", "w2:0@", None, 650.0, None, "f3"), (1, 1, "same", "w1:1", "w1:1@", "w1:2@", None, None, "f1")], EDITS)
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(df, total):
        def run(frames):
            for f in frames:
                total.add(len(f))
                yield f

        return df.mapInPandas(run, df.schema)

    got = film_edits.people(counted(tracks, seen[0]), links, counted(edits, seen[1])).collect()
    assert len(got) == 5 and [x.value for x in seen] == [4, 2]
