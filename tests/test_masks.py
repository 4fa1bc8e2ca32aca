"""Masks, suppression, assignment and seams against plain numpy and sequential versions."""

from collections import defaultdict

import numpy as np
import pytest

from tessera.operators import masks
from tessera.operators.greedy import assignment
from tessera.plans import mask_views

SF = "/root/testdata/sf0.001"


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def _boxes(rng, n, size=60):
    out = []
    for k in range(n):
        x, y, w, h = (int(v) for v in (*rng.integers(-20, size, 2), *rng.integers(1, 25, 2)))
        out.append((k, int(rng.integers(3)), x, y, x + w, y + h))
    return out


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for w, h in ((1, 1), (3, 5), (8, 2), (17, 9)):
        m = rng.random((h, w)) < 0.4
        assert (masks.unpack(masks.pack(m), w, h) == m).all()


def test_overlapping_boxes_and_mask_areas(spark):
    rng = np.random.default_rng(2)
    rows = _boxes(rng, 60)
    canvas = {}
    for k, _, x0, y0, x1, y1 in rows:
        m = rng.random((y1 - y0, x1 - x0)) < 0.5
        canvas[k] = (m, {(x0 + i, y0 + j) for j, i in zip(*np.nonzero(m), strict=True)})
    df = spark.createDataFrame([(*r, masks.pack(canvas[r[0]][0]) if r[0] % 9 else None) for r in rows] + [(99, 0, 5, 5, 5, 9, None)], "id bigint, k int, x0 bigint, y0 bigint, x1 bigint, y1 bigint, mask binary")
    met = masks.overlapping(df, masks.other(df, ["k"]), ["k"], 10).where("id < idr")
    got = {(r["id"], r["idr"]): (r["inter"], r["area"], r["arear"]) for r in masks.mask_overlap(met, ["id", "idr"]).collect()}
    pixels = {k: canvas[k][1] if k % 9 else set() for k in canvas}
    want = {(a[0], b[0]): (len(pixels[a[0]] & pixels[b[0]]), len(pixels[a[0]]), len(pixels[b[0]])) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and _iou(a[2:], b[2:]) > 0}
    assert got == want and len(want) > 20
    ious = {(r["id"], r["idr"]): r["v"] for r in met.withColumn("v", masks.box_iou()).collect()}
    assert all(v == pytest.approx(_iou(rows[a][2:], rows[b][2:])) for (a, b), v in ious.items())


@pytest.mark.parametrize("kind, tail", [("any", 0), ("chain", 20_000), ("any", 30)])
def test_first_ones_stay(spark, monkeypatch, kind, tail):
    monkeypatch.setattr(masks, "TAIL", tail)
    rng = np.random.default_rng(3)
    pairs = {(k, k + 1) for k in range(400)} if kind == "chain" else {tuple(sorted(map(int, rng.integers(0, 60, 2)))) for _ in range(120)}
    kept: list[int] = []
    for x in range(401):
        if not any((k, x) in pairs for k in kept):
            kept.append(x)
    gone = [r["node"] for r in masks.keep_first(spark.createDataFrame([*pairs, (7, 7)], "early bigint, late bigint")).collect()]
    assert len(gone) == len(set(gone)) and set(gone) == {x for p in pairs for x in p if x not in kept}


def test_assignment_by_parts_equals_the_whole_matrix(spark):
    rng = np.random.default_rng(4)
    rows = [(g, int(a), 100 + int(b), float(w)) for g in range(6) for a, b, w in {(x, y): (x, y, z) for x, y, z in zip(rng.integers(0, 9, 14), rng.integers(0, 9, 14), rng.random(14), strict=True)}.values()]
    got = masks.assign_pairs(spark.createDataFrame(rows, "g int, a bigint, b bigint, weight double"), ["g"]).collect()
    for g in range(6):
        own = {(a, b): w for k, a, b, w in rows if k == g}
        m = np.zeros((9, 9))
        for (a, b), w in own.items():
            m[a, b - 100] = w
        best = {(i, j + 100) for i, j in assignment(-m) if m[i, j] > 0}
        assert {(r["a"], r["b"]) for r in got if r["g"] == g} == best


def test_labels_move_as_by_whole_matrices(spark):
    seen = mask_views.detections(spark, SF)
    a, b = seen.collect(), mask_views.second_detector(seen).collect()
    truth, other = defaultdict(list), defaultdict(list)
    for r in a:
        truth[r["cam"], r["frame"]].append(r)
    for r in b:
        other[r["cam"], r["frame"]].append(r)
    got = defaultdict(dict)
    for r in mask_views.truth_transfer(spark, SF).collect():
        got[r["cam"], r["frame"]][r["det"]] = (r["label"], r["iou"])
    n = 0
    for key, dets in other.items():
        m = np.array([[_iou([d[c] for c in masks.BOX], [t[c] for c in masks.BOX]) for t in truth[key]] for d in dets])
        want = {dets[i]["det"]: (truth[key][j]["user_id"], round(m[i, j], 9)) for i, j in assignment(-m) if m[i, j] > 0.5}
        n += len(want)
        assert got[key] == want
    assert n > 500


def _seams(rows, least):
    """One piece of film: chunks one after the other."""
    shown = defaultdict(dict)
    for chunk, frame, local, box, m in rows:
        shown[chunk, frame][local] = {(box[0] + i, box[1] + j) for j, i in zip(*np.nonzero(m), strict=True)}
    piece = {}
    for c in sorted({r[0] for r in rows}):
        here, total, seen = {r[2] for r in rows if r[0] == c}, defaultdict(float), defaultdict(int)
        for f in {f for k, f in shown if k == c} & {f for k, f in shown if k == c - 1}:
            for a, p in shown[c - 1, f].items():
                for b, q in shown[c, f].items():
                    seen[a, b] += 1
                    total[a, b] += len(p & q) / max(1, len(p | q))
        ids, new = sorted({a for a, _ in seen}), sorted({b for _, b in seen})
        m = np.array([[total[a, b] / max(1, seen[a, b]) for b in new] for a in ids]).reshape(len(ids), len(new))
        links = {new[j]: ids[i] for i, j in assignment(-m) if m[i, j] >= least}
        for b in here:
            piece[c, b] = piece[c - 1, links[b]] if b in links else (c, b)
    first = {}
    for c, f in shown:
        first[f] = min(c, first.get(f, c))
    return piece, {(c, f, b, piece[c, b]) for c, f, b, *_ in rows if first[f] == c}


def test_pieces_through_chunks(spark):
    rng = np.random.default_rng(9)
    rows = []
    for who in range(6):
        x = int(rng.integers(0, 60))
        for frame in range(0, 60):
            if rng.random() < 0.7:
                m = rng.random((9, 7)) < 0.8
                for chunk in {frame // 12} | ({frame // 12 - 1} if frame % 12 < 4 and frame >= 12 else set()):
                    rows.append((chunk, frame, (who + chunk * 5) % 11, (x + frame // 3, 4, x + frame // 3 + 7, 13), m if chunk == frame // 12 else m & (rng.random((9, 7)) < 0.9)))
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame([(1, c, f, b, *box, masks.pack(m)) for c, f, b, box, m in rows], "film int, chunk bigint, frame bigint, local bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, mask binary")
    pieces, owned = masks.link_chunks(df, ["film"])
    name, stay = _seams(rows, 0.3)
    text = {k: f"1|{c:012d}:{b}" for k, (c, b) in name.items()}
    assert {(r["chunk"], r["local"]): r["piece"] for r in pieces.collect()} == text
    assert {(r["chunk"], r["frame"], r["local"], r["piece"]) for r in owned.collect()} == {(c, f, b, text[c, b]) for c, f, b, _ in stay}
    assert len(set(text.values())) < len(text)


def test_only_frames_that_two_chunks_show_are_compared(spark, monkeypatch):
    """Rows of other frames can't meet anything: with their masks they needn't be dealt to the grid."""
    full = masks.pack(np.ones((4, 4)))
    rows = [(1, c, f, who, 8 * who, 0, 8 * who + 4, 4, full) for c in range(3) for f in range(10 * c, 10 * c + 12) for who in range(5)]
    rows += [(None, 0, 11, 0, 0, 0, 4, 4, full), (1, 0, None, 0, 0, 0, 4, 4, full)]
    df = spark.createDataFrame(rows, "film int, chunk bigint, frame bigint, local bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, mask binary")
    given, real = [], masks.overlapping
    monkeypatch.setattr(masks, "overlapping", lambda left, right, *more: given.append((left.count(), right.count())) or real(left, right, *more))
    pieces, owned = masks.link_chunks(df, ["film"])
    assert given == [(20, 20)]  # two frames of five people at each of two seams
    assert {(r["chunk"], r["local"]): r["piece"] for r in pieces.where("film = 1").collect()} == {(c, who): f"1|{0:012d}:{who}" for c in range(3) for who in range(5)}
    first = {(f, who): min(c for c in range(3) if 10 * c <= f < 10 * c + 12) for f in range(32) for who in range(5)}
    assert {(r["frame"], r["local"]): r["chunk"] for r in owned.collect()} == first and owned.count() == len(first)
