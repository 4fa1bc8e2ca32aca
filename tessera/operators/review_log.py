"""Review operations as an append-only log: the state of a document is a fold over its operations in order.

Operations of different documents don't meet, so documents are folded side by side; one document's operations are what people
did to it by hand. The fold tells of every operation whether it counted, and the revision it led to; nothing is overwritten.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .greedy import per_groups

QUALITIES = ("unreviewed", "good", "bad", "partial")
DECISIONS = ("same", "different", "unsure")
OUT = "kind string, seq bigint, accepted boolean, revision bigint, reason string, piece bigint, other bigint, value string, quality string, first double, last double, dets array<bigint>"


class Refused(ValueError):
    """An operation that doesn't count."""


@dataclass
class State:
    """Pieces (id: detections with their times, in order of time), labels, qualities, relations (a < b: decision)."""

    pieces: dict[int, list[tuple[float, int]]]
    labels: dict[int, str] = field(default_factory=dict)
    quality: dict[int, str] = field(default_factory=dict)
    relations: dict[tuple[int, int], str] = field(default_factory=dict)

    def copy(self) -> State:
        """A state of its own. Detections of a piece are replaced, never changed, so both may hold the same list."""
        return State(dict(self.pieces), dict(self.labels), dict(self.quality), dict(self.relations))

    def new_label(self) -> str:
        numbers = [int(m[1]) for v in self.labels.values() if (m := re.fullmatch(r"P(\d+)", v))]
        return f"P{max(numbers, default=0) + 1}"

    def _known(self, *ids: int | None) -> None:
        if not ids or any(i not in self.pieces for i in ids):
            raise Refused("unknown piece")

    def label(self, pieces: list[int], value: str | None) -> None:
        self._known(*pieces)
        value = self.new_label() if value == "NEW" else value
        for i in pieces:
            if value:
                self.labels[i] = value
            else:
                self.labels.pop(i, None)

    def rate(self, pieces: list[int], value: str | None) -> None:
        self._known(*pieces)
        if value not in QUALITIES:
            raise Refused("unknown quality")
        self.quality |= dict.fromkeys(pieces, value)

    def merge(self, old: str | None, new: str | None) -> None:
        if not old or not new or "?" in (old, new):
            raise Refused("unknown people aren't merged")
        self.labels = {i: new if v == old else v for i, v in self.labels.items()}

    def split(self, piece: int, at: float | None) -> None:
        """The part from ``at`` on is a new piece; what was said about the whole no longer holds."""
        self._known(piece)
        dets = self.pieces[piece]
        before, after = [d for d in dets if at is not None and d[0] < at], [d for d in dets if at is not None and d[0] >= at]
        if not before or not after:
            raise Refused("no moment inside the piece")
        self.pieces[piece], self.pieces[max(self.pieces) + 1] = before, after
        self.relations = {k: v for k, v in self.relations.items() if piece not in k}
        self.labels.pop(piece, None)
        self.quality.pop(piece, None)

    def relate(self, a: int, b: int, decision: str | None) -> None:
        """"same" gives both one label, "different" takes a shared one from the second."""
        self._known(a, b)
        if a == b or decision not in DECISIONS:
            raise Refused("no pair")
        a, b = sorted((a, b))
        self.relations[a, b] = decision
        one, two = self.labels.get(a), self.labels.get(b)
        if decision == "same":
            self.labels[a] = self.labels[b] = next((v for v in (one, two) if v and v != "?"), None) or self.new_label()
        elif decision == "different" and one and one == two and one != "?":
            del self.labels[b]


class Log:
    """A document's state with its revision and the state before the last operation, for one step back."""

    def __init__(self, pieces: dict[int, list[tuple[float, int]]]):
        self.state, self.previous, self.revision = State(pieces), None, 0

    def apply(self, action: str, pieces: list[int], value: str | None, other: str | None, at: float | None, expected: int | None) -> None:
        """All or nothing; an ``expected`` revision that isn't the current one refuses the operation."""
        if expected is not None and expected != self.revision:
            raise Refused("stale revision")
        if action == "undo":
            if self.previous is None:
                raise Refused("nothing to undo")
            self.state, self.previous = self.previous, None
        else:
            tried = self.state.copy()
            if action == "label":
                tried.label(pieces, value)
            elif action == "quality":
                tried.rate(pieces, value)
            elif action == "merge":
                tried.merge(value, other)
            elif action == "split":
                tried.split(pieces[0] if pieces else None, at)
            elif action == "relation":
                tried.relate(*(pieces if len(pieces) == 2 else (None, None)), value)
            else:
                raise Refused("unknown action")
            self.state, self.previous = tried, self.state
        self.revision += 1


def fold_reviews(pieces: DataFrame, operations: DataFrame) -> DataFrame:
    """Outcomes and final states of documents: (doc, kind, ...) with a row for each operation, piece and relation.

    ``pieces``: (doc, piece, det, t), one row a detection. ``operations``: (doc, seq, action, pieces array, value, other, at,
    expected), folded by ``seq``. Kinds: "op" (seq, accepted, revision after it, reason), "piece" (piece, value: its label,
    quality, first, last, dets), "relation" (piece, other, value). Operations on documents without pieces are refused.
    """
    kind = pieces.schema["doc"].dataType.simpleString()
    rows = pieces.select("doc", F.lit(0).alias("part"), F.col("piece").cast("bigint").alias("seq"), F.col("t").cast("double").alias("at"), F.col("det").cast("bigint").alias("det"))
    ops = operations.select(
        "doc", F.lit(1).alias("part"), F.col("seq").cast("bigint").alias("seq"), F.col("at").cast("double").alias("at"), "action", F.col("pieces").cast("array<bigint>").alias("pieces"), "value", "other", F.col("expected").cast("double").alias("expected")
    )

    none = lambda v: None if v is None or (isinstance(v, float) and pd.isna(v)) else v

    def fold(own: list[tuple], asked: list[tuple]) -> list[tuple]:
        held: dict[int, list] = {}
        for p, t, d in own:
            held.setdefault(int(p), []).append((float(t), int(d)))
        log, out = Log({p: sorted(v) for p, v in held.items()}), []
        for seq, at, action, ids, value, other, expected in asked:
            try:
                log.apply(action, [int(i) for i in ids] if none(ids) is not None else [], none(value), none(other), none(at), None if pd.isna(expected) else int(expected))
                out.append(("op", seq, True, log.revision, None, None, None, None, None, None, None, None))
            except Refused as e:
                out.append(("op", seq, False, log.revision, str(e), None, None, None, None, None, None, None))
        s = log.state
        out += [("piece", None, None, log.revision, None, p, None, s.labels.get(p), s.quality.get(p, "unreviewed"), d[0][0], d[-1][0], [x for _, x in d]) for p, d in sorted(s.pieces.items())]
        return out + [("relation", None, None, log.revision, None, a, b, v, None, None, None, None) for (a, b), v in sorted(s.relations.items())]

    def run(f: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        doc, part = f["doc"].tolist(), f["part"].tolist()
        own = list(zip(f["seq"].tolist(), f["at"].tolist(), f["det"].tolist(), strict=True))
        asked = list(zip(*[f[c].tolist() for c in ("seq", "at", "action", "pieces", "value", "other", "expected")], strict=True))
        out, at = [], np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(f)).tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            k = a + sum(1 for x in part[a:b] if x == 0)  # pieces come first
            out += [(doc[a], *row) for row in fold(own[a:k], asked[k:b])]
        frame = pd.DataFrame(out, columns=["doc", *[c.split()[0] for c in OUT.split(", ")]])
        for c in ("seq", "piece", "other", "revision"):
            frame[c] = frame[c].astype("Int64")
        frame["accepted"] = frame["accepted"].astype("boolean")
        return frame

    return per_groups(rows.unionByName(ops, allowMissingColumns=True).where("doc is not null"), ["doc"], ["part", "seq", "at"], run, f"doc {kind}, {OUT}")
