"""Language ID: a bidirectional GRU over bytes labels every position; a document's probabilities are their mean.

The network is trained here in numpy by backpropagation through time on a bounded sample of windows (``SAMPLE_DOCS``
labelled documents of each language at most, ``WINDOWS`` windows of ``STEPS`` bytes of each). Gates are hard sigmoids,
clip(x/4 + 1/2, 0, 1), which keep a step to a few array operations. Prediction reads every byte of every text, cut into
windows of ``WINDOW`` bytes that start from a zero state on both sides, and pools the label probabilities of all positions that are letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_of, free_name, quoted, small_batches, table

HIDDEN = 8
STEPS = 64
SAMPLE_DOCS = 800
WINDOWS = 4
EPOCHS = 10
WINDOW = 256
NONE = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
#: ASCII letters and all bytes of characters beyond ASCII count as letter positions.
_IS_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _gates(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.25), out=x)
    np.add(x, np.float32(0.5), out=x)
    return np.clip(x, 0, 1, out=x)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or (not text.isascii() and any(map(str.isalpha, text))))


class ByteGru:
    """Two GRUs (left to right, right to left) and a softmax at every position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.labels, self.h = labels, hidden
        self.p = {}
        for d in "fb":
            self.p[f"e{d}"] = draw(256, 3 * hidden, scale=0.3)  # a byte's input to update gate, reset gate and candidate
            self.p[f"u{d}"] = draw(hidden, 2 * hidden, scale=0.3)
            self.p[f"c{d}"] = draw(hidden, hidden, scale=0.3)
        self.p["o"] = draw(2 * hidden, len(labels), scale=0.3)
        self.p["ob"] = np.zeros(len(labels), dtype=np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool, live: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States after every step, (steps, batch, hidden), for bytes (steps, batch); the state stays zero where ``live`` is false."""
        e, u, c, h = self.p[f"e{d}"], self.p[f"u{d}"], self.p[f"c{d}"], self.h
        state, out, tape = np.zeros((x.shape[1], h), dtype=np.float32), np.empty((*x.shape, h), dtype=np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            inp = e.take(x[t], axis=0)
            zr = _gates(state @ u + inp[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            rs = r * state
            n = np.tanh(rs @ c + inp[:, 2 * h :])
            if keep:
                tape.append((t, state, z, r, rs, n))
            state = n + z * (state - n)
            if live is not None:
                state = state * live[t][:, None]
            out[t] = state
        return out, tape

    def probabilities(self, x: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of every position of bytes (steps, batch); padding behind a text (``live`` false) leaves no trace in it."""
        f, b = self._run(x, "f", False)[0], self._run(x, "b", False, live)[0]
        s = f.reshape(-1, self.h) @ self.p["o"][: self.h]
        s += b.reshape(-1, self.h) @ self.p["o"][self.h :] + self.p["ob"]
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, backwards through time."""
        h, n = self.h, x.size
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        s = both @ self.p["o"] + self.p["ob"]
        s -= s.max(axis=2, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=2, keepdims=True)
        hot = np.eye(len(self.labels), dtype=np.float32)[y]
        loss = float(-np.log(np.maximum((p * hot).sum(axis=2), 1e-9)).mean())
        ds = (p - hot) / n
        g["o"] = both.reshape(n, -1).T @ ds.reshape(n, -1)
        g["ob"] = ds.sum(axis=(0, 1))
        back = ds @ self.p["o"].T
        for k, d in enumerate("fb"):
            u, c, dh = self.p[f"u{d}"], self.p[f"c{d}"], np.zeros((x.shape[1], h), dtype=np.float32)
            into = np.empty((*x.shape, 3 * h), dtype=np.float32)
            for t, state, z, r, rs, cand in reversed(runs[d][1]):
                dh = dh + back[t][:, k * h : (k + 1) * h]
                dn = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (state - cand) * 0.25 * ((z > 0) & (z < 1))
                drs = dn @ c.T
                dr = drs * state * 0.25 * ((r > 0) & (r < 1))
                dzr = np.concatenate([dz, dr], axis=1)
                g[f"c{d}"] += rs.T @ dn
                g[f"u{d}"] += state.T @ dzr
                into[t, :, : 2 * h], into[t, :, 2 * h :] = dzr, dn
                dh = dh * z + drs * r + dzr @ u.T
            order = np.argsort(x, axis=None, kind="stable")
            seen, first = np.unique(x.ravel()[order], return_index=True)
            g[f"e{d}"][seen] = np.add.reduceat(into.reshape(n, -1)[order], first, axis=0)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, seed: int = 2) -> ByteGru:
        """Adam on windows x (n, steps) with labels y (n)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                _, g = self.gradients(np.ascontiguousarray(x[pick].T), np.broadcast_to(y[pick], (x.shape[1], len(pick))))
                step += 1
                lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-3
                for k, p in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over the letter positions of each text, (texts, labels); all zero without letters."""
        total, letters = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        pieces = -(-lens // WINDOW)
        owner = np.repeat(np.arange(len(texts)), pieces)
        flat = np.frombuffer(b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, pieces, strict=True)), dtype=np.uint8).reshape(-1, WINDOW)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(lens[owner] - within * WINDOW, WINDOW)
        order = np.argsort(-size, kind="stable")  # whole windows first: only the others need a mask
        for at in range(0, len(flat), 1024):
            pick = order[at : at + 1024]
            steps = int(size[pick[0]])
            x = np.ascontiguousarray(flat[pick, :steps].T)
            live = None if size[pick[-1]] == steps else np.arange(steps)[:, None] < size[pick]
            p = self.probabilities(x, live)
            on = _IS_LETTER[x] if live is None else _IS_LETTER[x] & live
            p *= on[:, :, None]
            np.add.at(total, owner[pick], p.sum(axis=0))
            np.add.at(letters, owner[pick], on.sum(axis=0))
        return total / np.maximum(letters, 1)[:, None]


def training_windows(labelled: DataFrame, docs_each: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(lang, window) from about ``docs_each`` documents of each language, chosen by a hash of doc_id and text length."""
    usable = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null and length(text) > 0")
    counts = usable.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(1.25 * docs_each) / F.col("count"))
    picked = usable.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    raw = F.encode("text", "UTF-8")
    starts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.pmod(F.xxhash64("doc_id", k), F.greatest(F.length(raw) - STEPS, F.lit(1))).cast("int") + 1)
    cuts = picked.select("lang", F.explode(F.transform(starts, lambda s: F.substring(raw, s, F.lit(STEPS)))).alias("piece"))
    return [(r["lang"], bytes(r["piece"])) for r in cuts.collect()]


def train(windows: list[tuple[str, bytes]]) -> ByteGru | None:
    """The fitted network; None without windows."""
    labels = sorted({lang for lang, _ in windows})
    if not labels:
        return None
    windows = sorted(windows)
    x = np.zeros((len(windows), STEPS), dtype=np.uint8)
    for k, (_, w) in enumerate(windows):
        reps = (w * (STEPS // max(1, len(w)) + 1))[:STEPS]
        x[k] = np.frombuffer(reps, dtype=np.uint8)
    return ByteGru(labels).fit(x, np.array([labels.index(lang) for lang, _ in windows]))


def predict(docs: DataFrame, model: ByteGru | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, lang_pred and score (or other ``names`` for them). ``und`` with score 0 if the text is null or has no letter, or nothing was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = b.column(held).to_pylist()
            has = np.array([model is not None and has_letter(t) for t in texts], dtype=bool)
            lang, score = [NONE] * len(texts), np.zeros(len(texts))
            if has.any():
                at = np.flatnonzero(has)
                p = model.documents([texts[i].encode() for i in at])
                best = p.argmax(axis=1)
                score[at] = np.clip(p[np.arange(len(at)), best], 0, 1)
                for i, k in zip(at, best, strict=True):
                    lang[i] = model.labels[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in plain), pa.array(lang, type=pa.string()), pa.array(score)], names=[*plain, *names])

    plain = [f"_kept{k}" for k in range(len(keep))]  # mapInArrow can't take names with dots
    held = plain[keep.index("text")] if "text" in keep else "text"
    fields = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(plain, keep, strict=True))
    given = docs.select(*[F.col(quoted(c)).alias(p) for p, c in zip(plain, keep, strict=True)], *([] if "text" in keep else ["text"]))
    found = given.mapInArrow(run, f"{fields}, {names[0]} string, {names[1]} double")
    return found.select(*[F.col(p).alias(c) for p, c in zip(plain, keep, strict=True)], *names)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame) -> ByteGru | None:
    return train(training_windows(docs.where(~_held_out())))


def identify(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score. A null doc_id isn't held out; repeated rows are judged again.

    Null and empty texts, and those without a letter, are ``und`` with score 0; texts of any length are read whole. An empty
    table, or one without labelled rows outside the held-out fold, teaches nothing: every text is ``und``.
    """
    scored = predict(docs, fit_on(docs), ["doc_id"])
    return scored.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """Pipeline stage: documents whose language is one of the learned ones with at least ``least_score``; all columns stay.

    Null texts and those without a letter go; null doc_ids count like any other; repeated rows are judged alike.
    """
    names = free_name(docs, "_lang_pred"), free_name(docs, "_score")
    kept = predict(docs, fit_on(docs), docs.columns, names)
    return kept.where((F.col(names[0]) != NONE) & (F.col(names[1]) >= least_score)).select(*all_of(docs))


def op3_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
