"""Mixing sources to target weights with soft memberships.

A softmax classifier learned from a labelled table gives every document a posterior p_i over the domains. Rates r_i >= 0,
one for each document, are then fitted by least squares so that the expected domain totals of tokens, sum of r_i n_i p_id,
match the target shares of all tokens, starting from rates of 1. The fit is a projected gradient with lazy projection: the
gradient of a document's rate is p_i times the domains' misses, so all steps add up in one price v_d a domain, and the
projection gives r_i = max(0, 1 - p_i . v). Steps are scaled by the domains x domains matrix of the rows whose rate isn't 0
(a Gram matrix, without which soft posteriors take thousands of steps), steadied by a pull towards the last centre, which
moves and weakens until the targets are met. A step needs only sums by Spark (shares and that matrix, for several step
lengths at once); a document's rate follows from its posterior, so no rate is stored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_of, cut, free_name, quoted, small_batches, table
from .text_stats import NAMES, text_stats

TARGETS = {"good": 0.9, "low": 0.07, "toxic": 0.03}
#: Labelled documents of each domain that the classifier learns from, about, and the lexicon words of each domain.
SAMPLE_DOCS = 1500
LEXICON = 256
PULL = 1e-3
_LEAST_PULL = 1e-12
TOLERANCE = 1e-5
#: Newton steps at most; targets out of reach end earlier. What is missed is reported.
STEPS = 200
_LENGTHS = (1.0, 0.5, 0.25, 0.0625, 2.0**-8, 2.0**-14)
_WORD_MARKS = b".,;:!?\"'()*#$%&|"


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels table: toxic, else low or good by quality; rows without either are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def _words(text: bytes | None) -> set[bytes]:
    return {w.strip(_WORD_MARKS) for w in (text or b"").lower().split()}


def _features(text: bytes | None, lexicon: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Statistics, then for each domain the sum and the maximum of the log-odds of the lexicon words present."""
    hits = [lexicon[w] for w in lexicon.keys() & _words(text)]
    odds = np.array(hits) if hits else np.zeros((1, n))
    return np.concatenate([text_stats(text), np.log1p(np.maximum(odds, 0).sum(axis=0)), odds.max(axis=0)])


class Softmax:
    """Multinomial logistic regression on standardised features, fitted by accelerated gradient steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, domains: list[str], lexicon: dict[bytes, np.ndarray]):
        self.domains, self.lexicon = domains, lexicon
        self.mean, self.scale = x.mean(axis=0), np.sqrt(x.var(axis=0) + 1e-4)
        z, hot = self._z(x), np.eye(len(domains))[y]
        weight = weight / weight.sum()
        self.w = np.zeros((z.shape[1], len(domains)))
        step, ahead, last = 1.0 / (0.5 * np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1] + 1e-4), self.w, self.w
        for k in range(600):
            grad = z.T @ ((self._p(z @ ahead) - hot) * weight[:, None]) + 1e-4 * ahead
            self.w = ahead - step * grad
            ahead, last = self.w + k / (k + 3) * (self.w - last), self.w

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    @staticmethod
    def _p(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.empty((0, len(self.domains)))
        return self._p(self._z(np.array([_features(t, self.lexicon, len(self.domains)) for t in texts])) @ self.w)


def fit_classifier(docs: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Softmax | None:
    """Learns from about ``sample_docs`` labelled documents of each domain, chosen by a hash of doc_id; None without any."""
    counts = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row for each domain
    domains = sorted(counts)
    if not domains:
        return None
    share = F.coalesce(*[F.when(F.col("domain") == d, F.lit(min(1.0, sample_docs / counts[d]))) for d in domains])
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    sample = cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id").select("domain", "text"), "op6-sample")  # bounded: the sample

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = [(d, w) for d, t in zip(b.column("domain").to_pylist(), b.column("text").to_pylist(), strict=True) for w in _words(t) if w]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], type=pa.string()), pa.array([w for _, w in rows], type=pa.binary())], names=["domain", "word"])

    totals = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    df = sample.mapInArrow(count_words, "domain string, word binary").groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in domains])
    n_all = sum(totals.values())
    rows = df.withColumn("n", sum(F.col(f"`{d}`") for d in domains)).where("n >= 12")
    odds = [F.log((F.col(f"`{d}`") + 0.5) / (totals.get(d, 0) + 1.0)) - F.log((F.col("n") - F.col(f"`{d}`") + 0.5) / (n_all - totals.get(d, 0) + 1.0)) for d in domains]
    scored = rows.select("word", *[o.alias(f"o{k}") for k, o in enumerate(odds)])
    lexicon: dict[bytes, np.ndarray] = {}
    for k in range(len(domains)):  # the strongest LEXICON words of a domain
        for r in scored.orderBy(F.desc(f"o{k}"), "word").limit(LEXICON).collect():
            lexicon[bytes(r["word"])] = np.array([r[f"o{j}"] for j in range(len(domains))])
    n = len(domains)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = [_features(t, lexicon, n).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("domain"), pa.array(x, type=pa.list_(pa.float64()))], names=["domain", "x"])

    got = sample.mapInArrow(featurise, "domain string, x array<double>").toPandas().sort_values("domain", kind="stable")  # bounded: the sample
    y = got["domain"].map(domains.index).to_numpy()
    weight = np.array([counts[d] / max(totals.get(d, 1), 1) for d in domains])[y]
    return Softmax(np.stack(got["x"].to_numpy()), y, weight, domains, lexicon)


def memberships(docs: DataFrame, model: Softmax, keep: list[str], names: tuple[str, str] = ("n", "p")) -> DataFrame:
    """``keep`` columns, tokens (words) and posterior of each domain, called ``names``, for every whole text; null counts as empty."""
    held = f"_kept{keep.index('text')}" if "text" in keep else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = b.column(held).cast(pa.binary()).to_pylist()
            n = [len((t or b"").split()) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in plain), pa.array(n, type=pa.int64()), pa.array(model.posteriors(texts).tolist(), type=pa.list_(pa.float64()))], names=[*plain, *names])

    plain = [f"_kept{k}" for k in range(len(keep))]  # mapInArrow can't take names with dots
    fields = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(plain, keep, strict=True))
    given = docs.select(*[F.col(quoted(c)).alias(p) for p, c in zip(plain, keep, strict=True)], *([] if "text" in keep else ["text"]))
    found = given.mapInArrow(run, f"{fields}, {names[0]} bigint, {names[1]} array<double>")
    return found.select(*[F.col(p).alias(c) for p, c in zip(plain, keep, strict=True)], *names)


def rates_of(p: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates at the last prices of ``history``, for posteriors p (documents, domains)."""
    return np.maximum(0, 1 - p @ history[-1]) if history else np.ones(len(p))


def fit_rates(members: DataFrame, target: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The prices of all steps, and the expected domain shares that the rates reach; warns if they miss the targets."""
    d = len(target)

    def sums(tried: list[np.ndarray]) -> np.ndarray:
        """For each of the prices: half the sum of squared rates, the domain totals, the matrix of the active rows."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(tried), 1 + d + d * d))
            for f in frames:
                if len(f):
                    p, n = np.stack(f["p"].to_numpy()), f["n"].to_numpy()
                    for k, v in enumerate(tried):
                        r = rates_of(p, [v])
                        out[k, 0] += n @ r**2 / 2
                        out[k, 1 : 1 + d] += (n * r) @ p
                        out[k, 1 + d :] += ((p * (n * (r > 0))[:, None]).T @ p).ravel()
            yield pd.DataFrame({"k": np.arange(out.size), "v": out.ravel()})

        got = members.select("n", "p").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        return np.array([r["v"] for r in got]).reshape(len(tried), -1)

    v = np.zeros(d)
    now = sums([v])[0]
    all_tokens = now[1 : 1 + d].sum()
    if not all_tokens:
        return [], np.zeros(d)
    now /= all_tokens
    base, centre, history, last, pull = np.maximum(now[1 : 1 + d], 1e-9), v, [], np.inf, PULL
    value = lambda x, at: x[0] + target @ at + pull / 2 * (base @ (at - centre) ** 2)
    for _ in range(STEPS):
        share = now[1 : 1 + d]
        miss = np.abs(share - target).max()
        if miss <= TOLERANCE:
            break
        slope = share - target - pull * base * (v - centre)
        if np.abs(slope).max() <= TOLERANCE / 10:
            if miss > 0.99 * last and pull <= _LEAST_PULL:
                break  # the targets are out of reach: moving the centre brings no more
            centre, last, pull = v, miss, max(pull / 10, _LEAST_PULL)
            slope = share - target
        way = np.linalg.solve(now[1 + d :].reshape(d, d) + pull * np.diag(base), slope)
        tried = [v + x * way for x in _LENGTHS]
        got = sums(tried) / all_tokens
        best = min(range(len(tried)), key=lambda k: value(got[k], tried[k]))
        if value(got[best], tried[best]) >= value(now, v):
            if pull <= _LEAST_PULL:
                break
            centre, last, pull = v, miss, max(pull / 10, _LEAST_PULL)
            continue
        v, now = tried[best], got[best]
        history.append(v)
    share = now[1 : 1 + d]
    if np.abs(share - target).max() > TOLERANCE:
        warnings.warn(f"mixing targets {target.tolist()} are missed: shares reached {share.tolist()}", stacklevel=2)
    return history, share


def _rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """``keep`` columns and, under names free among them: tokens, likeliest domain, rate, copies."""
    names = [free_name(docs, x) for x in ("n_tokens", "domain", "rate", "copies", "_p")]
    n, domain, rate, copies, p = names
    kept = [F.col(quoted(c)) for c in keep]
    model = fit_classifier(docs, domains_of(labels))
    if model is None:
        rated = docs.select(*kept, F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")).cast("bigint").alias(n), F.lit(None).cast("string").alias(domain), F.lit(1.0).alias(rate))
    else:
        members = cut(memberships(docs, model, keep, (n, p)), "op6-members")
        want = np.array([targets.get(d, 0.0) for d in model.domains])
        history, _ = fit_rates(members.select(F.col(n).alias("n"), F.col(p).alias("p")), want / max(want.sum(), 1e-12))
        price = history[-1] if history else np.zeros(len(want))
        value = F.greatest(F.lit(0.0), F.expr("1D - (" + " + ".join(f"{p}[{k}] * {x!r}D" for k, x in enumerate(price.tolist())) + ")"))
        likeliest = F.get(F.array(*map(F.lit, model.domains)), (F.array_position(p, F.array_max(p)) - 1).cast("int"))
        rated = members.select(*kept, n, likeliest.alias(domain), value.alias(rate))
    luck = F.pmod(F.xxhash64(*kept, F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    return rated.withColumn(copies, F.floor(F.col(rate) + luck).cast("bigint")), names


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, domain (the likeliest), rate, copies.

    ``copies`` realises the rate: its whole part, plus one with the probability of the rest, decided by a hash of the kept
    columns. Domains without a target get none; without labelled rows every rate is 1 and the domain is null. Null and empty
    texts carry no tokens and follow their posterior's rate like any other; long texts are read whole. Repeated rows get
    the same rate; an empty table stays empty; other columns are ignored.
    """
    keep = list(keep)
    rated, names = _rated(docs.select(*dict.fromkeys([*keep, "text", "doc_id"])), labels, targets or TARGETS, keep)
    return rated.select(*keep, *[F.col(x).alias(y) for x, y in zip(names, ("n_tokens", "domain", "rate", "copies"), strict=False)])


def apply_mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Pipeline stage: every document as often as its ``copies`` say (none: it goes), with all its columns.

    Equal rows are repeated alike; null doc_ids and texts count like any other; the rate is found in the pass that carries the row.
    """
    rated, (*_, copies, _) = _rated(docs, labels, targets or TARGETS, docs.columns)
    return rated.select(*all_of(docs), F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int"))).alias(copies)).select(*all_of(docs))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
