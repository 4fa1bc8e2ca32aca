"""Quality rules: fixed base rules, then robust multivariate outliers for each language and source.

DataFrame functions only. Four transformed statistics of a document (``TRANSFORMED``) are held as integers, so that sums over
any partitioning are equal. For every group a minimum-covariance-determinant estimate is found by concentration steps: the
half of the group's documents with the smallest Mahalanobis distances gives the next mean and covariance, beginning with
medians and quartiles. A step is one pass: documents are counted and summed by group and distance bin, partial sums first, and
the bins that make up the half are added up; so no group is ever gathered, whatever share of the rows it holds. A last step
takes all documents within ``REWEIGHT`` of the raw estimate. Documents beyond ``CUTOFF`` are rejected.

Sources with fewer than ``MIN_ROWS`` documents that pass the base rules are estimated together within their language, and
languages with fewer of those rows together; if that pool is small too, its documents keep the base verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, skewed_join
from .common import cut, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
SHINGLE = 5
MIN_WORDS = 10
MAX_REPEATED = 20
#: The statistics and the deviation (in their own units) that any group is allowed in each.
TRANSFORMED = {"word_length": 0.024, "symbols": 0.03, "dup_lines": 0.12, "repeats": 0.1}
P = len(TRANSFORMED)
#: Integer steps of a transformed statistic.
SCALE = 2048
FLOOR = tuple(SCALE * f for f in TRANSFORMED.values())
STEPS = 4
MIN_ROWS = 60
#: Median, 0.975 and 0.9999 quantiles of chi-square with four degrees of freedom.
MEDIAN, REWEIGHT, CUTOFF = 3.357, 11.143, 23.513
#: Bins of squared distances: 16 to a doubling.
BIN, LEAST = 16, 2.0**-12
#: Group models up to which they are broadcast (about 200 bytes each); beyond, the join shuffles, split at heavy groups.
BROADCAST_ROWS = 100_000
X = [f"x{i}" for i in range(P)]


def text_counts(docs: DataFrame, keep: list[str | Column]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of every whole text.

    A null text has no words. Windows found twice are those whose words are equal; hashes only bring them together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("_t"), F.array_remove(F.split(text, SPACE), "").alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    rolled = lambda x, i: F.xxhash64(x, *[F.get("_h", i + k) for k in range(1, SHINGLE)])
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_g", F.when(F.size("_w") > SHINGLE, F.transform(F.slice("_h", 1, F.size("_h") - (SHINGLE - 1)), rolled)))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    near = lambda test: F.coalesce(test, F.lit(False))
    df = df.withColumn("_s", F.filter("_s", lambda e, k: near(e["h"] == F.get("_s", k - 1)["h"]) | near(e["h"] == F.get("_s", k + 1)["h"])))
    window = lambda e: F.slice("_w", e["i"] + 1, SHINGLE)
    same = lambda e, o: near((e["h"] == o["h"]) & (window(e) == window(o)))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda e, k: same(e, F.get("_s", k - 1)) | same(e, F.get("_s", k + 1))), lambda e: e["i"])))
    covered = F.aggregate(F.transform("_p", lambda x, k: F.least(F.coalesce(F.get("_p", k + 1) - x, F.lit(SHINGLE)), F.lit(SHINGLE))), F.lit(0), lambda a, x: a + x)
    names = [c if isinstance(c, str) else df.columns[k] for k, c in enumerate(keep)]
    counts = {
        "n_words": F.size("_w"), "word_chars": F.length(F.array_join("_w", "")), "n_symbols": F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, "")), "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")), "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    return df.select(*names, *[c.cast("bigint").alias(n) for n, c in counts.items()])


def _transformed() -> list[Column]:
    """Pseudo-counts keep short texts from varying more than long ones."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    x = [F.log((chars + 150) / (n + 30)), F.sqrt(F.col("n_symbols") / (chars + 150)), F.sqrt(F.col("n_dup_lines") / (lines + 4)), F.sqrt(F.col("n_repeat_words") / (n + 30))]
    return [F.floor(v * SCALE + 0.5).alias(name) for v, name in zip(x, X, strict=True)]


def _named(c: str) -> Column:
    """A column as a part of a group's name that no other value, null or empty text shares."""
    return F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("-"))


def _bins(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(LEAST))) * BIN).cast("int")


def distance2() -> Column:
    """Squared Mahalanobis distance of x0.. from a model's mean m0.. and Cholesky factor l00.., by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        rest = reduce(lambda a, j: a - F.col(f"l{i}{j}") * y[j], range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        y.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _factors(df: DataFrame) -> DataFrame:
    """From sums n, s0.., q00.. of a group: m0.. and l00.., the Cholesky factor of the covariance with FLOOR² added."""
    df = df.select("*", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)])
    for j in range(P):
        part = lambda i: reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))  # noqa: B023, E731
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(part(j), F.lit(0.0)) + FLOOR[j] ** 2))
        df = df.withColumns({f"l{i}{j}": part(i) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    return df


class _Groups:
    """The documents' statistics with their groups ``g``, the estimates' pools ``k`` and the joins between them."""

    def __init__(self, rows: DataFrame, pools: DataFrame):
        self.rows, self.pools = rows, pools
        self.few = pools.count() <= BROADCAST_ROWS
        self.heavy = [] if self.few else heavy_keys(rows, "g")

    def attach(self, rows: DataFrame, model: DataFrame, how: str = "inner") -> DataFrame:
        """``rows`` with the model of their pool."""
        by_group = self.pools.join(model, "k").drop("k")
        return rows.join(F.broadcast(by_group), "g", how) if self.few else skewed_join(rows, by_group, "g", self.heavy, how)

    def counted(self, rows: DataFrame, by: list[str | Column], what: list[Column]) -> DataFrame:
        """Sums of ``what`` by pool and ``by``; groups are summed before they meet their pool."""
        names = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i in range(P) for j in range(i + 1)]][: len(what)]
        parts = rows.groupBy("g", *by).agg(*[F.sum(c).alias(n) for c, n in zip(what, names, strict=True)])
        keys = [c for c in parts.columns if c not in ("g", *names)]
        return parts.join(self.pools, "g").groupBy("k", *keys).agg(*[F.sum(n).alias(n) for n in names])


def _pools(rows: DataFrame) -> DataFrame:
    """(g, k): the pool that each group of language and source is estimated in; groups without one are absent."""
    sizes = rows.groupBy("g", "by_lang").agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy(*by))  # noqa: E731  one row a group: at most as many as sources
    sizes = sizes.withColumn("k", F.when(F.col("n") >= MIN_ROWS, F.col("g")).otherwise(F.col("by_lang")))
    small = sizes.where("k = by_lang").groupBy("by_lang").agg(F.sum("n").alias("n_lang"))
    sizes = sizes.join(small, "by_lang", "left").withColumn("k", F.when((F.col("k") == F.col("by_lang")) & (F.col("n_lang") < MIN_ROWS), F.lit("*")).otherwise(F.col("k")))
    kept = sizes.groupBy("k").agg(F.sum("n").alias("n_pool")).where(F.col("n_pool") >= MIN_ROWS)
    return sizes.join(kept, "k").select("g", "k")


def _start(groups: _Groups) -> DataFrame:
    """Medians as means, quartile ranges as deviations: m0.., l00.. of every pool, from counts by value."""
    values = groups.rows.select("g", F.posexplode(F.array(*[F.floor(F.col(x) / 8) for x in X])).alias("c", "v"))
    counts = groups.counted(values, ["c", "v"], [F.lit(1)])
    w = Window.partitionBy("k", "c")  # distinct values, few thousand at most
    upto = counts.select("*", F.sum("n").over(w.orderBy("v")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("v")))
    cut_at = upto.groupBy("k", "c").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    one = lambda c, value: F.max(F.when(F.col("c") == c, value))
    floor = F.element_at(F.array(*map(F.lit, FLOOR)), F.col("c") + 1)
    scaled = cut_at.withColumn("scale", F.greatest((F.col("high") - F.col("low")) * 8 / 1.349, floor))
    return scaled.groupBy("k").agg(
        *[one(i, F.col("mid") * 8.0 + 4).alias(f"m{i}") for i in range(P)], *[(one(i, F.col("scale")) if i == j else F.max(F.lit(0.0))).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)]
    )


def _step(groups: _Groups, model: DataFrame, last: bool) -> DataFrame:
    """The next model: from the nearest half of each pool, or (``last``) from all within REWEIGHT, widened if the half is wider than normal."""
    x = [F.col(c) for c in X]
    sums = groups.counted(groups.attach(groups.rows, model).withColumn("b", _bins(distance2())), ["b"], [F.lit(1), *x, *[x[i] * x[j] for i in range(P) for j in range(i + 1)]])
    w = Window.partitionBy("k")  # one row a bin: a few hundred
    sums = sums.select("*", F.sum("n").over(w.orderBy("b")).alias("upto"), F.sum("n").over(w).alias("total"))
    sums = sums.withColumn("half", F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("b"))).over(w))
    edge = F.col("half")
    if last:
        wider = F.greatest(F.pow(F.lit(2.0), (F.col("half") + 1) / BIN) / MEDIAN, F.lit(1.0))
        edge = F.greatest(edge, _bins(wider * REWEIGHT))
    names = [c for c in sums.columns if c not in ("k", "b", "upto", "total", "half")]
    near = sums.where(F.col("b") <= edge).groupBy("k").agg(*[F.sum(n).alias(n) for n in names])
    return _factors(near).select("k", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, the counts of ``text_counts``, distance2 (null without an estimate), base_failed, kept.

    A null text is an empty one. Null languages and null sources are groups of their own. Repeated rows count each and get
    one verdict; an empty table gives an empty result; columns besides doc_id, text, lang and source are not read.
    """
    group = F.concat(_named("lang"), F.lit("|"), _named("source")).alias("g")
    counts = text_counts(docs.select("doc_id", "text", "lang", "source"), ["doc_id", group, F.concat(_named("lang"), F.lit("|*")).alias("by_lang")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = cut(counts.select("*", failed.alias("base_failed"), *_transformed()), "op11-rows")
    fit = rows.where(~F.col("base_failed"))
    groups = _Groups(fit.select("g", *X), cut(_pools(fit), "op11-pools"))
    model = cut(_start(groups), "op11-model")
    for k in range(STEPS + 1):
        model = cut(_step(groups, model, k == STEPS), "op11-model")
    judged = groups.attach(rows, model, "left").withColumn("distance2", distance2())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distance2", "base_failed", kept.alias("kept"))


def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("distance2")


def oracle_sql() -> str:
    """The same stated over rows: windows as texts, covered words counted one by one, every step of the estimate as a table."""
    x = [
        "ln((word_chars + 150) / (n_words + 30))", "sqrt(n_symbols / (word_chars + 150))", "sqrt(n_dup_lines / (n_lines + 4))", "sqrt(n_repeat_words / (n_words + 30))",
    ]
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    model = ", ".join([f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in pairs])
    floors = f"[{', '.join(repr(f) for f in FLOOR)}]"
    bins = lambda d: f"floor(log2(greatest({d}, {LEAST!r})) * {BIN})::INT"

    def distances(name: str, of: str) -> str:
        """Forward substitution, a column at a time."""
        steps, at = [], f"(SELECT f.*, {model} FROM fit f JOIN {of} USING (k))"
        for i in range(P):
            steps.append(f"{name}{i} AS (SELECT *, (x{i} - m{i}{''.join(f' - l{i}{j} * y{j}' for j in range(i))}) / l{i}{i} AS y{i} FROM {at})")
            at = f"{name}{i}"
        return ",\n".join([*steps, f"{name} AS (SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(P))} AS d2 FROM {at})"])

    def estimate(name: str, of: str, last: bool) -> str:
        """Means and the Cholesky factor of the rows up to the edge."""
        edge = "half" if not last else f"greatest(half, {bins(f'greatest(2.0 ** ((half + 1) / {BIN}) / {MEDIAN}, 1.0) * {REWEIGHT}')})"
        moments = ", ".join([f"avg(x{i}) AS m{i}" for i in range(P)] + [f"sum(x{i} * x{j})::DOUBLE / count(*) AS q{i}{j}" for i, j in pairs])
        steps, at = [], f"{name}s"
        for j in range(P):
            rest = lambda i: f"q{i}{j} - m{i} * m{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))  # noqa: B023, E731
            steps.append(f"{name}d{j} AS (SELECT *, sqrt(greatest({rest(j)}, 0.0) + {floors}[{j + 1}] ** 2) AS l{j}{j} FROM {at})")
            below = "".join(f", ({rest(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P))
            steps.append(f"{name}e{j} AS (SELECT *{below} FROM {name}d{j})")
            at = f"{name}e{j}"
        return ",\n".join([
            distances(f"{name}y", of), f"{name}b AS MATERIALIZED (SELECT *, {bins('d2')} AS b, row_number() OVER (PARTITION BY k ORDER BY {bins('d2')}) AS r, count(*) OVER (PARTITION BY k) AS n FROM {name}y)",
            f"{name}h AS (SELECT k, min(b) FILTER (2 * r >= n) AS half FROM {name}b GROUP BY k)",
            f"{name}s AS (SELECT k, {moments} FROM {name}b JOIN {name}h USING (k) WHERE b <= {edge} GROUP BY k)", *steps, f"{name} AS MATERIALIZED (SELECT k, {model} FROM {at})",
        ])

    rounds, of = [], "start"
    for k in range(STEPS + 1):
        rounds.append(estimate(f"r{k}", of, k == STEPS))
        of = f"r{k}"
    quartile = lambda c, share: f"min(v) FILTER (c = {c} AND r >= {share} * n)"
    start = ", ".join([f"{quartile(i, 0.5)} * 8.0 + 4 AS m{i}" for i in range(P)] + [f"greatest(({quartile(i, 0.75)} - {quartile(i, 0.25)}) * 8 / 1.349, {FLOOR[i]!r}) AS l{i}{j}" if i == j else f"0.0 AS l{i}{j}" for i, j in pairs])
    named = lambda c: f"coalesce(length({c}) || ':' || {c}, '-')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, {named('lang')} || '|' || {named('source')} AS g, {named('lang')} || '|*' AS by_lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT row_, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
grams AS (SELECT row_, i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT row_, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM w)),
twice AS (SELECT row_, i FROM grams JOIN (SELECT row_, s FROM grams GROUP BY row_, s HAVING count(*) > 1) USING (row_, s)),
covered AS (SELECT row_, count(DISTINCT i + k) AS n FROM twice, range({SHINGLE}) u(k) GROUP BY row_),
lines AS (SELECT row_, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
counts AS (SELECT d.row_, doc_id, g, by_lang, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (row_) JOIN lines USING (row_) LEFT JOIN covered c USING (row_)),
judged AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, {', '.join(f'floor({e} * {SCALE} + 0.5)::BIGINT AS x{i}' for i, e in enumerate(x))} FROM counts),
ok AS (SELECT *, count(*) OVER (PARTITION BY g) AS n_g FROM judged WHERE NOT base_failed),
pooled AS (SELECT *, CASE WHEN n_g >= {MIN_ROWS} THEN g ELSE by_lang END AS k1 FROM ok),
pooled2 AS (SELECT *, CASE WHEN k1 = by_lang AND count(*) OVER (PARTITION BY k1) < {MIN_ROWS} THEN '*' ELSE k1 END AS k FROM pooled),
fit AS MATERIALIZED (SELECT row_, k, {', '.join(X)} FROM pooled2 QUALIFY count(*) OVER (PARTITION BY k) >= {MIN_ROWS}),
cells AS (SELECT k, c, v, row_number() OVER (PARTITION BY k, c ORDER BY v) AS r, count(*) OVER (PARTITION BY k, c) AS n FROM (SELECT k, unnest(range({P})) AS c, unnest([{', '.join(f'floor(x{i} / 8)' for i in range(P))}]) AS v FROM fit)),
start AS MATERIALIZED (SELECT k, {start} FROM cells GROUP BY k),
{", ".join(rounds)},
{distances("final", of)}
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(f.d2 <= {CUTOFF}, true) AS kept FROM judged j LEFT JOIN final f USING (row_)"""
