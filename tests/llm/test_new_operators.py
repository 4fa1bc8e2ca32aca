"""Quality rules, the Merkle manifest and vector codes against brute force and their SQL, on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import merkle, quality_rules, vector_codes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, n int, tree string, n_words string"
VECTORS = "vec_id bigint, embedding array<float>, label int, v string, code int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "t", "w") for r in rows], DOCS)


def _odd_texts():
    rng = np.random.default_rng(2)
    words = np.array("the quick brown fox jumps over a lazy dog été ñandú #tag a|b <i> $5 100%".split())
    make = lambda n: " ".join(rng.choice(words, n))
    loop = make(7)
    return [
        None, "", " \t\n", "one", make(9), make(10), make(60), f"{make(30)}\n{make(12)}\n{make(30)}", "\n".join([make(8)] * 3), "a\n\n \na\na \n", make(20_000), " ".join([loop] * 50),
        "w " * 3000, f"{loop} x {loop} y {loop}", "#*$%&|<>" * 4, make(200) + "\x0b\x0c\r" + make(5), "   x", loop + " " + loop[: len(loop) // 2],
    ]


def _counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(grams)
    covered = {k for i, g in enumerate(grams) if twice[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)


def test_base_counts_match_brute_force(spark):
    rows = [(k, t, "en", None, None) for k, t in enumerate(_odd_texts())] + [(None, "one two", None, None, 3), (4, _odd_texts()[4], "en", None, None)]
    got = Counter(tuple(r)[:6] + (r["base_failed"],) for r in quality_rules.quality_rules(_docs(spark, rows)).drop("distance2").collect())
    want = Counter()
    for d, t, *_ in rows:
        n, chars, symbols, dup, repeat, _ = _counts(t)
        want[(d, n, chars, symbols, dup, repeat, n < 10 or 100 * repeat > 20 * n)] += 1
    assert got == want


def _mcd(x):
    """Steps of the estimate on one group's integer statistics, with sorting in place of sums by bin."""
    q = lambda v, share: v[np.searchsorted(np.arange(1, len(v) + 1), len(v) * share)]
    floor = np.array(quality_rules.FLOOR)
    cells = np.sort(x // 8, axis=0)
    mean = np.array([q(c, 0.5) * 8 + 4.0 for c in cells.T])
    cov = np.diag(np.maximum([(q(c, 0.75) - q(c, 0.25)) * 8 / 1.349 for c in cells.T], floor) ** 2)
    away = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    for k in range(quality_rules.STEPS + 1):
        bins = np.floor(np.log2(np.maximum(away(), quality_rules.LEAST)) * quality_rules.BIN)
        half = np.sort(bins)[-(-len(x) // 2) - 1]
        if k == quality_rules.STEPS:
            half = max(half, np.floor(np.log2(max(2 ** ((half + 1) / quality_rules.BIN) / quality_rules.MEDIAN, 1) * quality_rules.REWEIGHT) * quality_rules.BIN))
        near = x[bins <= half]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floor**2)
    return away()


def test_outliers_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "MIN_ROWS", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"] if r["doc_id"] % 3 else None, r["n_chars"]) for r in docs.collect()]
    rows += [(10_000 + k, " ".join(["#word", "a|b", "$$$$", f"w{k}"] * 6 + [f"z{j}{k}" for j in range(9)]), "xx", f"s{k}", 1) for k in range(4)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(_docs(spark, rows)).collect()}
    stats, groups = {}, defaultdict(list)
    for d, t, lang, source, _ in rows:
        n, chars, symbols, dup, repeat, lines = _counts(t)
        if not got[d]["base_failed"]:
            x = math.log((chars + 150) / (n + 30)), math.sqrt(symbols / (chars + 150)), math.sqrt(dup / (lines + 4)), math.sqrt(repeat / (n + 30))
            stats[d] = [math.floor(v * quality_rules.SCALE + 0.5) for v in x]
            groups[lang, source].append(d)
    pools = defaultdict(list)
    for (lang, source), ids in groups.items():
        pools[(lang, source) if len(ids) >= 20 else (lang,)] += ids
    for k in [k for k in pools if len(k) == 1 and len(pools[k]) < 20]:
        pools["*"] += pools.pop(k)
    assert len(pools) > 4 and any(len(k) == 2 for k in pools)
    for k, ids in pools.items():
        want = _mcd(np.array([stats[d] for d in ids], dtype=np.int64)) if len(ids) >= 20 else [None] * len(ids)
        for d, w in zip(ids, want, strict=True):
            assert got[d]["distance2"] == (None if w is None else pytest.approx(w, rel=1e-6)), (k, d)
            assert got[d]["kept"] == (w is None or w <= quality_rules.CUTOFF)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [got[d]["kept"] for d in stats if labels.get(d) == 1]
    assert np.mean(good) > 0.97


def test_models_by_shuffled_joins_are_equal(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(quality_rules, "MIN_ROWS", 8)
    one = sorted(map(tuple, quality_rules.quality_rules(docs).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quality_rules.quality_rules(docs.repartition(5)).collect())) == one  # whatever the partitioning


def _h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _tree(nodes):
    """(root, one list of (left, right) a level for every node) by plain levels."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for p, a in zip(paths, at, strict=True):
            p.append(("".join(runs[a // 8][: a % 8]), "".join(runs[a // 8][a % 8 + 1 :])))
        at, nodes = [a // 8 for a in at], [_h(*r) for r in runs]
    return nodes[0] if nodes else None, paths


def _manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text, lang, source, n: _h(*map(field, (d, source, lang, n, text)))
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(((r[0] is not None, r[0] or 0), leaf(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: _tree([x[1] for x in sorted(langs[k])]) for k in order}
    root, tops = _tree([trees[k][0] for k in order])
    out = []
    for k, top in zip(order, tops, strict=True):
        for (_, digest, (d, text, *more)), path in zip(sorted(langs[k]), trees[k][1], strict=True):
            hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and text is not None
            fold = leaf(d, "".join(c.lower() if "A" <= c <= "Z" else c for c in text), *more) if hit else digest
            for left, right in path + top:
                fold = _h(left, fold, right)
            out.append((d, digest, trees[k][0], root, _h(*[x for p in path + top for x in p]), fold, fold == root))
    return Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_matches_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rows = [(k, f"Text {k} É" if k % 7 else None, "en", "s" if k % 2 else None, k) for k in range(75)] + [(k, "Été", "fr", "s", None) for k in range(8)] + [(5, "A", "", "s", 1), (None, "B", None, None, None), (None, "b", None, "s", 2)]
    rows += [(9, "Same", "de", "s", 4)] * 9 + [(9, "other", "de", "s", 4), (3, "x" * 50_000, "it", "s", 5)]
    got = Counter(map(tuple, merkle.proofs(_docs(spark, rows)).collect()))
    assert got == _manifest(rows)


def test_heights_around_powers_of_the_arity(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    for n in (1, 2, 8, 9, 64, 65):
        rows = [(k, "T", "en", "s", k) for k in range(n)]
        assert Counter(map(tuple, merkle.proofs(_docs(spark, rows)).collect())) == _manifest(rows)


def test_manifest_of_many_small_trees(spark):
    rows = [(k, "T", f"lang{k % 90}", "s", k) for k in range(200)]
    assert Counter(map(tuple, merkle.proofs(_docs(spark, rows)).collect())) == _manifest(rows)


def _codes(rows, width):
    """Every part against every entry in whole numbers."""
    kept = [(i, label, [math.floor(float(x) * 4096) for x in v] + [0] * (width - len(v))) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    step, codes = width // 8, [[0] * 8 for _ in kept]
    part = lambda v, p: v[p * step : (p + 1) * step]
    books = [[part(v, p) for _, _, v in kept[:16]] for p in range(8)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(7):
        for k, (_, _, v) in enumerate(kept):
            codes[k] = [min(range(len(b)), key=lambda e, p=p, b=b: (away(part(v, p), b[e]), e)) for p, b in enumerate(books)]  # noqa: B023
        for p in range(8) if r < 6 else ():
            for e in range(len(books[p])):
                own = [part(v, p) for k, (_, _, v) in enumerate(kept) if codes[k][p] == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)] if own else books[p][e]
    errors = [sum(away(part(v, p), books[p][c]) for p, c in enumerate(code)) for code, (_, _, v) in zip(codes, kept, strict=True)]
    total = Counter()
    for e, (_, label, _) in zip(errors, kept, strict=True):
        total[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in code), e, total[label], sha) for (i, label, _), code, e in zip(kept, codes, errors, strict=True))


def _query(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    out = vector_codes.with_label_errors(vector_codes.encode(df)).collect()
    return Counter((r["vec_id"], "".join(f"{c:02x}" for c in r["code"]), r["error"], r["label_error"], r["codebooks_sha256"]) for r in out)


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(int(k), f32(rng.normal(0, 0.1, 16)), int(k % 3) if k % 5 else None) for k in rng.permutation(150)]
    rows += [(200, None, 1), (201, [1.0, None] + [0.0] * 14, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] * 16, 2), (None, f32([0.25] * 16), None), (7, rows[0][1], 9), (7, rows[0][1], 9), (300, [0.5, -0.5], 4), (301, [], 4)]
    assert _query(spark, rows) == _codes(rows, 16)


def test_codes_with_ties_and_few_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) / 4096 for x in rng.integers(-2, 3, 8)], k % 2) for k in range(120)]  # one number a part: many equal distances
    assert _query(spark, rows) == _codes(rows, 8)
    assert _query(spark, rows[:5]) == _codes(rows[:5], 8)
    assert not _query(spark, [(1, None, 1)])


def test_exponion_search_is_exact_and_skips_entries():
    rng = np.random.default_rng(7)
    books = rng.normal(0, 4000, (16, 8)).astype(np.int64)
    books[9] = books[3]
    x = books[rng.integers(0, 16, 3000)] + rng.integers(-400, 400, (3000, 8))
    book = vector_codes.Codebook(books)
    all_d = ((x[:, None] - books[None]) ** 2).sum(axis=2)
    for start in (rng.integers(0, 16, 3000), all_d.argmin(axis=1)):
        where, d, n = book.search(x, start)
        assert (where == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()
    assert n < 3000 * 4  # from the right entry, few others lie within the radius


@pytest.mark.parametrize("module, name, tables", [(quality_rules, "op11_robust_outliers", ["documents"]), (merkle, "op12_block_manifest", ["documents"]), (vector_codes, "op13_exponion_codes", ["embeddings"])])
def test_queries_equal_their_sql(spark, module, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(module.oracle_sql())
    names = [d[0] for d in want.description]
    got = getattr(module, name)(spark, SF)
    assert got.columns == names and Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_empty_tables_give_empty_results(spark):
    assert quality_rules.quality_rules(_docs(spark, [])).count() == 0
    assert merkle.proofs(_docs(spark, [])).count() == 0
    assert vector_codes.with_label_errors(vector_codes.encode(spark.createDataFrame([], VECTORS))).count() == 0
