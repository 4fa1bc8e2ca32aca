"""Each operator against a brute-force version on small tables with nulls, ties, repeats, empty and odd texts."""

import base64
import bz2
import gzip
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.operators import graph
from tessera.llm import decontaminate, language_id, license_scan, line_dedup, mixing, quality, secret_scan, simhash_dedup, text_stats, token_output, topk_search

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, score int, row int"
WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing above old green hills and rivers".split()


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "x", 1, 2) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    make = lambda n: " ".join(WORDS[i] + str(rng.integers(40)) for i in rng.integers(0, len(WORDS), n))
    base = [make(n) for n in (3, 12, 40, 40, 90, 300)]
    long = make(5000)
    out = [(k, t) for k, t in enumerate(base)]
    out += [(10, None), (11, ""), (12, "   \n\t"), (13, "one"), (14, "ONE"), (15, base[2]), (16, base[2].upper()), (17, base[4] + " tail"), (18, long), (19, long + " end"), (None, base[3]), (20, "été über ñandú " * 9), (15, base[2])]
    return out


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, rows):
    got = simhash_dedup.simhash_groups(_docs(spark, rows)).collect()
    fps = [_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    low = {k: min((d for (d, _), x in zip(rows, label, strict=True) if x == k and d is not None), default=None) for k in label}
    want = Counter((d, f"{f:016x}", low[k]) for (d, _), f, k in zip(rows, fps, label, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_spark_hashes_words_alike(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_of_close_fingerprints_are_never_missed(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for x in base for k in (1, 2, 3)]
    every = sorted({int(x) for x in base} | set(near))
    fps = spark.createDataFrame([(x,) for x in every], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash_dedup.near_roots(fps).collect()}
    pivots = simhash_dedup.references(fps)
    first_block = np.arange(1 << simhash_dedup.BLOCKS[0], dtype=np.uint64)
    assert len(np.unique(simhash_dedup.block_coordinates(first_block, pivots)[:, 0])) < len(first_block) / 2  # cells of distances, not of bits
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                assert roots[a] == roots[b]


def test_forest_keeps_paths_and_trees_whole():
    rng = np.random.default_rng(11)
    cases = [(7, [(2, 3), (2, 4), (3, 5), (4, 6), (1, 5), (0, 6)])]
    for n in (2, 5, 7, 30, 200) * 40:
        at = rng.permutation(n)
        path = [(int(at[k]), int(at[k + 1])) for k in range(n - 1)]
        tree = [(int(at[k]), int(at[rng.integers(k)])) for k in range(1, n)]
        cases += [(n, path), (n, tree), (n, [x for x in tree if rng.random() < 0.8])]
    for n, links in cases:
        want = list(range(n))
        while any(want[i] != want[j] for i, j in links):
            for i, j in links:
                want[i] = want[j] = min(want[i], want[j])
        i, j = np.array(links, dtype=np.int64).reshape(-1, 2).T
        assert simhash_dedup._forest(n, i, j).tolist() == want


def test_one_document_of_each_group_stays(spark, rows):
    kept = simhash_dedup.keep_one_of_each_group(_docs(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    groups = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_dedup.simhash_groups(_docs(spark, rows)).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids) == Counter(set(groups.values()))
    assert {(r["_row"], r["score"], r["row"]) for r in kept.collect()} == {("x", 1, 2)}


def test_near_copies_match_brute_force(spark):
    rng = np.random.default_rng(21)
    make = lambda n: [w + str(rng.integers(60)) for w in rng.choice(WORDS, n)]
    texts = []
    for n in (6, 60, 200, 400, 1000):
        for _ in range(4):
            base = make(n)
            texts.append(base)
            for changed in (1, 3, 6, 10, 20):
                copy = list(texts[-1] if rng.random() < 0.5 else base)  # chains as well as stars
                for at in rng.choice(n, min(n, changed), replace=False):
                    copy[at] = "other" + str(rng.integers(9000))
                texts.append(copy)
    texts += [texts[7], ["one"], ["ONE"], []]
    sets = [{tuple(x.lower() for x in w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    label, linked = list(range(len(sets))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                linked += 1
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    kept = simhash_dedup.keep_one_of_each_group(_docs(spark, [(k, " ".join(w)) for k, w in enumerate(texts)]))
    assert linked > 40 and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[k] for k in range(31)} == {0} and {got[k] for k in range(100, 130)} == {100}


def test_quality_is_held_out_and_ranks(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for d in range(400):
        good = d % 3 > 0
        words = rng.choice(WORDS, 40)
        rows.append((d, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((d, int(good), None))
    rows += [(1000, None), (1001, ""), (None, "some words")]
    lab = spark.createDataFrame([*labels, (5, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score_quality(_docs(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    flipped = spark.createDataFrame([(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels], "doc_id bigint, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(_docs(spark, rows), flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in got)  # labels held out are never read


def test_quality_without_labels(spark):
    got = quality.score_quality(_docs(spark, [(1, "a b")]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.5, 0)]


def test_pool_adjacent_violators():
    assert quality.pool_adjacent_violators(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


def test_text_stats_of_odd_texts():
    for t in (None, b"", b" \n ", b"x", b"a" * 100_000, "é\n".encode() * 50):
        assert np.isfinite(text_stats.text_stats(t)).all()


def test_gru_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language_id.ByteGru(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) * 0.5 for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (7, 3)), rng.integers(0, 3, (7, 3))
    loss = lambda: net.gradients(x, y)[0]
    _, g = net.gradients(x, y)
    for k in ("uf", "cb", "o", "ob", "ef"):
        for _ in range(4):
            at = (int(x[2, 1]), int(rng.integers(12))) if k == "ef" else tuple(int(rng.integers(s)) for s in net.p[k].shape)
            keep, eps = net.p[k][at], 1e-3
            net.p[k][at] = keep + eps
            up = loss()
            net.p[k][at] = keep - eps
            down = loss()
            net.p[k][at] = keep
            assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3


def test_language_id_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 60)
    monkeypatch.setattr(language_id, "EPOCHS", 6)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "123 !!", "en"), (-4, "ß", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()}
    assert [got[k]["lang_pred"] for k in (-1, -2, -3)] == ["und"] * 3 and got[-4]["lang_pred"] != "und"
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in truth)
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in truth.items() if got[d]["held_out"]]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "hello there", None)], "doc_id bigint, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()] == [("und", 0.0)]


def test_containment_matches_brute_force(spark, rows):
    texts = dict(rows)
    items = [(0, " ".join(texts[18].split()[700:740])), (1, " ".join(texts[18].split()[100:114])), (2, "One"), (3, None), (4, "completely other words that stand in no document at all"), (5, texts[4].upper()), (5, texts[4])]
    got = decontaminate.contaminated(_docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()

    def grams(t):
        import re

        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = set()
    for d, t in rows:
        for i, item in items:
            g = grams(item)
            if g and len(g & grams(t)) >= math.ceil(0.8 * len(g) - 1e-9):
                want.add((d, i, len(g), len(g & grams(t))))
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got} == want and want


def test_contaminated_documents_go(spark, rows):
    item = spark.createDataFrame([(0, " ".join(dict(rows)[18].split()[700:740]))], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(_docs(spark, rows), item)
    assert Counter((r["doc_id"], r["_row"], r["row"]) for r in kept.collect()) == Counter((d, "x", 2) for d, _ in rows if d not in (18, 19))
    empty = decontaminate.drop_contaminated(_docs(spark, rows), spark.createDataFrame([], "item_id bigint, text string"))
    assert empty.count() == len(rows)


def test_licenses(spark):
    apache = license_scan.TEMPLATES[0][1]
    rows = [(1, "Released under the MIT License. And under  the\nMIT license"), (2, "intro\n" + apache.replace("compliance", "harmony")), (3, None), (4, "CC BY-NC 4.0 cc-by-nc"), (5, "nothing"), (6, apache.replace(" ", "\n"))]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(_docs(spark, rows)).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base"]) == (10, 2, 1, 6, ["mit"])
    assert [(m["label"], m["start"]) for m in got[2]["matches"]] == [("apache-2", 1)]
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"]) == (0, 0, None)
    assert (got[4]["n_base"], got[4]["base"]) == (2, ["cc-by-nc"]) and got[6]["base"] == ["apache-2"]
    assert [(m["label"], m["start"], m["containment"]) for m in got[6]["matches"]] == [("apache-2", 0, 1.0)]  # wherever lines break


def test_license_join_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    pool = np.array(sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.words(t.encode())}), dtype=object)
    rows = []
    for k in range(60):
        whole = license_scan.words(license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)][1].encode())
        for _ in range(k % 9):
            whole[rng.integers(len(whole))] = b"other" if k % 2 else rng.choice(pool)
        around = list(rng.choice(pool, 40 if k % 3 else 4))
        rows.append((k, b"\n".join([*around, *whole[: len(whole) - k % 5], *around]).decode()))
    rows += [(60, " ".join(["word"] * 30000) + " " + license_scan.TEMPLATES[0][1]), (61, "free software")]
    got = {r["doc_id"]: {(m["label"], round(m["containment"], 9)) for m in r["matches"]} for r in license_scan.scan_licenses(_docs(spark, rows)).collect()}
    for d, t in rows:
        split, want = license_scan.words(t.encode()), set()
        for label, x in license_scan.TEMPLATES:
            tokens, width = set(license_scan.words(x.encode())), len(license_scan.words(x.encode()))
            best = max(len(tokens & set(split[i : i + width])) for i in range(len(split)))
            if best >= math.ceil(0.8 * len(tokens) - 1e-9):
                want.add((label, round(best / len(tokens), 9)))
        assert got[d] == want


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet((1, 0.3, 0.2), 3000)
    n = rng.integers(1, 900, 3000)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n bigint, p array<double>")
    target = np.array([0.5, 0.3, 0.2])
    history, share = mixing.fit_rates(rows, target)
    r = mixing.rates_of(p, history)
    assert (r >= 0).all() and np.abs((n * r) @ p / n.sum() - share).max() < 1e-9
    assert np.abs(share - target).max() < 5e-3


@pytest.mark.parametrize("alpha", [(3, 1.5, 0.5), (2, 1.5, 1)])
def test_mixing_meets_targets_with_soft_posteriors(spark, alpha):
    rng = np.random.default_rng(14)
    p, n = rng.dirichlet(alpha, 4000), rng.integers(1, 900, 4000)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n bigint, p array<double>")
    target = np.array([0.9, 0.07, 0.03])
    history, share = mixing.fit_rates(rows, target)
    r = mixing.rates_of(p, history)
    assert (r >= 0).all() and np.abs((n * r) @ p / n.sum() - target).max() <= mixing.TOLERANCE * 1.01 and np.abs(share - target).max() <= mixing.TOLERANCE


def test_mixing_reports_targets_out_of_reach(spark):
    rows = spark.createDataFrame([(5, [0.6, 0.4]), (7, [0.5, 0.5])], "n bigint, p array<double>")
    with pytest.warns(UserWarning, match="missed"):
        _, share = mixing.fit_rates(rows, np.array([0.9, 0.1]))
    assert share[0] < 0.9 - mixing.TOLERANCE


def test_mixing_stage_keeps_columns_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0)], docs.schema)
    rates = mixing.mixing_rates(docs.unionByName(odd), labels).collect()
    assert len(rates) == docs.count() + 2 and all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) <= 1 for r in rates)
    out = mixing.apply_mixture(docs.unionByName(odd), labels)
    assert out.columns == docs.columns
    nothing = mixing.mixing_rates(docs, labels.where("false")).collect()
    assert all(r["rate"] == 1 and r["domain"] is None for r in nothing)


def test_tokens_round_trip(spark, rows):
    more = [*rows, (30, "The <|endoftext|> mark, don't!! It's 3.14; foo!, bar. İstanbul ΣΑΣ ﬁ étude"), (31, "a.b,c ,. .,! A,B. x y z ×, ×. ok"), (32, "ŒUVRE Straße NAÏVE ŉa ſtop")]
    path = token_output.shared_dir(spark) + "/tokens-test"
    token_output.write_tokens(_docs(spark, more), path)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_tokens(spark, path).collect()), key=lambda r: r[2])
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_output.vocabulary_path())
    at = 0
    for (known, d, start, n, crc), (d2, t) in zip(got, sorted(more, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert (known, d, start, n, crc) == (d2 is not None, d2 or 0, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += n


def test_word_encoder_equals_the_library():
    enc = token_output.WordCachingEncoder(token_output.vocabulary_path())
    rng = np.random.default_rng(17)
    bits = ["École", "€5", "Œuvre", "😀", "Élan", "Привет", "Ärger", "<|", "İ", "don't", "I'M", "½", "ﬁ", "ΣΑΣ", "\u0301", "\u00a0", "\u2003", "ſ", "ŉ", "Ÿ", ".", ",", " ", "\n", "ǅ", "ẞ", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(bits[rng.integers(len(bits))] if rng.random() < 0.5 else chr(rng.choice([rng.integers(32, 384), rng.integers(32, 0x3000)])) for _ in range(rng.integers(1, 8)))
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_numerals_are_no_letters():
    assert not any(language_id.has_letter(t) for t in (None, "", "½", "²", "Ⅷ", "12 !"))
    assert all(language_id.has_letter(t) for t in ("a", "ß", "½ x", "日"))


def test_padding_leaves_no_trace():
    net = language_id.ByteGru(["a", "b"], hidden=4)
    alone, among = net.documents([b"some text"]), net.documents([b"some text", b"x" * 700, b"another one"])
    assert np.allclose(alone[0], among[0], atol=1e-5)
    assert np.allclose(net.probabilities(np.frombuffer(b"some text", dtype=np.uint8)[:, None]).mean(axis=0), net.documents([b"sometext"]), atol=0.5)


def test_mixing_rates_match_another_solver(spark):
    rng = np.random.default_rng(23)
    p, n = rng.dirichlet((2, 1, 1), 300), rng.integers(1, 90, 300)
    target = np.array([0.6, 0.25, 0.15])
    history, _ = mixing.fit_rates(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n bigint, p array<double>"), target)
    v, share = np.zeros(3), n / n.sum()
    for _ in range(200_000):  # plain gradient steps on the prices
        v += 0.5 * ((share * np.maximum(0, 1 - p @ v)) @ p - target)
    assert np.abs(mixing.rates_of(p, history) - np.maximum(0, 1 - p @ v)).max() < 1e-3


def test_dac_random_access():
    rng = np.random.default_rng(8)
    ids = np.concatenate([rng.integers(0, 2**k, 700) for k in (4, 8, 9, 16, 17, 25, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    reader = token_output.DacReader(token_output.dac_encode(ids))
    assert len(reader) == len(ids) and [reader[i] for i in range(len(ids))] == ids.tolist()
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert (reader.slice(int(a), int(b)) == ids[a:b]).all()
    assert len(token_output.DacReader(token_output.dac_encode(np.empty(0, dtype=np.uint32)))) == 0


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _blocks_met(a, b):
    """Whether two of the five bit blocks agree."""
    x, same = a ^ b, 0
    for w in line_dedup.BLOCKS:
        same += not x & ((1 << w) - 1)
        x >>= w
    return same >= 2


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice(WORDS, n)) for n in (30, 45, 60, 8)]
    rows = []
    for d in range(40):
        lines = [base[d % 4], f"line {d} " + base[(d + 1) % 4], " ".join(w + "s" if i == d % 29 else w for i, w in enumerate(base[2].split())), "short one", ""]
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, " ".join(rng.choice(WORDS, 2600))), (None, base[0]), (3, rows[3][1])]
    got = line_dedup.line_report(_docs(spark, rows)).collect()
    occ = [(d is None, d or 0, k, p, tuple(line.lower().split())) for k, (d, t) in enumerate(rows) for p, line in enumerate((t or "").split("\n"))]
    texts = sorted({w for *_, w in occ if w})

    def sim(w):
        longer = [x for x in w if len(x.encode()) > line_dedup.SHORT]
        w = longer or w
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    sims, label = [sim(w) for w in texts], list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if _blocks_met(sims[i], sims[j]) and (sims[i] ^ sims[j]).bit_count() <= line_dedup.MAX_BITS and abs(len(" ".join(a)) - len(" ".join(b))) <= 0.2 * max(len(" ".join(a)), len(" ".join(b))):
                x, y = " ".join(a), " ".join(b)
                if _edit(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if v == old else v for v in label]
    root = dict(zip(texts, label, strict=True))
    totals, seen = Counter(), set()
    for no, d, _, _, w in sorted(occ):
        if w:
            totals[None if no else d] += root[w] in seen
            seen.add(root[w])
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["n_removed"]
    assert len(got) == len(rows) and +have == +totals and sum(r["n_lines"] for r in got) == len(occ)


def test_search_matches_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    monkeypatch.setattr(topk_search, "QUERY_TERMS", 60)
    docs = _docs(spark, rows)
    got = Counter((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in topk_search.top_documents(docs, docs.where("doc_id % 5 = 0"), 4).collect())
    bags = [Counter(license_scan.words((t or "").replace("\n", " ").encode())) for _, t in rows]
    n, lens = len(rows), [sum(b.values()) for b in bags]
    df = Counter(w for b in bags for w in b)
    want = Counter()
    for q in {(d, t) for d, t in rows if d is not None and d % 5 == 0}:
        bag = bags[rows.index(q)]
        scored = [(sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * x / (sum(lens) / n))) for w, c in bag.items() if w in b), d) for b, x, (d, _) in zip(bags, lens, rows, strict=True)]
        best = sorted((-round(s, 9), d is None, d or 0, s, d) for s, d in scored if s > 0)[:4]
        want.update((q[0], k + 1, d, round(s, 6)) for k, (*_, s, d) in enumerate(best))
    assert got == want


def test_search_in_empty_tables(spark, rows):
    docs = _docs(spark, rows)
    assert topk_search.top_documents(docs.where("false"), docs, 3).count() == 0
    assert topk_search.top_documents(docs, docs.where("false"), 3).count() == 0


def test_secret_base_patterns():
    text = 'x Password="abcdef1" token: abc secret=tokens=1 AKIA' + "A1" * 8 + " " + "ab12" * 6 + " api-key=zzzzzz API_KEY = 'q.w-e/r'"
    assert [(k, text[s:e]) for k, s, e in secret_scan.base_spans(text)] == [
        ("assign", 'Password="abcdef1'), ("assign", "secret=tokens=1"), ("access", "AKIA" + "A1" * 8), ("hex", "ab12" * 6), ("assign", "API_KEY = 'q.w-e/r"),
    ]
    assert secret_scan.base_spans("\u017fecret=abcdefg to\u212aen=abcdefg") == []  # only A-Z and a-z fold


def test_secret_layers_reach_the_fixpoint():
    inner = "é token = hunter2hunter2"
    layers = base64.b64encode(zlib.compress(base64.b64encode(inner.encode()))).decode()
    text = "see " + layers.replace("=", "%3D") + " end"
    spans = secret_scan.all_spans(text)
    kinds = {k for k, _, _ in spans}
    assert any(k.endswith("base64>unpack>base64>assign") for k in kinds)
    assert all(text[s:e] and 0 <= s < e <= len(text) for _, s, e in spans)
    assert secret_scan.all_spans("\\u0070assword=hunter22") == [("unicode>assign", 0, 22)]
    assert secret_scan.all_spans("\\u{70}assword=hunter22") == [("unicode>assign", 0, 22)]
    assert secret_scan.all_spans("") == [] and secret_scan.all_spans("%%% \\u00 &#xD800; AAAAAAAAAAAAAAAAAAAAA") == []


def _in_base64(raw):
    return base64.b64encode(raw).decode()


SECRET = b"token = hunter2hunter2"


@pytest.mark.parametrize("raw", [
    "a\u00a0b\u200b\ufeff ".encode() + SECRET, b"\x1b[31m\x00" + SECRET, b"\xff\xfe\x80 " + SECRET + b" \xe9", SECRET.decode().encode("utf-16"), SECRET.decode().encode("utf-16-be"),
])
def test_secrets_in_layers_that_are_not_clean_text(raw):
    assert any(k == "base64>assign" for k, _, _ in secret_scan.all_spans(f"see {_in_base64(raw)} end"))


@pytest.mark.parametrize("before", ["id-", "a/", "ab_cd/", "xyz", "key/of-/"])
def test_secrets_in_misaligned_base64(before):
    text = f"see {before}{_in_base64(SECRET + b' and more')} end"
    (span,) = [x for x in secret_scan.all_spans(text) if x[0] == "base64>assign"]
    assert span[1] >= 4 + len(before)
    assert any(k == "base64>unpack>assign" for k, _, _ in secret_scan.all_spans(f"see {before}{_in_base64(gzip.compress(SECRET))} end"))


@pytest.mark.parametrize("columns", [64, 76])
def test_secrets_in_wrapped_archives_of_several_members(columns):
    noise = np.random.default_rng(0).integers(0, 256, 900, dtype=np.uint8).tobytes()
    for pack in (gzip.compress, bz2.compress):
        line = _in_base64(pack(noise) + pack(SECRET))
        text = "see\n" + "\n".join(line[k : k + columns] for k in range(0, len(line), columns)) + "\nend."
        assert any(k == "base64>unpack>assign" for k, _, _ in secret_scan.all_spans(text))


def test_secrets_in_large_archives(monkeypatch):
    for pad in (b"\0", b"word, ", b"word "):
        raw = pad * ((secret_scan.MAX_UNPACKED + 5_000_000) // len(pad)) + b" " + SECRET
        assert any(k == "base64>unpack>assign" for k, _, _ in secret_scan.all_spans(_in_base64(gzip.compress(raw, 1))))
    monkeypatch.setattr(secret_scan, "WINDOW", 64)
    monkeypatch.setattr(secret_scan, "_PIECE", 7)
    for k in range(30):
        raw = b"plain, " * 40 + b"x" * k + b" " + SECRET + b", plain" * 40
        assert any(x == "base64>unpack>assign" for x, _, _ in secret_scan.all_spans(_in_base64(gzip.compress(raw))))


@pytest.mark.parametrize("raw", [gzip.compress(SECRET), bz2.compress(SECRET), zlib.compress(SECRET), zlib.compress(SECRET, wbits=12), SECRET.decode().encode("utf-16-le"), gzip.compress(zlib.compress(SECRET))])
def test_secrets_in_bytes_written_as_escapes(raw):
    from urllib.parse import quote

    for text in (quote(raw), "".join(f"%{b:02x}" for b in raw), repr(raw)[2:-1], "".join(f"\\x{b:02X}" for b in raw)):
        spans = [x for x in secret_scan.all_spans(f"see {text} end") if x[0].endswith(">assign")]
        assert spans and all(4 <= s < e <= 4 + len(text) + 4 for _, s, e in spans), text
    assert any(k.startswith("base64>") and k.endswith("assign") for k, _, _ in secret_scan.all_spans(_in_base64(raw)))


@pytest.mark.parametrize("columns", [4, 8, 15])
def test_secrets_in_narrow_base64(columns):
    for raw in (SECRET, gzip.compress(SECRET)):
        line = _in_base64(raw)
        text = "see\n\n" + "\n".join(line[k : k + columns] for k in range(0, len(line), columns)) + "\n\nend."
        assert any(k.startswith("base64>") and k.endswith("assign") for k, _, _ in secret_scan.all_spans(text))


def test_secret_scan_of_odd_rows(spark, rows):
    got = secret_scan.scan_secrets(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["spans"] == [] for r in got)


@pytest.mark.parametrize("run", [
    simhash_dedup.simhash_groups, simhash_dedup.keep_one_of_each_group, license_scan.scan_licenses, secret_scan.scan_secrets, token_output.token_digest, line_dedup.line_report, language_id.identify,
])
def test_empty_tables(spark, run):
    assert run(_docs(spark, [])).count() == 0
