"""The pipeline end to end, and each stage on its own input."""

import numpy as np

import corpus_pipeline
from tessera.llm import queries, simhash_dedup


def test_stages_filter_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, sf), f"test-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
    got = docs.orderBy("start").collect()
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]


def test_every_operator_is_registered():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14))


def test_near_dedup_links_sets_by_their_fingerprints(spark):
    rng = np.random.default_rng(12)
    base = [[f"w{rng.integers(9000)}" for _ in range(400)] for _ in range(6)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:-1], "end"]) for w in base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "CAST(doc_id AS string) AS row", "text")
    sets = simhash_dedup.shingle_sets(docs).selectExpr("doc_id AS set", "n", "fp", "1 AS n_copies")
    fps = {r["set"]: r["fp"] % 2**64 for r in sets.collect()}
    assert all(fps[k] == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in x) > len(x)) for k, x in enumerate(map(simhash_dedup.shingles, texts)))
    near = {(k, k + 6) for k in range(6) if (fps[k] ^ fps[k + 6]).bit_count() <= 3}
    assert near and {(r["a"], r["b"]) for r in simhash_dedup.fingerprint_pairs(sets).collect()} == near


def test_variants_of_a_text_are_joined_by_way_of_it(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = [f"w{rng.integers(9000)}" for _ in range(300)]
    variants = []
    for k in range(40):
        copy = list(base)
        for at in rng.choice(300, 6, replace=False):
            copy[at] = f"v{k}-{at}"
        variants.append(copy)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([base, *variants])], "doc_id bigint, text string").selectExpr("doc_id", "CAST(doc_id AS string) AS row", "text")
    made = {}
    plain = simhash_dedup.cut
    monkeypatch.setattr(simhash_dedup, "cut", lambda df, tag, *more: made.setdefault(tag, plain(df, tag, *more)))
    assert simhash_dedup.near_copies(docs).select("root").distinct().count() == 1
    assert made["near-crowd"].count() < 41  # no cell's members are left to be compared with each other


def test_a_crowd_of_unlike_texts_is_settled_without_its_shingles(spark, monkeypatch):
    """Variants of a text that are too different for each other meet by bands; their parities tell them apart."""
    rng = np.random.default_rng(21)
    words = np.array([f"w{k}" for k in range(5000)])
    base = rng.choice(words, 400)
    texts = []
    for _ in range(60):
        own = base.copy()
        own[rng.choice(400, 24, replace=False)] = rng.choice(words, 24)  # two variants have a similarity of about 0.4
        texts.append(" ".join(own))
    texts.append(texts[7] + " and more")
    fetched, real = [], simhash_dedup._verified
    monkeypatch.setattr(simhash_dedup, "_verified", lambda pairs, arrays: fetched.append(pairs.count()) or real(pairs, arrays))
    docs = spark.createDataFrame([(k, str(k), t) for k, t in enumerate(texts)], "doc_id bigint, row string, text string")
    roots = {r["doc_id"]: r["root"] for r in simhash_dedup.near_copies(docs).collect()}
    sets = [set(simhash_dedup.shingles(t).tolist()) for t in texts]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike == {(7, 60)} and roots[7] == roots[60] and len(set(roots.values())) == 60
    assert len(fetched) == 2 and fetched[1] <= 5  # of 1,800 pairs in all


def test_parities_never_differ_in_more_places_than_the_sets_do():
    rng = np.random.default_rng(22)
    for n, own in ((1, 0), (5, 1), (300, 30), (3000, 600), (20_000, 2)):
        common, a, b = (rng.integers(0, 2**64, size=k, dtype=np.uint64) for k in (n, own, own))
        x, y = (simhash_dedup.parities(np.unique(np.concatenate([common, z]))) for z in (a, b))
        assert len(x) == simhash_dedup.PARITIES // 64 and np.bitwise_count((x ^ y).view(np.uint64)).sum() <= 2 * own
