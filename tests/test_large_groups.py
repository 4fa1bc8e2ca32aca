"""Days, hours and customers that hold far more rows than the small tables do."""

import hashlib
import itertools

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.operators import greedy, neighbours, pair_blocks
from tessera.operators.greedy import assignment, per_group, per_groups, suppress
from tessera.plans import catalogue


def write_table(folder, name, rows, columns):
    duckdb.sql(f"COPY (SELECT {columns} FROM {rows}) TO '{folder}/{name}.parquet'")


def sql_rows(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    return names, sorted(got.fetchall(), key=lambda r: tuple((x is None, x) for x in r))


EVENTS = "e AS event_id, TIMESTAMP '2024-01-01' + to_seconds(e % 80000) AS ts, e % 500 AS user_id, ['view', 'click', 'purchase', 'signup', 'error'][1 + e % 5] AS event_type, CAST(e % 97 AS DOUBLE) AS value, '{\"k\": 1}' AS props"


def test_signature_of_a_day_beyond_64_bits(spark, tmp_path):
    write_table(tmp_path, "events", "range(200000) t(e)", EVENTS)
    total = sum(int(hashlib.md5(f"{e}|{e % 500}|{['view', 'click', 'purchase', 'signup', 'error'][e % 5]}".encode()).hexdigest()[:12], 16) for e in range(200000))
    assert total >= 2**63
    (row,) = catalogue.QUERIES["content_signatures"](spark, str(tmp_path)).collect()
    assert row["n"] == 200000 and row["signature"] == (total + 2**63) % 2**64 - 2**63


def test_orders_of_a_customer_at_the_same_moment(spark, tmp_path):
    """Against a loop: the SQL's two windows may order equal rows differently in DuckDB, which then splits them."""
    write_table(tmp_path, "orders", "range(6000) t(o)", "o AS o_orderkey, o % 50 AS o_custkey, TIMESTAMP '2024-01-01' + to_days(CAST(o * 7919 % 900 AS INT) // 3 * 3) AS o_orderdate")
    want = []
    for who, start in duckdb.sql(f"SELECT o_custkey, epoch_us(o_orderdate) AS a FROM '{tmp_path}/orders.parquet' ORDER BY 1, 2").fetchall():
        end = start + 30 * 86_400_000_000
        if want and want[-1][0] == who and start <= want[-1][2]:
            want[-1][2:] = [end, want[-1][3] + 1]
        else:
            want.append([who, start, end, 1])
    got = catalogue.QUERIES["interval_union"](spark, str(tmp_path)).select("o_custkey", "start_us", "end_us", "n").collect()
    assert sorted(map(list, got)) == want


@pytest.mark.parametrize("name", ["colocation_median", "cannot_links", "same_time_rivals"])
def test_pairs_of_busy_hours_are_folded_without_shuffling_meetings(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(pair_blocks, "BLOCK_ROWS", 1000)
    monkeypatch.setattr(pair_blocks, "MEETINGS", 5000)
    some = EVENTS.replace("e % 500 AS user_id", "nullif(hash(e) % 211, 7)::BIGINT AS user_id").replace("CAST(e % 97 AS DOUBLE)", "CASE WHEN hash(e + 1) % 5 > 0 THEN CAST(hash(e) % 97 AS DOUBLE) END").replace("e % 80000", "e % 9000")
    write_table(tmp_path, "events", "range(9000) t(e)", some)
    names, want = sql_rows(tmp_path, name, "events")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select(*names)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and (len(want) > 100 or name == "cannot_links")


@pytest.mark.parametrize("name", ["edge_questions", "break_candidates"])
def test_neighbours_in_busy_hours_are_found_without_making_pairs(spark, tmp_path, name):
    some = EVENTS.replace("e % 500 AS user_id", "nullif(hash(e) % 300, 7)::BIGINT AS user_id").replace("CAST(e % 97 AS DOUBLE)", "CASE WHEN hash(e + 1) % 5 > 0 THEN CAST(hash(e) % 97 AS DOUBLE) END").replace("e % 80000", "hash(e + 2) % 2000 * 41")
    write_table(tmp_path, "events", "range(4000) t(e)", some)
    names, want = sql_rows(tmp_path, name, "events")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select(*names)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000


def test_groups_keep_their_tasks_and_many_columns_are_narrowed(spark):
    rng = np.random.default_rng(3)
    df = spark.range(4000).selectExpr("id % 40 AS k", "id")
    own = per_group(df, ["k"], ["id"], lambda f: f, "k bigint, id bigint").selectExpr("spark_partition_id() AS p").distinct().count()
    assert own == int(spark.conf.get("spark.sql.shuffle.partitions"))
    cost = rng.random((4, 500))
    few = sorted({int(j) for row in cost for j in np.argsort(row)[:4]})
    best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(few, 4))
    got = assignment(cost)
    assert len({j for _, j in got}) == 4 and abs(sum(cost[i, j] for i, j in got) - best) < 1e-12


def test_lone_seam_pairs_are_found_before_the_join(spark, tmp_path):
    some = EVENTS.replace("to_seconds(e % 80000)", "to_seconds(CAST(hash(e) % 864000 AS BIGINT))").replace("e % 500 AS user_id", "(hash(e + 1) % 90)::BIGINT AS user_id")
    write_table(tmp_path, "events", "range(1500) t(e)", some)
    names, want = sql_rows(tmp_path, "seam_pairs", "events")
    got = catalogue.QUERIES["seam_pairs"](spark, str(tmp_path)).select(*names)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_many_groups_share_a_call_and_nulls_are_one_key(spark):
    df = spark.range(3_000).selectExpr("CASE WHEN id >= 90 THEN id div 3 END AS k", "id")
    seen = per_groups(df.coalesce(1), ["k"], ["id"], lambda f, group: pd.DataFrame({"n": [group.max() + 1], "rows": [len(f)]}), "n bigint, rows bigint").collect()
    assert sum(r["n"] for r in seen) == 971 and sum(r["rows"] for r in seen) == 3_000 and len(seen) <= 3 * 8


def test_suppression_of_a_long_island_and_of_a_null_key(spark):
    rng = np.random.default_rng(3)
    rows = [(u, k, int(t), float(s)) for u in (None, 7) for k, (t, s) in enumerate(zip(rng.integers(0, 40_000, 2_000), rng.integers(0, 50, 2_000)))]
    got = {(r["u"], r["i"]) for r in suppress(spark.createDataFrame(rows, "u int, i bigint, t bigint, s double"), ["u"], "i", "t", "s", 30).collect()}
    want = set()
    for u in (None, 7):
        kept = []
        for _, i, t, _ in sorted((r for r in rows if r[0] == u), key=lambda r: (-r[3], r[2], r[1])):
            if all(abs(t - x) >= 30 for x in kept):
                kept.append(t)
                want.add((u, i))
    assert got == want


def test_small_assignments_take_the_same_steps(monkeypatch):
    rng = np.random.default_rng(8)
    costs = [rng.integers(0, 4, (n, m)) / 4 for n in (1, 2, 5, 9) for m in (1, 3, 9, 20) for _ in range(5)]
    small = [assignment(c) for c in costs]
    monkeypatch.setattr(greedy, "SMALL", 0)
    assert small == [assignment(c) for c in costs]


def test_vectors_are_copied_to_few_blocks_and_pairs_counted_once(spark):
    many = spark.range(20_000).selectExpr("id", "array(1.0) AS v", "0 AS label")
    assert neighbours._block_pairs(many, "id", "v", "label", False).count() == 2 * 8 * 20_000
    assert neighbours._block_pairs(many, "id", "v", "label", True).count() == 9 * 20_000


def test_distances_are_binned_as_a_full_count_gives_them(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SMALL", 30)
    monkeypatch.setattr(neighbours, "CELLS", 100)
    rng = np.random.default_rng(4)
    vectors = [(k, int(rng.integers(3)), rng.normal(size=5).round(2).tolist()) for k in range(100)] + [(100, 1, [0.0] * 5), (101, 1, [-1.0] + [0.0] * 4), (102, 2, [1.0] + [0.0] * 4)]
    got = {(r["same"], r["d"]): r["n"] for r in neighbours.distance_histogram(spark.createDataFrame(vectors, "id bigint, label int, v array<double>"), "id", "v", "label").collect()}
    unit = np.array([v for _, _, v in vectors])
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    want = {}
    for i, j in itertools.combinations(range(len(vectors)), 2):
        key = (vectors[i][1] == vectors[j][1], int(np.floor((1 - unit[i] @ unit[j]) * 1e6 + 0.5)))
        want[key] = want.get(key, 0) + 1
    assert got == want and (False, 2_000_000) in got
