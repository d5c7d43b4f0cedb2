import random

import pytest

from tidemark.operators import kvmap
from tidemark.schema import KV


def table(spark, d):
    return spark.createDataFrame(list(d.items()), KV)


def batch(spark, rows):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "seq long, k long, v long")


def held(df):
    return {r.k: r.v for r in df.collect()}


@pytest.mark.parametrize(
    "a, b, want",
    [(10, 15, [100, 130, 150]), (13, 15, [130, 150]), (10, 13, [100, 130]), (10, 10, [100]), (0, 10, [100]), (15, 1000, [150]), (13, 1000, [130, 150]), (16, 100, []), (1, 9, [])],
)
def test_range(spark, a, b, want):
    assert [r.v for r in kvmap.lookup_range(table(spark, {15: 150, 10: 100, 13: 130}), a, b).collect()] == want


def test_range_over_many_and_after_deletes(spark):
    m = table(spark, {k: 10 * k for k in range(1, 101)})
    assert [r.v for r in kvmap.lookup_range(m, 80, 86).collect()] == list(range(800, 861, 10))
    m = table(spark, {k: 10 * k for k in range(1, 31)})
    m, old = kvmap.delete(m, batch(spark, [(16, None), (17, None), (23, None), (99, None)]))
    assert [r.old for r in old.orderBy("seq").collect()] == [160, 170, 230, None]
    assert [r.v for r in kvmap.lookup_range(m, 14, 25).collect()] == [140, 150, 180, 190, 200, 210, 220, 240, 250]


def test_insert_keeps_the_first(spark):
    m, ok = kvmap.insert(kvmap.empty(spark), batch(spark, [(10, 1), (15, 2), (10, 3)]))
    assert held(m) == {10: 1, 15: 2} and [r.inserted for r in ok.orderBy("seq").collect()] == [True, True, False]
    m2, ok = kvmap.insert(m, batch(spark, [(10, 9), (11, 4)]))
    assert held(m2) == {10: 1, 15: 2, 11: 4} and [r.inserted for r in ok.orderBy("seq").collect()] == [False, True]
    assert {r.k: r.v for r in kvmap.lookup(m, batch(spark, [(10, 0), (11, 0)])).collect()} == {10: 1, 11: None}
    assert kvmap.lookup_one(m, 15).collect()[0].v == 2 and kvmap.lookup_one(m, 16).count() == 0


def test_update_returns_old_values(spark):
    m, old = kvmap.update(table(spark, {1: 10, 2: 20}), batch(spark, [(1, 11), (3, 33), (1, 12)]))
    assert held(m) == {1: 12, 2: 20} and [r.old for r in old.orderBy("seq").collect()] == [10, None, 11]


def test_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        kvmap.in_range(table(spark, {-1: 0})).collect()


def test_log_against_a_dict(spark):
    rng = random.Random(3)
    base = {k: k for k in range(0, 40, 2)}
    log = [(i, rng.choice(["insert", "update", "delete", "lookup"]), rng.randrange(45), rng.randrange(1000)) for i in range(400)]
    now, want = dict(base), {}
    for i, op, k, v in log:
        want[i] = now.get(k)
        if op == "insert":
            now.setdefault(k, v)
        elif op == "update" and k in now:
            now[k] = v
        elif op == "delete":
            now.pop(k, None)
    state, old = kvmap.apply_log(table(spark, base), spark.createDataFrame(log, "seq long, op string, k long, v long"))
    assert held(state) == now and {r.seq: r.old for r in old.collect()} == want


def test_a_long_log_of_one_key(spark):
    import time

    log = spark.range(100_000).selectExpr("id AS seq", "element_at(array('insert', 'update', 'delete', 'lookup'), cast(id % 4 + 1 AS int)) AS op", "5L AS k", "id AS v")
    t = time.time()
    state, found = kvmap.apply_log(spark.createDataFrame([(5, 77), (6, 1)], "k long, v long"), log)
    assert found.where("old is null").count() == 49_999 and {tuple(x) for x in state.collect()} == {(6, 1)} and time.time() - t < 60
