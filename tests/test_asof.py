import random

import pytest

from tidemark.operators import asof
from tidemark.schema import FACT, QUERY
from tidemark.sources import store
from tidemark.streaming import append

SMALL = {
    (0, 20200131): {0: 1, 10: 2, 20: 3},
    (0, 20200229): {5: 11, 15: 12, 25: 13},
    (0, 20200331): {10: 110, 20: 120, 25: 130},
    (1, 20200229): {5: 21, 15: 22, 25: 23},
    (1, 20200331): {10: 220, 20: 220, 25: 230},
    (1, 20200430): {10: 2100, 20: 2200, 25: 2300},
}
CASES = [
    ((0, 20200131, 20200131, 20), [(20200131, 20, 3)]),
    ((0, 20200131, 20200131, 15), [(20200131, 10, 2)]),
    ((0, 20200115, 20200405, 20), [(20200331, 20, 120), (20200229, 15, 12), (20200131, 20, 3)]),
    ((1, 20200315, 20200515, 21), [(20200430, 20, 2200), (20200331, 20, 220)]),
    ((1, 20200331, 20200331, 21), [(20200331, 20, 220)]),
    ((0, 20200229, 20200229, 4), []),
    ((0, 20200401, 20200131, 99), []),
    ((2, 20200101, 20201231, 99), []),
]


def facts(spark, rows):
    return spark.createDataFrame([(a, d, t, float(v)) for a, d, t, v in rows], FACT)


@pytest.fixture(scope="module")
def small(spark):
    return facts(spark, [(a, d, t, v) for (a, d), x in SMALL.items() for t, v in x.items()])


@pytest.mark.parametrize("query, want", CASES)
def test_single(small, query, want):
    assert [(r.date, r.timestamp, r.value) for r in asof.as_of_range(small, *query).collect()] == want


def test_batch_is_the_union_of_its_queries(spark, small):
    q = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(CASES)], QUERY)
    got = [(r.id, r.date, r.timestamp, r.value) for r in asof.as_of_batch(small, q).collect()]
    assert got == [(i, *r) for i, (_, rows) in enumerate(CASES) for r in rows]


def test_next_asset_in_the_way(spark):
    f = facts(spark, [(0, 20200331, 10, 1), (1, 20200229, 5, 2)])
    assert [r.value for r in asof.as_of_range(f, 0, 20200301, 20200405, 20).collect()] == [1.0]


def test_empty_store(spark):
    f, q = spark.createDataFrame([], FACT), spark.createDataFrame([], QUERY)
    assert asof.as_of_range(f, 0, 0, 99999999, 9).collect() == []
    assert asof.as_of_batch(f, q).collect() == []


def test_tie_takes_the_greater_value(spark):
    f = facts(spark, [(0, 20200131, 10, 1), (0, 20200131, 10, 2)])
    assert [r.value for r in asof.as_of_range(f, 0, 0, 99999999, 10).collect()] == [2.0]
    with pytest.raises(store.DuplicateKey):
        store.checked(f)


def test_random_against_plain_python(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(5), 20200101 + rng.randrange(20), rng.randrange(60), rng.randrange(1000)) for _ in range(400)]
    qs = [(i, rng.randrange(6), a := 20200101 + rng.randrange(20), a + rng.randrange(-2, 10), rng.randrange(70)) for i in range(60)]
    want = []
    for i, a, s, e, t in qs:
        by = {}
        for x, d, k, v in rows:
            if x == a and s <= d <= e and k <= t:
                by[d] = max(by.get(d, (-1, -1.0)), (k, float(v)))
        want += [(i, d, *by[d]) for d in sorted(by, reverse=True)]
    got = asof.as_of_batch(facts(spark, rows), spark.createDataFrame(qs, QUERY)).collect()
    assert [(r.id, r.date, r.timestamp, r.value) for r in got] == want


def test_store_and_plans(spark, small, tmp_path):
    store.write_store(small, p := str(tmp_path / "s"), files=3)
    back = store.open_store(spark, p)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, small.collect()))
    assert [r.value for r in asof.as_of_range(back, *CASES[2][0]).collect()] == [120, 12, 3]
    plan = asof.as_of_range(back, *CASES[2][0])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(asset_id,0)" in plan and "GreaterThanOrEqual(date,20200115)" in plan and "WindowGroupLimit" in plan
    q = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(CASES)], QUERY)
    plan = asof.as_of_batch(back, q)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_bucketed_store_spares_the_shuffle(spark, small, tmp_path):
    store.write_bucketed(small, "facts_b", 4, str(tmp_path / "b"))
    t = spark.table("facts_b")
    plan = asof.latest(t, 99)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert asof.latest(t, 99).count() == 6
    spark.sql("drop table facts_b")


def test_stream_appends_versions(spark, small, tmp_path):
    small.write.parquet(src := str(tmp_path / "in"))
    append.append_stream(append.stream_facts(spark, src), out := str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [r.value for r in asof.as_of_range(store.open_store(spark, out), *CASES[2][0]).collect()] == [120, 12, 3]


def test_cross_section_and_revisions(small):
    assert {(r.asset_id, r.value) for r in asof.cross_section(small, 20200331, 20).collect()} == {(0, 120.0), (1, 220.0)}
    r = asof.revisions(small, 15).where("asset_id = 0 and date = 20200131").collect()[0]
    assert (r.first_value, r.last_value, r.versions) == (1.0, 2.0, 2)


def test_store_files_are_sorted_and_most_are_skipped(spark, tmp_path):
    import pyarrow.parquet as pq

    from tidemark.sources import store

    facts = spark.range(20_000).selectExpr("pmod(id * 7919, 100) AS asset_id", "20240101 + pmod(id * 31, 28) AS date", "id AS timestamp", "cast(id AS float) AS value")
    store.write_store(facts, path := str(tmp_path / "s"), files=8, rows_per_file=500)
    files = sorted(tmp_path.glob("s/*.parquet"))
    holds = 0
    for f in files:
        rows = [tuple(r.values()) for r in pq.read_table(f).to_pylist()]
        assert rows == sorted(rows)
        stats = pq.ParquetFile(f).metadata.row_group(0).column(0).statistics
        holds += stats.min <= 3 <= stats.max
    assert len(files) >= 40 and holds <= 3
    plan = store.open_store(spark, path).where("asset_id = 3 and date >= 20240105")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(asset_id,3)" in plan and "GreaterThanOrEqual(date,20240105)" in plan


def test_loads_are_checked_as_they_are_written(spark, small, tmp_path):
    from tidemark.schema import FACT

    path = str(tmp_path / "s")
    twice = [(0, 20200131, 10, 1), (1, 20200131, 10, 2), (0, 20200131, 10, 3)]
    with pytest.raises(store.DuplicateKey, match="20200131"):
        store.write_store(facts(spark, twice), path)
    assert not (tmp_path / "s").exists()
    store.write_store(facts(spark, twice), path, on_duplicate="keep")
    assert store.open_store(spark, path).count() == 3
    loose = spark.createDataFrame([(0, 20200131, 10, 1.0), (1, 20200131, -1, 2.0)], "asset_id long, date long, timestamp long, value float")
    unknown = spark.createDataFrame([(0, 20200131, None, 1.0)], loose.schema)
    for bad, wrong in ((facts(spark, twice), store.DuplicateKey), (loose, ValueError), (unknown, ValueError)):
        with pytest.raises(wrong):
            store.write_store(bad, path)
        assert store.open_store(spark, path).count() == 3 and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError):
        store.write_store(small, path, on_duplicate="drop")
    store.write_store(store.open_store(spark, path).where("asset_id = 1"), path)
    assert [r.asset_id for r in store.open_store(spark, path).collect()] == [1]
    plan = store._checking(small.repartitionByRange(3, "asset_id", "date").sortWithinPartitions(*FACT.names[:3]), "error")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
