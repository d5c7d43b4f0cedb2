"""The registered queries of the time-series engine and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import asof, kvmap
from tidemark.sources import adapters, facts, raw, shared, store

Query = Callable[[SparkSession, str], DataFrame]

_BATCH = [(1, 3, 20240101, 20241231, 4_000_000_000), (2, 3, 20240105, 20240120, 1_705_000_000), (3, 17, 20240110, 20240125, 1_705_600_000), (4, 999_999, 0, 99_999_999, 1)]
_QUERY = "id long, asset_id long, start_date long, end_date long, timestamp long"

_EVENTS = """(SELECT user_id AS asset_id, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS date, CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp", CAST(value AS FLOAT) AS value FROM events)"""
_LINES = """(SELECT l_suppkey AS asset_id, CAST(strftime(l_shipdate, '%Y%m') AS BIGINT) * 100 + 1 AS date, l_orderkey AS "timestamp", CAST(l_extendedprice AS FLOAT) AS value FROM lineitem)"""
_ORDERS = """(SELECT o_custkey AS asset_id, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS date, o_orderkey AS "timestamp", CAST(o_totalprice AS FLOAT) AS value FROM orders)"""


def _newest(by: str) -> str:
    return f'QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY "timestamp" DESC, value DESC) = 1'


def _range_sql(rows: str, where: str, tail: str = "") -> str:
    return f'SELECT CAST(0 AS BIGINT) AS id, * FROM {rows} WHERE {where} {_newest("asset_id, date")} {tail}'


def _batch_sql(rows: str, queries: str) -> str:
    return f'SELECT id, f.asset_id, date, f."timestamp", value FROM {rows} f JOIN {queries} q ON f.asset_id = q.asset_id AND date BETWEEN start_date AND end_date AND f."timestamp" <= q."timestamp" QUALIFY row_number() OVER (PARTITION BY id, date ORDER BY f."timestamp" DESC, value DESC) = 1'


def asof_range_single(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of_range(adapters.events_as_facts(spark, d, 20240101, 20241231), 3, 20240101, 20241231, 4_000_000_000)


def asof_on_store(spark: SparkSession, d: str) -> DataFrame:
    store.write_store(adapters.events_as_facts(spark, d), path := shared.new_path(spark, "store"), on_duplicate="keep")
    return asof.as_of_range(store.open_store(spark, path), 3, 20240101, 20241231, 4_000_000_000)


def asof_range_batch(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of_batch(adapters.events_as_facts(spark, d), spark.createDataFrame(_BATCH, _QUERY))


def asof_batch_from_table(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    q = adapters.table(spark, d, "supplier").select(
        k.alias("id"), k.alias("asset_id"), F.lit(19930101).cast("long").alias("start_date"), (F.lit(19960001) + F.pmod(k, F.lit(12)) * 100).cast("long").alias("end_date"), (k * 137).alias("timestamp")
    )
    return asof.as_of_batch(adapters.lineitem_as_facts(spark, d), q)


def asof_ties(spark: SparkSession, d: str) -> DataFrame:
    return asof.latest(adapters.lineitem_as_facts(spark, d), 4_000_000_000)


def asof_empty_range(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of_range(adapters.events_as_facts(spark, d), 3, 20241231, 20240101, 4_000_000_000)


def asof_before_first(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of_range(adapters.events_as_facts(spark, d), 3, 20240101, 20241231, 1)


def asof_last_n_dates(spark: SparkSession, d: str) -> DataFrame:
    return asof.as_of_range(adapters.events_as_facts(spark, d), 3, 20240101, 20241231, 4_000_000_000, limit=5)


def latest_all_assets(spark: SparkSession, d: str) -> DataFrame:
    return asof.latest(adapters.events_as_facts(spark, d), 4_000_000_000)


def fact_dump(spark: SparkSession, d: str) -> DataFrame:
    return store.dump(adapters.orders_as_facts(spark, d))


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    store.write_store(adapters.events_as_facts(spark, d), path := shared.new_path(spark, "store"), on_duplicate="keep")
    return store.open_store(spark, path)


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    raw.write_raw_csv(adapters.events_as_facts(spark, d), path := shared.new_path(spark, "csv"))
    return facts.read_facts_csv(spark, path)


def _raw_events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").cast("string").alias("asset"), F.col("value").cast("string").alias("v"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("known")
    )


def normalize_raw(spark: SparkSession, d: str) -> DataFrame:
    return raw.normalize_raw(_raw_events(spark, d), [0], [3], {"asset_text": "asset", "date": "day", "known_at": "known"})


def raw_sorted(spark: SparkSession, d: str) -> DataFrame:
    raw.write_raw_csv(_raw_events(spark, d).select("day", "asset", "known"), path := shared.new_path(spark, "raw"))
    return raw.normalize_and_sort(raw.read_raw_csv(spark, path, 3), [0], [2], 3)


def raw_rejected(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    day = F.when(n % 7 == 0, "2024-02-30").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    known = F.when(n % 5 == 0, "noon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = adapters.table(spark, d, "events").select(day.alias("day"), n.cast("string").alias("n"), known.alias("known"))
    return raw.rejected(rows, [0], [2]).withColumn("bad_columns", F.array_join(F.col("bad_columns").cast("array<string>"), ","))


def _map(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("v"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey").cast("long")
    return adapters.table(spark, d, "part").select(p.alias("seq"), F.pmod(p * 7, F.lit(5000)).alias("k"), (p + 1_000_000).alias("v"))


def kv_lookup(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.lookup(_map(spark, d), _changes(spark, d))


def kv_range(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.lookup_range(_map(spark, d), 100, 2000)


def kv_insert(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.insert(_map(spark, d), _changes(spark, d))[0]


def kv_insert_results(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.insert(_map(spark, d), _changes(spark, d))[1]


def kv_update(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.update(_map(spark, d), _changes(spark, d))[0]


def kv_update_results(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.update(_map(spark, d), _changes(spark, d))[1]


def kv_delete(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.delete(_map(spark, d), _changes(spark, d))[0]


def kv_delete_results(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.delete(_map(spark, d), _changes(spark, d))[1]


def _log(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("event_id").cast("long")
    op = F.element_at(F.array(*map(F.lit, ("insert", "update", "delete"))), (F.pmod(seq * 31, F.lit(3)) + 1).cast("int"))
    return adapters.table(spark, d, "events").select(seq.alias("seq"), op.alias("op"), F.pmod(F.col("user_id").cast("long") * 3, F.lit(500)).alias("k"), (seq + 1_000_000).alias("v"))


def kv_apply_log(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.apply_log(_map(spark, d), _log(spark, d))[0]


def kv_apply_log_results(spark: SparkSession, d: str) -> DataFrame:
    return kvmap.apply_log(_map(spark, d), _log(spark, d))[1]


def cross_section(spark: SparkSession, d: str) -> DataFrame:
    return asof.cross_section(adapters.events_as_facts(spark, d), 20240110, 4_000_000_000)


def revisions(spark: SparkSession, d: str) -> DataFrame:
    return asof.revisions(adapters.lineitem_as_facts(spark, d), 4_000_000_000)


_NEW = "(SELECT p_partkey AS seq, (p_partkey * 7) % 5000 AS k, p_partkey + 1000000 AS v FROM part)"
_KV = "(SELECT o_orderkey AS k, o_custkey AS v FROM orders)"
_ONE = f"(SELECT * FROM {_NEW} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1)"
_LAST = f"(SELECT * FROM {_NEW} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)"
_FIRST_QUERIES = ", ".join(map(str, _BATCH))

_LOG = "(SELECT event_id AS seq, ['insert','update','delete'][(event_id * 31) % 3 + 1] AS op, (user_id * 3) % 500 AS k, event_id + 1000000 AS v FROM events)"
#: What a key holds at the end follows from the operations after its last delete: the first insert there puts a value unless one is held, each later update replaces it.
_REPLAY = f"""
WITH l AS (SELECT * FROM {_LOG}), cut AS (SELECT k, max(seq) FILTER (op = 'delete') AS gone FROM l GROUP BY k),
live AS (SELECT l.*, gone FROM l JOIN cut USING (k) WHERE gone IS NULL OR seq > gone),
base AS (SELECT b.k, b.v FROM {_KV} b LEFT JOIN cut USING (k) WHERE gone IS NULL),
put AS (SELECT k, min(seq) AS seq, arg_min(v, seq) AS v FROM live WHERE op = 'insert' GROUP BY k),
held AS (SELECT coalesce(b.k, p.k) AS k, coalesce(b.v, p.v) AS v, CASE WHEN b.k IS NOT NULL THEN -1 ELSE p.seq END AS since FROM base b FULL JOIN put p ON b.k = p.k),
up AS (SELECT h.k, arg_max(l.v, l.seq) AS v FROM held h JOIN live l ON l.k = h.k AND l.op = 'update' AND l.seq > h.since GROUP BY h.k)
SELECT h.k, coalesce(up.v, h.v) AS v FROM held h LEFT JOIN up USING (k)"""

#: What an operation finds follows from those of its key before it: since the last delete, the first put (by the base, if nothing was deleted, or by an insert) and the last update after it.
_FOUND = f"""
WITH l AS (SELECT seq, op, k, v FROM {_LOG} UNION ALL SELECT -1, 'insert', k, v FROM {_KV}),
c AS (SELECT *, coalesce((sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS part FROM l),
put AS (SELECT k, part, min(seq) AS since, arg_min(v, seq) AS v FROM c WHERE op = 'insert' GROUP BY k, part),
up AS (SELECT c.k, c.part, c.seq, c.v FROM c JOIN put p ON c.k = p.k AND c.part = p.part AND c.op = 'update' AND c.seq > p.since),
last AS (SELECT c.k, c.seq, u.v FROM c ASOF LEFT JOIN (SELECT k * 1000000 + part AS at, seq, v FROM up) u ON c.k * 1000000 + c.part = u.at AND c.seq > u.seq)
SELECT c.seq, CASE WHEN p.since < c.seq THEN coalesce(last.v, p.v) END AS old FROM c LEFT JOIN put p ON c.k = p.k AND c.part = p.part LEFT JOIN last ON last.k = c.k AND last.seq = c.seq WHERE c.seq >= 0"""

QUERIES: dict[str, tuple[Query, str]] = {
    "asof_range_single": (asof_range_single, _range_sql(_EVENTS, 'asset_id = 3 AND date BETWEEN 20240101 AND 20241231 AND "timestamp" <= 4000000000')),
    "asof_range_batch": (asof_range_batch, _batch_sql(_EVENTS, f'(SELECT * FROM (VALUES {_FIRST_QUERIES}) v(id, asset_id, start_date, end_date, "timestamp"))').replace("SELECT id,", "SELECT CAST(id AS BIGINT) AS id,", 1)),
    "asof_batch_from_table": (asof_batch_from_table, _batch_sql(_LINES, '(SELECT s_suppkey AS id, s_suppkey AS asset_id, 19930101 AS start_date, 19960001 + (s_suppkey % 12) * 100 AS end_date, s_suppkey * 137 AS "timestamp" FROM supplier)')),
    "asof_ties": (asof_ties, f'SELECT * FROM {_LINES} {_newest("asset_id, date")}'),
    "asof_empty_range": (asof_empty_range, _range_sql(_EVENTS, "asset_id = 3 AND date BETWEEN 20241231 AND 20240101")),
    "asof_before_first": (asof_before_first, _range_sql(_EVENTS, 'asset_id = 3 AND date BETWEEN 20240101 AND 20241231 AND "timestamp" <= 1')),
    "asof_last_n_dates": (asof_last_n_dates, _range_sql(_EVENTS, 'asset_id = 3 AND date BETWEEN 20240101 AND 20241231 AND "timestamp" <= 4000000000', "ORDER BY date DESC LIMIT 5")),
    "latest_all_assets": (latest_all_assets, f'SELECT * FROM {_EVENTS} {_newest("asset_id, date")}'),
    "fact_dump": (fact_dump, f"SELECT * FROM {_ORDERS}"),
    "store_roundtrip": (store_roundtrip, f"SELECT * FROM {_EVENTS}"),
    "csv_roundtrip": (csv_roundtrip, f"SELECT * FROM {_EVENTS}"),
    "normalize_raw": (normalize_raw, "SELECT CAST(user_id AS VARCHAR) AS asset_text, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS date, CAST(round_even(CAST(epoch_us(ts) AS DECIMAL(20, 0)) / 1000000, 0) AS BIGINT) AS known_at FROM events"),
    "kv_lookup": (kv_lookup, f"SELECT n.k, b.v FROM {_NEW} n LEFT JOIN {_KV} b USING (k)"),
    "kv_range": (kv_range, f"SELECT v FROM {_KV} WHERE k BETWEEN 100 AND 2000"),
    "kv_insert": (kv_insert, f"SELECT k, v FROM {_KV} UNION ALL SELECT k, v FROM {_ONE} n WHERE k NOT IN (SELECT o_orderkey FROM orders)"),
    "kv_insert_results": (kv_insert_results, f"SELECT seq, k, k NOT IN (SELECT o_orderkey FROM orders) AND row_number() OVER (PARTITION BY k ORDER BY seq) = 1 AS inserted FROM {_NEW}"),
    "kv_update": (kv_update, f"SELECT b.k, coalesce(n.v, b.v) AS v FROM {_KV} b LEFT JOIN {_LAST} n USING (k)"),
    "kv_update_results": (kv_update_results, f"SELECT seq, n.k, CASE WHEN b.v IS NOT NULL THEN coalesce(lag(n.v) OVER (PARTITION BY n.k ORDER BY seq), b.v) END AS old FROM {_NEW} n LEFT JOIN {_KV} b USING (k)"),
    "kv_delete": (kv_delete, f"SELECT k, v FROM {_KV} b WHERE k NOT IN (SELECT (p_partkey * 7) % 5000 FROM part)"),
    "kv_delete_results": (kv_delete_results, f"SELECT seq, n.k, CASE WHEN row_number() OVER (PARTITION BY n.k ORDER BY seq) = 1 THEN b.v END AS old FROM {_NEW} n LEFT JOIN {_KV} b USING (k)"),
    "kv_apply_log": (kv_apply_log, _REPLAY),
    "kv_apply_log_results": (kv_apply_log_results, _FOUND),
    "asof_on_store": (asof_on_store, _range_sql(_EVENTS, 'asset_id = 3 AND date BETWEEN 20240101 AND 20241231 AND "timestamp" <= 4000000000')),
    "raw_sorted": (raw_sorted, "SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS c0, CAST(user_id AS VARCHAR) AS c1, CAST(round_even(CAST(epoch_us(ts) AS DECIMAL(20, 0)) / 1000000, 0) AS BIGINT) AS c2 FROM events"),
    "raw_rejected": (raw_rejected, "SELECT CASE WHEN event_id % 7 = 0 THEN '2024-02-30' ELSE strftime(ts, '%Y-%m-%d') END AS day, CAST(event_id AS VARCHAR) AS n, CASE WHEN event_id % 5 = 0 THEN 'noon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS known, CASE WHEN event_id % 35 = 0 THEN '1,3' WHEN event_id % 7 = 0 THEN '1' ELSE '3' END AS bad_columns FROM events WHERE event_id % 7 = 0 OR event_id % 5 = 0"),
    "cross_section": (cross_section, f'SELECT * FROM {_EVENTS} WHERE date = 20240110 {_newest("asset_id")}'),
    "revisions": (revisions, f'SELECT asset_id, date, arg_min(value, {{t: "timestamp", v: value}}) AS first_value, arg_max(value, {{t: "timestamp", v: value}}) AS last_value, count(*) AS versions FROM {_LINES} GROUP BY ALL'),
}
