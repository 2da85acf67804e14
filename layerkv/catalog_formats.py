"""More registered queries: binary formats through DataFrames, workloads B to F, and a store's life, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerkv import workloads
from layerkv.catalog import EVENTS, STORED, event_changes, layers, live_sql, new_store, read_back, register
from layerkv.functions import columns
from layerkv.operators.versions import newest
from layerkv.plans.batch import WriteBatch
from layerkv.plans.options import NEVER, Options
from layerkv.plans.store import Store
from layerkv.sources.change_logs import event_log, order_log, read
from layerkv.sources.logs import decode_logs, encode_logs
from layerkv.sources.tables import decode_tables, encode_tables, get_from_tables
from layerkv.streaming.ingest import apply_ordered

# Binary logs: a batch is twenty events, a log twenty batches


def event_logs(spark, folder):
    log = event_changes(spark, folder).withColumn("n", F.col("seq") - 1)
    batch = F.floor(F.col("n") / 20)
    path = F.format_string("%06d.log", F.floor(F.col("n") / 400))
    return encode_logs(log.select(path.alias("path"), (batch * 20 + 1).alias("base_seq"), (F.col("n") % 20).cast("int").alias("ordinal"), "vtype", F.col("user_key").cast("binary").alias("user_key"), F.col("value").cast("binary").alias("value")))


LOGGED = """SELECT printf('%06d.log', event_id // 400) AS path, event_id // 20 * 20 + 1 AS base_seq, (event_id % 20)::INTEGER AS ordinal, printf('user%016d', user_id) AS user_key, event_id + 1 AS seq,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vtype, CASE WHEN event_type = 'error' THEN '' ELSE event_id::VARCHAR END AS value"""


def as_text(rows):
    return rows.withColumns({"user_key": F.col("user_key").cast("string"), "value": F.col("value").cast("string")})


@register("log_replay", f"{LOGGED}, false AS torn FROM events")
def _(spark, folder):
    return as_text(decode_logs(event_logs(spark, folder)))


@register("log_torn_tail", f"SELECT * FROM ({LOGGED}, true AS torn, event_id FROM events) QUALIFY base_seq < max(base_seq) OVER (PARTITION BY path)")
def _(spark, folder):
    """Every log loses its last five bytes: the record they are of is gone as a whole, the others are there."""
    cut = F.substring("content", F.lit(1), F.length("content") - 5)
    return as_text(decode_logs(event_logs(spark, folder).select("path", cut.alias("content")))).withColumn("event_id", F.col("seq") - 1)


# Binary tables: one for each of eight classes of users


def event_tables(spark, folder):
    log = event_log(spark, folder)
    path = F.format_string("%06d.sst", F.col("user_key") % 8)
    key = F.format_string("user%016d", F.col("user_key")).cast("binary")
    return encode_tables(log.select(path.alias("path"), key.alias("user_key"), "seq", "vtype", F.when(F.col("vtype") == 1, (F.col("seq") - 1).cast("string").cast("binary")).alias("value")), 512, 4)


@register("table_entries", f"WITH {EVENTS} SELECT printf('%06d.sst', user_key % 8) AS path, printf('user%016d', user_key) AS user_key, seq, vtype, CASE WHEN vtype = 1 THEN (seq - 1)::VARCHAR END AS value FROM ev")
def _(spark, folder):
    return as_text(decode_tables(event_tables(spark, folder)))


@register(
    "table_get",
    f"""WITH {EVENTS}, asked AS (SELECT DISTINCT user_id, m AS upto FROM events, (VALUES (500), (1000000)) v(m)),
    best AS (SELECT user_id, upto, arg_max(vtype, seq) AS vtype, max(seq) AS seq FROM asked LEFT JOIN ev ON user_key = user_id AND seq <= upto GROUP BY ALL)
    SELECT user_id, upto, vtype, CASE WHEN vtype = 1 THEN (seq - 1)::VARCHAR END AS value FROM best
    UNION ALL SELECT 1000000 + c_custkey, 500, NULL, NULL FROM customer WHERE c_custkey < 8""",
)
def _(spark, folder):
    """Every user's newest entry at two sequences, and some users that no table has."""
    users = read(spark, folder, "events").select("user_id").distinct().withColumn("at", F.explode(F.array(F.lit(500), F.lit(1000000)).cast("array<bigint>")))
    absent = read(spark, folder, "customer").where("c_custkey < 8").select((F.col("c_custkey") + 1000000).alias("user_id"), F.lit(500).cast("long").alias("at"))
    asked = users.unionByName(absent).select(F.format_string("%06d.sst", F.col("user_id") % 8).alias("path"), F.format_string("user%016d", F.col("user_id")).cast("binary").alias("user_key"), "at")
    found = get_from_tables(event_tables(spark, folder), asked)
    return found.select(F.substring(F.col("user_key").cast("string"), 5, 16).cast("long").alias("user_id"), F.col("at").alias("upto"), "vtype", F.col("value").cast("string").alias("value"))


@register("internal_key_parts", f"WITH {EVENTS} SELECT 'user' || user_key AS user_key, seq, vtype FROM ev")
def _(spark, folder):
    key = F.concat(F.lit("user"), F.col("user_key").cast("string"))
    names = event_log(spark, folder).select(columns.internal_key(key, F.col("seq"), F.col("vtype")).alias("name"))
    user_key, seq, vtype = columns.split_internal_key(F.col("name"))
    return names.select(user_key.cast("string").alias("user_key"), seq.alias("seq"), vtype.alias("vtype"))


@register("newest_orders", "SELECT o_custkey AS user_key, max(o_orderkey) + 1 AS seq, arg_max(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS vtype, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def _(spark, folder):
    return newest(order_log(spark, folder))


# Workloads: operations follow from the events' numbers

KEYS = 500


def operations(spark, folder, name):
    op = workloads.pick(workloads.SPECS[name], F.col("event_id") % 100 / 100)
    rows = read(spark, folder, "events").select(F.col("event_id").alias("op_no"), op.alias("op"), (F.col("event_id") * 7919 % KEYS).alias("key_no"))
    return workloads.numbered_keys(rows, KEYS, workloads.SPECS[name].latest)


def operations_sql(name: str) -> str:
    below, cases = 0, []
    for op, share in workloads.SPECS[name].shares:
        below += round(share * 100)
        cases.append(f"WHEN event_id % 100 < {below} THEN '{op}'")
    key = "greatest(newest - drawn, 0)" if workloads.SPECS[name].latest else "drawn"
    return f"""picked AS (SELECT event_id AS op_no, CASE {' '.join(cases)} END AS op, event_id * 7919 % {KEYS} AS drawn FROM events),
    counted AS (SELECT *, {KEYS - 1} + coalesce(count(*) FILTER (op = 'insert') OVER (ORDER BY op_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newest FROM picked),
    o AS (SELECT op_no, op, CASE WHEN op = 'insert' THEN newest + 1 ELSE {key} END AS key_no, newest FROM counted),
    v AS (SELECT printf('user%016d', i) AS k, i + 1 AS seq, rpad('v' || i || ':', 100, 'x') AS value FROM range({KEYS}) t(i)
          UNION ALL SELECT printf('user%016d', key_no), op_no + {KEYS + 1}, rpad('v' || op_no || ':', 100, 'x') FROM o WHERE op IN ('update', 'insert', 'rmw'))"""


def register_reads(name: str) -> None:
    sql = f"""WITH {operations_sql(name)}, r AS (SELECT op_no, op, printf('user%016d', key_no) AS key, op_no + {KEYS} AS at FROM o WHERE op IN ('read', 'rmw'))
    SELECT op_no, op, key, r.at, v.seq AS version, v.value FROM r ASOF LEFT JOIN v ON r.key = v.k AND r.at >= v.seq"""

    @register(f"workload_{name.lower()}_reads", sql)
    def _(spark, folder):
        return workloads.answers(operations(spark, folder, name), KEYS)


for _name in "BCDF":
    register_reads(_name)


@register(
    "workload_e_scans",
    f"""WITH {operations_sql('E')}, r AS (SELECT op_no, printf('user%016d', unnest(range(key_no, least(key_no + {workloads.SCAN_ROWS - 1}, newest) + 1))) AS key, op_no + {KEYS} AS at FROM o WHERE op = 'scan')
    SELECT op_no, key, v.seq AS version, v.value FROM r ASOF LEFT JOIN v ON r.key = v.k AND r.at >= v.seq""",
)
def _(spark, folder):
    return workloads.scans(operations(spark, folder, "E"), KEYS)


@register("workload_d_operations", f"WITH {operations_sql('D')} SELECT * FROM o")
def _(spark, folder):
    return operations(spark, folder, "D")


ZIPF_KEYS = 1000


@register(
    "zipf_ranks",
    f"""WITH z AS (SELECT sum(pow(i::DOUBLE, -{workloads.THETA}::DOUBLE)) AS zeta, 1 + pow(0.5::DOUBLE, {workloads.THETA}::DOUBLE) AS two FROM range(1, {ZIPF_KEYS + 1}) t(i)),
    e AS (SELECT *, (1 - pow(2.0::DOUBLE / {ZIPF_KEYS}, 1 - {workloads.THETA}::DOUBLE)) / (1 - two / zeta) AS eta FROM z),
    u AS (SELECT event_id, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS u FROM events)
    SELECT event_id, (CASE WHEN u * zeta < 1 THEN 0 WHEN u * zeta < two THEN 1 ELSE least(floor({ZIPF_KEYS} * pow(eta * u - eta + 1, 1 / (1 - {workloads.THETA}::DOUBLE))), {ZIPF_KEYS - 1}) END)::BIGINT AS rank FROM u, e""",
)
def _(spark, folder):
    u = F.col("event_id") * 7919 % 10007 / F.lit(10007.0)
    return read(spark, folder, "events").select("event_id", workloads.zipf(u, ZIPF_KEYS, workloads.zeta(spark, ZIPF_KEYS)).alias("rank"))


@register("workload_load", "SELECT i AS ordinal, printf('user%016d', i) AS user_key, 1 AS vtype, rpad('v' || i || ':', 100, 'x') AS value FROM range(1000) t(i)")
def _(spark, folder):
    return workloads.load(spark, 1000)


# A store's life


@register("store_reopened", f"WITH {EVENTS}, {live_sql()} {STORED}")
def _(spark, folder):
    """One part flushed, one published but not flushed, one left to the end: all there when opened again."""
    store = new_store(spark)
    first, second, third = layers(event_changes(spark, folder))[::-1]
    apply_ordered(store, first, "seq")
    store.flush()
    apply_ordered(store, second, "seq")
    apply_ordered(store, third, "seq")
    store.close()
    return read_back(Store.open(spark, store.folder.path, Options(create_if_missing=False)).df())


@register("store_multi_get", f"WITH {EVENTS}, {live_sql()} SELECT printf('user%016d', user_key) AS user_key, seq - 1 AS event_id FROM live WHERE user_key % 7 = 3 AND user_key < 100")
def _(spark, folder):
    store = new_store(spark)
    apply_ordered(store, event_changes(spark, folder), "seq")
    found = store.multi_get([f"user{k:016d}" for k in range(3, 100, 7)])
    return spark.createDataFrame([(k.decode(), int(v)) for k, v in found.items()], "user_key string, event_id long")


@register(
    "store_stats",
    f"""WITH {EVENTS}, {live_sql()}
    SELECT count(*) AS writes, 2::BIGINT AS flushes, 1::BIGINT AS compactions, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_key, seq <= 500 FROM ev)) AS flush_versions_dropped,
           (SELECT count(*) FROM live) AS scan_entries_returned, 0::BIGINT AS scan_entries_skipped, max(seq)::BIGINT AS last_sequence FROM ev""",
)
def _(spark, folder):
    """Two flushes and a compaction, then a scan that steps over nothing."""
    store, changes = new_store(spark), event_changes(spark, folder)
    for part in (changes.where("seq <= 500"), changes.where("seq > 500")):
        apply_ordered(store, part, "seq")
        store.flush()
    store.maintain()
    for _row in store.iterate():
        pass
    return store.stats().select("writes", "flushes", "compactions", "flush_versions_dropped", "scan_entries_returned", "scan_entries_skipped", "last_sequence")


@register("store_scan_skips", f"WITH {EVENTS}, {live_sql()} SELECT (SELECT count(*) FROM live) AS scan_entries_returned, count(*) - (SELECT count(*) FROM live) AS scan_entries_skipped FROM ev")
def _(spark, folder):
    """A scan of a log that was never collapsed steps over every other entry."""
    store = new_store(spark)
    apply_ordered(store, event_changes(spark, folder), "seq")
    for _row in store.iterate():
        pass
    return store.stats().select("scan_entries_returned", "scan_entries_skipped")


@register("store_files", f"WITH {EVENTS} SELECT 1 AS level, count(DISTINCT user_key) FILTER (live) AS rows, 0::BIGINT AS overlaps FROM (SELECT user_key, arg_max(vtype, seq) = 1 AS live FROM ev GROUP BY 1)")
def _(spark, folder):
    """After compaction one level holds just the live rows, in files that don't overlap."""
    store, changes = new_store(spark), event_changes(spark, folder)
    for part in (changes.where("seq <= 500"), changes.where("seq > 500")):
        apply_ordered(store, part, "seq")
        store.flush()
    store.compact_all()
    files = store.files()
    pairs = files.alias("a").join(files.alias("b"), F.expr("a.level = b.level AND a.number < b.number AND a.smallest <= b.largest AND a.largest >= b.smallest"))
    return files.groupBy("level").agg(F.sum("rows").alias("rows")).withColumn("overlaps", F.lit(pairs.count()).cast("long"))


@register("store_batches", "SELECT printf('user%016d', s_suppkey % 20) AS user_key, max(s_suppkey) AS event_id FROM supplier GROUP BY 1 HAVING max(s_suppkey) % 3 <> 0")
def _(spark, folder):
    """Batches of puts and deletes, some pending when read."""
    store = Store.open(spark, new_store(spark).folder.path, Options(sync_policy=NEVER, background_compaction=False))
    numbers = sorted(r[0] for r in read(spark, folder, "supplier").select("s_suppkey").collect())  # some suppliers, as a caller would write them
    batches = [WriteBatch() for _ in range(0, len(numbers), 7)]
    for k, n in enumerate(numbers):
        key = f"user{n % 20:016d}"
        batches[k // 7].put(key, str(n)) if n % 3 else batches[k // 7].delete(key)
    store.write_all(batches[: len(batches) // 2])
    store.sync()
    store.write_all(batches[len(batches) // 2 :])
    return read_back(store.df())


@register("store_entries", f"WITH {EVENTS} SELECT printf('user%016d', user_key) AS user_key, seq, vtype, CASE WHEN vtype = 1 THEN (seq - 1)::VARCHAR END AS value FROM ev")
def _(spark, folder):
    """All entries of a store that nothing was flushed in yet."""
    store = new_store(spark)
    apply_ordered(store, event_changes(spark, folder), "seq")
    return as_text(store.log()).select("user_key", "seq", "vtype", "value")


@register("store_seek_page", f"WITH {EVENTS}, {live_sql()}, s AS ({STORED}) SELECT * FROM s WHERE user_key >= 'user0000000000000040' ORDER BY user_key LIMIT 15")
def _(spark, folder):
    """A page of a compacted store with a tail: read up to the key that the manifest shows to be far enough."""
    store, changes = new_store(spark), event_changes(spark, folder)
    apply_ordered(store, changes.where("seq <= 8000"), "seq")
    store.flush()
    store.compact_level(0)
    apply_ordered(store, changes.where("seq > 8000"), "seq")
    return read_back(store.scan("user0000000000000040", 15))


@register("store_settled_read", f"WITH {EVENTS}, {live_sql()} {STORED}")
def _(spark, folder):
    """A compacted store, whose files hold each key once, read without an aggregation."""
    store = new_store(spark)
    apply_ordered(store, event_changes(spark, folder), "seq")
    store.flush()
    store.compact_level(0)
    return read_back(store.df())
