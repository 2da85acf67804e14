"""Registered queries on change logs over the driver's tables, with DuckDB SQL for the same rows.

``EVENTS`` below is the log of users' events: the key is the user, the sequence the event's number
plus one, an error event deletes. ``ORDERS`` is that of customers' orders.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerkv import workloads
from layerkv.functions import columns
from layerkv.operators import amplification, layout, lookups, versions
from layerkv.plans.options import Options
from layerkv.plans.store import Store
from layerkv.sources.change_logs import event_log, order_log, read
from layerkv.streaming.ingest import apply_ordered, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS = "ev AS (SELECT user_id AS user_key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vtype, value FROM events)"
ORDERS = "od AS (SELECT o_custkey AS user_key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS vtype, o_totalprice AS value FROM orders)"
LIVE = "live AS (SELECT * FROM (SELECT * FROM {0} WHERE {1} QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1) WHERE vtype = 1)"


def live_sql(log: str = "ev", visible: str = "true") -> str:
    return LIVE.format(log, visible)


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Versions and snapshots


@register("live_scan", f"WITH {EVENTS}, {live_sql()} SELECT user_key, seq, value FROM live")
def _(spark, folder):
    return versions.live(event_log(spark, folder)).select("user_key", "seq", "value").orderBy("user_key")


@register("live_scan_orders", f"WITH {ORDERS}, {live_sql('od')} SELECT user_key, seq, value FROM live")
def _(spark, folder):
    return versions.live(order_log(spark, folder)).select("user_key", "seq", "value")


@register("snapshot_scan", f"WITH {EVENTS}, {live_sql('ev', 'seq <= 501')} SELECT user_key, seq, value FROM live")
def _(spark, folder):
    return versions.live(event_log(spark, folder), 501).select("user_key", "seq", "value")


@register("newest_versions", f"WITH {EVENTS} SELECT user_key, seq, vtype FROM ev QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1")
def _(spark, folder):
    return versions.newest(event_log(spark, folder)).select("user_key", "seq", "vtype")


@register("smallest_snapshot", f"WITH {EVENTS} SELECT least(max(seq), 700, 5000)::BIGINT AS smallest_snapshot FROM ev")
def _(spark, folder):
    pinned = spark.range(1).select(F.explode(F.array(F.lit(700).cast("long"), F.lit(5000).cast("long"))).alias("seq"))
    return versions.smallest_snapshot(event_log(spark, folder), pinned)


COLLAPSE = EVENTS + ", n AS (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM ev), kept AS (SELECT user_key, seq, vtype, value FROM n WHERE newer IS NULL OR newer > {0})"


@register("flush_collapse", f"WITH {COLLAPSE.format(1 << 40)} SELECT * FROM kept")
def _(spark, folder):
    return versions.collapse(event_log(spark, folder), 1 << 40)


@register("flush_collapse_pinned", f"WITH {COLLAPSE.format(5000)} SELECT * FROM kept")
def _(spark, folder):
    return versions.collapse(event_log(spark, folder), 5000)


@register("compact_bottom", f"WITH {COLLAPSE.format(1 << 40)} SELECT * FROM kept WHERE vtype = 1 OR seq > {1 << 40}")
def _(spark, folder):
    return versions.compact(event_log(spark, folder), 1 << 40, bottom_most=True)


@register("compact_not_bottom", f"WITH {COLLAPSE.format(1 << 40)} SELECT * FROM kept")
def _(spark, folder):
    return versions.compact(event_log(spark, folder), 1 << 40, bottom_most=False)


@register("compact_pinned", f"WITH {COLLAPSE.format(5000)} SELECT * FROM kept WHERE vtype = 1 OR seq > 5000")
def _(spark, folder):
    return versions.compact(event_log(spark, folder), 5000, bottom_most=True)


@register("versions_dropped", f"WITH {COLLAPSE.format(5000)} SELECT (SELECT count(*) FROM ev) - (SELECT count(*) FROM kept) AS dropped")
def _(spark, folder):
    newer = versions.with_newer(event_log(spark, folder))
    return newer.agg(F.count(F.when(F.col("newer") <= 5000, 1)).alias("dropped"))


LAYERS = ((0, 3000), (3000, 7000), (7000, 1 << 40))


def layers(log: DataFrame) -> list[DataFrame]:
    """The log cut by sequence, newest layer first."""
    return [log.where((F.col("seq") > a) & (F.col("seq") <= b)) for a, b in reversed(LAYERS)]


@register("merge_union_ordered", f"WITH {EVENTS} SELECT user_key, seq, vtype, CASE WHEN seq > 7000 THEN 0 WHEN seq > 3000 THEN 1 ELSE 2 END AS source_rank FROM ev")
def _(spark, folder):
    return versions.in_order(versions.merge(layers(event_log(spark, folder)))).select("user_key", "seq", "vtype", "source_rank")


@register("layered_read", f"WITH {EVENTS}, {live_sql()} SELECT user_key, seq, value FROM live")
def _(spark, folder):
    return versions.live(versions.merge(layers(event_log(spark, folder)))).select("user_key", "seq", "value")


@register("layered_compacted_read", f"WITH {EVENTS}, {live_sql()} SELECT user_key, seq, value FROM live")
def _(spark, folder):
    new, *old = layers(event_log(spark, folder))
    merged = versions.compact(versions.merge(old).drop("source_rank"), 1 << 40, bottom_most=True)
    return versions.live(versions.merge([new, merged])).select("user_key", "seq", "value")


@register("batch_last_write_wins", f"WITH {EVENTS}, b AS (SELECT seq // 25 AS batch_id, * FROM ev) SELECT batch_id, user_key, seq, vtype FROM b QUALIFY row_number() OVER (PARTITION BY batch_id, user_key ORDER BY seq DESC) = 1")
def _(spark, folder):
    log = event_log(spark, folder).withColumn("batch_id", F.floor(F.col("seq") / 25))
    best = log.groupBy("batch_id", "user_key").agg(F.max_by(F.struct("seq", "vtype"), "seq").alias("r"))
    return best.select("batch_id", "user_key", "r.seq", "r.vtype")


@register("batch_sequences", "SELECT l_shipdate::DATE AS batch_id, l_orderkey, l_linenumber, (999 + row_number() OVER (ORDER BY l_shipdate::DATE, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice))::BIGINT AS seq FROM lineitem")
def _(spark, folder):
    rows = read(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("batch_id"), "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ordinal"))
    return versions.batch_sequences(rows, 1000).drop("ordinal")


# Lookups and scans


@register("point_get", f"WITH {EVENTS}, {live_sql()} SELECT user_key, seq, value FROM live WHERE user_key = 7")
def _(spark, folder):
    return lookups.get(event_log(spark, folder), 7).select("user_key", "seq", "value")


@register("point_get_tombstoned", f"WITH {EVENTS}, {live_sql()}, dead AS (SELECT min(user_key) AS k FROM ev WHERE user_key NOT IN (SELECT user_key FROM live)) SELECT user_key, seq, value FROM live WHERE user_key = (SELECT k FROM dead)")
def _(spark, folder):
    log = event_log(spark, folder)
    dead = versions.newest(log).where("vtype = 0").agg(F.min("user_key")).first()[0]
    return lookups.get(log, dead).select("user_key", "seq", "value")


@register("point_get_absent", f"WITH {EVENTS}, {live_sql()} SELECT user_key, seq, value FROM live WHERE user_key = -1")
def _(spark, folder):
    return lookups.get(event_log(spark, folder), -1).select("user_key", "seq", "value")


@register("layered_point_get", f"WITH {EVENTS}, {live_sql()} SELECT user_key, seq, value FROM live WHERE user_key = 11")
def _(spark, folder):
    return lookups.layered_get(layers(event_log(spark, folder)), 11).select("user_key", "seq", "value")


@register("multi_get", f"WITH {EVENTS}, {live_sql()}, asked AS (SELECT DISTINCT c_custkey AS user_key FROM customer) SELECT user_key, live.value IS NOT NULL AS found, live.value FROM asked LEFT JOIN live USING (user_key)")
def _(spark, folder):
    asked = read(spark, folder, "customer").select(F.col("c_custkey").alias("user_key"))
    return lookups.multi_get(event_log(spark, folder), asked)


@register("seek_scan_limit", f"WITH {ORDERS}, {live_sql('od')} SELECT user_key, seq, value FROM live WHERE user_key >= 100 ORDER BY user_key LIMIT 50")
def _(spark, folder):
    return lookups.seek(order_log(spark, folder), 100, 50).select("user_key", "seq", "value")


@register("seek_scan", f"WITH {ORDERS}, {live_sql('od')} SELECT user_key, seq, value FROM live WHERE user_key >= 100")
def _(spark, folder):
    return lookups.seek(order_log(spark, folder), 100).select("user_key", "seq", "value")


@register("keyset_page", f"WITH {ORDERS}, {live_sql('od')} SELECT user_key, seq, value FROM live WHERE user_key > 60 ORDER BY user_key LIMIT 20")
def _(spark, folder):
    return lookups.page_after(order_log(spark, folder), 60, 20).select("user_key", "seq", "value")


@register(
    "asof_lookup",
    f"""WITH {EVENTS}, p AS (SELECT o_orderkey, o_custkey, o_orderkey % 10000 AS at FROM orders)
    SELECT o_orderkey, o_custkey, p.at, ev.seq AS version, CASE WHEN ev.vtype = 1 THEN ev.value END AS value
    FROM p ASOF LEFT JOIN ev ON p.o_custkey = ev.user_key AND p.at >= ev.seq""",
)
def _(spark, folder):
    probes = read(spark, folder, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 10000).alias("at"))
    return lookups.as_of(probes, event_log(spark, folder), "o_custkey", "at")


# Layout

#: Files over the parts table: every hundred keys a file, odd ones one level down with a wider range.
FILES = """files AS (
  SELECT (p_partkey // 100 % 7)::INTEGER AS level, p_partkey // 100 AS number, sum(p_size * 1000)::BIGINT AS file_size,
         min(p_partkey) AS smallest, max(p_partkey) + 150 * (p_partkey // 100 % 2) AS largest
  FROM part GROUP BY p_partkey // 100)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    number = F.floor(F.col("p_partkey") / 100)
    rows = read(spark, folder, "part").groupBy(number.alias("number")).agg(F.sum(F.col("p_size") * 1000).cast("long").alias("file_size"), F.min("p_partkey").alias("smallest"), F.max("p_partkey").alias("_last"))
    return rows.select((F.col("number") % 7).cast("int").alias("level"), "number", "file_size", "smallest", (F.col("_last") + 150 * (F.col("number") % 2)).alias("largest"))


@register("range_overlap", f"WITH {FILES} SELECT a.number AS input, b.number FROM files a JOIN files b ON b.largest >= a.smallest AND b.smallest <= a.largest WHERE a.level = 0 AND b.level = 1")
def _(spark, folder):
    found = files(spark, folder)
    return layout.range_join(found.where("level = 0"), found.where("level = 1"))


@register("file_holds_key", f"WITH {FILES} SELECT level, number FROM files WHERE smallest <= 150 AND largest >= 150")
def _(spark, folder):
    return layout.overlapping(files(spark, folder), F.lit(150), F.lit(150)).select("level", "number")


@register("compaction_range", f"WITH {FILES} SELECT level, min(smallest) AS low, max(largest) AS high, sum(file_size)::BIGINT AS input_bytes FROM files GROUP BY level")
def _(spark, folder):
    return files(spark, folder).groupBy("level").agg(F.min("smallest").alias("low"), F.max("largest").alias("high"), F.sum("file_size").alias("input_bytes"))


@register("level_summary", f"WITH {FILES} SELECT level, count(*) AS files, sum(file_size)::BIGINT // 1024 AS kib, 'L' || level || ': ' || count(*) || ' files, ' || (sum(file_size)::BIGINT // 1024) || ' KiB' AS summary FROM files GROUP BY level")
def _(spark, folder):
    return layout.level_summary(files(spark, folder))


@register(
    "level_budget_score",
    f"""WITH {FILES}, t AS (SELECT level, sum(file_size)::BIGINT AS bytes, count(*) AS n FROM files WHERE level < 6 GROUP BY level),
    b AS (SELECT *, 100000 * pow(10, greatest(level - 1, 0))::BIGINT AS budget FROM t)
    SELECT level, CASE WHEN level = 0 THEN n / 4::DOUBLE ELSE bytes / budget::DOUBLE END AS score, CASE WHEN level = 0 THEN n >= 4 ELSE bytes > budget END AS due FROM b""",
)
def _(spark, folder):
    return layout.compaction_scores(files(spark, folder), 4, 100_000)


@register("obsolete_files", f"WITH {FILES} SELECT number FROM files WHERE number NOT IN (SELECT number FROM files WHERE level IN (1, 3))")
def _(spark, folder):
    found = files(spark, folder)
    return layout.obsolete(found.select("number"), found.where("level IN (1, 3)"))


@register("files_newest_first", f"WITH {FILES} SELECT level, number, (row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = 0 THEN -number ELSE smallest END))::INTEGER AS place FROM files")
def _(spark, folder):
    order = F.when(F.col("level") == 0, -F.col("number")).otherwise(F.col("smallest"))
    return files(spark, folder).select("level", "number", F.row_number().over(Window.partitionBy("level").orderBy(order)).alias("place"))


# Amplification


@register("scan_amplification", f"WITH {EVENTS}, {live_sql()} SELECT (SELECT count(*) FROM live) AS returned, (SELECT count(*) FROM ev) AS skipped, (SELECT count(*) FROM ev) / (SELECT count(*) FROM live)::DOUBLE AS skipped_per_row")
def _(spark, folder):
    return amplification.scan_amplification(event_log(spark, folder))


@register(
    "write_amplification",
    f"""WITH {COLLAPSE.format(1 << 40)}, b AS (SELECT seq // 25 AS batch_id, count(*) AS n, count(*) * 16 AS user_bytes FROM ev GROUP BY 1),
    s AS (SELECT sum(user_bytes) AS user_bytes, sum(user_bytes + 20 + 5 * n) AS log_bytes FROM b)
    SELECT log_bytes::BIGINT AS log_bytes, user_bytes::BIGINT AS user_bytes, (log_bytes + 16 * (SELECT count(*) FROM kept)) / user_bytes::DOUBLE AS amplification FROM s""",
)
def _(spark, folder):
    log = event_log(spark, folder)
    batches = log.groupBy(F.floor(F.col("seq") / 25).alias("batch_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("user_bytes", F.col("n") * 16)
    sums = batches.agg(F.sum("user_bytes").alias("user_bytes"), F.sum(amplification.log_bytes(F.col("user_bytes"), F.col("n"))).alias("log_bytes"), F.lit(0).alias("flushed"))
    flushed = versions.collapse(log, 1 << 40).agg(F.lit(0).alias("user_bytes"), F.lit(0).alias("log_bytes"), (F.count(F.lit(1)) * 16).alias("flushed"))
    row = sums.unionByName(flushed).agg(*[F.sum(c).alias(c) for c in ("user_bytes", "log_bytes", "flushed")])
    return row.select("log_bytes", "user_bytes", amplification.write_amplification(F.col("log_bytes"), F.col("flushed"), F.lit(0), F.col("user_bytes")).alias("amplification"))


@register("cache_hit_rate", "SELECT event_type, count(*) FILTER (value < 50) AS hits, count(*) FILTER (value >= 50) AS misses, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (value < 50) / count(*)::DOUBLE END AS rate FROM events WHERE value IS NOT NULL GROUP BY event_type")
def _(spark, folder):
    rows = read(spark, folder, "events").where("value IS NOT NULL").groupBy("event_type").agg(F.count(F.when(F.col("value") < 50, 1)).alias("hits"), F.count(F.when(F.col("value") >= 50, 1)).alias("misses"))
    return rows.withColumn("rate", amplification.cache_hit_rate(F.col("hits"), F.col("misses")))


@register(
    "latency_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS k FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(CASE WHEN n = least(floor(0.5::DOUBLE * k), k - 1) + 1 THEN value END) AS p50, max(CASE WHEN n = least(floor(0.95::DOUBLE * k), k - 1) + 1 THEN value END) AS p95,
           max(CASE WHEN n = least(floor(0.99::DOUBLE * k), k - 1) + 1 THEN value END) AS p99, max(CASE WHEN n = least(floor(0.999::DOUBLE * k), k - 1) + 1 THEN value END) AS p999, max(value) AS max
    FROM r GROUP BY event_type""",
)
def _(spark, folder):
    samples = read(spark, folder, "events").where("value IS NOT NULL")
    return amplification.percentiles(samples, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}, "event_type")


# Scalar functions


@register("varint_length", "SELECT event_id, 1 + (n >= 128)::INT + (n >= 16384)::INT + (n >= 2097152)::INT + (n >= 268435456)::INT AS bytes FROM (SELECT event_id, event_id * event_id AS n FROM events)")
def _(spark, folder):
    return read(spark, folder, "events").select("event_id", columns.varint_length(F.col("event_id") * F.col("event_id")).alias("bytes"))


@register(
    "prefix_shared_length",
    """WITH a AS (SELECT c_custkey, c_name AS a, lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer)
    SELECT c_custkey, (SELECT count(*) FROM range(1, least(length(a), length(b)) + 1) t(i) WHERE a[1:i] = b[1:i])::INTEGER AS shared FROM a WHERE b IS NOT NULL""",
)
def _(spark, folder):
    rows = read(spark, folder, "customer").withColumn("_before", F.lag("c_name").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    return rows.where("_before IS NOT NULL").select("c_custkey", columns.shared_prefix_length(F.col("c_name"), F.col("_before")).alias("shared"))


@register("probe_count", "SELECT p_partkey, greatest(1, least(30, floor(p_size * 0.69314718056::DOUBLE)))::INTEGER AS probes FROM part")
def _(spark, folder):
    return read(spark, folder, "part").select("p_partkey", columns.probes(F.col("p_size")).alias("probes"))


_BYTES = "list_transform(range(length(k)), lambda i: ascii(k[i + 1]))"
_MULTIPLIER, _SEED, _WORD = columns.HASH_MULTIPLIER, columns.HASH_SEED, columns.WORD
HASHES = f"""
b AS (SELECT id, k, length(k) AS n, {_BYTES} AS x FROM keys),
w AS (SELECT *, list_transform(range(n // 4), lambda i: x[4*i+1] + x[4*i+2] * 256 + x[4*i+3] * 65536 + x[4*i+4] * 16777216::BIGINT) AS words,
      xor({_SEED}, (n * {_MULTIPLIER}::HUGEINT % {_WORD})::BIGINT) AS start FROM b),
h AS (SELECT *, list_reduce(list_prepend(start, words), lambda a, c: xor(((a + c) % {_WORD} * {_MULTIPLIER}::HUGEINT % {_WORD})::BIGINT, ((a + c) % {_WORD} * {_MULTIPLIER}::HUGEINT % {_WORD})::BIGINT >> 16)) AS whole FROM w),
t AS (SELECT *, n % 4 AS rest, (whole + CASE WHEN n % 4 > 0 THEN x[n - n % 4 + 1] ELSE 0 END + CASE WHEN n % 4 > 1 THEN x[n - n % 4 + 2] * 256 ELSE 0 END + CASE WHEN n % 4 > 2 THEN x[n - n % 4 + 3] * 65536 ELSE 0 END) % {_WORD} AS s FROM h),
hashes AS (SELECT id, k, CASE WHEN rest = 0 THEN whole ELSE xor((s * {_MULTIPLIER}::HUGEINT % {_WORD})::BIGINT, (s * {_MULTIPLIER}::HUGEINT % {_WORD})::BIGINT >> 24) END AS hash FROM t)"""


@register("bloom_hash", f"WITH keys AS (SELECT c_custkey AS id, 'user' || c_custkey AS k FROM customer), {HASHES} SELECT id AS c_custkey, hash FROM hashes")
def _(spark, folder):
    key = F.concat(F.lit("user"), F.col("c_custkey").cast("string")).cast("binary")
    return read(spark, folder, "customer").select("c_custkey", columns.filter_hash(key).alias("hash"))


PROBES, BITS_PER_KEY = 6, 10


@register(
    "bloom_membership",
    f"""WITH keys AS (SELECT c_custkey AS id, 'user' || c_custkey AS k FROM customer), {HASHES},
    m AS (SELECT count(*) FILTER (id % 2 = 0) * {BITS_PER_KEY} AS raw FROM hashes), bits AS (SELECT ((greatest(raw, 64) + 7) // 8 * 8)::BIGINT AS bits FROM m),
    p AS (SELECT id, unnest(range({PROBES})) AS i, hash, (hash >> 17) + ((hash % 131072) << 15) AS delta FROM hashes),
    places AS (SELECT id, (hash + i * delta) % {_WORD} % bits AS place FROM p, bits),
    filter_bits AS (SELECT DISTINCT place FROM places WHERE id % 2 = 0)
    SELECT places.id AS c_custkey, count(f.place) = count(*) AS may_contain FROM places LEFT JOIN filter_bits f ON places.place = f.place GROUP BY places.id""",
)
def _(spark, folder):
    """Even customers make the filter, all ask it; the filter is a set of bits that is joined, not sent."""
    key = F.concat(F.lit("user"), F.col("c_custkey").cast("string")).cast("binary")
    hashed = read(spark, folder, "customer").select("c_custkey", columns.filter_hash(key).alias("hash"))
    keys = read(spark, folder, "customer").where("c_custkey % 2 = 0").agg(F.count(F.lit(1)).alias("n"))
    bits = keys.select(F.floor((F.greatest(F.col("n") * BITS_PER_KEY, F.lit(64)) + 7) / 8) * 8).scalar()  # a subquery of the same job
    places = hashed.withColumn("bits", bits).select("c_custkey", F.explode(columns.probe_positions(F.col("hash"), F.col("bits"), F.lit(PROBES))).alias("place"))
    made = places.where("c_custkey % 2 = 0").select("place").distinct().withColumn("_set", F.lit(1))
    asked = places.join(made, "place", "left").groupBy("c_custkey").agg((F.count("_set") == F.count(F.lit(1))).alias("may_contain"))
    return asked


CRC_STEP = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {columns.CRC32C_POLYNOMIAL}) ELSE c >> 1 END"


@register(
    "crc32c",
    f"""WITH steps AS (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: {CRC_STEP}) AS c FROM (SELECT unnest(range(256)) AS n)), t AS (SELECT list(c ORDER BY n) AS t FROM steps)
    SELECT c_custkey, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(c_name)), lambda i: ascii(c_name[i + 1])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS crc
    FROM customer, t""",
)
def _(spark, folder):
    return read(spark, folder, "customer").select("c_custkey", columns.crc32c(F.col("c_name").cast("binary")).alias("crc"))


@register(
    "internal_keys",
    f"""WITH {EVENTS}, d AS (SELECT user_key, seq, printf('%014X%02X', seq, vtype) AS d FROM ev)
    SELECT seq, hex('user' || user_key) || d[15:16] || d[13:14] || d[11:12] || d[9:10] || d[7:8] || d[5:6] || d[3:4] || d[1:2] AS name FROM d""",
)
def _(spark, folder):
    key = F.concat(F.lit("user"), F.col("user_key").cast("string"))
    return event_log(spark, folder).select("seq", F.hex(columns.internal_key(key, F.col("seq"), F.col("vtype"))).alias("name"))


# Workloads


@register(
    "workload_mix",
    """WITH o AS (SELECT event_id AS op_no, CASE WHEN event_id % 100 < 50 THEN 'read' ELSE 'update' END AS op, event_id * 7919 % 500 AS key_no FROM events)
    SELECT op, count(*) AS n, count(DISTINCT key_no) AS keys FROM o GROUP BY op""",
)
def _(spark, folder):
    op = workloads.pick(workloads.SPECS["A"], F.col("event_id") % 100 / 100)
    rows = read(spark, folder, "events").select("event_id", op.alias("op"), (F.col("event_id") * 7919 % 500).alias("key_no"))
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key_no").alias("keys"))


@register(
    "workload_reads",
    """WITH o AS (SELECT event_id AS op_no, CASE WHEN event_id % 100 < 50 THEN 'read' ELSE 'update' END AS op, event_id * 7919 % 500 AS key_no FROM events),
    v AS (SELECT printf('user%016d', i) AS k, i + 1 AS seq, rpad('v' || i || ':', 100, 'x') AS value FROM range(500) t(i)
          UNION ALL SELECT printf('user%016d', key_no), op_no + 501, rpad('v' || op_no || ':', 100, 'x') FROM o WHERE op = 'update'),
    r AS (SELECT op_no, op, printf('user%016d', key_no) AS key, op_no + 500 AS at FROM o WHERE op = 'read')
    SELECT op_no, op, key, r.at, v.seq AS version, v.value FROM r ASOF LEFT JOIN v ON r.key = v.k AND r.at >= v.seq""",
)
def _(spark, folder):
    op = workloads.pick(workloads.SPECS["A"], F.col("event_id") % 100 / 100)
    ops = read(spark, folder, "events").select(F.col("event_id").alias("op_no"), op.alias("op"), (F.col("event_id") * 7919 % 500).alias("key_no"))
    return workloads.answers(ops, 500)


@register("generated_keys", "SELECT c_custkey, printf('user%016d', c_custkey) AS bench_key, rpad('v' || c_custkey || ':', 100, 'x') AS bench_value, printf('key%08d', c_custkey) AS test_key, rpad(printf('value%08d:', c_custkey), 64, '.') AS test_value FROM customer")
def _(spark, folder):
    n = F.col("c_custkey")
    return read(spark, folder, "customer").select("c_custkey", workloads.bench_key(n).alias("bench_key"), workloads.bench_value(n).alias("bench_value"), workloads.test_key(n).alias("test_key"), workloads.test_value(n).alias("test_value"))


@register("file_names", "SELECT s_suppkey, printf('%06d.sst', s_suppkey) AS name, s_suppkey AS number, 'sst' AS kind FROM supplier")
def _(spark, folder):
    name = F.format_string("%06d.sst", F.col("s_suppkey"))
    return read(spark, folder, "supplier").select("s_suppkey", name.alias("name"), F.regexp_extract(name, r"^(\d+)\.(sst|log)$", 1).cast("long").alias("number"), F.regexp_extract(name, r"^(\d+)\.(sst|log)$", 2).alias("kind"))


# Stores


def new_store(spark: SparkSession) -> Store:
    """A store of its own below the cluster's shared checkpoint folder; below one of this process where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return Store.open(spark, f"{shared or tempfile.gettempdir()}/store-{uuid.uuid4()}", Options(background_compaction=False, l0_compaction_trigger=2))


def event_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a store's changes; the value is the event's number."""
    log = event_log(spark, folder)
    return log.select(workloads.bench_key(F.col("user_key")).alias("user_key"), "vtype", (F.col("seq") - 1).cast("string").alias("value"), "seq")


def read_back(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_key").cast("string").alias("user_key"), F.col("value").cast("string").cast("long").alias("event_id"))


STORED = "SELECT printf('user%016d', user_key) AS user_key, seq - 1 AS event_id FROM live"


@register("store_compacted_read", f"WITH {EVENTS}, {live_sql()} {STORED}")
def _(spark, folder):
    """Three frames, each flushed, then compacted: reads as the log does."""
    store, changes = new_store(spark), event_changes(spark, folder)
    for part in layers(changes)[::-1]:
        apply_ordered(store, part, "seq")
        store.flush()
    store.compact_all()
    return read_back(store.df())


@register("store_snapshot_read", f"WITH {EVENTS}, {live_sql('ev', 'seq <= 3000')} {STORED}")
def _(spark, folder):
    """A snapshot after the first frame keeps what it saw through later frames and compaction."""
    store, parts = new_store(spark), layers(event_changes(spark, folder))[::-1]
    apply_ordered(store, parts[0], "seq")
    pinned = store.snapshot()
    for part in parts[1:]:
        apply_ordered(store, part, "seq")
        store.flush()
    store.compact_all()
    return read_back(store.df(pinned))


@register("store_scan_page", f"WITH {EVENTS}, {live_sql()}, s AS ({STORED}) SELECT * FROM s WHERE user_key >= 'user0000000000000050' ORDER BY user_key LIMIT 20")
def _(spark, folder):
    store = new_store(spark)
    apply_ordered(store, event_changes(spark, folder), "seq")
    store.flush()
    return read_back(store.scan("user0000000000000050", 20))


@register("stream_ingest_read", f"WITH {EVENTS}, {live_sql()} {STORED}")
def _(spark, folder):
    """The events table as a stream into a store."""
    store = new_store(spark)
    schema = read(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    changes = stream.select(workloads.bench_key(F.col("user_id")).alias("user_key"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("vtype"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    ingest(changes, store, f"events-{uuid.uuid4()}", f"{store.folder.path}/stream", "seq").awaitTermination()
    return read_back(store.df())
