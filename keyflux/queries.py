"""A query per operator over the test tables, and the DuckDB SQL that must give the same rows.

Test tables stand in for the operators' inputs: events are an operation log
(click: Clock, view: Get, other: Add), ratings and timings; embeddings, of
which components over 0.2 in size are kept, are sparse samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import clocks, kv, models, schedule, slices, stats
from .session import table
from .sources import text

RANGES = [(10, 40), (40, 70), (70, 90)]
TIDS = [0, 1, 2, 3]
START = 0.01
TAGS = {"click": "ITER", "view": "WAIT", "purchase": "PROC", "signup": "TIME", "error": "TOTL"}
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- inputs ----------------------------------------------------------------


def op_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    flag = F.when(F.col("event_type") == "click", "Clock").when(F.col("event_type") == "view", "Get").otherwise("Add")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 2).cast("int").alias("model_id"), (F.col("user_id") % 4).alias("tid"), flag.alias("flag"), F.get_json_object("props", "$.k").cast("long").alias("key"), F.col("value").alias("val"))


def adds(spark: SparkSession, sf: str) -> DataFrame:
    return op_log(spark, sf).filter("flag = 'Add'").select("seq", "key", "val")


def requests(spark: SparkSession) -> DataFrame:
    return spark.range(120).select(F.col("id").alias("key"))


def samples(spark: SparkSession, sf: str, positive: int = 1, negative: int = 0) -> DataFrame:
    e = table(spark, sf, "embeddings")
    all_ = F.transform("embedding", lambda x, i: F.struct((i + 1).cast("int").alias("idx"), x.cast("double").alias("x")))
    y = F.when(F.col("label") >= 5, positive).otherwise(negative)
    return e.select(F.col("vec_id").alias("sample_id"), y.alias("y"), F.floor(F.col("vec_id") / 4).alias("b"), (F.col("vec_id") % 4).alias("worker"), F.filter(all_, lambda s: F.abs(s["x"]) > 0.2).alias("features"))


def start_weights(spark: SparkSession) -> DataFrame:
    return spark.range(65).select(F.col("id").alias("key"), F.lit(START).alias("val"))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("pos"), F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("item"), F.round("value").cast("int").alias("rating"))


def timings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 100).cast("int").alias("iter"), (F.col("user_id") % 4).alias("tid"), F.round(F.col("value") * 1000).cast("long").alias("dur_us"), "event_type")


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


OPS = """ops AS (SELECT event_id AS seq, CAST(user_id % 2 AS INTEGER) AS model_id, user_id % 4 AS tid,
  CASE event_type WHEN 'click' THEN 'Clock' WHEN 'view' THEN 'Get' ELSE 'Add' END AS flag,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS key, value AS val FROM events)"""
STATE = OPS + ", state AS (SELECT key, arg_max(val, seq) AS val FROM ops WHERE flag = 'Add' GROUP BY key)"
CLOCKED = (
    OPS
    + ", c AS (SELECT *, "
    + ", ".join(f"CAST(sum(CASE WHEN flag = 'Clock' AND tid = {t} THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS c{t}" for t in TIDS)
    + " FROM ops), m AS (SELECT *, least(c0, c1, c2, c3) AS mn, CASE tid WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS ck FROM c), "
    + "n AS (SELECT *, lag(mn, 1, 0) OVER (ORDER BY seq) AS prev FROM m)"
)
SAMPLES = """s0 AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS idx FROM embeddings),
  s AS (SELECT vec_id, idx, x, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY vec_id ORDER BY idx) AS rn FROM s0 WHERE abs(x) > 0.2)"""
RATINGS = """r AS (SELECT event_id AS pos, user_id AS "user", CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item, CAST(round(value) AS INTEGER) AS rating FROM events),
  mu AS (SELECT (SELECT sum(rating) FROM (SELECT rating FROM r ORDER BY pos LIMIT 5000)) // (SELECT count(*) FROM r) AS mu)"""
TIMINGS = "t AS (SELECT event_id AS seq, CAST(event_id // 100 AS INTEGER) AS iter, user_id % 4 AS tid, CAST(round(value * 1000) AS BIGINT) AS dur_us, event_type FROM events)"


# --- keyed tables ------------------------------------------------------------


@query(f"WITH {STATE} SELECT key, val FROM state")
def kv_put_lww(spark, sf):
    return kv.put(adds(spark, sf))


@query(f"WITH {STATE} SELECT k.key, coalesce(val, 0) AS val FROM (SELECT unnest(range(120)) AS key) k LEFT JOIN state USING (key)")
def kv_get_default0(spark, sf):
    return kv.get(kv.put(adds(spark, sf)), requests(spark))


@query(f"WITH {STATE} SELECT DISTINCT o.key, coalesce(state.val, 0) AS val FROM ops o LEFT JOIN state USING (key) WHERE flag = 'Get' ORDER BY key")
def kv_get_sorted_dedup(spark, sf):
    return kv.get_sorted(kv.put(adds(spark, sf)), op_log(spark, sf).filter("flag = 'Get'"))


@query(f"WITH {STATE} SELECT o.seq AS pos, o.key, coalesce(state.val, 0) AS val FROM ops o LEFT JOIN state USING (key) WHERE flag = 'Get'")
def kv_server_get(spark, sf):
    return kv.server_get(kv.put(adds(spark, sf)), op_log(spark, sf).filter("flag = 'Get'").select(F.col("seq").alias("pos"), "key"))


@query(f"WITH {STATE} SELECT k.key, coalesce(val, 0) AS val FROM (SELECT unnest(range(120)) AS key) k LEFT JOIN state USING (key)")
def kv_append_last(spark, sf):
    log = kv.append(adds(spark, sf).filter("seq % 2 = 0"), adds(spark, sf).filter("seq % 2 = 1"))
    return kv.append_get(log, requests(spark))


@query(f"WITH {STATE} SELECT key, val FROM state")
def kv_upsert(spark, sf):
    a = adds(spark, sf)
    half = a.agg((F.max("seq") / 2).alias("h"))
    a = a.join(F.broadcast(half))
    return kv.upsert(kv.put(a.filter("seq <= h")), a.filter("seq > h"))


@query(f"WITH {STATE} SELECT k.key FROM (SELECT unnest(range(120)) AS key) k WHERE key NOT IN (SELECT key FROM state)")
def cache_miss_anti(spark, sf):
    return kv.missing(requests(spark), kv.put(adds(spark, sf)))


# --- slices and numbering -----------------------------------------------------


def _jump_sql(servers: int) -> str:
    return f"""WITH RECURSIVE {OPS}, k AS (SELECT DISTINCT key FROM ops), r AS (SELECT key, CAST(key AS HUGEINT) AS s, CAST(0 AS BIGINT) AS j FROM k
  UNION ALL SELECT key, s2, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(s2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT) FROM (SELECT key, j, (s * 2862933555777941757 + 1) % 18446744073709551616 AS s2 FROM r WHERE j < {servers}))
SELECT key, CAST(max(j) AS INTEGER) AS server FROM r WHERE j < {servers} GROUP BY key"""


@query(_jump_sql(3))
def slice_jch(spark, sf):
    return slices.jump_slice(op_log(spark, sf).select("key").distinct(), 3)


@query(_jump_sql(7))
def slice_jch7(spark, sf):
    return slices.jump_slice(op_log(spark, sf).select("key").distinct(), 7)


_RANGE_SQL = f"WITH {OPS} SELECT DISTINCT key, CAST(CASE WHEN key >= 10 AND key < 40 THEN 0 WHEN key >= 40 AND key < 70 THEN 1 ELSE 2 END AS INTEGER) AS server FROM ops"


@query(_RANGE_SQL)
def slice_range(spark, sf):
    return slices.range_slice(op_log(spark, sf).select("key").distinct(), RANGES)


@query(_RANGE_SQL)
def slice_range_table(spark, sf):
    ranges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(RANGES)], "server int, first long, stop long")
    return slices.range_slice_table(op_log(spark, sf).select("key").distinct(), ranges)


@query(f"WITH {STATE}, v AS (SELECT *, CASE WHEN key >= 10 AND key < 40 THEN 0 WHEN key >= 40 AND key < 70 THEN 1 ELSE 2 END AS server FROM state) SELECT CAST(server AS INTEGER) AS server, count(*) AS n, round(sum(val), 6) AS total FROM v GROUP BY server")
def slice_range_pairs(spark, sf):
    s = slices.range_slice(kv.put(adds(spark, sf)), RANGES)
    return s.groupBy("server").agg(F.count("*").alias("n"), F.round(F.sum("val"), 6).alias("total"))


@query("SELECT DISTINCT user_id AS tid, user_id // 1000 AS node FROM events")
def thread_node(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("tid")).distinct().withColumn("node", slices.node_of_thread(F.col("tid")))


def _nodes(spark, sf):
    return table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("node"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS node, CAST(r_regionkey * 1000 + i AS BIGINT) AS tid FROM region, range(3) t(i)")
def server_threads(spark, sf):
    return slices.server_threads(_nodes(spark, sf), 3).select("node", F.col("tid").cast("long"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS node, CAST(r_regionkey * 1000 + 50 AS BIGINT) AS tid FROM region")
def helper_threads(spark, sf):
    return slices.helper_threads(_nodes(spark, sf))


@query("""WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS node, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT row_number() OVER (ORDER BY node, i) - 1 AS worker_id, node, node * 1000 + 100 + i AS tid FROM n""")
def worker_alloc(spark, sf):
    spec = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("node")).agg(F.count("*").alias("num"))
    return slices.allocate_workers(spec)


# --- sources -------------------------------------------------------------------

_LINES = """l0 AS (SELECT doc_id, lang, string_split("text", chr(10)) AS p FROM documents), l1 AS (SELECT doc_id, lang, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM l0),
  l AS (SELECT doc_id, lang, unnest(p) AS line, CAST(unnest(range(len(p))) AS INTEGER) AS line_no FROM l1)"""


@query(f"WITH {_LINES} SELECT doc_id, line_no, line FROM l")
def lines_scan(spark, sf):
    return text.split_lines(table(spark, sf, "documents"), "text", ["doc_id"])


@query(f"WITH {_LINES} SELECT lang, count(*) AS n_lines FROM l GROUP BY lang")
def line_count(spark, sf):
    return text.split_lines(table(spark, sf, "documents"), "text", ["lang"]).groupBy("lang").agg(F.count("*").alias("n_lines"))


@query(f"WITH {SAMPLES} SELECT vec_id AS sample_id, y AS label, idx, round(x, 6) AS x FROM s")
def parse_libsvm(spark, sf):
    s = samples(spark, sf).select("sample_id", F.col("y").alias("label"), F.map_from_entries("features").alias("features"))
    return _rounded(text.long_samples(text.parse_libsvm(text.render_libsvm(s), sample_id="sample_id")), "x")


@query(f"""WITH {RATINGS} SELECT pos, "user", item, rating FROM r""")
def parse_ratings(spark, sf):
    r = ratings(spark, sf)
    return text.parse_ratings(r.select("pos", F.concat_ws("\t", "user", "item", "rating").alias("value")))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, replace(s_name, ':', '') AS hostname, CAST(10000 + s_suppkey AS INTEGER) AS port FROM supplier")
def parse_machinefile(spark, sf):
    s = table(spark, sf, "supplier")
    lines = s.select(F.concat_ws(":", "s_suppkey", F.regexp_replace("s_name", ":", ""), F.col("s_suppkey") + 10000).alias("value"))
    return text.parse_nodes(lines.unionByName(spark.createDataFrame([("# id:host:port",), ("",)], "value string")))


#: Beside the pages' own: URLs that lack parts, hold marks in odd places, or are none.
ODD_URLS = ["mailto:x", "http:/a/b", "http://h:12ab/p", "a1://h", "://h/x", "http://a:b:c@h/p", "HTTP://u@h:1", "http://[::1]:80/x", "http://[::1]x", "http://h?q/p?x#y#z", "http://h/p#f?x", "http://", "nothing", "ftp+x-y.z://h/@:/?#"]


@query(f"""WITH u AS (SELECT page_id, url AS s FROM pages UNION ALL SELECT -i, list_value({", ".join(f"'{u}'" for u in ODD_URLS)})[i] FROM range(1, {len(ODD_URLS) + 1}) t(i)),
a AS (SELECT page_id, s, strpos(s, ':') AS c FROM u),
b AS (SELECT page_id, left(s, c - 1) AS scheme, substr(s, c + 1) AS r, c > 0 AND translate(lower(left(s, greatest(c - 1, 0))), 'abcdefghijklmnopqrstuvwxyz+-.', '') = '' AND starts_with(substr(s, c + 1), '//') AS begins FROM a),
d AS (SELECT *, substr(r, 3) AS t, strpos(substr(r, 3), '@') AS sign, strpos(substr(r, 3), '/') AS slash FROM b),
e AS (SELECT *, CASE WHEN sign > 0 AND (slash = 0 OR sign < slash) THEN left(t, sign - 1) ELSE '' END AS who, CASE WHEN sign > 0 AND (slash = 0 OR sign < slash) THEN substr(t, sign + 1) ELSE t END AS h FROM d),
f AS (SELECT *, CASE WHEN starts_with(h, '[') THEN CASE WHEN strpos(h, ']') > 0 THEN strpos(h, ']') ELSE length(h) END ELSE least(CASE WHEN strpos(h, ':') > 0 THEN strpos(h, ':') ELSE length(h) + 1 END, CASE WHEN strpos(h, '/') > 0 THEN strpos(h, '/') ELSE length(h) + 1 END) - 1 END AS n FROM e),
g AS (SELECT *, left(h, n) AS host, substr(h, n + 1) AS x FROM f),
k AS (SELECT *, CASE WHEN starts_with(x, ':') THEN split_part(substr(x, 2), '/', 1) ELSE '' END AS port FROM g),
l AS (SELECT *, CASE WHEN starts_with(x, ':') THEN substr(x, length(port) + 2) ELSE x END AS y FROM k),
m AS (SELECT *, begins AND (y = '' OR starts_with(y, '/')) AS valid, substr(y, 2) AS z FROM l),
o AS (SELECT *, length(split_part(split_part(z, '#', 1), '?', 1)) AS p FROM m),
q AS (SELECT *, left(z, p) AS path, CASE WHEN substr(z, p + 1, 1) = '?' THEN split_part(substr(z, p + 2), '#', 1) ELSE '' END AS query FROM o)
SELECT page_id, valid, CASE WHEN valid THEN lower(scheme) ELSE '' END AS scheme, CASE WHEN valid THEN split_part(who, ':', 1) ELSE '' END AS "user", CASE WHEN valid AND strpos(who, ':') > 0 THEN substr(who, strpos(who, ':') + 1) ELSE '' END AS password,
  CASE WHEN valid AND host <> '' THEN host ELSE 'localhost' END AS host, CASE WHEN valid AND port <> '' THEN CAST(regexp_extract(port, '^[0-9]+') AS INTEGER) ELSE 9000 END AS port, CASE WHEN valid THEN path ELSE '' END AS path, CASE WHEN valid THEN query ELSE '' END AS query,
  CASE WHEN valid AND strpos(substr(z, p + 1), '#') > 0 THEN substr(z, p + 1 + strpos(substr(z, p + 1), '#')) ELSE '' END AS fragment FROM q""")
def parse_url(spark, sf):
    odd = spark.createDataFrame([(-i - 1, u) for i, u in enumerate(ODD_URLS)], "page_id long, url string")
    return text.parse_url(table(spark, sf, "pages").select("page_id", "url").unionByName(odd), "url", ["page_id"])


def _stats(spark, sf):
    kind = F.create_map(*[F.lit(x) for kv_ in TAGS.items() for x in kv_])
    t = timings(spark, sf)
    return t.select(kind[F.col("event_type")].alias("stat_type"), "iter", "tid", F.col("dur_us").cast("double").alias("value"))


@query(f"WITH {TIMINGS} SELECT CASE event_type WHEN 'click' THEN 'ITER' ELSE 'WAIT' END AS stat_type, iter, tid, CAST(dur_us AS DOUBLE) AS value FROM t WHERE event_type IN ('click', 'view')")
def stat_log_extract(spark, sf):
    lines = text.stat_lines(_stats(spark, sf)).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("value")))
    return text.parse_stats(lines, ("ITER", "WAIT"))


# --- vectors ---------------------------------------------------------------------


@query("WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) SELECT vec_id, round(sum(x * i / 64.0::DOUBLE), 6) AS dot FROM v GROUP BY vec_id")
def vec_dot(spark, sf):
    w = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i / 64.0)
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), w), 6).alias("dot"))


@query("WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM v GROUP BY vec_id")
def vec_mean_sd(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.mean(v), 6).alias("mean"), F.round(vectors.stddev(v), 6).alias("sd"))


@query("WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS idx FROM embeddings) SELECT vec_id, idx, CASE WHEN x * 200 > 30 THEN 1 ELSE 0 END AS bit FROM v")
def vec_binarize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 200)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.binarize(scaled)).alias("idx", "bit"))


@query("""WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS idx FROM embeddings)
SELECT vec_id, idx, round((x - avg(x) OVER (PARTITION BY vec_id)) / stddev_pop(x) OVER (PARTITION BY vec_id), 6) AS z FROM v""")
def vec_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.transform(vectors.normalize(F.col("embedding")), lambda x: F.round(x, 6))).alias("idx", "z"))


@query("SELECT vec_id, CAST(d AS INTEGER) AS digit, CASE WHEN label = d THEN 1 ELSE 0 END AS hot FROM embeddings, range(10) t(d)")
def onehot_label(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.one_hot(F.col("label"))).alias("digit", "hot"))


# --- statistics ---------------------------------------------------------------------


@query(f"""WITH {TIMINGS}, a AS (SELECT tid, count(*) AS n, sum(dur_us) AS total, sum(dur_us) // count(*) AS mean FROM t GROUP BY tid)
SELECT tid, a.n, CAST(a.total AS BIGINT) AS total, CAST(a.mean AS BIGINT) AS mean, CAST(floor(sqrt(CAST(sum((dur_us - mean) * (dur_us - mean)) // a.n AS DOUBLE))) AS BIGINT) AS st_dev FROM t JOIN a USING (tid) GROUP BY tid, a.n, a.total, a.mean""")
def stats_summary(spark, sf):
    return stats.summary(timings(spark, sf))


@query(f"""WITH {TIMINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY seq DESC) AS k FROM t)
SELECT tid, CAST(sum(dur_us) FILTER (k <= 1) AS BIGINT) AS last_1, CAST(sum(dur_us) FILTER (k <= 5) AS BIGINT) AS last_5, CAST(sum(dur_us) AS BIGINT) AS last_all FROM r GROUP BY tid""")
def stats_last_n(spark, sf):
    return stats.last_n(timings(spark, sf), {"last_1": 1, "last_5": 5, "last_all": None})


@query(f"WITH {TIMINGS} SELECT iter, CAST(sum(dur_us) AS BIGINT) AS total FROM t GROUP BY iter")
def stats_iter_sum(spark, sf):
    return stats.sum_by_iteration(timings(spark, sf))


# --- clocks -----------------------------------------------------------------------


@query(f"WITH {OPS} SELECT tid, count(*) FILTER (flag = 'Clock') AS clock FROM ops GROUP BY tid")
def progress_clock(spark, sf):
    return clocks.progress(op_log(spark, sf))


@query(f"WITH {CLOCKED} SELECT seq, tid, ck, mn, CASE WHEN mn > prev THEN mn ELSE -1 END AS changed_min FROM n WHERE flag = 'Clock'")
def min_clock_trace(spark, sf):
    return clocks.min_clock_trace(op_log(spark, sf), TIDS)


@query(f"WITH {OPS} SELECT g.seq, g.tid, g.key, coalesce(arg_max(a.val, a.seq), 0) AS val FROM ops g LEFT JOIN ops a ON a.flag = 'Add' AND a.key = g.key AND a.seq < g.seq WHERE g.flag = 'Get' GROUP BY g.seq, g.tid, g.key")
def asp_get(spark, sf):
    return clocks.asp_get(op_log(spark, sf))


@query(f"""WITH {CLOCKED} SELECT g.seq, g.tid, g.key, coalesce(arg_max(a.val, a.seq), 0) AS val FROM n g LEFT JOIN n a ON a.flag = 'Add' AND a.key = g.key AND a.mn + 1 <= greatest(g.mn, g.ck)
WHERE g.flag = 'Get' AND g.ck <= (SELECT max(mn) FROM n) GROUP BY g.seq, g.tid, g.key""")
def bsp_get(spark, sf):
    return clocks.bsp_get(op_log(spark, sf), TIDS)


@query(f"""WITH {CLOCKED}, f AS (SELECT mn, min(seq) AS reached FROM n GROUP BY mn),
g AS (SELECT n.*, CASE WHEN n.ck <= n.mn + 2 THEN n.seq ELSE f.reached END AS release FROM n LEFT JOIN f ON f.mn = n.ck - 2 WHERE n.flag = 'Get')
SELECT g.seq, g.tid, g.key, coalesce(arg_max(a.val, a.seq), 0) AS val FROM g LEFT JOIN n a ON a.flag = 'Add' AND a.key = g.key AND a.seq < g.release WHERE g.release IS NOT NULL GROUP BY g.seq, g.tid, g.key""")
def ssp_get(spark, sf):
    return clocks.ssp_get(op_log(spark, sf), 2, TIDS)


@query(f"""WITH {CLOCKED}, x AS (SELECT *, CAST(sum(CASE WHEN flag = 'Add' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS adds FROM n)
SELECT x.seq, x.adds - coalesce(y.adds, 0) AS pending FROM x LEFT JOIN (SELECT mn, adds FROM x WHERE mn > prev) y USING (mn) WHERE x.flag = 'Clock'""")
def bsp_pending_adds(spark, sf):
    return clocks.bsp_pending_adds(op_log(spark, sf), TIDS)


@query(f"WITH {CLOCKED} SELECT count(*) FILTER (ck > (SELECT max(mn) FROM n)) AS pending FROM n WHERE flag = 'Get'")
def bsp_pending_gets(spark, sf):
    return clocks.bsp_pending_gets(op_log(spark, sf), TIDS)


@query(f"WITH {CLOCKED} SELECT seq, CASE WHEN ck > mn + 2 THEN 1 ELSE 0 END AS blocked, CASE WHEN ck > mn + 2 THEN ck - 2 ELSE -1 END AS release_clock FROM n WHERE flag = 'Get'")
def ssp_blocked(spark, sf):
    return clocks.ssp_blocked(op_log(spark, sf), 2, TIDS)


@query(f"WITH {CLOCKED} SELECT ck - 2 AS release_clock, count(*) AS pending FROM n WHERE flag = 'Get' AND ck > mn + 2 GROUP BY ck - 2")
def ssp_pending(spark, sf):
    return clocks.ssp_pending(op_log(spark, sf), 2, TIDS)


@query(f"WITH {OPS} SELECT model_id, flag, count(*) AS n FROM ops WHERE model_id = 1 GROUP BY model_id, flag")
def server_dispatch(spark, sf):
    return clocks.dispatch(op_log(spark, sf), [1])


@query(f"WITH {OPS}, a AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY seq) AS round FROM ops WHERE flag = 'Clock') SELECT CAST(round AS INTEGER) AS round, max(seq) AS seq FROM a GROUP BY round HAVING count(*) = 4")
def barrier_rounds(spark, sf):
    return clocks.barrier_rounds(op_log(spark, sf), TIDS)


# --- models --------------------------------------------------------------------------

_LR = f"""{SAMPLES}, z AS (SELECT vec_id, y, 0.01::DOUBLE + sum(0.01::DOUBLE * x) AS score, sum(x) AS sx FROM s GROUP BY vec_id, y),
  p AS (SELECT *, 1 / (1 + exp(-score)) AS p FROM z), g AS (SELECT *, 0.01::DOUBLE + sx * (y - p) AS g FROM p)"""


@query(f"WITH {_LR} SELECT vec_id AS sample_id, round(score, 6) AS score, round(p, 6) AS p FROM p")
def lr_score(spark, sf):
    s = models.lr_score(models.attach(samples(spark, sf), start_weights(spark), 65))
    return _rounded(s.select("sample_id", "score", "p"), "score", "p")


@query(f"""WITH {_LR}, push AS (SELECT 0 AS key, vec_id, g FROM g UNION ALL SELECT s.idx, vec_id, g FROM s JOIN g USING (vec_id)), w AS (SELECT key, arg_max(g, vec_id) AS g FROM push GROUP BY key)
SELECT k.key, round(0.01::DOUBLE + 0.0001::DOUBLE * coalesce(w.g, 0), 9) AS val FROM (SELECT unnest(range(65)) AS key) k LEFT JOIN w USING (key)""")
def lr_step(spark, sf):
    return _rounded(models.lr_step(samples(spark, sf), start_weights(spark), rows=65), "val", digits=9)


@query(f"""WITH {_LR}, push AS (SELECT 0 AS key, vec_id, y - p AS d FROM p UNION ALL SELECT s.idx, vec_id, (p.y - p.p) * s.x FROM s JOIN p USING (vec_id)), w AS (SELECT key, arg_max(d, vec_id) AS d FROM push GROUP BY key)
SELECT k.key, round(0.01::DOUBLE + 0.0001::DOUBLE * coalesce(w.d, 0), 9) AS val FROM (SELECT unnest(range(65)) AS key) k LEFT JOIN w USING (key)""")
def lr_step_textbook(spark, sf):
    return _rounded(models.lr_step(samples(spark, sf), start_weights(spark), compat=False, rows=65), "val", digits=9)


def _accuracy_sql(score: str, hit: str) -> str:
    return f"WITH {SAMPLES}, z AS (SELECT vec_id, y, {score} AS score FROM s GROUP BY vec_id, y) SELECT count(*) AS n, count(*) FILTER ({hit}) AS n_correct, round(100.0::DOUBLE * count(*) FILTER ({hit}) / count(*), 6) AS accuracy FROM z"


@query(_accuracy_sql("0.01::DOUBLE + sum(0.01::DOUBLE * x)", "(score > 0) = (y > 0)"))
def lr_accuracy(spark, sf):
    return _rounded(models.accuracy(models.lr_predict(samples(spark, sf), start_weights(spark), rows=65)), "accuracy")


@query(_accuracy_sql("0.01::DOUBLE + coalesce(sum(0.01::DOUBLE * x) FILTER (rn > 1), 0)", "(score > 0) = (y > 0)"))
def lr_accuracy_compat(spark, sf):
    return _rounded(models.accuracy(models.lr_predict(samples(spark, sf), start_weights(spark), compat=True, rows=65)), "accuracy")


@query(f"WITH {SAMPLES} SELECT vec_id AS sample_id, round(coalesce(sum(0.01::DOUBLE * x) FILTER (rn > 1), 0), 6) AS score FROM s GROUP BY vec_id")
def svm_score(spark, sf):
    s = models.svm_score(models.attach(samples(spark, sf, 1, -1), start_weights(spark), 65, bias=False))
    return _rounded(s.select("sample_id", "score"), "score")


@query(f"""WITH {SAMPLES}, z AS (SELECT vec_id, 2 * y - 1 AS y, coalesce(sum(0.01::DOUBLE * x) FILTER (rn > 1), 0) AS score FROM s GROUP BY vec_id, y),
push AS (SELECT s.idx AS key, vec_id, CASE WHEN s.rn = 1 THEN 0.01::DOUBLE WHEN z.y * score > 1 THEN 0.01::DOUBLE - 2 * 0.0001::DOUBLE * 0.01::DOUBLE ELSE 0.01::DOUBLE - 2 * (0.0001::DOUBLE * 0.01::DOUBLE - z.y * s.x) END AS v FROM s JOIN z USING (vec_id)),
w AS (SELECT key, arg_max(v, vec_id) AS v FROM push GROUP BY key) SELECT k.key, round(coalesce(w.v, 0.01::DOUBLE), 6) AS val FROM (SELECT unnest(range(65)) AS key) k LEFT JOIN w USING (key)""")
def svm_step(spark, sf):
    return _rounded(models.svm_step(samples(spark, sf, 1, -1), start_weights(spark), rows=65), "val")


@query(_accuracy_sql("coalesce(sum(0.01::DOUBLE * x) FILTER (rn > 1), 0)", "(score >= 0) = (y > 0)"))
def svm_accuracy(spark, sf):
    return _rounded(models.accuracy(models.svm_predict(samples(spark, sf, 1, -1), start_weights(spark), rows=65)), "accuracy")


@query(f"WITH {RATINGS} SELECT CAST(mu AS BIGINT) AS mean_rating FROM mu")
def mf_mean_rating(spark, sf):
    return models.mean_rating(ratings(spark, sf))


def _blank(spark):
    return spark.createDataFrame([], "id long, bias double, f array<double>")


def _rated(spark, sf):
    return ratings(spark, sf).join(F.broadcast(models.mean_rating(ratings(spark, sf))))


@query(f"WITH {RATINGS} SELECT pos, round(mu + 0.001::DOUBLE, 6) AS predicted, round(rating - (mu + 0.001::DOUBLE), 6) AS err FROM r, mu")
def mf_predict(spark, sf):
    a = models.attach_factors(_rated(spark, sf), _blank(spark), _blank(spark), 10, 0.01)
    return _rounded(models.mf_predict(a, F.col("mean_rating")).select("pos", "predicted", "err"), "predicted", "err")


@query(f"""WITH {RATINGS}, e AS (SELECT "user", item, pos, rating - (mu + 0.001::DOUBLE) AS e FROM r, mu),
u AS (SELECT 'user' AS side, "user" AS id, arg_max(e, pos) AS e FROM e GROUP BY "user"), i AS (SELECT 'item' AS side, item AS id, arg_max(e, pos) AS e FROM e GROUP BY item),
un AS (SELECT *, 0.01::DOUBLE + 0.0001::DOUBLE * (e * 0.01::DOUBLE - 0.02::DOUBLE * 0.01::DOUBLE) AS f FROM u),
vn AS (SELECT *, 0.01::DOUBLE + 0.0001::DOUBLE * (e * (0.01::DOUBLE + 0.0001::DOUBLE * (e * 0.01::DOUBLE - 0.02::DOUBLE * 0.01::DOUBLE)) - 0.02::DOUBLE * 0.01::DOUBLE) AS f FROM i),
a AS (SELECT * FROM un UNION ALL SELECT * FROM vn)
SELECT side, id, CAST(l AS INTEGER) AS l, round(CASE WHEN l = -1 THEN 0.0001::DOUBLE * e ELSE f END, 8) AS val FROM a, range(-1, 10) t(l)""")
def mf_step(spark, sf):
    users, items = models.mf_step(_rated(spark, sf), _blank(spark), _blank(spark), F.col("mean_rating"))
    return _rounded(models.factors_long("user", users).unionByName(models.factors_long("item", items)), "val", digits=8)


@query(f"""WITH {RATINGS}, c AS (SELECT "user", item, arg_max(rating, pos) AS rating FROM (SELECT * FROM r ORDER BY pos LIMIT 5000) GROUP BY "user", item)
SELECT CAST(mu AS BIGINT) AS mean_rating, round(sqrt(sum((rating - mu) * (rating - mu))), 6) AS sse_root, round(sqrt(avg((rating - mu) * (rating - mu))), 6) AS rmse FROM c, mu GROUP BY mu""")
def mf_error(spark, sf):
    r = ratings(spark, sf)
    return _rounded(models.mf_error(r, _blank(spark), _blank(spark), models.mean_rating(r)), "sse_root", "rmse")


@query(f"""WITH {RATINGS} SELECT pos, l, CAST("user" + l * 1000 AS BIGINT) AS key FROM r, range(10) t(l)""")
def mf_keys(spark, sf):
    return ratings(spark, sf).select("pos", F.posexplode(models.factor_keys(F.col("user"), 1000, 10)).alias("l", "key")).withColumn("l", F.col("l").cast("long"))


@query("WITH r AS (SELECT vec_id, vec_id % 4 AS worker, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY vec_id % 4) AS n FROM embeddings) SELECT worker, CAST(b AS INTEGER) AS b, vec_id FROM range(200) t(b) JOIN r ON b % n = k")
def batch_wrap(spark, sf):
    return models.batch(table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("worker")), 200, "worker", "vec_id").select("worker", "b", "vec_id")


@query("WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS k FROM embeddings) SELECT vec_id, CASE WHEN k <= 100 THEN 1 ELSE 0 END AS test FROM r")
def holdout_last_n(spark, sf):
    train, test = models.hold_out_last(table(spark, sf, "embeddings").select("vec_id"), 100, "vec_id")
    return train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1)))


# --- scheduling ------------------------------------------------------------------------

_TIMES = f"{TIMINGS}, w AS (SELECT iter, tid, CAST(sum(dur_us) AS DOUBLE) AS time FROM t GROUP BY iter, tid), q AS (SELECT *, CASE WHEN time > 1.5 * min(time) OVER (PARTITION BY iter) THEN 1 ELSE 0 END AS straggler FROM w)"


def _times(spark, sf):
    return timings(spark, sf).groupBy("iter", "tid").agg(F.sum("dur_us").cast("double").alias("time"))


@query(f"WITH {_TIMES} SELECT iter, tid, time, straggler FROM q")
def sched_stragglers(spark, sf):
    return schedule.stragglers(_times(spark, sf))


@query(f"""WITH RECURSIVE {_TIMES}, p AS (SELECT *, sum(CASE WHEN straggler = 1 THEN 20 ELSE 0 END) OVER (PARTITION BY iter) AS pool, sum(1 - straggler) OVER (PARTITION BY iter) AS takers, row_number() OVER (PARTITION BY iter, straggler ORDER BY time, tid) AS place FROM q),
f AS (SELECT iter, CAST(0 AS BIGINT) AS place, CAST(max(pool) AS BIGINT) AS rest, CAST(max(takers) AS BIGINT) AS left_, CAST(0 AS BIGINT) AS took FROM p GROUP BY iter
  UNION ALL SELECT iter, place + 1, rest - x, left_ - 1, x FROM (SELECT *, CASE WHEN rest < 1 THEN 0 ELSE CAST(floor(rest / left_ + 0.5) AS BIGINT) END AS x FROM f WHERE left_ > 0))
SELECT p.iter, p.tid, p.time, 100 AS old_w, CAST(CASE WHEN straggler = 1 THEN 80 ELSE 100 + f.took END AS INTEGER) AS new_w FROM p LEFT JOIN f ON f.iter = p.iter AND f.place = p.place""")
def sched_rebalance(spark, sf):
    return schedule.rebalance(_times(spark, sf).withColumn("old_w", F.lit(100)))


@query(f"WITH {_TIMES} SELECT iter, tid, time * CASE WHEN tid = 3 OR (tid = 1 AND iter BETWEEN 50 AND 74) THEN 11 ELSE 1 END AS time FROM w")
def sched_injection(spark, sf):
    t = _times(spark, sf).withColumnRenamed("tid", "worker_id")
    return schedule.injected_delay(t, 1000.0, transient=True, permanent=True).withColumnRenamed("worker_id", "tid").select("iter", "tid", "time")


def entry(spark: SparkSession) -> DataFrame:
    """Two supersteps of logistic regression over the smallest tables: the weights."""
    return _queries["lr_train"](spark, "/root/testdata/sf0.001")


from . import queries_jobs  # noqa: E402, F401 - registers its queries
