"""Queries of the engine over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq import catalog_io
from strataq.api import Engine
from strataq.functions.values import DATE_PARTS
from strataq.sources.sinks import flat, write_parquet

FLAGSHIP = "tpch_q1"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})


#: name: (our SQL, DuckDB's SQL, or None where the text is the same in both)
SQL: dict[str, tuple[str, str | None]] = {
    "tpch_q1": (
        """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
        sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge,
        avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
        None,
    ),
    "tpch_q6": ("SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", None),
    "scan_projection": ("SELECT o_orderkey, o_orderstatus AS status FROM orders", None),
    "scan_star": ("SELECT * FROM customer", None),
    "select_arith": ("SELECT p_partkey, p_size + 1 AS a, p_size * 2 - 3 AS b, -p_size AS c, p_retailprice / 4 AS d FROM part", None),
    "select_concat": ("SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer", None),
    "select_case": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'low' END AS class FROM orders", None),
    "select_case_null": ("SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_linenumber > 3 THEN l_quantity END) AS s, count(CASE WHEN l_linenumber > 3 THEN l_quantity END) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber", None),
    "select_coalesce": ("SELECT event_id, coalesce(CASE WHEN value > 50 THEN event_type END, 'small') AS kind FROM events", None),
    "filter_cmp": ("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <> 105 AND o_totalprice < 150000 AND o_orderstatus = 'O'", None),
    "filter_in_not_in": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5, 7) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", None),
    "filter_in_null": ("SELECT count(*) AS n FROM customer WHERE c_nationkey NOT IN (1, NULL)", None),
    "filter_between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1500", None),
    "filter_like_prefix": ("SELECT p_partkey FROM part WHERE p_name LIKE 'small%'", None),
    "filter_like_suffix": ("SELECT p_partkey FROM part WHERE p_type LIKE '%L'", None),
    "filter_like_contains": ("SELECT page_id FROM pages WHERE url LIKE '%com%'", None),
    "filter_like_underscore": ("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_2' OR p_brand NOT LIKE '%1_'", None),
    "filter_not_group": ("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR NOT (o_totalprice > 100000 AND o_custkey < 700))", None),
    "filter_is_null": ("SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NULL OR o_orderkey IS NOT NULL", None),
    "filter_date_literal": ("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1997-03-01' AND o_orderdate < '1997-04-01 00:00:00'", None),
    "filter_date_ns": ("SELECT count(*) AS n FROM events WHERE ts > '2024-01-10 00:00:00.000000001'", "SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'"),
    "agg_count_star": ("SELECT count(*) AS n FROM lineitem", None),
    "agg_count_distinct": ("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem", None),
    "agg_sum_int": ("SELECT sum(l_linenumber) AS a, sum(l_orderkey) AS b, sum(l_linenumber + 5) AS c FROM lineitem", "SELECT CAST(sum(l_linenumber) AS DECIMAL(38,0)) AS a, CAST(sum(l_orderkey) AS DECIMAL(38,0)) AS b, CAST(sum(l_linenumber + 5) AS DECIMAL(38,0)) AS c FROM lineitem"),
    "agg_min_max_string": ("SELECT min(c_name) AS a, max(c_mktsegment) AS b, min(c_acctbal) AS c FROM customer", None),
    "agg_min_max_time": ("SELECT min(ts) AS a, max(ts) AS b FROM events", None),
    "agg_avg_int": ("SELECT avg(l_linenumber) AS a, avg(l_orderkey) AS b FROM lineitem", None),
    "agg_filter_where": ("SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS r, sum(l_quantity) FILTER (WHERE l_linestatus = 'O' AND l_discount > 0.05) AS q, avg(l_tax) FILTER (WHERE l_quantity > 1000) AS none FROM lineitem", None),
    "agg_empty_input": ("SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_returnflag) AS m FROM lineitem WHERE l_quantity < 0", None),
    "agg_having_scalar": ("SELECT count(*) AS n FROM orders HAVING count(*) > 10", None),
    "group_single": ("SELECT event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY event_type", None),
    "group_multi": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "group_expr": ("SELECT l_linenumber * 10 AS k, count(*) AS n FROM lineitem GROUP BY l_linenumber * 10", None),
    "group_position": ("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2", None),
    "group_alias": ("SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY month", None),
    "group_no_agg": ("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_null_key": ("SELECT CASE WHEN l_linenumber > 3 THEN l_returnflag END AS k, count(*) AS n FROM lineitem GROUP BY 1", None),
    "group_having": ("SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50 AND sum(l_quantity) BETWEEN 100 AND 1000000", None),
    "group_having_hidden": ("SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING max(c_acctbal) > 9000 OR min(c_acctbal) IS NULL", None),
    "group_order_hidden": ("SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY sum(c_acctbal) DESC LIMIT 7", None),
    "group_count_topk": ("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10", None),
    "group_distinct_topk": ("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey ORDER BY 2 DESC, 1 LIMIT 10", None),
    "group_sum_topk": ("SELECT user_id, sum(value) AS s FROM events GROUP BY user_id ORDER BY s DESC LIMIT 10", None),
    "group_dependent_keys": ("SELECT l_linenumber, l_linenumber - 1 AS b, l_linenumber * l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3", None),
    "group_high_cardinality": ("SELECT l_orderkey, l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_partkey", None),
    "order_rows_topn": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "order_offset": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15 OFFSET 10", None),
    "order_nulls_last": ("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS p FROM orders ORDER BY p DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS p FROM orders ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 25"),
    "limit_zero": ("SELECT o_orderkey FROM orders LIMIT 0", None),
    "limit_first_rows": ("SELECT o_orderkey FROM orders LIMIT 12", "SELECT o_orderkey FROM orders ORDER BY file_row LIMIT 12"),
    "limit_first_groups": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey LIMIT 9", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY min(file_row) LIMIT 9"),
    "fn_strlen": ("SELECT doc_id, strlen(text) AS n FROM documents", None),
    "fn_make_date": ("SELECT p_partkey, make_date(p_size) AS d FROM part", "SELECT p_partkey, DATE '1970-01-01' + p_size AS d FROM part"),
    "fn_make_date_filter": ("SELECT count(*) AS n, max(make_date(p_size)) AS d FROM part WHERE make_date(p_size) > '1970-01-20'", "SELECT count(*) AS n, max(DATE '1970-01-01' + p_size) AS d FROM part WHERE p_size > 19"),
    "fn_epoch_ms": ("SELECT event_id, epoch_ms(event_id * 1000) AS t FROM events", None),
    "fn_regexp_replace": ("SELECT regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') AS host, count(*) AS n, min(url) AS first FROM pages GROUP BY 1", None),
    "fn_regexp_first": ("SELECT page_id, regexp_replace(url, '[aeiou]', '<\\0>') AS u FROM pages", None),
    "fn_regexp_global": ("SELECT page_id, regexp_replace(url, '([a-z])([0-9])', '\\2$\\1', 'g') AS u FROM pages", None),
    "fn_regexp_options": ("SELECT page_id, regexp_replace(url, 'HTTP', 'x', 'ic') AS a, regexp_replace(url, 'HTTP', 'x', 'ci') AS b, regexp_replace(url, 'S?://', '\\\\', 'i g') AS c, regexp_replace(url, '.', '-', 'l') AS d FROM pages", None),
    "fn_regexp_lines": ("SELECT doc_id, strlen(regexp_replace(text, '^.*$', '', 's')) AS a, strlen(regexp_replace(text, '.+', '')) AS b, strlen(regexp_replace(text, '.+', '', 'sm')) AS c, strlen(regexp_replace(text, '[a-z.]$', 'xyz')) AS d, strlen(regexp_replace(text, '(?m)[a-z.]$', '!!', 'g')) AS e, strlen(regexp_replace(text, '(?m)^', '> ', 'g')) AS f FROM documents", None),
    "fn_regexp_classes": ("SELECT page_id, regexp_replace(url, '[[:punct:]]+', '_', 'g') AS a, regexp_replace(url, '[[:^alpha:]&&]', '', 'g') AS b, regexp_replace(url, '(?P<one>[a-z]+)(?:[^a-z]{1,2})', '[\\1]', 'g') AS c, regexp_replace(url, '(?i:HTTPS?)://', '') AS d, regexp_replace(url, '\\x2f', '|', 'g') AS e FROM pages", None),
    "fn_cast_text": ("SELECT c_custkey, CAST(c_name AS VARCHAR) AS name FROM customer", None),
    "decimal_literals": ("SELECT o_orderkey, 0.05 * 1.10 AS a, 1.25 + 0.5 AS b, 7 / 2 AS c FROM orders", "SELECT o_orderkey, CAST(0.0550 AS DECIMAL(6,4)) AS a, CAST(1.75 AS DECIMAL(4,2)) AS b, 7 // 2 AS c FROM orders"),
    "int_div": ("SELECT l_orderkey, l_partkey, l_linenumber, l_partkey / l_linenumber AS q, -l_partkey / 7 AS r FROM lineitem", "SELECT l_orderkey, l_partkey, l_linenumber, l_partkey // l_linenumber AS q, (-l_partkey) // 7 AS r FROM lineitem"),
    "case_in_sum": ("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END) AS done FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END) AS DECIMAL(38,0)) AS done FROM orders GROUP BY o_orderpriority"),
    "events_per_hour": ("SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, avg(value) AS a FROM events GROUP BY 1, 2", None),
}
for _p in ("microsecond", "millisecond", "second", "minute", "day", "week", "quarter", "year"):
    SQL[f"fn_date_trunc_{_p}"] = (f"SELECT event_id, date_trunc('{_p}', ts) AS t FROM events", f"SELECT event_id, CAST(date_trunc('{_p}', ts) AS TIMESTAMP) AS t FROM events")
for _p in DATE_PARTS:
    SQL[f"fn_date_part_{_p}"] = (f"SELECT event_id, extract({_p} FROM ts) AS v FROM events", f"SELECT event_id, CAST(floor(date_part('{_p}', ts)) AS BIGINT) AS v FROM events")


def _sql(text: str):
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(text)


def agg_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums and means of DECIMAL(15,2) prices."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("decimal(15,2)").alias("p"), F.col("l_discount").cast("decimal(15,2)").alias("d"))
    return Engine(spark, {"t": rows}).sql("SELECT l_returnflag, sum(p) AS s, avg(p) AS a, sum(p * (1 - d)) AS disc, min(p) AS lo, max(p + d) AS hi FROM t GROUP BY l_returnflag")


def agg_avg_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(engine(spark, sf_dir).sql("SELECT event_type, avg_state(value) AS st FROM events GROUP BY event_type"))


def partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workers' partial aggregates, merged."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    e = Engine(spark, {"a": rows.where("l_linenumber <= 3"), "b": rows.where("l_linenumber > 3")})
    aggs, keys = "count(*) AS n, sum(l_quantity) AS q, min(l_tax) AS lo, max(l_shipdate) AS hi, avg(l_extendedprice) AS mean", "l_returnflag"
    return e.merge([e.partial("a", aggs, keys), e.partial("b", aggs, keys)], aggs, keys)


def parts_of_a_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same engine by filter, aggregates and keys given apart."""
    return engine(spark, sf_dir).query("orders", filter="o_totalprice > 1000", aggregate="count(*) AS n, max(o_orderdate) AS last", group_by="o_orderstatus AS status", column_order=["last", "status", "n"])


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered copy written as Parquet and read again."""
    path = catalog_io.scratch(spark)
    write_parquet(engine(spark, sf_dir).query("customer", filter="c_acctbal > 0", copy=True), path, codec="zstd", bloom={"c_custkey": 0.01})
    return Engine(spark).query(path, select="c_custkey, c_name, c_acctbal * 2 AS twice")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts and sums by window of time over a stream of files, each window final once the watermark passes it."""
    from strataq.streaming import stream_windows as windows

    path, out = catalog_io.scratch(spark), catalog_io.scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a last row far ahead moves the watermark past all others; it belongs to no finished window itself
    last = rows.agg(F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 9 DAYS")).cast("timestamp_ntz").alias("ts"))
    rows.unionByName(last, allowMissingColumns=True).orderBy("ts").write.parquet(path)
    df = windows(spark, path, rows.schema, "ts", "6 hours", "1 day", keys=["event_type"], sums=["value"])
    q = df.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").format("parquet").option("path", f"{out}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


OTHERS = {
    agg_decimal: "SELECT l_returnflag, sum(p) AS s, CAST(round(CAST(sum(p) AS DECIMAL(30,2)) * 1.0000000000 / count(p), 6) AS DECIMAL(19,6)) AS a, CAST(sum(p * (1 - d)) AS DECIMAL(38,4)) AS disc, min(p) AS lo, CAST(max(p + d) AS DECIMAL(16,2)) AS hi FROM (SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(15,2)) AS p, CAST(l_discount AS DECIMAL(15,2)) AS d FROM lineitem) GROUP BY l_returnflag",
    agg_avg_state: "SELECT event_type, sum(value) AS st__sum, count(value) AS st__count FROM events GROUP BY event_type",
    partial_merge: "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, abs(min(l_tax)) AS lo, max(l_shipdate) AS hi, avg(l_extendedprice) AS mean FROM lineitem GROUP BY l_returnflag",
    parts_of_a_query: "SELECT max(o_orderdate) AS last, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus",
    parquet_roundtrip: "SELECT c_custkey, c_name, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 0",
    stream_windows: "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2",
}


def queries() -> dict:
    return {k: _sql(ours) for k, (ours, _) in SQL.items()} | {f.__name__: f for f in OTHERS} | catalog_io.queries()


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, (ours, theirs) in SQL.items():
        text = theirs or ours
        if "file_row" in text:  # the order of rows in the file, as DuckDB numbers them
            text = text.replace("FROM orders", "FROM (SELECT *, row_number() OVER () AS file_row FROM orders)")
        out[k] = text
    return out | {f.__name__: sql for f, sql in OTHERS.items()} | catalog_io.oracle_sql()
