"""Queries of what lies around the SQL engine: inputs, outputs, column types, requests, refusals; each with DuckDB SQL."""

from __future__ import annotations

import atexit
import contextlib
import io
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.api import Engine
from strataq.plans.errors import QueryError
from strataq.sources import inspect, parquet, sinks


def scratch(spark: SparkSession) -> str:
    """A new folder name in the folder that the session shares; what is written there goes when the driver ends."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    path = f"{base}/strataq-scratch-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session has ended; the folder is the cluster's to clean
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _thirds(spark: SparkSession, sf_dir: str) -> list[str]:
    """orders as three inputs by o_orderkey % 3, each in order of its key."""
    base = scratch(spark)
    rows = _table(spark, sf_dir, "orders")
    paths = [f"{base}/third_{k}" for k in range(3)]
    for k, p in enumerate(paths):
        sinks.write_parquet(rows.where(F.col("o_orderkey") % 3 == k).orderBy("o_orderkey"), p)
    return paths


# --- inputs
def input_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A LIMIT over several inputs takes the first rows of the first one given."""
    a, b, c = _thirds(spark, sf_dir)
    return Engine(spark).query([c, a, b], select="o_orderkey, o_orderstatus", limit=25)


def input_order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _thirds(spark, sf_dir)
    return Engine(spark).query([c, a, b], group_by="o_custkey", aggregate="count(*) AS n, sum(o_orderkey) AS s", limit=20)


def input_order_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _thirds(spark, sf_dir)
    return Engine(spark).query([b, c, a], filter="o_orderstatus = 'F'", select="o_orderkey", limit=30)


def input_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _thirds(spark, sf_dir)[0].rpartition("/")[0]
    return Engine(spark).query(f"{base}/third_[02]", select="o_orderkey, o_totalprice")


def input_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workers take a half of the row groups of each file; their partial answers are merged."""
    path = scratch(spark)
    sinks.write_parquet(_table(spark, sf_dir, "lineitem"), path, row_group_rows=1_000)
    files = [f.path for f in parquet.footers(spark, [path])]
    aggs, keys = "count(*) AS n, sum(l_quantity) AS q, max(l_shipdate) AS hi, avg(l_linenumber) AS m", "l_returnflag"
    e = Engine(spark)
    return e.merge([e.partial(parquet.open_slices(spark, files, [half] * len(files)), aggs, keys) for half in ([0, 1, 2], [1, 2, 2])], aggs, keys)


def input_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of both versions: plain and dictionary values, delta-packed integers, delta byte arrays, RLE booleans."""
    base, rows = scratch(spark), _table(spark, sf_dir, "orders").withColumn("big", F.col("o_totalprice") > 200000)
    for v in ("v1", "v2"):
        sinks.write_parquet(rows.where(F.col("o_orderkey") % 2 == int(v == "v2")), f"{base}/{v}", version=v)
    return Engine(spark).query([f"{base}/v1", f"{base}/v2"], select="o_orderkey, o_orderpriority, o_totalprice, o_orderdate, CASE WHEN big THEN 1 ELSE 0 END AS big")


def input_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, rows = scratch(spark), _table(spark, sf_dir, "customer")
    for c in sinks.CODECS:
        sinks.write_parquet(rows, f"{base}/{c}", codec=c)
    return Engine(spark).query([f"{base}/{c}" for c in sinks.CODECS], group_by="c_mktsegment", aggregate="count(*) AS n, count(DISTINCT c_custkey) AS d, min(c_name) AS lo")


def report_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}
    df, _ = Engine(spark)._open(f"{sf_dir}/lineitem.parquet", True)
    return spark.createDataFrame([(f.name, names[f.dataType.simpleString()]) for f in df.schema.fields], "column_name string, column_type string")


def report_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [inspect.inspect(spark, f.path, detail=True) for t in ("orders", "part") for f in parquet.footers(spark, [f"{sf_dir}/{t}.parquet"])]
    kept = [(r["columns"], r["rows"], sum(g["rows"] for g in r["groups"]), len(r["schema"])) for r in found]
    return spark.createDataFrame(kept, "columns long, n long, in_groups long, leaves long").groupBy("columns", "leaves").agg(F.sum("n").alias("n"), F.sum("in_groups").alias("in_groups"))


def report_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(inspect.conform(spark, f"{sf_dir}/customer.parquet").items()), "column_name string, state string")


# --- outputs
def sink_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, {"customer": f"{sf_dir}/customer.parquet"})
    return sinks.text_rows(e.sql("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_nationkey > 12 THEN c_mktsegment END AS seg FROM customer"), "ndjson")


def sink_ndjson_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as microseconds, dates as days, DECIMAL with its scale, booleans, whole groups."""
    rows = _table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("d"), F.col("value").cast("decimal(12,3)").alias("p"), (F.col("value") > 50).alias("b"), F.struct("user_id", "event_type").alias("g"))
    return sinks.text_rows(Engine(spark, {"t": rows}).sql("SELECT event_id, ts, d, p, b, g FROM t"), "ndjson")


def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, {"events": f"{sf_dir}/events.parquet"})
    return sinks.text_rows(e.sql("SELECT event_id, event_type, CASE WHEN event_id > 20 THEN value END AS v, props, ts FROM events"), "csv")


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array, in order; for answers that one process prints."""
    e = Engine(spark, {"region": f"{sf_dir}/region.parquet"})
    return spark.createDataFrame([(e.text("SELECT r_regionkey, r_name FROM region ORDER BY r_name DESC", "json"),)], "document string")


def sink_aggregate_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups written as Parquet: integer sums as INT64, states of averages as two columns."""
    path = scratch(spark)
    e = Engine(spark, {"lineitem": f"{sf_dir}/lineitem.parquet"})
    sinks.write_parquet(e.sql("SELECT l_suppkey, count(*) AS n, sum(l_linenumber) AS s, avg_state(l_quantity) AS q FROM lineitem GROUP BY l_suppkey"), path, narrow=True)
    return e.query(path, select="l_suppkey, n, s, q__sum, q__count")


def sink_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a write leaves in footers: statistics, page indexes, Bloom filters where asked for, the codec."""
    path = scratch(spark)
    sinks.write_parquet(_table(spark, sf_dir, "customer").repartition(2), path, codec="gzip", bloom={"c_custkey": 0.01, "c_name": 0.05}, version="v2")
    facts = [(c["path"], c["bloom_filter"], c["page_index"], c["statistics"] is not None, c["codec"]) for f in parquet.footers(spark, [path]) for g in inspect.inspect(spark, f.path, detail=True)["groups"] for c in g["columns"]]
    return spark.createDataFrame(facts, "path string, bloom boolean, page_index boolean, stats boolean, codec string").distinct()


def sink_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups of at most so many rows, which hold all rows together."""
    path = scratch(spark)
    sinks.write_parquet(_table(spark, sf_dir, "orders"), path, row_group_rows=500, codec="zstd", level=1)
    sizes = [n for f in parquet.footers(spark, [path]) for n in f.groups]
    return spark.createDataFrame([(sum(sizes), max(sizes) <= 500)], "n long, fits boolean")


def sink_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, {"orders": f"{sf_dir}/orders.parquet"})
    return spark.createDataFrame(e.arrow("SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS hi, avg(o_totalprice) AS a FROM orders GROUP BY o_orderpriority"))


# --- types of columns
def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    value = F.col("value")
    return rows.select(
        "event_id",
        "event_type",
        F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(value).alias("x"),
        F.when(F.col("event_id") % 5 != 0, value > 60).alias("flag"),
        F.when(F.col("event_id") % 6 != 0, value.cast("decimal(10,2)")).alias("p"),
        F.to_date("ts").alias("d"),
        F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("kind"), "ts").alias("what")).alias("who"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("s"),
        F.col("value").cast("float").alias("f"),
    )


# Fixed for the queries below: what _typed() does, in DuckDB's SQL.
_TYPED = """(SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS x, CASE WHEN event_id % 5 <> 0 THEN value > 60 END AS flag,
  CASE WHEN event_id % 6 <> 0 THEN value::DECIMAL(10,2) END AS p, ts::DATE AS d, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN event_type END AS s, value::FLOAT AS f FROM events) AS t"""

#: name: (our SQL over t, DuckDB's SQL over the same columns, or None where the text is the same)
TYPED: dict[str, tuple[str, str | None]] = {
    "type_boolean": ("SELECT event_id FROM t WHERE flag", None),
    "type_boolean_not": ("SELECT event_id FROM t WHERE NOT flag AND flag <> true", None),
    "type_decimal": ("SELECT event_id FROM t WHERE p >= 100.005 OR p = 20.5 OR p < 1.0000001", "SELECT event_id FROM t WHERE p >= 100.01 OR p = 20.5 OR p <= 1.00"),
    "type_decimal_in": ("SELECT event_id, p FROM t WHERE p BETWEEN 10 AND 20.129 AND p NOT IN (12.5, 13.333)", "SELECT event_id, p FROM t WHERE p BETWEEN 10 AND 20.12 AND p <> 12.5"),
    "type_nan": ("SELECT event_id FROM t WHERE x > 150", None),
    "type_nan_not": ("SELECT event_id FROM t WHERE NOT x < 150 AND x <> 170.5", None),
    "type_nan_between": ("SELECT event_id FROM t WHERE x BETWEEN 10 AND 20 OR x NOT BETWEEN 0 AND 180", None),
    "type_nan_max": ("SELECT event_type, max(x) AS hi, count(x) AS n FROM t GROUP BY event_type", None),
    "type_float": ("SELECT event_id FROM t WHERE f = 106.03 OR f = 9.64 OR f <= 3.1", "SELECT event_id FROM t WHERE f = 106.03::FLOAT OR f = 9.64::FLOAT OR f <= 3.1::FLOAT"),
    "type_date": ("SELECT event_id FROM t WHERE d = '2024-01-05 13:00:00' OR d > 19745", "SELECT event_id FROM t WHERE d = DATE '2024-01-05' OR d > DATE '1970-01-01' + 19745"),
    "type_null_text": ("SELECT event_id FROM t WHERE s IS NULL OR s = 'click'", None),
    "type_null_compare": ("SELECT event_id FROM t WHERE s = NULL OR event_id < 40", None),
    "type_null_between": ("SELECT count(*) AS n FROM t WHERE NOT (event_id BETWEEN 10 AND NULL)", None),
    "type_null_like": ("SELECT count(*) AS n FROM t WHERE s LIKE NULL OR s NOT LIKE 'c%'", None),
    "type_bytes_order": ("SELECT event_id FROM t WHERE s > 'p' AND s <= 'view'", None),
    "nested_path": ("SELECT event_id, who.what.kind AS kind FROM t WHERE who.id < 20", "SELECT event_id, event_type AS kind FROM t WHERE user_id < 20"),
    "nested_leaf": ("SELECT event_id, id AS id FROM t WHERE kind = 'click'", "SELECT event_id, user_id AS id FROM t WHERE event_type = 'click'"),
    "nested_group_by": ("SELECT who.what.kind AS kind, count(*) AS n, max(who.id) AS hi FROM t GROUP BY who.what.kind", "SELECT event_type AS kind, count(*) AS n, max(user_id) AS hi FROM t GROUP BY event_type"),
    "computed_on_kept_rows": ("SELECT event_id, 1000 / (event_id - 3) AS q FROM t WHERE event_id <> 3", "SELECT event_id, 1000 // (event_id - 3) AS q FROM t WHERE event_id <> 3"),
    "date_parts_of_dates": ("SELECT event_id, extract(week FROM d) AS w, extract(dow FROM d) AS dow, extract(doy FROM d) AS doy, extract(hour FROM d) AS h FROM t", "SELECT event_id, extract(week FROM d) AS w, extract(dow FROM d) AS dow, extract(doy FROM d) AS doy, 0::BIGINT AS h FROM t"),
    "date_trunc_of_dates": ("SELECT event_id, date_trunc('week', d) AS w, date_trunc('quarter', d) AS q FROM t", "SELECT event_id, CAST(date_trunc('week', d) AS TIMESTAMP) AS w, CAST(date_trunc('quarter', d) AS TIMESTAMP) AS q FROM t"),
}


def _typed_sql(text: str):
    return lambda spark, sf_dir: Engine(spark, {"t": _typed(spark, sf_dir)}).sql(text)


def nested_group_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole group as one column, and --columns with a group's name: all its leaves."""
    e = Engine(spark, {"t": _typed(spark, sf_dir)})
    whole = e.sql("SELECT event_id, who FROM t").select("event_id", F.col("who.id").alias("id"), F.col("who.what.kind").alias("kind"))
    leaves = e.query("t", columns=["who", "event_id"])
    return whole.join(leaves.select("event_id", F.to_json("who.what").isNotNull().alias("whole")), "event_id")


def columns_in_schema_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(spark).query(f"{sf_dir}/orders.parquet", columns=["o_orderstatus", "o_totalprice", "o_custkey"])
    return df.select(F.lit(",".join(df.columns)).alias("names"), *df.columns)


def unordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.plans.parser import parse_sql

    e = Engine(spark, {"orders": f"{sf_dir}/orders.parquet"})
    both = [e.run(parse_sql("SELECT o_custkey, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey"), ordered=o) for o in (False, True)]
    return both[0].intersect(both[1])


# --- requests and the command line
def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    kind = T._parse_datatype_string(schema)
    return spark.createDataFrame([tuple(float(r[f.name]) if isinstance(f.dataType, T.DoubleType) else r[f.name] for f in kind.fields) for r in rows], kind)


def request_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Engine(spark).request({"inputs": [f"{sf_dir}/orders.parquet"], "filter": "o_totalprice > 1000", "aggregate": "count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS lo", "group_by": "o_orderstatus"})
    return _rows(spark, r["rows"], "o_orderstatus string, n long, s double, lo long")


def request_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Engine(spark).request({"sql": f"SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM '{sf_dir}/customer.parquet' GROUP BY c_nationkey HAVING count(*) > 1 ORDER BY 1"})
    return _rows(spark, r["rows"], "c_nationkey int, n long")


def request_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers answer partial requests, one for each slice of row groups; answers of another plan or schema are refused."""
    path = scratch(spark)
    sinks.write_parquet(_table(spark, sf_dir, "orders").repartition(3, "o_orderkey"), path, row_group_rows=200)
    files = [f.path for f in parquet.footers(spark, [path])]
    e, aggs, keys = Engine(spark), "count(*) AS n, avg(o_totalprice) AS a, max(o_orderpriority) AS p", "o_orderstatus"
    ask = lambda half, **more: e.request({"operation": "partial_aggregate", "partial": {"inputs": files, "row_groups": [half] * len(files), "aggregate": aggs, "group_by": keys, **more}})
    refused = ask([0, 1], plan_digest="other")
    if refused.get("error") != "PartialMismatch":
        raise AssertionError(refused)
    return e.merge_responses([ask([k, k + 1, 4]) for k in range(4)], aggs, keys, schema=e.partial(path, aggs, keys).schema)


def request_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    r, p = e.request({"operation": "capabilities"}), e.request({"operation": "prepare_aggregate", "aggregate": "avg(o_totalprice) AS a, count(*) AS n", "group_by": "o_orderstatus"})
    rows = [("formats", ",".join(r["formats"])), ("codecs", ",".join(r["codecs"])), ("merges", ",".join(a["merge"] for a in p["aggregates"])), ("groups", ",".join(p["groups"]))]
    return spark.createDataFrame(rows, "item string, value string")


def _command(*argv: str) -> tuple[int, str, str]:
    from strataq.__main__ import main

    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        code = main(list(argv))
    return code, out.getvalue(), err.getvalue()


def cli_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, out, err = _command("query", f"{sf_dir}/lineitem.parquet", "--filter", "l_quantity < 10", "--group-by", "l_returnflag", "--aggregate", "count(*) AS n", "--summary=json")
    s = json.loads(err.strip().splitlines()[-1])
    if code or len(out.splitlines()) != s["rows"]:
        raise AssertionError(err)
    return spark.createDataFrame([(s["rows"], s["rows_in"], s["rows_scanned"], s["rows_matched"])], "n_rows long, rows_in long, rows_scanned long, rows_matched long")


def cli_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer with statistics used, not used, and trusted."""
    rows = []
    for flag in ("--threads=2", "--scan-all", "--trust-stats"):
        code, out, err = _command("query", f"{sf_dir}/orders.parquet", "--aggregate", "count(*) AS n, min(o_orderkey) AS lo, max(o_custkey) AS hi", flag)
        if code:
            raise AssertionError(err)
        rows.append((flag, *json.loads(out).values()))
    return spark.createDataFrame(rows, "flag string, n long, lo long, hi long")


def cli_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for parts in (["--columns", "r_name"], ["--aggregate", "count(*) AS n"], ["--aggregate", "count(*) AS n", "--group-by", "r_name"]):
        code, out, err = _command("query", f"{sf_dir}/region.parquet", *parts, "--explain")
        if code:
            raise AssertionError(err)
        found = json.loads(out)
        rows.append((found["kind"], ",".join(found["columns"])))
    return spark.createDataFrame(rows, "kind string, names string")


def cli_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/region.parquet"
    cases = {
        "good": (path,), "no file": (f"{sf_dir}/none.parquet",), "modulo": (path, "--filter", "r_regionkey % 2 = 0"), "sql and parts": ("--query", "SELECT 1", "--filter", "a = 1"),
        "aggregate and select": (path, "--aggregate", "count(*)", "--select", "r_name"), "order without keys": (path, "--column-order", "r_name"), "two limits": ("--query", f"SELECT r_name FROM '{path}' LIMIT 1", "--limit", "2"),
        "bad format": (path, "--format", "xml"), "parquet to stdout": (path, "--format", "parquet"), "output is input": (path, "-o", path), "bad size": (path, "--max-memory", "12Q"),
    }
    rows = [(k, _command("query", *v)[0]) for k, v in cases.items()]

    class Closed(io.StringIO):
        def write(self, s: str) -> int:
            raise BrokenPipeError

    from strataq.__main__ import main

    with contextlib.redirect_stdout(Closed()), contextlib.redirect_stderr(io.StringIO()):
        rows.append(("closed pipe", main(["query", path])))
    return spark.createDataFrame(rows, "name string, code int")


# --- refusals: (name, SQL over orders, the error's name)
REFUSED: dict[str, list[tuple[str, str, str]]] = {
    "refuse_relations": [
        ("join", "SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "JoinNotSupported"),
        ("comma", "SELECT o_orderkey FROM orders, lineitem", "JoinNotSupported"),
        ("subquery", "SELECT o_orderkey FROM (SELECT * FROM orders)", "SubqueryNotSupported"),
        ("in subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)", "SubqueryNotSupported"),
        ("union", "SELECT o_orderkey FROM orders UNION SELECT o_custkey FROM orders", "SetOperationNotSupported"),
        ("intersect", "SELECT o_orderkey FROM orders INTERSECT SELECT o_custkey FROM orders", "SetOperationNotSupported"),
        ("distinct", "SELECT DISTINCT o_custkey FROM orders", "DistinctNotSupported"),
        ("with", "WITH a AS (SELECT 1) SELECT * FROM a", "CteNotSupported"),
        ("insert", "INSERT INTO orders VALUES (1)", "NotASelect"),
        ("two", "SELECT o_orderkey FROM orders; SELECT o_custkey FROM orders", "MultipleStatements"),
    ],
    "refuse_windows": [
        ("over", "SELECT row_number() OVER (ORDER BY o_orderkey) AS n FROM orders", "WindowNotSupported"),
        ("sum over", "SELECT sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders", "WindowNotSupported"),
    ],
    "refuse_predicates": [
        ("two columns", "SELECT o_orderkey FROM orders WHERE o_orderkey = o_custkey", "ColumnComparison"),
        ("expression", "SELECT o_orderkey FROM orders WHERE o_orderkey + 1 > 5", "ExpressionInPredicate"),
        ("modulo", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0", "ModuloNotSupported"),
        ("fraction", "SELECT o_orderkey FROM orders WHERE o_orderkey = 1.5", "BadValue"),
        ("text", "SELECT o_orderkey FROM orders WHERE o_orderkey = 'x'", "BadValue"),
        ("is true", "SELECT o_orderkey FROM orders WHERE o_orderkey IS TRUE", "UnsupportedPredicate"),
        ("escape", "SELECT o_orderkey FROM orders WHERE o_orderstatus LIKE 'a!%' ESCAPE '!'", "UnsupportedPredicate"),
        ("glob", "SELECT o_orderkey FROM orders WHERE o_orderstatus GLOB 'a*'", "UnsupportedPredicate"),
        ("aggregate", "SELECT o_custkey, count(*) AS n FROM orders WHERE count(*) > 1 GROUP BY o_custkey", "AggregateInWhere"),
    ],
    "refuse_aggregates": [
        ("sum distinct", "SELECT sum(DISTINCT o_custkey) AS s FROM orders", "DistinctNotSupported"),
        ("median", "SELECT median(o_totalprice) AS m FROM orders", "UnknownFunction"),
        ("sum of text", "SELECT sum(o_orderstatus) AS s FROM orders", "TypeMismatch"),
        ("arithmetic", "SELECT sum(o_custkey) + 1 AS s FROM orders", "AggregateArithmetic"),
        ("not grouped", "SELECT o_custkey, o_orderkey FROM orders GROUP BY o_custkey", "NotGrouped"),
        ("bare column", "SELECT o_custkey, count(*) AS n FROM orders", "NotGrouped"),
        ("having rows", "SELECT o_custkey FROM orders HAVING o_custkey > 1", "HavingWithoutAggregate"),
    ],
    "refuse_functions": [
        ("upper", "SELECT upper(o_orderstatus) AS u FROM orders", "UnknownFunction"),
        ("own", "SELECT my_function(o_orderkey) AS u FROM orders", "UnknownFunction"),
        ("cast", "SELECT CAST(o_orderkey AS VARCHAR) AS u FROM orders", "CastNotSupported"),
        ("arity", "SELECT strlen(o_orderstatus, o_orderstatus) AS u FROM orders", "WrongArity"),
        ("regex lookahead", "SELECT regexp_replace(o_orderstatus, '(?=F)', 'x') AS u FROM orders", "UnsupportedRegex"),
        ("regex backreference", "SELECT regexp_replace(o_orderstatus, '(F)\\1', 'x') AS u FROM orders", "UnsupportedRegex"),
        ("regex possessive", "SELECT regexp_replace(o_orderstatus, 'F*+', 'x') AS u FROM orders", "BadRegex"),
        ("regex option", "SELECT regexp_replace(o_orderstatus, 'F', 'x', 'q') AS u FROM orders", "BadRegexOption"),
        ("regex group", "SELECT regexp_replace(o_orderstatus, 'F', '\\1') AS u FROM orders", "BadRegex"),
        ("part", "SELECT date_trunc('decade', o_orderdate) AS u FROM orders", "UnknownDatePart"),
        ("scale", "SELECT " + " * ".join(["0.00001"] * 8) + " AS u FROM orders", "DecimalScaleTooLarge"),
    ],
    "refuse_order": [
        ("nulls first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey NULLS FIRST", "NullsFirstNotSupported"),
        ("position", "SELECT o_orderkey FROM orders ORDER BY 2", "BadPosition"),
        ("name", "SELECT o_orderkey FROM orders ORDER BY o_nothing", "ColumnNotFound"),
    ],
    "refuse_depth": [
        ("value", "SELECT " + "(" * 400 + "o_orderkey" + ")" * 400 + " AS k FROM orders", "ExpressionTooDeep"),
        ("predicate", "SELECT o_orderkey FROM orders WHERE " + "NOT (" * 400 + "o_orderkey = 1" + ")" * 400, "ExpressionTooDeep"),
    ],
}


def _refusals(cases: list[tuple[str, str, str]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer")})
        rows = []
        for name, sql, _ in cases:
            try:
                e.sql(sql)
                rows.append((name, "accepted"))
            except QueryError as x:
                rows.append((name, x.code))
        return spark.createDataFrame(rows, "name string, code string")

    return run


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


_NUMBER = r"regexp_replace({}::VARCHAR, '\.0$', '')"
OTHERS = {
    input_order_rows: "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 2 ORDER BY o_orderkey LIMIT 25",
    input_order_groups: "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS DECIMAL(38,0)) AS s FROM orders GROUP BY o_custkey ORDER BY min(((o_orderkey + 1) % 3) * 1000000000000 + o_orderkey) LIMIT 20",
    input_order_filtered: "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY (o_orderkey + 2) % 3, o_orderkey LIMIT 30",
    input_glob: "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 1",
    input_row_groups: "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, max(l_shipdate) AS hi, avg(l_linenumber) AS m FROM lineitem GROUP BY l_returnflag",
    input_encodings: "SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END::BIGINT AS big FROM orders",
    input_codecs: f"SELECT c_mktsegment, {len(sinks.CODECS)} * count(*) AS n, count(DISTINCT c_custkey) AS d, min(c_name) AS lo FROM customer GROUP BY c_mktsegment",
    report_schema: "SELECT column_name, column_type FROM (DESCRIBE lineitem)",
    report_inspect: "SELECT 6::BIGINT AS columns, count(*) AS n, count(*) AS in_groups, 6::BIGINT AS leaves FROM (SELECT 1 FROM orders UNION ALL SELECT 1 FROM part)",
    report_conform: "SELECT column_name, 'ok' AS state FROM (DESCRIBE customer)",
    sink_ndjson: f"""SELECT '{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_acctbal":' || {_NUMBER.format("c_acctbal")} || ',"seg":' || coalesce('"' || CASE WHEN c_nationkey > 12 THEN c_mktsegment END || '"', 'null') || '}}' AS line FROM customer""",
    sink_ndjson_types: """SELECT '{"event_id":' || event_id || ',"ts":' || epoch_us(ts) || ',"d":' || (ts::DATE - DATE '1970-01-01') || ',"p":' || value::DECIMAL(12,3) || ',"b":' || (value > 50) || ',"g":{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}' AS line FROM events""",
    sink_csv: f"""SELECT event_id || ',' || event_type || ',' || coalesce({_NUMBER.format("CASE WHEN event_id > 20 THEN value END")}, '') || ',' || CASE WHEN props = '' OR props LIKE '%"%' OR props LIKE '%,%' THEN '"' || replace(props, '"', '""') || '"' ELSE props END || ',' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS line FROM events""",
    sink_json: """SELECT '[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_name DESC) || ']' || chr(10) AS document FROM region""",
    sink_aggregate_parquet: "SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, sum(l_quantity) AS q__sum, count(l_quantity) AS q__count FROM lineitem GROUP BY l_suppkey",
    sink_footer: "SELECT column_name AS path, column_name IN ('c_custkey', 'c_name') AS bloom, true AS page_index, true AS stats, 'GZIP' AS codec FROM (DESCRIBE customer)",
    sink_row_groups: "SELECT count(*) AS n, true AS fits FROM orders",
    sink_arrow: "SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS hi, avg(o_totalprice) AS a FROM orders GROUP BY o_orderpriority",
    nested_group_whole: "SELECT event_id, user_id AS id, event_type AS kind, true AS whole FROM events",
    columns_in_schema_order: "SELECT 'o_custkey,o_orderstatus,o_totalprice' AS names, o_custkey, o_orderstatus, o_totalprice FROM orders",
    unordered_groups: "SELECT o_custkey, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey",
    request_groups: "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS lo FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus",
    request_sql: "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1",
    request_fanout: "SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS a, max(o_orderpriority) AS p FROM orders GROUP BY o_orderstatus",
    request_capabilities: _values([("formats", ",".join(sinks.FORMATS)), ("codecs", ",".join(sinks.CODECS)), ("merges", "avg_state,sum"), ("groups", "o_orderstatus")], "item, value"),
    cli_summary: "SELECT count(DISTINCT l_returnflag) AS n_rows, (SELECT count(*) FROM lineitem) AS rows_in, (SELECT count(*) FROM lineitem) AS rows_scanned, count(*) AS rows_matched FROM lineitem WHERE l_quantity < 10",
    cli_statistics: "SELECT flag, n, lo, hi FROM (SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_custkey) AS hi FROM orders), (VALUES ('--threads=2'), ('--scan-all'), ('--trust-stats')) AS f(flag)",
    cli_explain: _values([("rows", "r_name"), ("scalar", "n"), ("grouped", "r_name,n")], "kind, names"),
    cli_exit_codes: _values([("good", 0), ("no file", 1), ("modulo", 2), ("sql and parts", 2), ("aggregate and select", 2), ("order without keys", 2), ("two limits", 2), ("bad format", 2), ("parquet to stdout", 2), ("output is input", 2), ("bad size", 2), ("closed pipe", 141)], "name, code"),
}


def queries() -> dict:
    out = {f.__name__: f for f in OTHERS}
    out |= {k: _typed_sql(ours) for k, (ours, _) in TYPED.items()}
    return out | {k: _refusals(cases) for k, cases in REFUSED.items()}


def oracle_sql() -> dict[str, str]:
    out = {f.__name__: sql for f, sql in OTHERS.items()}
    out |= {k: (theirs or ours).replace("FROM t", f"FROM {_TYPED}") for k, (ours, theirs) in TYPED.items()}
    return out | {k: _values([(n, c) for n, _, c in cases], "name, code") for k, cases in REFUSED.items()}
