"""The command line: python -m strataq query|schema|inspect|conform ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from contextlib import contextmanager

from strataq.plans.errors import DataError, QueryError


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataq")
    sub = top.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("inputs", nargs="*")
    for name in ("query", "filter", "columns", "select", "aggregate", "group-by", "column-order", "codec", "format", "max-memory", "row-group-bytes", "profile"):
        q.add_argument(f"--{name}")
    q.add_argument("--output", "-o")
    q.add_argument("--limit", type=int)
    q.add_argument("--threads", "-j", type=int)
    q.add_argument("--row-group-size", type=int)
    q.add_argument("--compress-priority", choices=("size", "speed"))
    q.add_argument("--parquet-version", choices=("v1", "v2"))
    q.add_argument("--bloom-filter", action="append", default=[])
    q.add_argument("--summary", choices=("json",))
    for name in ("scan-all", "trust-stats", "fast-levels", "unordered", "cache", "no-bloom-filters", "explain", "fsync", "no-fsync", "single-file"):
        q.add_argument(f"--{name}", action="store_true")
    sub.add_parser("schema").add_argument("path")
    i = sub.add_parser("inspect")
    i.add_argument("paths", nargs="+")
    i.add_argument("--format", choices=("json",))
    i.add_argument("--detail", action="store_true")
    sub.add_parser("conform").add_argument("path")
    return top


def size(text: str) -> int:
    """Bytes, or a number with K, M, G or T and an optional B, in powers of 1024."""
    import re

    m = re.fullmatch(r"(\d+(?:\.\d+)?)([KMGT]?)(B?)", text, re.I)
    if not m or (m[3] and not m[2]):
        raise QueryError("BadSize", text)
    return int(float(m[1]) * 1024 ** " KMGT".index(m[2].upper() or " "))


def _session(a: argparse.Namespace):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("strataq").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    if "SPARK_MASTER" not in os.environ:
        b = b.master(f"local[{getattr(a, 'threads', None) or '*'}]").config("spark.sql.shuffle.partitions", "16")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def _settings(spark, a: argparse.Namespace, kind: str):
    """What --scan-all and --trust-stats set for one query.

    Spark answers from statistics in its second reader only, which knows no places of rows; so only for one-row answers.
    """
    wanted = {}
    if a.scan_all:
        wanted |= {"spark.sql.parquet.filterPushdown": "false"}
    elif a.trust_stats and kind == "scalar":
        wanted |= {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _scanned(spark, most: int) -> int:
    """Rows that the last run's scans gave: those of the row groups that statistics did not rule out."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    n = store.executionsCount()
    if not n:
        return most
    last = store.executionsList(int(n) - 1, 1).head().executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    total, known = 0, False
    for i in range(nodes.size()):
        node = nodes.apply(i)
        if not node.name().startswith("Scan parquet"):
            continue
        for k in range(node.metrics().size()):
            m = node.metrics().apply(k)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                total, known = total + int(values.apply(m.accumulatorId()).replace(",", "")), True
    return min(total, most) if known else most


def _query(a: argparse.Namespace) -> int:
    from strataq.api import Engine, build
    from strataq.plans.parser import parse_sql
    from strataq.sources import sinks

    began = time.monotonic()
    parts = (a.filter, a.columns, a.select, a.aggregate, a.group_by, a.column_order)
    if a.query and (a.inputs or any(parts)):
        raise QueryError("ConflictingOptions", "SQL goes without inputs and parts")
    if not a.query and not a.inputs:
        raise QueryError("NoInput", "no input was named")
    if a.query:
        q, source = parse_sql(a.query), None
        if a.limit is not None:
            if q.limit is not None:
                raise QueryError("ConflictingOptions", "LIMIT and --limit")
            q.limit = a.limit
    else:
        names = [c.strip() for c in a.columns.split(",")] if a.columns else None
        order = [c.strip() for c in a.column_order.split(",")] if a.column_order else None
        q, source = build(filter=a.filter, columns=names, select=a.select, aggregate=a.aggregate, group_by=a.group_by, column_order=order, limit=a.limit), a.inputs
    form = {"jsonl": "ndjson", None: None}.get(a.format, a.format)
    named = a.output not in (None, "-")
    form = form or ("parquet" if named else "ndjson")
    if form not in sinks.FORMATS:
        raise QueryError("BadFormat", form)
    if a.max_memory:
        size(a.max_memory)
    if form == "parquet" and not named:
        raise QueryError("OutputNeeded", "Parquet goes to a file: -o FILE")
    spark = _session(a)
    engine = Engine(spark)
    with _settings(spark, a, q.kind):
        return _answer(a, spark, engine, q, source, form, named, began)


def _answer(a: argparse.Namespace, spark, engine, q, source, form: str, named: bool, began: float) -> int:
    from strataq.plans.ast import Agg, Item, Query
    from strataq.sources import sinks

    source = source if source is not None else q.source
    files = engine.files(source)
    df = engine.run(q, source, ordered=not a.unordered, copy=form == "parquet")
    if a.explain:
        print(json.dumps({"kind": q.kind, "columns": df.columns, "plan": df._jdf.queryExecution().toString()}))
        return 0
    rows = 0
    if form == "parquet":
        bloom = {c: float(p or 0.01) for c, _, p in (b.partition(":") for b in a.bloom_filter)}
        level = {"size": 3, "speed": 1, None: None}[a.compress_priority]
        sinks.write_parquet(
            df, a.output, codec=a.codec or "snappy", single=a.single_file, bloom=bloom, row_group_bytes=size(a.row_group_bytes) if a.row_group_bytes else None,
            row_group_rows=a.row_group_size, version=a.parquet_version, level=level, narrow=q.kind != "rows", inputs=[f.path for f in files],
        )
    elif named:
        sinks.refuse_alias(a.output, [f.path for f in files])
        temp = f"{a.output}.strataq-{os.getpid()}"
        try:
            with open(temp, "w", encoding="utf-8", newline="") as f:
                rows = sinks.write_text(df, form, f)
            os.replace(temp, a.output)
        finally:
            if os.path.exists(temp):
                os.remove(temp)
    else:
        rows = sinks.write_text(df, form, sys.stdout)
        sys.stdout.flush()
    if a.summary:
        rows_in = sum(f.rows for f in files)
        scanned = _scanned(spark, rows_in)
        if form == "parquet":
            rows = sum(f.rows for f in engine.files(a.output))
        elif form != "ndjson":
            rows -= 1 if form == "csv" else 2
        if q.where is None:
            kept = scanned
        elif q.kind == "rows" and q.limit is None and not q.offset:
            kept = rows
        else:  # one more pass, over the columns of the filter alone
            kept = engine.run(Query(items=[Item(Agg("count", None), "n")], where=q.where), source).first()[0]
        out = {"type": "summary", "ok": True, "rows": rows, "rows_in": rows_in, "rows_scanned": max(scanned, kept), "rows_matched": kept, "output": a.output if named else None, "codec": (a.codec or "snappy").upper() if form == "parquet" else None, "total_ms": int((time.monotonic() - began) * 1000)}
        print(json.dumps(out), file=sys.stderr)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.command == "query":
            return _query(a)
        from strataq.sources import inspect

        spark = _session(a)
        if a.command == "inspect":
            print(json.dumps([inspect.inspect(spark, p, detail=a.detail) for p in a.paths], default=str))
            return 0
        if a.command == "schema":
            print(inspect.schema(spark, a.path), end="")
            return 0
        found = inspect.conform(spark, a.path)
        print(json.dumps(found))
        return int(any(v != "ok" for v in found.values()))
    except BrokenPipeError:
        sys.stderr.close()
        return 141
    except QueryError as e:
        text = json.dumps({"type": "error", "ok": False, "code": e.code, "message": e.message}) if getattr(a, "summary", None) else f"strataq: {e}"
        print(text, file=sys.stderr)
        return 1 if isinstance(e, DataError) else 2
    except Exception as e:
        line = str(e).split("\n")[0]
        print(json.dumps({"type": "error", "ok": False, "code": "Failed", "message": line}) if getattr(a, "summary", None) else f"strataq: {line}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
