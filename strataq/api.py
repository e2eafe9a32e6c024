"""The engine: SQL, the parts of a query, JSON-like requests, partial aggregates."""

from __future__ import annotations

import hashlib
import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.operators.query import ORDINAL, execute, needs_place
from strataq.plans.ast import Agg, Col, Item, Lit, Query
from strataq.plans.errors import DataError, QueryError
from strataq.plans.parser import parse_items, parse_predicate, parse_sql
from strataq.sources import parquet, sinks

PLAN_VERSION = 1
MERGES = {"count": "sum", "sum": "sum", "min": "min", "max": "max", "avg": "avg_state"}


def build(*, filter: str | None = None, columns: list[str] | None = None, select: str | None = None, aggregate: str | None = None, group_by: str | None = None, column_order: list[str] | None = None, limit: int | None = None) -> Query:
    """A query from its parts, as the command line and requests give them."""
    if (aggregate or group_by) and (select or columns):
        raise QueryError("ConflictingOptions", "aggregates go without a selection of columns")
    if select and columns:
        raise QueryError("ConflictingOptions", "columns or select, not both")
    if column_order and not group_by:
        raise QueryError("ConflictingOptions", "a column order needs a group-by")
    q = Query(columns=columns or None, limit=limit, column_order=column_order)
    if filter:
        q.where = parse_predicate(filter)
    if select:
        q.items = parse_items(select)
        for i in q.items:
            if not isinstance(i.expr, Col) and not i.alias:
                raise QueryError("AliasNeeded", f"{i.text} needs AS name")
    if group_by:
        q.group = parse_items(group_by)
    if aggregate:
        made = parse_items(aggregate)
        if not all(isinstance(i.expr, Agg) for i in made):
            raise QueryError("NotAnAggregate", "a list of aggregates is needed")
        q.items = [Item(g.expr, g.alias, g.text) for g in q.group] + made
    elif group_by:
        q.items = [Item(g.expr, g.alias, g.text) for g in q.group]
    return q


class Engine:
    """Queries over Parquet files. tables: names for FROM beside paths."""

    def __init__(self, spark: SparkSession, tables: dict[str, str | list[str] | DataFrame] | None = None):
        self.spark = spark
        self.tables = dict(tables or {})

    def _open(self, source: str | list[str] | DataFrame, exact: bool) -> tuple[DataFrame, list[parquet.File]]:
        if isinstance(source, str) and source in self.tables:
            source = self.tables[source]
        if isinstance(source, DataFrame):
            return source, []
        inputs = [source] if isinstance(source, str) else list(source)
        schema, files = parquet.opened(self.spark, parquet.expand(self.spark, inputs), exact)
        return parquet.read_files(self.spark, schema, files), files

    def files(self, source: str | list[str] | DataFrame) -> list[parquet.File]:
        """The files of an input with what their footers say; none for a DataFrame."""
        return self._open(source, False)[1]

    def run(self, q: Query, source: str | list[str] | DataFrame | None = None, *, ordered: bool = False, copy: bool = False) -> DataFrame:
        """The answer as a DataFrame. ordered: rows in input order, groups by first appearance, also without a LIMIT."""
        source = source if source is not None else q.source
        if source is None:
            raise QueryError("NoInput", "no input was named")
        df, files = self._open(source, q.kind == "rows")
        if not files or not needs_place(q, ordered):
            return execute(df, q, ordered=ordered, copy=copy)
        most = None
        if q.kind == "rows" and q.limit is not None and not q.order:
            files, most = self._needed(df, q, files)
            df = parquet.read_files(self.spark, df.schema, files)
        df = parquet.with_ordinal(self.spark, df, files, ORDINAL)
        place = F.col(ORDINAL)
        return execute(df if most is None else df.where(place < most), q, ordinal=place, ordered=ordered, copy=copy)

    def _needed(self, df: DataFrame, q: Query, files: list[parquet.File]) -> tuple[list[parquet.File], int | None]:
        """The first files that hold the rows of a LIMIT without an order, and the place where those rows end.

        Footers tell without a filter. With one, the first file, the first two, four, ... are tried until they fill the
        limit, so files far behind the last row wanted are never read.
        """
        rows = q.limit + (q.offset or 0)
        if q.where is None:
            some = parquet.first_files(files, rows)
            return some, parquet.place_after(some, rows)
        n = 1
        while n < len(files):
            part = parquet.read_files(self.spark, df.schema, files[:n])
            if execute(part, Query(items=[Item(Lit(1), "n")], where=q.where)).limit(rows).count() >= rows:
                return files[:n], None
            n *= 2
        return files, None

    def sql(self, text: str, *, ordered: bool = False) -> DataFrame:
        return self.run(parse_sql(text), ordered=ordered)

    def query(self, source: str | list[str], *, ordered: bool = False, copy: bool = False, **parts: Any) -> DataFrame:
        return self.run(build(**parts), source, ordered=ordered, copy=copy)

    def arrow(self, text: str):
        """The answer as a PyArrow table, in order."""
        return self.sql(text, ordered=True).toArrow()

    def text(self, text: str, form: str = "ndjson") -> str:
        return "".join(sinks.lines(self.sql(text, ordered=True), form))

    def explain(self, text: str) -> dict[str, Any]:
        """Kind and plan, without reading data."""
        q = parse_sql(text)
        df = self.run(q)
        return {"kind": q.kind, "columns": df.columns, "plan": df._jdf.queryExecution().toString()}

    # --- partial aggregates
    def prepare(self, aggregate: str, group_by: str | None = None) -> dict[str, Any]:
        """Which partial columns an aggregate has (_a0, ... and keys _g0, ...), and how they merge."""
        q = build(aggregate=aggregate, group_by=group_by)
        aggs = q.items[len(q.group) :]
        for a in aggs:
            if a.expr.fn not in MERGES:
                raise QueryError("PartialNotMergeable", f"{a.expr.fn} has no partial form")
        name = lambda i: i.alias or (i.expr.fn if isinstance(i.expr, Agg) else i.text)
        plan = {"aggregates": [{"merge": MERGES[a.expr.fn], "name": name(a)} for a in aggs], "groups": [name(g) for g in q.group]}
        digest = hashlib.sha256(json.dumps([plan, aggregate, group_by]).encode()).hexdigest()[:32]
        return plan | {"plan_version": PLAN_VERSION, "plan_digest": digest}

    def partial(self, source: str | list[str] | DataFrame, aggregate: str, group_by: str | None = None, filter: str | None = None) -> DataFrame:
        """One worker's share: _g{i} and _a{i}; an average is its state (sum, count)."""
        self.prepare(aggregate, group_by)
        q = build(aggregate=aggregate, group_by=group_by, filter=filter)
        n = len(q.group)
        items = [Item(i.expr, f"_g{k}", i.text) for k, i in enumerate(q.items[:n])]
        for k, i in enumerate(q.items[n:]):
            e = i.expr
            items.append(Item(Agg("avg_state", e.arg, e.where) if e.fn == "avg" else e, f"_a{k}", i.text))
        q.items = items
        q.group = [Item(g.expr) for g in q.group]
        return self.run(q, source)

    def merge_responses(self, responses: list[dict[str, Any]], aggregate: str, group_by: str | None = None, *, schema: T.StructType) -> DataFrame:
        """The whole answer from the answers to partial_aggregate requests; all must be of this plan and of one schema.

        schema: of a partial answer, as partial() has it; rows come as JSON.
        """
        plan = self.prepare(aggregate, group_by)
        first = responses[0]
        for r in responses:
            if not r.get("ok"):
                raise DataError(r.get("error", "PartialFailed"), r.get("message", ""))
            if r["plan_digest"] != plan["plan_digest"] or r["schema_fingerprint"] != first["schema_fingerprint"]:
                raise QueryError("PartialMismatch", "answers of another plan or schema")
        rows = [sinks.from_json(x, schema) for r in responses for x in r["rows"]]
        return self.merge([self.spark.createDataFrame(rows, schema)], aggregate, group_by)

    def merge(self, partials: list[DataFrame], aggregate: str, group_by: str | None = None) -> DataFrame:
        """The whole answer from partial answers."""
        plan = self.prepare(aggregate, group_by)
        whole = partials[0]
        for p in partials[1:]:
            whole = whole.unionByName(p)
        aggs = []
        for k, a in enumerate(plan["aggregates"]):
            c = F.col(f"_a{k}")
            if a["merge"] == "avg_state":
                t = whole.schema[f"_a{k}"].dataType["sum"].dataType
                total, count = F.sum(c["sum"]), F.sum(c["count"])
                out = total / F.nullif(count, F.lit(0)).cast("double" if isinstance(t, T.DoubleType) else T.DecimalType(19, 0))
            elif a["merge"] == "sum":
                t = whole.schema[f"_a{k}"].dataType
                out = F.sum(c).cast(T.DecimalType(38, t.scale)) if isinstance(t, T.DecimalType) else F.sum(c)
            else:
                out = (F.min if a["merge"] == "min" else F.max)(c)
            aggs.append(out.alias(a["name"]))
        keys = [F.col(f"_g{k}").alias(n) for k, n in enumerate(plan["groups"])]
        return whole.groupBy(*keys).agg(*aggs) if keys else whole.agg(*aggs)

    def schema_fingerprint(self, source: str | list[str]) -> str:
        df, _ = self._open(source, False)
        return hashlib.sha256(repr(parquet._shape(df.schema, False)).encode()).hexdigest()[:32]

    # --- requests
    def request(self, r: dict[str, Any]) -> dict[str, Any]:
        """One JSON-like request; the answer is {"ok": true, "rows": [...]} or {"ok": false, "error": ..., "message": ...}."""
        began = time.monotonic()
        try:
            out = self._request({k: v for k, v in r.items() if v is not None})
        except QueryError as e:
            return {"ok": False, "error": e.code, "message": e.message}
        return {"ok": True} | out | {"total_ms": int((time.monotonic() - began) * 1000)}

    def _request(self, r: dict[str, Any]) -> dict[str, Any]:
        op = r.get("operation")
        if op == "capabilities":
            return {"plan_versions": [PLAN_VERSION], "partial_aggregate_version": 1, "formats": list(sinks.FORMATS), "codecs": list(sinks.CODECS)}
        if op == "prepare_aggregate":
            return self.prepare(r["aggregate"], r.get("group_by"))
        if op == "partial_aggregate":
            p = r.get("partial") or {}
            if {"sql", "select", "columns", "column_order", "output_url"} & (set(r) | set(p)):
                raise QueryError("BadFieldType", "a partial aggregate takes inputs, aggregate, group_by and filter")
            source = parquet.open_slices(self.spark, p["inputs"], p["row_groups"]) if p.get("row_groups") else p["inputs"]
            plan, print_ = self.prepare(p["aggregate"], p.get("group_by")), self.schema_fingerprint(p["inputs"])
            for name, own in (("plan_version", plan["plan_version"]), ("plan_digest", plan["plan_digest"]), ("schema_fingerprint", print_)):
                if p.get(name, own) != own:
                    raise QueryError("PartialMismatch", f"{name} is {own} here, not {p[name]}")
            df = self.partial(source, p["aggregate"], p.get("group_by"), p.get("filter"))
            return plan | {"partial_version": 1, "schema_fingerprint": print_, "rows": self._rows(df)}
        if op is not None:
            raise QueryError("UnknownOperation", str(op))
        if "sql" in r:
            if "row_groups" in r:
                raise QueryError("BadFieldType", "row_groups goes without sql")
            df = self.sql(r["sql"], ordered=r.get("ordered", True))
        else:
            source = r.get("inputs") or ([r["s3_url"]] if "s3_url" in r else None)
            if not source:
                raise QueryError("MissingField", "inputs, s3_url or sql")
            names = [c.strip() for c in r.get("columns", []) if c.strip()]
            order = r["column_order"].split(",") if isinstance(r.get("column_order"), str) else r.get("column_order")
            q = build(filter=r.get("filter"), columns=names, select=r.get("select"), aggregate=r.get("aggregate"), group_by=r.get("group_by"), column_order=order, limit=r.get("limit"))
            if "row_groups" in r:
                source = parquet.open_slices(self.spark, list(source), r["row_groups"])
            df = self.run(q, source, ordered=r.get("ordered", True), copy="output_url" in r)
        if "output_url" in r:
            codec = r.get("output_codec", "snappy")
            bloom = {c: float(p or 0.01) for c, _, p in (b.partition(":") for b in r.get("bloom_filters", []))}
            sinks.write_parquet(df, r["output_url"], codec=codec if codec in sinks.CODECS else "snappy", bloom=bloom, narrow=True, inputs=df.inputFiles())
            return {"output": r["output_url"]}
        return {"rows": self._rows(df)}

    def _rows(self, df: DataFrame) -> list[dict[str, Any]]:
        from decimal import Decimal

        return [json.loads(line, parse_float=Decimal) for line in sinks.lines(df, "ndjson")]
