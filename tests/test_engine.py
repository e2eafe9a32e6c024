"""Answers on small files with nulls, NaN, decimals, nested columns; outputs; requests; the command line."""

import datetime as dt
import json
import math
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strataq.__main__ import main
from strataq.api import Engine
from strataq.plans.errors import QueryError
from strataq.sources import inspect

D = Decimal


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    n = 60
    main_table = pa.table(
        {
            "id": pa.array(range(-10, n - 10), pa.int64()),
            "k": pa.array([["b", "a", None, "c"][i % 4] for i in range(n)]),
            "amt": pa.array([None if i % 11 == 0 else i / 4 for i in range(n)], pa.float64()),
            "f": pa.array([i / 10 for i in range(n)], pa.float32()),
            "price": pa.array([D(i).scaleb(-2) for i in range(n)], pa.decimal128(9, 2)),
            "d": pa.array([dt.date(1969, 12, 1) + dt.timedelta(days=i) for i in range(n)]),
            "flag": pa.array([None if i % 5 == 0 else i % 2 == 0 for i in range(n)]),
            "ts": pa.array([dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=1500 * i) for i in range(n)], pa.timestamp("us")),
            "name": pa.array([["a%", "O'Brien", "x\\y", "", None, "a OR b"][i % 6] for i in range(n)]),
        }
    )
    pq.write_table(main_table, d / "main.parquet", row_group_size=16)
    pq.write_table(pa.table({"x": [1.0, 2.0, math.nan, 3.0], "i": [1, 2, 3, 4]}), d / "nan.parquet")
    r = [{"key": i, "name": f"n{i}"} for i in range(5)]
    pq.write_table(pa.table({"r": r, "key": pa.array(range(100, 105)), "tags": [[1], [2], [], None, [5]]}), d / "nested.parquet")
    for i, keys in enumerate((["z", "y", "z"], ["x", "y", "w"])):
        pq.write_table(pa.table({"k": keys, "v": [i * 3 + j for j in range(3)]}), d / f"order{i}.parquet")
    return d


@pytest.fixture
def q(spark, files):
    e = Engine(spark, {p.stem: str(p) for p in files.iterdir()})
    return lambda text, **a: [tuple(r) for r in e.sql(text, **a).collect()]


def test_three_valued_logic(q):
    assert q("SELECT count(*) FROM main WHERE amt > 5 OR NOT amt > 5") == [(54,)]
    assert q("SELECT count(*) FROM main WHERE id NOT IN (1, NULL)") == [(0,)]
    assert q("SELECT count(*) FROM main WHERE id IN (1, NULL)") == [(1,)]
    assert q("SELECT count(*) FROM main WHERE NOT (id BETWEEN 0 AND NULL)") == [(10,)]
    assert q("SELECT count(*) FROM main WHERE name LIKE NULL") == [(0,)]
    assert q("SELECT count(*) FROM main WHERE flag") == [(24,)]
    assert q("SELECT count(*) FROM main WHERE NOT flag") == [(24,)]


def test_like_has_no_escape(q):
    assert q("SELECT count(*) FROM main WHERE name LIKE 'x\\_'") == [(10,)]
    assert q("SELECT count(*) FROM main WHERE name LIKE 'a%'") == [(20,)]


def test_nan_is_above_every_number(q):
    assert q("SELECT i FROM nan WHERE x > 5") == [(3,)]
    assert sorted(q("SELECT i FROM nan WHERE NOT x < 2.5")) == [(3,), (4,)]
    assert sorted(q("SELECT i FROM nan WHERE x <> 2")) == [(1,), (3,), (4,)]
    assert q("SELECT i FROM nan WHERE x BETWEEN 2 AND 100") == [(2,), (4,)]
    assert math.isnan(q("SELECT max(x) FROM nan")[0][0]) and q("SELECT i FROM nan ORDER BY x DESC LIMIT 1") == [(3,)]


def test_literals_meet_column_types(q):
    assert q("SELECT id FROM main WHERE f = 0.1") == [(-9,)]
    assert q("SELECT count(*) FROM main WHERE price > 0.105") == [(49,)]
    assert q("SELECT count(*) FROM main WHERE price = 0.105") == [(0,)]
    assert q("SELECT count(*) FROM main WHERE id < 99999999999999999999") == [(60,)]
    assert q("SELECT count(*) FROM main WHERE d = '1970-01-01 12:00:00'") == [(1,)]
    assert q("SELECT count(*) FROM main WHERE ts <= '2024-01-01 00:00:01.500000001'") == [(2,)]
    for bad in ("id = 1.5", "id = 'x'", "k = 1", "d = 'soon'", "flag = 1"):
        with pytest.raises(QueryError) as e:
            q(f"SELECT id FROM main WHERE {bad}")
        assert e.value.code == "BadValue"


def test_decimal_types(spark, files):
    e = Engine(spark, {"main": str(files / "main.parquet")})
    t = dict(e.sql("SELECT price * price AS m, price + 1.5 AS p, price * 0.05 AS l, price / 2 AS q FROM main").dtypes)
    assert t == {"m": "decimal(18,4)", "p": "decimal(10,2)", "l": "decimal(12,4)", "q": "double"}
    t = dict(e.sql("SELECT sum(price) AS s, avg(price) AS a, sum(id) AS i, avg(id) AS m FROM main").dtypes)
    assert t == {"s": "decimal(38,2)", "a": "decimal(13,6)", "i": "decimal(38,0)", "m": "double"}
    with pytest.raises(QueryError) as x:
        e.sql("SELECT " + " * ".join(["price"] * 20) + " AS p FROM main")
    assert x.value.code == "DecimalScaleTooLarge"


def test_arithmetic(q):
    assert q("SELECT id / 3 AS a, -id / 3 AS b, amt / 0 AS c, -amt / 0 AS e FROM main WHERE id = -8") == [(-2, 2, math.inf, -math.inf)]
    assert q("SELECT amt / 0 AS c FROM main WHERE id = -10") == [(None,)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        q("SELECT id / 0 AS x FROM main")
    with pytest.raises(Exception, match="OVERFLOW"):
        q("SELECT id + 9223372036854775807 AS x FROM main")
    assert q("SELECT CASE WHEN id > 1000 THEN id / 0 ELSE 1 END AS x FROM main LIMIT 1") == [(1,)]


def test_sums_past_64_bits(q):
    assert q("SELECT sum(id * 0 + 9223372036854775807) AS s FROM main") == [(60 * (2**63 - 1),)]


def test_functions(q):
    assert q("SELECT strlen(name) AS n, date_trunc('minute', ts) AS m, extract(millisecond FROM ts) AS ms, date_part('dow', d) AS w FROM main WHERE id = -9") == [(7, dt.datetime(2024, 1, 1), 1500, 2)]
    assert q("SELECT regexp_replace(name, '([aO])', '<\\1>') AS r, regexp_replace(name, 'r', '$', 'g') AS g, regexp_replace(name, 'B.', '\\07', 'i') AS z FROM main WHERE id = -9") == [("<O>'Brien", "O'B$ien", "O'Br7ien")]
    assert q("SELECT epoch_ms(id) AS t, make_date(id) AS d FROM main WHERE id = 1") == [(dt.datetime(1970, 1, 1, 0, 0, 0, 1000), dt.date(1970, 1, 2))]
    for bad, code in (("upper(k)", "UnknownFunction"), ("strlen(id)", "TypeMismatch"), ("cast(id AS VARCHAR)", "CastNotSupported"), ("coalesce(k)", "WrongArity"), ("regexp_replace(k, '(?=a)', '')", "UnsupportedRegex")):
        with pytest.raises(QueryError) as e:
            q(f"SELECT {bad} AS x FROM main")
        assert e.value.code == code


def test_groups(q):
    assert q("SELECT k, count(*) AS n FROM main GROUP BY k", ordered=True) == [("b", 15), ("a", 15), (None, 15), ("c", 15)]
    assert q("SELECT k, count(amt) AS n FROM main GROUP BY 1 HAVING max(id) > 46 ORDER BY n DESC, k") == [("a", 14), (None, 14), ("c", 13)]
    assert q("SELECT count(*) AS n, sum(amt) AS s, avg(price) AS a FROM main WHERE id > 1000") == [(0, None, None)]
    assert q("SELECT id, id - 1 AS p, id * id AS s, count(*) AS n FROM main WHERE id = 5 GROUP BY 1, 2, 3") == [(5, 4, 25, 1)]
    assert q("SELECT max(id) AS k FROM main GROUP BY k ORDER BY k LIMIT 1") == [(46,)]
    for bad, code in (("SELECT k, id FROM main GROUP BY k", "NotGrouped"), ("SELECT sum(id) + 1 AS x FROM main", "AggregateArithmetic"), ("SELECT k, count(*) FROM main", "NotGrouped"), ("SELECT k AS a, id AS a FROM main", "DuplicateColumn")):
        with pytest.raises(QueryError) as e:
            q(bad)
        assert e.value.code == code


def test_input_order(spark, files):
    e = Engine(spark)
    both = [str(files / "order1.parquet"), str(files / "order0.parquet")]
    assert [r[0] for r in e.query(both, select="v", limit=4).collect()] == [3, 4, 5, 0]
    assert [tuple(r) for r in e.query(both, group_by="k", aggregate="count(*) AS n", ordered=True).collect()] == [("x", 1), ("y", 2), ("w", 1), ("z", 2)]
    assert [r[0] for r in e.sql(f"SELECT v FROM '{files}/order*.parquet' LIMIT 4").collect()] == [0, 1, 2, 3]
    for bad, code in ((str(files / "no*.parquet"), "FileNotFound"), (f"{files.parent}/*/main.parquet", "GlobInDirectory")):
        with pytest.raises(QueryError) as x:
            e.query(bad)
        assert x.value.code == code
    with pytest.raises(QueryError) as x:
        e.query([both[0], str(files / "nan.parquet")])
    assert x.value.code == "SchemaMismatch"


def test_nested_names(q):
    assert q('SELECT key, "r"."key" AS inner, name FROM nested LIMIT 1') == [(100, 0, "n0")]
    assert q("SELECT r.name FROM nested WHERE r.key = 3") == [("n3",)]
    with pytest.raises(QueryError) as e:
        q("SELECT tags FROM nested")
    assert e.value.code == "RepeatedColumn"


def test_text_formats(spark, files):
    e = Engine(spark, {"main": str(files / "main.parquet"), "nan": str(files / "nan.parquet")})
    one = "SELECT id, k, amt, f, price, d, flag, ts, name FROM main WHERE id = {}"
    assert e.text(one.format(-10)) == '{"id":-10,"k":"b","amt":null,"f":0,"price":0.00,"d":-31,"flag":null,"ts":1704067200000000,"name":"a%"}\n'
    assert e.text(one.format(-9), "csv").split("\r\n")[1] == "-9,a,0.25,0.1,0.01,1969-12-02,false,2024-01-01 00:00:01.500000,O'Brien"
    assert e.text(one.format(-7), "csv").split("\r\n")[1].endswith(',""') and e.text(one.format(-6), "csv").split("\r\n")[1].endswith(",")
    assert e.text("SELECT x FROM nan WHERE i > 2 ORDER BY i", "json") == '[{"x":"NaN"},{"x":3}]\n'
    assert e.text("SELECT x FROM nan WHERE i > 9", "json") == "[]\n"
    assert e.text("SELECT avg_state(x) AS st FROM nan WHERE i < 3") == '{"st":{"sum":3,"count":2}}\n'
    assert e.text("SELECT avg_state(x) AS st FROM nan WHERE i < 3", "csv") == "st__sum,st__count\r\n3,2\r\n"
    assert e.arrow("SELECT i FROM nan").num_rows == 4


def test_partial_and_requests(spark, files):
    e = Engine(spark)
    path = str(files / "main.parquet")
    aggs, keys = "count(*) AS n, avg(price) AS a, max(d) AS d", "k"
    whole = e.query(path, aggregate=aggs, group_by=keys).collect()
    parts = [e.partial(path, aggs, keys, f) for f in ("id < 3", "id >= 3")]
    plain = lambda rows: sorted((str(r["k"]), r["n"], r["d"], round(r["a"], 4)) for r in rows)
    assert plain(e.merge(parts, aggs, keys).collect()) == plain(whole)
    ok = e.request({"inputs": [path], "aggregate": "count(*) AS n", "filter": "id < 0"})
    assert ok["ok"] and ok["rows"] == [{"n": 10}]
    assert e.request({"inputs": [path], "filter": "id %"})["error"] == "ModuloNotSupported"
    assert e.request({"operation": "partial_aggregate", "partial": {"inputs": [path], "aggregate": "avg(id) AS m"}})["rows"][0]["_a0"]["count"] == 60
    slices = [e.request({"inputs": [path], "row_groups": [g], "aggregate": "count(*) AS n, min(id) AS lo"})["rows"][0] for g in ([0, 1], [1, 4], [2, 2], [1, 2, 3])]
    assert slices == [{"n": 16, "lo": -10}, {"n": 44, "lo": 6}, {"n": 0, "lo": None}, {"n": 16, "lo": 6}]
    for bad, code in (([[0, 9]], "RowGroupOutOfRange"), ([[2, 1]], "BadFieldType"), ([], "BadFieldType")):
        assert e.request({"inputs": [path], "row_groups": bad, "aggregate": "count(*) AS n"})["error"] == code
    assert e.request({"operation": "capabilities"})["partial_aggregate_version"] == 1
    assert e.request({"sql": f"SELECT count(DISTINCT k) AS n FROM '{path}'"})["rows"] == [{"n": 3}]


def test_command_line(spark, files, tmp_path, capsys):
    path = str(files / "main.parquet")
    assert main(["query", path, "--filter", "id = 3", "--columns", "k,id"]) == 0
    assert capsys.readouterr().out == '{"id":3,"k":"a"}\n'
    out = str(tmp_path / "o.parquet")
    assert main(["query", path, "--aggregate", "sum(id) AS s", "-o", out, "--codec", "zstd", "--summary=json"]) == 0
    assert pq.read_table(out).to_pydict() == {"s": [1170]} and {**json.loads(capsys.readouterr().err.strip().split("\n")[-1]), "total_ms": 0} == {"type": "summary", "ok": True, "rows": 1, "rows_in": 60, "rows_scanned": 60, "rows_matched": 60, "output": out, "codec": "ZSTD", "total_ms": 0}
    assert main(["query", "--query", f"SELECT id % 2 FROM '{path}'"]) == 2
    assert main(["query", str(files / "none.parquet")]) == 1
    assert main(["query", path, "--aggregate", "count(*)", "--select", "id"]) == 2
    assert main(["inspect", path, "--detail"]) == 0 and json.loads(capsys.readouterr().out)[0]["row_groups"] == 4
    assert main(["schema", path]) == 0 and main(["conform", path]) == 0
    assert inspect.conform(spark, path)["id"] == "ok"
