"""Files and footers: what a LIMIT reads, what an output may replace, patterns and their options."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strataq.api import Engine
from strataq.functions import regex
from strataq.plans.errors import DataError, QueryError
from strataq.sources import inspect, parquet, sinks


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    d = tmp_path_factory.mktemp("many")
    for i in range(40):
        pq.write_table(pa.table({"x": list(range(10 * i, 10 * i + 10)), "k": [f"{i % 4}+ a"] * 10}), d / f"part {i:03d}+.parquet", row_group_size=4)
    return d


def test_limit_reads_the_files_it_needs(spark, many):
    e = Engine(spark)
    first = e.sql(f"SELECT x FROM '{many}/*.parquet' LIMIT 7")
    assert [r.x for r in first.collect()] == list(range(7)) and len(first.inputFiles()) == 1
    some = e.query(str(many / "*.parquet"), select="x", limit=25)
    assert [r.x for r in some.collect()] == list(range(25)) and len(some.inputFiles()) == 3
    late = e.sql(f"SELECT x FROM '{many}/*.parquet' WHERE x >= 57 LIMIT 5 OFFSET 2")
    assert [r.x for r in late.collect()] == [59, 60, 61, 62, 63] and len(late.inputFiles()) == 8
    assert [r.k for r in e.query(str(many / "*.parquet"), group_by="k", limit=3).collect()] == ["0+ a", "1+ a", "2+ a"]
    assert e.sql(f"SELECT x FROM '{many}/*.parquet' WHERE x < 0 LIMIT 5").collect() == []


def test_footers(spark, many):
    files = parquet.footers(spark, parquet.expand(spark, [str(many / "*.parquet")]))
    assert len(files) == 40 and all(f.groups == (4, 4, 2) for f in files) and [f.place for f in files] == list(range(40))
    assert [len(parquet.first_files(files, n)) for n in (0, 1, 10, 11, 400, 999)] == [1, 1, 1, 2, 40, 40]
    facts = inspect.inspect(spark, files[0].path, detail=True)
    assert facts["rows"] == 10 and [g["rows"] for g in facts["groups"]] == [4, 4, 2]
    with pytest.raises(DataError):
        inspect.inspect(spark, __file__)


def test_outputs_spare_inputs_and_strangers(spark, many, tmp_path):
    e = Engine(spark)
    df = e.query(str(many / "*.parquet"), select="x")
    paths = [f.path for f in e.files(str(many / "*.parquet"))]
    for bad in (str(many), paths[3], f"{many}/../{many.name}", f"{many}/part 003+.parquet/below"):
        with pytest.raises(QueryError) as x:
            sinks.write_parquet(df, bad, inputs=paths)
        assert x.value.code == "OutputIsInput"
    (tmp_path / "keep.txt").write_text("mine")
    with pytest.raises(DataError) as x:
        sinks.write_parquet(df, str(tmp_path))
    assert x.value.code == "OutputNotReplaceable" and (tmp_path / "keep.txt").exists()
    for _ in range(2):
        sinks.write_parquet(df, str(tmp_path / "out"), inputs=paths)
    assert pq.read_table(tmp_path / "out").num_rows == 400


def test_pattern_options():
    o = regex.options("i c\tg")
    assert (o.every, o.fold) == (True, False) and regex.options("ci").fold and not regex.options("sm").dot_all and regex.options("ns").dot_all
    assert regex.to_java("a$", regex.Options()) == ("(?d:a\\z)", 0) and regex.to_java("(a)(?P<n>b)", regex.Options())[1] == 2
    assert regex.to_java("a.$", regex.Options(literal=True)) == ("(?d:a\\.\\$)", 0)
    for bad in ("a**", "a*+", "(", ")", "[a", "(?=a)", "(?<!a)", "(?>a)", "\\1", "\\pL", "\\Q", "\\", "a{2,1}", "a{1001}", "*a"):
        with pytest.raises(QueryError):
            regex.to_java(bad, regex.Options())
    for bad in ("\\", "\\x", "\\3"):
        with pytest.raises(QueryError):
            regex.pieces(bad, 2)
