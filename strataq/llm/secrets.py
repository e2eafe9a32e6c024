"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control, in SQL functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import durable

# The base patterns, in their order. The first keeps its group 2 of 12 characters or more.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of these characters, of MIN_TOKEN or more, are tested for randomness.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"
#: The share of false discoveries that is allowed in each class of lengths.
FDR = 0.01
LENGTHS = (20, 32, 64)
#: A test of the battery rejects randomness beyond so many standard deviations (about 1 in 1000).
SIGMAS = 3.29
#: In text, a character is of the class of the one before it with this probability, in a token of letters or digits.
STAY = 0.9
#: Logarithms of evidence are counted in bins of so much, up to so many bins.
BIN, BINS = 0.25, 400
#: Matches are placed in blocks of so many.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """Structs (start, end, value) of the leftmost non-overlapping matches; value is the group. Code points, end exclusive.

    Places are sums of what lies before, taken within blocks of matches and then over the blocks, so that no array
    grows match by match to the length of all.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    sizes = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), F.transform(whole, F.char_length).alias("len"), value.alias("value"))
    kind = "array<struct<start:int,end:int,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(a: Column, s: Column) -> Column:
        start, end = a["at"] + s["gap"], a["at"] + s["gap"] + s["len"]
        one = F.struct(start.alias("start"), end.alias("end"), s["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    def place(blocks: Column) -> Column:
        before = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, s: F.struct((a["at"] + s["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )
        move = lambda s, by: F.transform(s["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, before, move))

    def cut(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)), zero, add))

    return F.when(text.rlike(pattern), _let(_let(sizes, cut), place)).otherwise(F.array().cast(kind))


def _encoding(t: Column) -> Column:
    """The size of the smallest alphabet in use that holds the token: hex, base 32, lower-case base 36, base 62, base 64."""
    out = F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(t.rlike("^[A-Z2-7]+$"), 32)
    return out.when(t.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36).when(t.rlike("^[0-9A-Za-z]+$"), 62).otherwise(64)


def battery(token: Column) -> Column:
    """(n, passed, evidence) of a token.

    passed: none of the tests rejects that its characters are drawn evenly and independently from the alphabet of its
    encoding: chi-squared of the counts, Wald-Wolfowitz runs above and below the mean, correlation with the next one.
    evidence: the logarithm of how much likelier the token is drawn so than written as text, where characters keep to
    the class (lower, upper, digit, mark) of the one before. Under the latter its exponential has a mean of 1 at most.
    Each part is one pass over the characters, so the time is linear in the token.
    """
    t = token
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    times = F.transform(F.array_distinct(chars), lambda c: (F.char_length(t) - F.char_length(F.replace(t, c, F.lit("")))).cast("double"))
    base = F.struct(
        F.char_length(t).cast("double").alias("n"),
        _encoding(t).cast("double").alias("a"),
        F.transform(chars, lambda c: F.ascii(c).cast("double")).alias("v"),
        F.aggregate(times, F.lit(0.0), lambda s, x: s + x * x).alias("squares"),
        F.size(F.regexp_extract_all(t, F.lit(CLASSES), F.lit(0))).alias("runs"),
    )

    def sums(b: Column) -> Column:
        """Of the values, their squares and the products of neighbours, in one pass; no character has the code -1."""
        zero = F.struct(F.lit(-1.0).alias("last"), *[F.lit(0.0).alias(k) for k in ("one", "two", "near")])
        step = lambda s, x: F.struct(x.alias("last"), (s["one"] + x).alias("one"), (s["two"] + x * x).alias("two"), (s["near"] + F.when(s["last"] >= 0, s["last"] * x).otherwise(0.0)).alias("near"))
        return F.struct(b.alias("b"), F.aggregate(b["v"], zero, step).alias("s"))

    def turns(p: Column) -> Column:
        """Of the values, how many are above the mean, and how often neighbours lie on different sides of it."""
        mean = p["s"]["one"] / p["b"]["n"]
        zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("up"), F.lit(0.0).alias("turns"), mean.alias("mean"))

        def step(s: Column, x: Column) -> Column:
            side = F.when(x > s["mean"], 1).otherwise(0)
            turned = F.when((s["last"] >= 0) & (s["last"] != side), 1.0).otherwise(0.0)
            return F.struct(side.alias("last"), (s["up"] + side).alias("up"), (s["turns"] + turned).alias("turns"), s["mean"].alias("mean"))

        return F.struct(p["b"].alias("b"), p["s"].alias("s"), F.aggregate(p["b"]["v"], zero, step).alias("t"))

    def test(p: Column) -> Column:
        b, s, mean = p["b"], p["s"], p["t"]["mean"]
        chi = (b["a"] / b["n"] * b["squares"] - b["n"] - (b["a"] - 1)) / F.sqrt(2 * (b["a"] - 1))
        var = s["two"] - b["n"] * mean * mean
        near = s["near"] - mean * (2 * s["one"] - F.get(b["v"], F.lit(0)) - F.element_at(b["v"], -1)) + (b["n"] - 1) * mean * mean
        serial = near / F.greatest(var, F.lit(1e-9)) * F.sqrt(b["n"])
        up = p["t"]["up"]
        expect = 2 * up * (b["n"] - up) / b["n"] + 1
        spread = F.sqrt(F.greatest((expect - 1) * (expect - 2) / F.greatest(b["n"] - 1, F.lit(1.0)), F.lit(1e-9)))
        good = (chi <= SIGMAS) & (F.abs(serial) <= SIGMAS) & (F.abs((p["t"]["turns"] + 1 - expect) / spread) <= SIGMAS)
        # text: keep the class, or change to one of the three others, each time with an even choice of at most 26 there
        keep = -F.log(b["a"]) - F.lit(math.log(STAY / 26))
        change = -F.log(b["a"]) - F.lit(math.log((1 - STAY) / 3 / 6))
        evidence = (b["n"] - b["runs"]) * keep + (b["runs"] - 1) * change
        return F.struct(b["n"].cast("int").alias("n"), good.alias("passed"), evidence.alias("evidence"))

    return _let(_let(_let(base, sums), turns), test)


def _class(n: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(LENGTHS):
        out = F.when(n >= low, i).otherwise(out)
    return out


def thresholds(counts: dict[tuple[int, int], int], tested: dict[int, int], rate: float) -> dict[int, int]:
    """For each class of lengths the least bin of evidence that is a discovery (e-value Benjamini-Hochberg), if any.

    counts: of passed tokens by class and bin. The lower edge of a bin stands for its evidence, so the rate holds.
    """
    out = {}
    for c, n in tested.items():
        above = 0
        for b in range(BINS, 0, -1):
            above += counts.get((c, b), 0)
            if above and math.exp(min(b * BIN, 700)) >= n / (rate * above):
                out[c] = b
    return out


def scan_secrets(docs: DataFrame, rate: float = FDR, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) for each row: arrays of structs (start, kind number in KINDS, end), sorted.

    base: the fixed patterns. added: long runs of token characters that pass the battery and whose evidence stands out
    among all tokens of their class of lengths in the whole corpus, at the given false-discovery rate, and that do not
    overlap a base span. One pass over the texts keeps spans and statistics; the driver gets counts by class and bin,
    a bounded number of rows.

    Nulls: a null or empty text has no spans; a null id is kept. Repeated rows are scanned each for itself. An empty
    table gives an empty result. Only the two named columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    assign = F.filter(_located(text, ASSIGN, 2), lambda s: F.char_length(s["value"]) >= 12)
    base = F.array_sort(F.concat(kind(assign, 0), kind(_located(text, ACCESS), 1), kind(_located(text, HEX), 2)))
    tokens = F.transform(_located(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["value"]).alias("test")))
    rows = durable(docs.select(F.col(id_col).alias("id"), base.alias("base"), tokens.alias("tokens")))

    each = rows.select(F.explode("tokens.test").alias("t"))
    bin_ = F.least(F.greatest(F.floor(F.col("t.evidence") / BIN), F.lit(0)), F.lit(BINS)).cast("int")
    found = each.groupBy(_class(F.col("t.n")).alias("c"), F.when(F.col("t.passed"), bin_).otherwise(-1).alias("b")).agg(F.count("*").alias("n")).collect()
    tested: dict[int, int] = {}
    for r in found:
        tested[r["c"]] = tested.get(r["c"], 0) + r["n"]
    least = thresholds({(r["c"], r["b"]): r["n"] for r in found}, tested, rate)

    def wanted(s: Column) -> Column:
        level = F.lit(math.inf)
        for c, b in least.items():
            level = F.when(_class(s["test"]["n"]) == c, F.lit(b * BIN)).otherwise(level)
        apart = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return s["test"]["passed"] & (s["test"]["evidence"] >= level) & apart

    return rows.select("id", "base", kind(F.filter("tokens", wanted), 3).alias("added"))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
