"""MinHash near-deduplication with an LSH forest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import BROADCAST_ROWS, drop_tables, durable, ship, small
from strataq.llm.components import components
from strataq.llm.tokens import grams, mix, words

SHINGLE = 5
#: Documents are linked from this Jaccard similarity on, unless a caller names another.
THRESHOLD = 0.85
#: Minhashes of a set, how many a label holds, and from how many on two labels share a region, at most.
HASHES, DEPTH, LEAST = 128, 8, 4
#: The forest and the count of agreeing minhashes may each miss a pair at the threshold with at most this probability.
MISS = 8e-6
#: Bits of a set's parity map, in longs of 64.
PARITY = 1024
_NULL_ID = -(1 << 63)

_rng = np.random.default_rng(11)
_A = (_rng.integers(0, 1 << 31, HASHES) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES).astype(np.uint32)


@dataclass(frozen=True)
class Limits:
    """What follows from a threshold: documents are linked if den * |intersection| >= num * |union|.

    Of the minhashes, tree t's label are depth from t * stride on; the first least of them are its region, and no two
    regions share a minhash. Neighbours of which fewer than agree minhashes agree are
    left to the exact join.
    """

    num: int
    den: int
    least: int
    trees: int
    agree: int

    @property
    def stride(self) -> int:
        return HASHES // self.trees

    @property
    def depth(self) -> int:
        return min(DEPTH, HASHES - (self.trees - 1) * self.stride)


def limits(threshold: float) -> Limits:
    """The deepest regions of which HASHES hold enough for MISS, and the highest count of agreeing minhashes for it."""
    part = Fraction(str(threshold)).limit_denominator(1_000)
    if not 0 < part <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    s = float(part)
    for least in range(LEAST, 0, -1):
        trees = 1 if s == 1 else math.ceil(math.log(MISS) / math.log1p(-(s**least)))
        if trees * least <= HASHES:
            break
    else:
        raise ValueError(f"{HASHES} minhashes are too few for threshold {threshold}")
    agree, lost = 0, 0.0
    while agree < HASHES and (lost := lost + math.comb(HASHES, agree) * s**agree * (1 - s) ** (HASHES - agree)) <= MISS:
        agree += 1
    return Limits(part.numerator, part.denominator, least, trees, agree)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, h1, h2, sig): the size and two hashes of the shingle set, and its minhashes, big-endian."""
    for b in batches:
        n = np.zeros(len(b), np.int64)
        h1, h2 = np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64)
        sig = np.zeros((len(b), HASHES), ">u4")
        for i, _, w in words(b.column(1), fold=True):
            g, first = grams(w, SHINGLE)
            full = np.flatnonzero(np.diff(first))
            if not len(full):
                continue
            high = (g >> np.uint64(32)).astype(np.uint32)
            hashed = np.empty_like(high)
            for k in range(HASHES):
                np.multiply(high, _A[k], out=hashed)
                hashed += _B[k]
                sig[i + full, k] = np.minimum.reduceat(hashed, first[full])
            for d in full:
                own = np.unique(g[first[d] : first[d + 1]])
                n[i + d], h1[i + d], h2[i + d] = len(own), own.sum(), mix(own ^ np.uint64(0x5DEECE66D)).sum()
        raw = sig.tobytes()
        size = 4 * HASHES
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), _signed(h1), _signed(h2), pa.array([raw[k * size : k * size + size] for k in range(len(b))], pa.binary())], names=["id", "n", "h1", "h2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, shingles, bits): the set, as sorted hashes, and its parity map.

    Each shingle flips one bit of the map. Two maps differ in no more bits than their sets differ in shingles, so maps
    that differ in too many rule a link out for sure.
    """
    for b in batches:
        for i, j, w in words(b.column(1), fold=True):
            g, first = grams(w, SHINGLE)
            rows = [np.unique(g[first[d] : first[d + 1]]) for d in range(j - i)]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
            odd = [np.packbits((np.bincount((r >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1).astype(np.uint8)) for r in rows]
            bits = np.concatenate(odd).view(np.int64) if odd else np.zeros(0, np.int64)
            at = np.arange(len(rows) + 1, dtype=np.int32) * (PARITY // 64)
            lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(v)) for e, v in ((ends, flat), (at, bits))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *lists], names=["id", "shingles", "bits"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (region, label) to pairs of rows that follow one another in a region."""
    region, node = None, None
    for b in batches:
        if not len(b):
            continue
        r, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if region is not None:
            r, n = np.insert(r, 0, region), np.insert(n, 0, node)
        same = (r[1:] == r[:-1]) & (n[1:] != n[:-1])
        x, y = n[:-1][same], n[1:][same]
        region, node = r[-1], n[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _agreeing(agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, signature of a, signature of b) to the pairs of which enough minhashes agree."""
        for b in batches:
            for k in range(0, len(b), 2_000):
                part = b.slice(k, 2_000)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(len(part), -1) for c in (2, 3))
                yield part.select([0, 1]).filter(pa.array((x == y).sum(1) >= agree))

    return run


def _end(df: DataFrame, end: str, col: str) -> DataFrame:
    return df.select(F.col("node").alias(end), F.col(col).alias(f"{col}_{end}"), *([F.col("n").alias(f"n_{end}")] if col == "sig" else []))


def _likely(pairs: DataFrame, sigs: DataFrame, at: Limits) -> DataFrame:
    """Those pairs (a, b) that sizes and minhashes don't rule out."""
    both = pairs.join(_end(sigs, "a", "sig"), "a").join(_end(sigs, "b", "sig"), "b")
    sizes = F.least("n_a", "n_b") * at.den >= F.greatest("n_a", "n_b") * at.num
    return both.where(sizes).select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing(at.agree), "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, at: Limits) -> DataFrame:
    """Those pairs (a, b) that the whole shingle sets link."""
    both = pairs.join(_end(sets, "a", "shingles"), "a").join(_end(sets, "b", "shingles"), "b")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    union = F.size("shingles_a") + F.size("shingles_b") - shared
    return durable(both.where(shared * at.den >= union * at.num).select("a", "b").distinct())


def _crossing(nodes: DataFrame, sets: DataFrame, at: Limits) -> DataFrame:
    """All pairs (a, b) of nodes (node, root) of different roots whose sets could be similar enough.

    A prefix-filtered join: shingles are ordered by how many of the nodes have them; of two similar sets, the first
    common shingle is among the first few of both, and as much of either must follow it as the overlap still needs; and
    the parity maps must not differ in more bits than the sets may in shingles. All of that is the join's condition, so
    the rows that leave it are few but links, whatever the size of a group of near copies.
    """
    nodes = durable(nodes.join(sets.select("node", "bits"), "node"))
    own = sets.select("node", "shingles").join(nodes.select("node"), "node")
    tokens = durable(own.select("node", F.explode("shingles").alias("h")))
    often = durable(tokens.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    ranked = tokens.join(often, "h", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "h"))).alias("all"))
    n = F.size("all").cast("long")
    up = lambda x, by: F.floor((x + (by - 1)) / by).cast("int")
    first = F.posexplode(F.slice("all", 1, (n - up(n * at.num, at.den) + 1).cast("int"))).alias("pos", "t")
    heads = ranked.select("node", n.alias("n"), first).where("t.c > 1").select("node", "n", "pos", F.col("t.h").alias("h"))
    heads = durable(heads.join(nodes, "node"))
    per = heads.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"))
    mixed = durable(per.where("roots > 1").select("h", F.col("top.root").alias("top")))
    heads = durable(heads.join(mixed, "h"))
    short = F.col("pos") <= F.col("n") - up(F.col("n") * 2 * at.num, at.num + at.den)
    side = lambda df, e: df.select("h", *[F.col(c).alias(f"{c}_{e}") for c in ("node", "root", "n", "pos", "bits")])
    larger = F.col("n_y") < F.col("n_x")
    later = larger | ((F.col("n_y") == F.col("n_x")) & (F.col("node_y") < F.col("node_x")))
    need = up((F.col("n_x") + F.col("n_y")) * at.num, at.num + at.den)
    rest = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= need
    apart = F.lit(0)
    for i in range(PARITY // 64):
        apart = apart + F.bit_count(F.get("bits_x", F.lit(i)).bitwiseXOR(F.get("bits_y", F.lit(i))))
    rest = rest & (apart <= F.col("n_x") + F.col("n_y") - 2 * need)
    fits = (F.col("root_x") != F.col("root_y")) & later & rest & (F.col("n_y") * at.den >= F.col("n_x") * at.num)
    minor, top = F.col("root") != F.col("top"), F.col("root") == F.col("top")
    some = side(heads.where(minor), "x").join(side(heads.where(short), "y"), "h").where(fits)
    more = side(heads.where(top), "x").join(side(heads.where(short & minor), "y"), "h").where(fits)
    return some.unionByName(more).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Words are what blanks separate, A-Z lower-cased; a document's set holds its shingles of five words (a shorter
    text is one). Documents whose sets have a Jaccard similarity of threshold or more are linked; component_id is the least
    id that links reach.

    Equal sets collapse to one node first, by map-side combined minima. The forest: a node has 128
    minhashes, and each label of 8 of them is a place in one of the sorted orders. Nodes that share the first minhashes
    of a label are a region of that order; limits() takes as many orders as a pair at the threshold needs to share a
    region with probability 1 - 8e-6: at 0.85, 16 with regions of 4 minhashes, at 0.8, 23. Candidates are, first, the
    neighbours in each order, which have the longest common prefixes, so the depth adapts to how dense a region is.
    Those that 128 minhashes don't rule out are compared on the full sets, and components are taken. Second, the nodes
    of regions that still hold several components are the candidates for links between components: an exact prefix
    filter and parity maps leave few pairs of them, and each goes to the full sets, whatever its minhashes say. So a link is missed only
    if its ends share no region of any order; nothing is capped. A dense group of copies is one component by then and
    gives no pairs. Orders are range-partitioned by label and node, which splits hot regions.

    Nulls: a null or empty text, or one of blanks, has an empty set and is linked with nothing. Rows that share an id
    are one document and share its links; a null id counts as an id and is returned as null. Repeated rows stay. An
    empty table gives an empty result. Only the two named columns are read.
    """
    at = limits(threshold)
    spark = docs.sparkSession
    ship(spark)
    made: list[str] = []
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    sketches = durable(given.mapInArrow(_sketch, "id long, n long, h1 long, h2 long, sig binary"), made)
    full = sketches.where("n > 0")
    nodes = durable(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("node"), F.any_value("sig").alias("sig")), made)
    label = lambda t, n: F.substring("sig", 4 * t * at.stride + 1, 4 * n)
    trees = F.explode(F.array(*[F.struct(F.xxhash64(F.lit(t), label(t, at.least)).alias("region"), label(t, at.depth).alias("label")) for t in range(at.trees)]))
    forest = nodes.select("node", trees.alias("x")).select("node", "x.region", "x.label")
    shared = durable(forest.groupBy("region").agg(F.count("*").alias("c")).where("c > 1").select("region"), made)
    places = durable(forest.join(small(shared), "region").select("region", "node", "label"), made)

    some = places.select(F.col("node").alias("id")).distinct()
    some = durable(some, made)
    texts = given.join(F.broadcast(some) if some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else some, "id", "left_semi")
    sets = durable(texts.mapInArrow(_sets, "id long, shingles array<long>, bits array<long>").withColumnRenamed("id", "node"), made)
    sigs = nodes.select("node", "n", "sig")

    ordered = places.repartitionByRange("region", "label", "node").sortWithinPartitions("region", "label", "node")
    pairs = durable(ordered.select("region", "node").mapInArrow(_neighbours, "a long, b long").distinct(), made)
    compared = durable(_likely(pairs, sigs, at), made)
    links = _linked(compared, sets, at)
    roots = components(links)

    placed = places.select("region", "node").join(roots, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root"))
    placed = durable(placed, made)
    per = placed.groupBy("region", "root").agg(F.count("*").alias("c"))
    mixed = per.groupBy("region").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    mixed = durable(mixed.select("region", F.col("top.root").alias("top")), made)
    left = durable(placed.join(small(mixed), "region"), made)
    cross = _crossing(left.select("node", "root").distinct(), sets, at)
    cross = durable(cross.join(compared, ["a", "b"], "left_anti"), made)
    more = _linked(cross, sets, at)
    names = durable(components(links.unionByName(more)), made)

    owned = nodes.select("h1", "h2", "n", "node").join(names, "node", "left").withColumn("root", F.coalesce("root", "node"))
    owned = durable(owned, made)
    least = owned.groupBy("root").agg(F.min("node").alias("component"))
    owned = durable(owned.join(least, "root").select("h1", "h2", "n", "component"), made)
    out = sketches.select("id", "n", "h1", "h2").join(owned, ["h1", "h2", "n"], "left")
    none = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    component = F.coalesce("component", "id")
    out = out.select("id", "n", component.alias("component"))
    out = durable(out)
    drop_tables(spark, made)
    return out.select(none("id").alias("id"), F.col("n").alias("n_shingles"), none("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component left: the one of least id. Rows that repeat its id stay."""
    gone = near_duplicates(docs, threshold, id_col=id_col, text_col=text_col).where(~F.col("kept")).select(F.col("id").alias("__op3_id")).distinct()
    gone = durable(gone)
    return docs.join(small(gone), F.col(f"`{id_col}`").eqNullSafe(F.col("__op3_id")), "left_anti")
