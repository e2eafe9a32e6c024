"""Substring deduplication by matching hashed windows of words against the whole corpus, in blocks by minimizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import durable, ship
from strataq.llm.tokens import buffers, grams, mix, words

#: A factor of so many words or more is a repeat.
LEAST = 20
#: Seeds are the least hashes of runs of so many words.
SEED = 5
#: Bytes of a window's hash that are sent; with the seed's eight, 112 bits tell windows apart.
SENT = 6
_NULL_ID = -(1 << 63)
_ROWS = "key long, doc long, pos int, n int, ref long, at int, wins binary"
_RUNS = "doc long, pos int, n int, ref long, at int"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each so many consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _repeats(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of windows that also start earlier, and of their first; all are given in order of (doc, pos)."""
    order = np.argsort(h, kind="stable") if group is None else np.lexsort((h, group))
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    if group is not None:
        new[1:] |= group[order[1:]] != group[order[:-1]]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    again = ~new & ((doc[head] != doc[order]) | (pos[head] != pos[order]))
    own, first = order[again], head[again]
    by = np.argsort(own)
    return own[by], first[by]


def _runs(doc: np.ndarray, pos: np.ndarray, ref: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start in which both sides go on by one word, and how long they are."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(doc)))


def _index(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) to the windows of each chunk, each once, in runs with one seed; repeats within it as runs (pos, n, ref, at)."""
        for b in batches:
            b = b.take(pa.array(np.argsort(b.column(0).to_numpy(), kind="stable")))
            ids = b.column(0).to_numpy()
            for i, j, w in words(b.column(1), fold=False):
                win, first = grams(w, least, short=False)
                if not len(win):
                    continue
                seed, from_ = grams(w, min(SEED, least), short=False)
                count = np.diff(first)
                row = np.repeat(np.arange(j - i), count)
                pos = np.arange(len(win)) - first[row]
                doc = ids[i + row]
                key = _least(seed, least - min(SEED, least) + 1)[pos + from_[row]]
                own, head = _repeats(win, doc, pos)
                start, n = _runs(doc[own], pos[own], doc[head], pos[head])
                own, head = own[start], head[start]
                keep = np.ones(len(win), bool)
                keep[np.repeat(own, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = False
                kept = np.flatnonzero(keep)
                new = np.ones(len(kept), bool)
                new[1:] = (np.diff(kept) != 1) | (row[kept[1:]] != row[kept[:-1]]) | (key[kept[1:]] != key[kept[:-1]])
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(kept)))
                raw = np.ascontiguousarray(win[kept].view(np.uint8).reshape(-1, 8)[:, :SENT]).tobytes()
                ends = (np.concatenate([[0], np.cumsum(size), np.full(len(own), size.sum())]) * SENT).astype(np.int32)
                a, m = kept[at], len(own)
                both = lambda x, y, t: pa.array(np.concatenate([x, y]).astype(t))
                wins = pa.Array.from_buffers(pa.binary(), len(a) + m, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [
                        # what is settled here goes on by its place, not by its words, which may be very common
                        pa.array(np.concatenate([key[a], mix(doc[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos[own].astype(np.uint64))]).view(np.int64)),
                        both(doc[a], doc[own], np.int64),
                        both(pos[a], pos[own], np.int32),
                        both(np.zeros(len(a)), n, np.int32),
                        both(np.zeros(len(a), np.int64), doc[head], np.int64),
                        both(np.zeros(len(a)), pos[head], np.int32),
                        wins,
                    ],
                    names=["key", "doc", "pos", "n", "ref", "at", "wins"],
                )

    return run


def _batch(doc: np.ndarray, pos: np.ndarray, n: np.ndarray, ref: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    kinds = (np.int64, np.int32, np.int32, np.int64, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip((doc, pos, n, ref, at), kinds, strict=True)], names=["doc", "pos", "n", "ref", "at"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _index, sorted by (key, doc, pos), to all repeats, as runs.

    Of the last seed of a batch, the different windows met so far go with it into the next: no seed is ever gathered.
    """
    none = np.zeros(0, np.int64)
    last, seen = None, (none, none, none)  # the seed; window, doc and pos of the first occurrences
    for b in batches:
        key, doc, pos, n, ref, at = (b.column(k).to_numpy() for k in range(6))
        if (n > 0).any():
            done = n > 0
            yield _batch(doc[done], pos[done], n[done], ref[done], at[done])
        column = b.column(6)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(b) + 1].astype(np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        rows = np.flatnonzero(n == 0)
        if not len(rows):
            continue
        k = key[rows]
        shared = np.zeros(len(rows), bool)
        shared[1:] = k[1:] == k[:-1]
        shared[:-1] |= k[1:] == k[:-1]
        shared[k == k[-1]] = True  # may go on in the next batch
        if last is not None:
            shared[k == last] = True
        rows = rows[shared]
        size = (ends[rows + 1] - ends[rows]) // SENT
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        where = np.repeat(ends[rows], size) + step * SENT
        wide = np.zeros((len(where), 8), np.uint8)
        for c in range(SENT):
            wide[:, c] = raw[where + c]
        h = wide.view(np.int64).ravel()
        d, p, g = np.repeat(doc[rows], size), np.repeat(pos[rows], size) + step, np.repeat(key[rows], size)
        if last is not None and k[0] == last:
            h, d, p = np.concatenate([seen[0], h]), np.concatenate([seen[1], d]), np.concatenate([seen[2], p])
            g = np.concatenate([np.full(len(seen[0]), last), g])
        own, head = _repeats(h, d, p, g)
        if len(own):
            by = np.lexsort((p[own], d[own]))
            own, head = own[by], head[by]
            start, m = _runs(d[own], p[own], d[head], p[head])
            own, head = own[start], head[start]
            yield _batch(d[own], p[own], m, d[head], p[head])
        last = k[-1]
        tail = np.flatnonzero(g == last)
        _, one = np.unique(h[tail], return_index=True)
        one = tail[np.sort(one)]
        seen = (h[one], d[one], p[one])


def _factors(runs: list[dict], least: int) -> list[tuple[int, int, int | None, int]]:
    """Factors (start, words, ref, at), glued after matching: runs that go on where another ends, on both sides, are one factor."""
    out: list[list] = []
    for r in sorted(runs, key=lambda r: (r["pos"], r["n"])):
        ref = None if r["ref"] == _NULL_ID else r["ref"]
        if out and out[-1][0] + out[-1][1] == r["pos"] and out[-1][2] == ref and out[-1][3] + out[-1][1] == r["at"]:
            out[-1][1] += r["n"]
        else:
            out.append([r["pos"], r["n"], ref, r["at"]])
    return [(s, n + least - 1, ref, at) for s, n, ref, at in out]


def _apply(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text, runs) to (id, n_words, n_removed, kept_sha256, kept_text, factors)."""
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref", pa.int64()), ("at", pa.int32())]))
        for b in batches:
            data, offsets = buffers(b.column(1))
            runs = b.column(2).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for i in range(len(b)):
                ws = data[offsets[i] : offsets[i + 1]].tobytes().split()
                factors = [f for f in _factors(runs[i], least) if f[0] + f[1] <= len(ws)] if runs[i] else []
                keep, to = [], 0
                for s, n, _, _ in factors:
                    keep += ws[to:s]
                    to = max(to, s + n)
                keep += ws[to:]
                text = b" ".join(keep)
                for column, x in zip(out, (len(ws), len(ws) - len(keep), hashlib.sha256(text).hexdigest(), text.decode(), factors), strict=True):
                    column.append(x)
            lists = pa.array([[dict(zip(("start", "words", "ref", "at"), f, strict=True)) for f in x] for x in out[4]], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3], pa.string()), lists], names=["id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors"])

    return run


def drop_repeats(docs: DataFrame, least: int = LEAST, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text, factors) for each row; texts=False leaves kept_text out.

    Words are what blanks separate. Each window of least words is looked up by its hash among all that start
    before it, by (id, position); there is no greedy parse. Windows that have their first occurrence at consecutive
    places of one document are then glued to a factor (start, words, ref, at). As every window is looked up on its own,
    those over the end of a factor too, no repeat is lost between two factors. Words in factors are removed; what is earlier is judged
    on the input. kept_text has the other words, joined by one space.

    The reference is the corpus itself, indexed in blocks by seed: the least hash of the five-word runs in a window,
    which equal windows share. A document is looked up in just the blocks that its own seeds name, and those are all
    blocks that could hold its windows. Runs of windows with one seed are one row. Windows that repeat within a
    chunk of input are resolved there and only their first goes on, so of a passage that a third of all documents
    share, a block gets a row per chunk; a block is read as a sorted stream and holds the different windows of one seed.

    Nulls: a null or empty text has no words. A null id sorts first and is returned as null. Rows that share an id
    count as one place: neither is earlier than the other, and what one loses the other loses at the same positions.
    An empty table gives an empty result. Only the two named columns are read.
    """
    if least < 2:
        raise ValueError("least must be 2 words or more")
    ship(docs.sparkSession)
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.col(text_col).alias("text"))
    rows = given.mapInArrow(_index(least), _ROWS).repartition("key").sortWithinPartitions("key", "doc", "pos")
    found = durable(rows.mapInArrow(_match, _RUNS))
    per = found.groupBy("doc").agg(F.collect_set(F.struct("pos", "n", "ref", "at")).alias("runs"))
    both = given.join(per, "doc", "left").select(F.col("doc").alias("id"), "text", "runs")
    kind = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string, factors array<struct<start:int,words:int,ref:long,at:int>>"
    out = both.mapInArrow(_apply(least), kind).withColumn("id", F.when(F.col("id") != _NULL_ID, F.col("id")))
    return out if texts else out.drop("kept_text")
