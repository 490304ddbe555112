"""Removal of byte strings that occur twice, by suffix sorting one bucket at a time with difference-cover ranks.

A byte goes if a string of `length` bytes that covers it starts anywhere else in the corpus, in the same text or another.

Suffixes are dealt to buckets so that equal windows of `length` bytes meet: a window belongs to the substring of `ANCHOR`
bytes in it with the lowest hash (the leftmost of equals). Consecutive windows of a text with one such anchor form a run;
only its digest is shuffled at first. Runs whose anchor occurs once hold nothing repeated; equal runs are repeated
entirely and count as one from then on. What remains are anchors with different runs, at the edges of repeated passages.
Their bytes form blocks of bounded size, and the suffixes of a block are sorted at a time: by their first and last bytes,
and suffixes that still tie by ranks of the positions in a difference cover, computed beforehand: for any two suffixes
some offset takes both to ranked positions. The few anchors with very many different runs are dealt window by window
instead, by digests, so that no block grows with the corpus.

Digests have 128 bits and stand for the strings. Null texts count as empty; texts shorter than `length` lose nothing;
repeated rows lose everything if they are long enough. Equal texts are worked on once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from gridwise.llm.common import by_bytes, fresh, stored

ANCHOR = 100
PERIOD = 64
BATCH_BYTES = 4 << 20
#: Windows of a long text are taken in stretches of this many.
STRETCH = 1 << 19
#: Bytes of runs in a block, and runs of one anchor beyond which windows are dealt one by one.
BLOCK_BYTES = 1 << 20
MOST_RUNS = 1024
PLACE_BITS = 20
RUNS = "a long, s1 long, s2 long, k1 long, k2 long, first int, n int"


def difference_cover(period: int) -> list[int]:
    """Residues of which some two differ by any number, modulo the period; greedily, so about 1.3 roots of it."""
    cover, open_ = [0], set(range(1, period))
    while open_:
        best = max(
            (x for x in range(period) if x not in cover),
            key=lambda x: (len({(x - c) % period for c in cover} & open_ | {(c - x) % period for c in cover} & open_), -x),
        )
        open_ -= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


@lru_cache(2)
def common_offsets(period: int) -> tuple[np.ndarray, np.ndarray]:
    """Which residues are covered, and for each two residues the least offset that takes both into the cover."""
    covered = np.zeros(period, bool)
    covered[difference_cover(period)] = True
    offsets = np.full((period, period), -1, np.int64)
    residues = np.arange(period)
    for offset in range(period - 1, -1, -1):
        hit = covered[(residues + offset) % period]
        offsets[np.ix_(hit, hit)] = offset
    return covered, offsets


@lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of an odd number and of its inverse modulo 2^64."""
    state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values = mixed(state) | np.uint64(1)
    base = 0xD1342543DE82EF95
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchor_hashes(data: bytes, size: int = ANCHOR) -> np.ndarray:
    """A hash of each substring of `size` bytes."""
    values, up, down = powers(STRETCH + 4096)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[np.frombuffer(data, np.uint8)] * up[:n], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])


def lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def runs_of(data: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """Runs of consecutive windows with one anchor: hash of the anchor, first window, number of windows."""
    for start in range(0, len(data) - length + 1, STRETCH):
        part = data[start : start + STRETCH + length - 1]
        hashes = anchor_hashes(part)
        placed = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        least = lowest(placed, length - ANCHOR + 1)
        firsts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        sizes = np.diff(firsts, append=len(least))
        anchors = (least[firsts] >> np.uint64(PLACE_BITS)).astype(np.int64)
        yield from zip(anchors.tolist(), (firsts + start).tolist(), sizes.tolist())


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(both[:, i].copy()) for i in (0, 1)]


def all_runs(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, BATCH_BYTES):
            columns: tuple[list, ...] = ([], [], [], [])
            digests: list[bytes] = []
            for row, value in enumerate(batch.column(2)):
                data = value.as_py()
                for anchor, first, n in runs_of(data, length):
                    for column, x in zip(columns, (anchor, row, first, n)):
                        column.append(x)
                    digests.append(digest(data[first : first + n - 1 + length]))
            rows = pa.array(columns[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *halves(digests), batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                names=["a", "s1", "s2", "k1", "k2", "first", "n"],
            )

    return texts.where(F.octet_length("text") >= length).select("k1", "k2", "text").mapInArrow(run, RUNS)


def sort_block(runs: list[bytes], length: int, period: int = PERIOD) -> list[np.ndarray]:
    """For each run which of its windows occur twice in the block."""
    data = b"".join(runs)
    sizes = np.array([len(r) for r in runs])
    starts = np.cumsum(sizes) - sizes
    covered, offsets = common_offsets(period)
    inner = length - period + 1
    # Ranks of the covered positions by the bytes that lie within any window however it is offset.
    ranks = np.full(len(data) + period, -1, np.int64)
    places = [p for s, n in zip(starts.tolist(), sizes.tolist()) for p in range(s, s + n - inner + 1) if covered[p % period]]
    contents = [data[p : p + inner] for p in places]
    order = {x: i for i, x in enumerate(sorted(set(contents)))}
    ranks[places] = [order[x] for x in contents]
    # Windows by their first and last bytes.
    windows = np.concatenate([np.arange(s, s + n - length + 1) for s, n in zip(starts.tolist(), sizes.tolist())])
    names: dict[bytes, int] = {}
    at = windows.tolist()
    head = np.array([names.setdefault(data[p : p + period], len(names)) for p in at])
    tail = np.array([names.setdefault(data[p + length - period : p + length], len(names)) for p in at])
    sorted_ = np.lexsort((tail, head))
    group = np.concatenate([[0], np.cumsum((head[sorted_][1:] != head[sorted_][:-1]) | (tail[sorted_][1:] != tail[sorted_][:-1]))])
    twice = np.zeros(len(windows), bool)
    left, rounds = np.arange(len(sorted_)), 0
    while len(left):
        mine = group[left]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        members = np.diff(first, append=len(left))
        several = np.repeat(members > 1, members)
        if rounds == 16:  # groups of many different windows
            seen: dict[bytes, int] = {}
            for i in left[several].tolist():
                p = at[sorted_[i]]
                other = seen.setdefault(data[p : p + length], i)
                if other != i:
                    twice[sorted_[i]] = twice[sorted_[other]] = True
            break
        leader = windows[sorted_[np.repeat(left[first], members)]]
        this = windows[sorted_[left]]
        shift = offsets[leader % period, this % period]
        equal = ranks[leader + shift] == ranks[this + shift]
        found = np.add.reduceat(equal.astype(np.int64), first)
        twice[sorted_[left[equal & np.repeat(found > 1, members)]]] = True
        left, rounds = left[~equal & several], rounds + 1
    counts = np.maximum(sizes - length + 1, 0)
    return np.split(twice, np.cumsum(counts)[:-1])


def stretches(marked: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last places of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


RANGES = "s1 long, s2 long, from_ array<int>, to_ array<int>"


def range_rows(s1: list[int], s2: list[int], marked: list[np.ndarray]) -> pa.RecordBatch:
    found = [stretches(m) for m in marked]
    return pa.RecordBatch.from_pydict({
        "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()),
        "from_": pa.array([f[0] for f in found], pa.list_(pa.int32())), "to_": pa.array([f[1] for f in found], pa.list_(pa.int32())),
    })


def sorted_buckets(runs: DataFrame, length: int) -> DataFrame:
    """Repeated windows of runs (a, s1, s2, data), a bounded block of whole buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for a, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if a != last and size >= BLOCK_BYTES:
                    yield found(block)
                    block, size = [], 0
                block.append(tuple(row))
                size, last = size + len(row[2]), a
        if block:
            yield found(block)

    def found(block: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        s1, s2, data = zip(*block)
        return range_rows(list(s1), list(s2), sort_block(list(data), length))

    dealt = runs.select("a", "s1", "s2", "data").repartition("a").sortWithinPartitions("a")
    return dealt.mapInArrow(run, RANGES)


def single_windows(runs: DataFrame, length: int) -> DataFrame:
    """The same for runs of anchors that have very many, by digests of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, 1 << 18):
            s1, s2, place, digests = [], [], [], []
            for x, y, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(data) - length + 1
                s1 += [x] * n
                s2 += [y] * n
                place += range(n)
                digests += [digest(data[p : p + length]) for p in range(n)]
            yield pa.RecordBatch.from_arrays(
                [*halves(digests), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(place, pa.int32())],
                names=["w1", "w2", "s1", "s2", "place"],
            )

    each = runs.select("s1", "s2", "data").mapInArrow(run, "w1 long, w2 long, s1 long, s2 long, place int")
    twice = each.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    places = each.join(stored(twice, "windows"), ["w1", "w2"]).groupBy("s1", "s2").agg(F.collect_set("place").alias("from_"))
    return places.select("s1", "s2", "from_", F.col("from_").alias("to_"))


def text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")


def cut_texts(docs: DataFrame, length: int = 400, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """For each different text: k1, k2, n_bytes, spans (start, end) in bytes, and `kept`, the bytes that are left.

    Also gives the cached texts, to be released when the result has been used.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(value.alias("text")).select(*text_key(F.col("text")), "text")
    texts = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first(F.col("text").cast("binary")).alias("text"))
    texts = texts.persist(StorageLevel.DISK_ONLY)
    runs = all_runs(texts, length)
    content = F.struct("s1", "s2")
    anchors = runs.groupBy("a").agg(F.count("*").alias("c"), F.min(content).alias("low"), F.max(content).alias("high")).where("c > 1")
    # Stored, so that what follows is a join of two shuffles, which Spark can split where an anchor is frequent.
    anchors = stored(anchors.select("a", (F.col("low") == F.col("high")).alias("same")), "anchors")
    known = stored(runs.join(anchors, "a"), "runs")
    # Equal runs stand for all their windows; the others are compared window by window, one of each content.
    window_range = lambda a, b: (F.array(a).alias("from_"), F.array(b).alias("to_"))
    whole = known.where("same").select("k1", "k2", "first", *window_range(F.lit(0), F.col("n") - 1))
    mixed_runs = known.where("not same")
    contents = mixed_runs.groupBy("a", "s1", "s2").agg(
        F.count("*").alias("c"), F.max("n").alias("n"), F.min(F.struct("k1", "k2", "first")).alias("at")
    )
    asked = contents.select("a", "s1", "s2", "c", "n", "at.*")
    crowded = asked.groupBy("a").agg(F.count("*").alias("different")).where(F.col("different") > MOST_RUNS).select("a", F.lit(True).alias("crowded"))
    wanted = asked.join(stored(crowded, "crowded"), "a", "left").join(texts.select("k1", "k2", "text"), ["k1", "k2"])
    compared = stored(wanted.select(
        "a", "s1", "s2", "c", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"),
        F.substring("text", F.col("first") + 1, F.col("n") + length - 1).alias("data"),
    ), "edges")
    several = compared.where("c > 1").select("s1", "s2", *window_range(F.lit(0), F.col("n") - 1))
    ranges = several.unionByName(sorted_buckets(compared.where("not crowded"), length)).unionByName(
        single_windows(compared.where("crowded"), length)
    ).where(F.size("from_") > 0)
    edges = mixed_runs.join(ranges, ["s1", "s2"]).select("k1", "k2", "first", "from_", "to_")
    covered = F.zip_with("from_", "to_", lambda a, b: F.struct((F.col("first") + a).alias("start"), (F.col("first") + b + length).alias("end")))
    spans = whole.unionByName(edges).select("k1", "k2", covered.alias("spans")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 3, BATCH_BYTES):
            sizes, found, kept = [], [], []
            for copies, data, spans in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                merged: list[list[int]] = []
                whole = [{"start": 0, "end": len(data)}] if copies > 1 and len(data) >= length else []
                for span in sorted(whole or spans or [], key=lambda s: s["start"]):
                    if merged and span["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span["end"])
                    else:
                        merged.append([span["start"], span["end"]])
                ends = [0, *(e for _, e in merged)]
                kept.append(b"".join(data[e:s] for e, s in zip(ends, [*(s for s, _ in merged), len(data)])))
                found.append([{"start": s, "end": e} for s, e in merged])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())],
                names=["k1", "k2", "n_bytes", "spans", "kept"],
            )

    shape = "k1 long, k2 long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    cut = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "copies", "text", "spans").mapInArrow(run, shape)
    return cut, texts


def removed(docs: DataFrame, results: list[Column], length: int = 400, text: str = "text") -> DataFrame:
    """`docs` without the text, with `results`, expressions over n_bytes, spans and kept of its text."""
    cut, texts = cut_texts(docs, length, text)
    found = stored(cut.select("k1", "k2", *results), "cut")
    texts.unpersist()
    rest = [c for c in docs.columns if c != text]
    k1, k2 = fresh([*rest, *found.columns[2:]], "k1_"), fresh([*rest, *found.columns[2:]], "k2_")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    a, b = text_key(value)
    keyed = docs.select(*[f"`{c}`" for c in rest], a.alias(k1), b.alias(k2))
    return keyed.join(found.withColumnsRenamed({"k1": k1, "k2": k2}), [k1, k2]).drop(k1, k2)
