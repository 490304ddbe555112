"""Near duplicates by SimHash fingerprints and the general pigeonhole principle.

A text gets a fingerprint of 64 bits from the hashes of its word shingles. Fingerprints link if few bits differ. To find
all links, bits that go together are grouped into partitions; for each fingerprint a dynamic program gives the partitions
unequal thresholds t that add up so that a fingerprint within the distance must be within t bits in some partition. It
minimises the expected candidates, estimated from counts of all fingerprints' partition values. Each fingerprint probes
the values within t bits of its own, and what it meets there is verified bit by bit.

Equal fingerprints are one node, so copies cost nothing. A bucket's members are dealt to cells of bounded size, and a
cell gives a spanning forest of its links, not all pairs.

Null texts count as empty; texts without words get fingerprint 0 and link like any other. Rows without an id take part;
the component id is the smallest id of a component, null if none of its rows has one. Repeated rows share a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridwise.llm.common import by_bytes, fresh, stored, tidied
from gridwise.llm.components import components

BITS = 64
BATCH_BYTES = 1 << 20
#: Partition values are counted on so many of their bits.
COUNTED_BITS = 16
#: Most rows of one side of a cell, and what one probe costs in units of one candidate: a row that is dealt and sorted
#: takes some microseconds, a comparison within a cell some ten nanoseconds.
CELL_ROWS = 4096
PROBE_COST = 200.0
# Eight byte lanes hold the eight bits of a byte, so that sums of up to 255 rows don't run over.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_hashes(text: str | None, words_per_shingle: int, seed: int) -> list[bytes]:
    words = text.encode().lower().split() if text else []
    if len(words) < words_per_shingle:
        return [xxhash.xxh64_digest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: -words_per_shingle])]
    digest = xxhash.xxh64_digest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[words_per_shingle - 1 :])]


def fingerprints(texts: list[str | None], words_per_shingle: int, seed: int) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    hashes, counts = [], []
    for text in texts:
        found = shingle_hashes(text, words_per_shingle, seed)
        hashes += found
        counts.append(len(found))
    counts = np.array(counts, np.int64)
    out = np.zeros((len(texts), BITS), np.uint8)
    if hashes:
        ends = np.cumsum(counts)
        starts = ends - counts
        cuts = np.unique(np.concatenate([starts[counts > 0], np.arange(0, len(hashes), 255)]))
        lanes = LANES[np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)]
        parts = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).astype(np.int64)
        filled = np.flatnonzero(counts)
        sums = np.add.reduceat(parts, np.searchsorted(cuts, starts[filled]), axis=0)
        out[filled] = sums * 2 > counts[filled, None]
    return np.packbits(out, axis=1).view(">i8").ravel().astype(np.int64)


def with_fingerprint(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42, text: str = "text", name: str = "fp") -> DataFrame:
    """`docs` without the text, with its fingerprint as a long."""
    rest = [c for c in docs.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0, BATCH_BYTES):
            found = fingerprints(batch.column(0).to_pylist(), words_per_shingle, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], names=[*rest, name])

    chosen = docs.select(F.col(f"`{text}`").cast("string").alias(text), *[f"`{c}`" for c in rest])
    return chosen.mapInArrow(tidied(run), docs.select(*[f"`{c}`" for c in rest], F.lit(0).cast("long").alias(name)).schema)


def ball(bits: int, radius: int) -> int:
    """Number of values within `radius` bits of one of `bits` bits."""
    return sum(math.comb(bits, i) for i in range(radius + 1))


def masks(bits: int, radius: int) -> np.ndarray:
    """All values of `bits` bits with 1 to `radius` set bits."""
    found, level = [], [(0, 0)]
    for _ in range(radius):
        level = [(value | 1 << i, i + 1) for value, start in level for i in range(start, bits)]
        found += [value for value, _ in level]
    return np.array(found, np.int64)


def partition_count(nodes: int, distance: int) -> int:
    """How many partitions cost least if bits were independent."""

    def cost(m: int) -> float:
        width = BITS // m
        low, extra = divmod(distance + 1 - m, m)
        probes = [ball(width, low + (i < extra)) for i in range(m)]
        return sum(p * (PROBE_COST + nodes / 2.0**width) for p in probes)

    return min(range(2, distance + 2), key=lambda m: (cost(m), m)) if distance else 1


def bit_groups(both: np.ndarray, rows: int, count: int) -> list[list[int]]:
    """Bits in `count` groups; bits that go together share one. `both[i, j]`: rows in which bits i and j are set."""
    share = both / max(rows, 1)
    ones = np.diag(share)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    near = np.abs((share - np.outer(ones, ones)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    left, groups = set(range(BITS)), []
    for g in range(count):
        size = BITS // count + (g < BITS % count)
        group = [max(sorted(left), key=lambda b: sum(near[b, x] for x in left))]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: sum(near[b, x] for x in group))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def value_of(fingerprint: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fingerprint), np.int64)
    for i, bit in enumerate(group):
        out |= (fingerprint >> bit & 1) << i
    return out


@dataclass(frozen=True)
class Plan:
    """Bit groups, and for each group and threshold from -1 the expected candidates by the value's counted bits."""

    distance: int
    groups: list[list[int]]
    expected: list[np.ndarray]


def estimates(counts: np.ndarray, width: int, distance: int) -> np.ndarray:
    """Expected members within t bits (t from 0 to `distance`), by counted value, if the other bits are random."""
    counted = min(width, COUNTED_BITS)
    rest = width - counted
    keys = np.arange(len(counts))
    at = [counts.astype(float)]
    for radius in range(1, min(distance, counted) + 1):
        total = np.zeros(len(counts))
        for mask in masks(counted, radius)[len(masks(counted, radius - 1)) :]:
            total += counts[keys ^ mask]
        at.append(total)
    return np.array(
        [sum(x * ball(rest, t - a) for a, x in enumerate(at) if a <= t) / 2.0**rest for t in range(distance + 1)]
    )


def make_plan(nodes: DataFrame, distance: int) -> Plan:
    """Count bits and partition values over all fingerprints; only tables of fixed size reach the driver."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = (batch.column(0).to_numpy()[:, None] >> np.arange(BITS) & 1).astype(np.float64)
            total += bits.T @ bits
            rows += len(bits)
        if rows:
            yield pa.RecordBatch.from_pydict({
                "bit": pa.array([*range(BITS), BITS], pa.int32()),
                "both": pa.array([*total.astype(np.int64).tolist(), [rows]], pa.list_(pa.int64())),
            })

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << min(len(g), COUNTED_BITS), np.int64) for g in groups]
        for batch in batches:
            found = batch.column(0).to_numpy()
            for g, group in enumerate(groups):
                sums[g] += np.bincount(value_of(found, group[:COUNTED_BITS]), minlength=len(sums[g]))
        for g, counts in enumerate(sums):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"g": pa.array(np.full(len(used), g), pa.int32()), "value": pa.array(used), "n": pa.array(counts[used])})

    found = nodes.select("fp").mapInArrow(pairs, "bit int, both array<long>").select("bit", F.posexplode("both").alias("other", "n"))
    table, rows = np.zeros((BITS, BITS)), 0
    for bit, other, n in found.groupBy("bit", "other").agg(F.sum("n")).collect():
        if bit < BITS:
            table[bit, other] = n
        else:
            rows = n
    groups = bit_groups(table, rows, partition_count(rows, distance))
    counts = [np.zeros(1 << min(len(g), COUNTED_BITS), np.int64) for g in groups]
    seen = nodes.select("fp").mapInArrow(values, "g int, value long, n long").groupBy("g", "value").agg(F.sum("n").alias("n")).toPandas()
    for g, part in seen.groupby("g"):
        counts[g][part["value"].to_numpy()] = part["n"].to_numpy()
    return Plan(distance, groups, [estimates(c, len(g), distance) for c, g in zip(counts, groups)])


def thresholds(plan: Plan, fingerprint: np.ndarray) -> np.ndarray:
    """For each fingerprint and group the threshold (-1: no probe) that the dynamic program allots."""
    n, budget = len(fingerprint), plan.distance + 1
    best = np.full((budget + 1, n), np.inf)
    best[0] = 0
    choice = []
    for group, expected in zip(plan.groups, plan.expected):
        key = value_of(fingerprint, group[:COUNTED_BITS])
        now, taken = best.copy(), np.zeros((budget + 1, n), np.int8)
        for spent in range(1, min(budget, len(group)) + 1):
            cost = expected[spent - 1][key] + PROBE_COST * ball(len(group), spent - 1)
            for total in range(spent, budget + 1):
                new = best[total - spent] + cost
                better = new < now[total]
                now[total][better] = new[better]
                taken[total][better] = spent
        best = now
        choice.append(taken)
    out, left = np.empty((len(plan.groups), n), np.int8), np.full(n, budget)
    for g in range(len(plan.groups) - 1, -1, -1):
        spent = choice[g][left, np.arange(n)]
        out[g] = spent - 1
        left = left - spent
    return out


OWN, ASKS = 1, 2  # a bucket row is a member, or asks the members, or both


def bucket_rows(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Rows (g, key, fp, kind): each fingerprint is a member of its bucket in each group and asks those it probes."""
    shared = nodes.sparkSession.sparkContext.broadcast(plan)  # at most 2^16 numbers for each group and threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        changes = {(len(g), t): masks(len(g), t) for g in plan.groups for t in range(plan.distance + 1) if ball(len(g), t) < 1 << 20}
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                fp = whole.column(0).slice(start, 2048).to_numpy()
                given = thresholds(plan, fp)
                for g, group in enumerate(plan.groups):
                    key = value_of(fp, group)
                    keys, fps, kinds = [key], [fp], [OWN + ASKS * (given[g] >= 0)]
                    for t in range(1, plan.distance + 1):
                        asking = given[g] == t
                        if asking.any():
                            mask = changes[len(group), t]
                            keys.append((key[asking, None] ^ mask).ravel())
                            fps.append(np.repeat(fp[asking], len(mask)))
                            kinds.append(np.full(len(fps[-1]), ASKS))
                    keys, fps = np.concatenate(keys), np.concatenate(fps)
                    yield pa.RecordBatch.from_pydict({
                        "g": pa.array(np.full(len(keys), g, np.int32)), "key": pa.array(keys), "fp": pa.array(fps),
                        "kind": pa.array(np.concatenate(kinds).astype(np.int32)),
                    })

    return nodes.select("fp").mapInArrow(tidied(run), "g int, key long, fp long, kind int")


def cells(rows: DataFrame) -> DataFrame:
    """Deal buckets that are larger than a cell into pairs of a block of askers and a block of members."""
    large = rows.groupBy("g", "key").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS).withColumn(
        "side", F.ceil(F.col("n") / CELL_ROWS).cast("int")
    ).drop("n")
    dealt = rows.join(large, ["g", "key"], "left").withColumn("side", F.coalesce("side", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("side")).cast("int")
    every = F.sequence(F.lit(0), F.col("side") - 1)
    ways = F.when(F.col("side") == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("kind").alias("as")))).otherwise(
        F.concat(
            F.when(F.col("kind").bitwiseAND(ASKS) > 0, F.transform(every, lambda b: F.struct(block.alias("a"), b.alias("b"), F.lit(ASKS).alias("as")))).otherwise(F.array()),
            F.when(F.col("kind").bitwiseAND(OWN) > 0, F.transform(every, lambda a: F.struct(a.alias("a"), block.alias("b"), F.lit(OWN).alias("as")))).otherwise(F.array()),
        )
    )
    return dealt.withColumn("way", F.explode(ways)).select("g", "key", "way.a", "way.b", "fp", F.col("way.as").alias("kind"))


def forest(cell: np.ndarray, fp: np.ndarray, kind: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints that verify, among rows sorted by cell."""
    n, bits = len(cell), fp.view(np.uint64)
    label = np.arange(n)
    ends = np.searchsorted(cell, cell, side="right")
    rows = np.flatnonzero(ends - np.arange(n) > 1)
    shift = 1
    while len(rows):
        other = rows + shift
        a, b = kind[rows], kind[other]
        meet = (a & OWN & (b >> 1)) | (b & OWN & (a >> 1))
        near = (np.bitwise_count(bits[rows] ^ bits[other]) <= distance) & (meet > 0)
        i, j = rows[near], other[near]
        while len(i := i[(differ := label[i] != label[j])]):
            j = j[differ]
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            np.minimum.at(label, high, low)
            while not np.array_equal(deeper := label[label], label):
                label = deeper
        shift += 1
        rows = rows[rows + shift < ends[rows]]
    linked = fp != fp[label]
    return fp[linked], fp[label][linked]


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Spanning links (u, v) of all fingerprints of `nodes` (fp, distinct) within `distance` bits."""
    plan = make_plan(nodes, distance)
    dealt = cells(bucket_rows(nodes, plan))
    cell = ["g", "key", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([*held, new], axis=1) if held else new
            same = (rows[:4] == rows[:4, -1:]).all(axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [rows[:, cut:]]
            if cut:
                yield found(rows[:, :cut])
        if held:
            yield found(held[0])

    def found(rows: np.ndarray) -> pa.RecordBatch:
        new = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
        number = np.concatenate([[0], np.cumsum(new)])
        u, v = forest(number, rows[4], rows[5], distance)
        return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    return dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(tidied(run), "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, words_per_shingle: int = 4, distance: int = 4, seed: int = 42, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of `docs`: id, k1 and k2 (a digest of id and text), fingerprint `fp`, `component_id`."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.select(F.col(f"`{id}`").alias("id"), value.alias("text"), *row_key(docs, id, text))
    marked = stored(with_fingerprint(keyed, words_per_shingle, seed), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes, distance))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").withColumnRenamed("id", id)


def row_key(docs: DataFrame, id: str = "doc_id", text: str = "text"):
    """128 bits that stand for a row's id and text; only rows with both equal share them."""
    parts = [F.col(f"`{id}`").cast("string"), F.col(f"`{text}`").cast("string")]
    marks = [F.isnull(p).cast("int") for p in parts]
    return F.xxhash64(*marks, *parts).alias("k1"), F.xxhash64(F.lit("second"), *parts[::-1], *marks).alias("k2")


def keep_one(docs: DataFrame, words_per_shingle: int = 4, distance: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the one with the smallest id (null last, then by digest)."""
    found = near_duplicates(docs, words_per_shingle, distance, id=id, text=text)
    first = found.groupBy("root").agg(
        F.min(F.struct(F.isnull(id).alias("none"), F.col(id).alias("id"), "k1", "k2")).alias("first")
    ).select("first.k1", "first.k2")
    k1, k2 = fresh(docs.columns, "k1"), fresh(docs.columns, "k2")
    a, b = row_key(docs, id, text)
    keyed = docs.withColumns({k1: a, k2: b})
    kept = keyed.join(first.toDF(k1, k2), [k1, k2], "left_semi")
    return kept.dropDuplicates([k1, k2]).select(*[f"`{c}`" for c in docs.columns])
