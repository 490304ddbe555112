"""MinHash near duplicates by an LSH forest.

A text's set holds the hashes (64 bits) of its distinct word shingles; texts with equal sets are one node. A node's signature
has 128 minimum values of 16 bits. The forest is 32 sorted orders of the signatures: tree t reads a signature from its value
4 t on, cyclically, so it can go as deep as 128 values. A region of a tree is what shares a prefix. Regions start at four
values; where more than `REGION` nodes share them, the region goes deeper, each part as deep as its own density asks for.

1. In the first trees, nodes next to each other in a region's order have the longest common prefix; these pairs are
   candidates if enough of their values are equal. Candidates are confirmed on the full sets and give components.
2. In some trees, regions that still hold several components are looked at again, at four values: each node's most similar
   partner of another component is a candidate. Crowded regions are dealt into cells, so that each node outside of the
   region's largest component meets every other node of the region in some cell; none is left out for being crowded.
3. The same in all trees, now with all remaining pairs of different components whose signatures are near enough.

In steps 2 and 3 a pair is looked at in the first tree that it shares a region of.

In all steps, shingles that a node shares with no other node of the regions bound its similarity to any of them; pairs that
this bound keeps below 0.8 are no candidates. Texts with changes of their own, of which crowds are made, mostly go this way.

So a link is missed only if its signatures share four values in none of the trees, or have fewer than `LEAST_EQUAL` values
equal: with a similarity of 0.8, 5e-8 and less than 1e-7 of all links, and less with any higher one. What is confirmed is
exact. It is confirmed in its cell, which gets each text of its candidates once; pairs that others of the cell connect by then
are left out. Only links leave a cell, fewer than it has nodes.

Null texts and texts without words have an empty set and are linked with nothing. Rows without an id take part; the
component id is the smallest id of a component, null if none of its rows has one. Repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwise.llm.common import by_bytes, stored
from gridwise.llm.components import components
from gridwise.llm.simhash import row_key, shingle_hashes

VALUES = 128
TREES = 32
FIRST_TREES = 3
SECOND_TREES = 8
SHALLOW = 4
DEPTHS = (6, 9, 13, 19, 28, 42, 63, 95, VALUES)
#: Most nodes of a region that is not split, and of one side of a cell.
REGION = 512
#: Signatures with fewer equal values are no candidates: six deviations below 0.8 of the values.
LEAST_EQUAL = 76
SEED = 42
BATCH_BYTES = 2 << 20
#: Rows of open regions, some of which carry a text, in a partition.
ROWS_PER_PARTITION = 20_000
FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % i, SEED) | 1 for i in range(VALUES)], np.uint64)[:, None]


def shingle_set(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Distinct shingle hashes in order."""
    return np.unique(np.frombuffer(b"".join(shingle_hashes(text, words_per_shingle, SEED)), "<u8"))


def signature(hashes: np.ndarray) -> bytes:
    """The last 16 bits of the smallest product of each factor with the hashes, which are random already."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[None, start : start + 4096] * FACTORS).min(axis=1), out=least)
    return least.astype("<u2").tobytes()


def signed(docs: DataFrame, words_per_shingle: int, id: str, text: str) -> DataFrame:
    """Rows (k1, k2, id, n_shingles, d1, d2, signature): keys of the row, a digest of the set; nulls for empty sets."""
    keys = docs.select(*row_key(docs, id, text), F.col(f"`{id}`").alias("id"))
    names = [*keys.columns, "n_shingles", "d1", "d2", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0, BATCH_BYTES):
            sizes, digests, signatures = [], [], []
            for value in batch.column(0).to_pylist():
                found = shingle_set(value, words_per_shingle)
                sizes.append(len(found))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(found), "<i8").tolist() if len(found) else (None, None))
                signatures.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sizes, pa.int64()), *[pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)],
                 pa.array(signatures, pa.binary())],
                names=names,
            )

    chosen = docs.select(F.col(f"`{text}`").cast("string").alias("text"), *row_key(docs, id, text), F.col(f"`{id}`").alias("id"))
    long, none = F.lit(0).cast("long"), F.lit(None)
    more = {"n_shingles": long, "d1": none.cast("long"), "d2": none.cast("long"), "signature": none.cast("binary")}
    return chosen.mapInArrow(run, keys.withColumns(more).schema)


def in_trees(nodes: DataFrame, trees: int) -> DataFrame:
    """Rows (t, h, node): the first four values of each node in each tree, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = signatures_of(batch.column(1)).view("<i8")[:, :trees]
            n = len(starts)
            yield pa.RecordBatch.from_pydict({
                "t": pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), "h": pa.array(starts.ravel()),
                "node": pa.array(np.repeat(batch.column(0).to_numpy(), trees)),
            })

    return nodes.select("node", "signature").mapInArrow(run, "t int, h long, node long")


def signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


def labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """With `comp`, the component so far."""
    if roots is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def open_regions(rows: DataFrame) -> DataFrame:
    """Rows of the regions that hold several components, with their number `n`; of regions with the same nodes only the
    first."""
    rows = rows.drop("n")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    regions = rows.groupBy("t", "h").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), *marks)
    one = regions.where("low < high").groupBy("n", "x0", "x1").agg(F.min(F.struct("t", "h")).alias("r")).select("r.t", "r.h", "n")
    return rows.join(one, ["t", "h"])


def leaves(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (cell, t, node, comp): crowded regions as deep as their parts need, so that a part is no larger than `REGION`.

    Nodes that share a whole signature with more than that are dealt by their hash; later steps take care of the others.
    """
    plain = rows.where(F.col("n") <= REGION).select(F.xxhash64("t", "h").alias("cell"), "t", "node", "comp")
    crowded = rows.where(F.col("n") > REGION).join(nodes.select("node", "signature"), "node")
    prefix = lambda d: F.expr(f"xxhash64({d}, t, substring(concat(signature, signature), 2 * {SHALLOW} * t + 1, {2 * d}))")
    ways = F.array(*[F.struct(F.lit(d).alias("depth"), prefix(d).alias("p")) for d in DEPTHS])
    deep = crowded.select("t", "node", "comp", F.explode(ways).alias("way")).select("t", "node", "comp", "way.*")
    sizes = deep.groupBy("t", "depth", "p").agg(F.count("*").alias("size"))
    fits = deep.join(sizes, ["t", "depth", "p"]).where((F.col("size") <= REGION) | (F.col("depth") == VALUES))
    leaf = fits.groupBy("t", "node", "comp").agg(F.min(F.struct("depth", "p", "size")).alias("leaf"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("leaf.size") / REGION))
    return plain.unionByName(leaf.select(F.xxhash64("leaf.p", part).alias("cell"), "t", "node", "comp"))


def cells(rows: DataFrame) -> DataFrame:
    """Rows (cell, t, node, comp): in crowded regions each node outside of the largest component meets all others."""
    plain = rows.where(F.col("n") <= REGION).select(F.xxhash64("t", "h").alias("cell"), "t", "node", "comp")
    crowded = rows.where(F.col("n") > REGION)
    sizes = crowded.groupBy("t", "h", "comp").agg(F.count("*").alias("size"))
    sides = sizes.groupBy("t", "h").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all")).select(
        "t", "h", F.col("top.comp").alias("largest"), F.ceil(F.col("top.size") / REGION).cast("int").alias("inner"),
        F.ceil((F.col("all") - F.col("top.size")) / REGION).cast("int").alias("outer"),
    )
    dealt = crowded.join(sides, ["t", "h"]).withColumn("own", F.col("comp") == F.col("largest"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    ways = F.when(F.col("own"), F.transform(upto("outer"), lambda o: pair(o, F.col("block")))).otherwise(F.concat(
        F.transform(upto("inner"), lambda i: pair(F.col("block"), i)),
        F.transform(upto("outer"), lambda o: pair(F.least(o, F.col("block")), F.col("inner") + F.greatest(o, F.col("block")))),
    ))
    spread = dealt.withColumn("block", block).withColumn("way", F.explode(ways))
    return plain.unionByName(spread.select(F.xxhash64("t", "h", "way.a", "way.b").alias("cell"), "t", "node", "comp"))


def by_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, which is the first column, from batches sorted by it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        cell = table.column(0).to_numpy()
        cuts = (np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()
        for start, end in zip([0, *cuts], cuts):
            yield table.slice(start, end - start)
        held = table.slice(cuts[-1] if cuts else 0)
    if held is not None and held.num_rows:
        yield held


def neighbours(t: int, signatures: np.ndarray, size: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs next to each other in the tree's order: each node's longest common prefixes."""
    order = np.lexsort(np.roll(signatures, -SHALLOW * t, axis=1).T[::-1])
    i, j = order[:-1], order[1:]
    near = ((signatures[i] == signatures[j]).sum(axis=1) >= LEAST_EQUAL) & within_reach(i, j, size, alone)
    return i[near], j[near]


def within_reach(i: np.ndarray, j: np.ndarray, size: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Whether pairs may have a similarity of 0.8, by the sizes of their sets and the shingles that others have as well."""
    common = np.minimum(size[i] - alone[i], size[j] - alone[j])
    return 100 * common >= 80 * (size[i] + size[j] - common)


def across(
    t: int, signatures: np.ndarray, comp: np.ndarray, size: np.ndarray, alone: np.ndarray, best: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components with enough equal values that share no region of an earlier tree; with `best` only the
    most similar one of each node."""
    starts = signatures.view("<i8")[:, :t]
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(len(signatures) - 1 + best):
        others = np.flatnonzero(comp != comp[i])
        others = others if best else others[others > i]
        others = others[within_reach(np.full(len(others), i), others, size, alone)]
        equal = (signatures[others] == signatures[i]).sum(axis=1)
        near = (equal >= LEAST_EQUAL) & ~(starts[others] == starts[i]).any(axis=1)
        at, equal = others[near], equal[near]
        at = at[[equal.argmax()]] if best and len(at) else at
        first.append(np.full(len(at), i))
        second.append(at)
    return np.concatenate(first), np.concatenate(second)


def pairs_of(table: pa.Table, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates among a cell's rows (t, comp, n_shingles, alone, signature), the most similar first."""
    trees, comp, size, alone = (table.column(c).to_numpy() for c in ("t", "comp", "n_shingles", "alone"))
    signatures, t = signatures_of(table.column("signature")), int(trees[0])
    if how == "neighbours":
        i, j = neighbours(t, signatures, size, alone)
    else:
        i, j = across(t, signatures, comp, size, alone, how == "best")
    order = np.argsort(-(signatures[i] == signatures[j]).sum(axis=1), kind="stable")
    return i[order], j[order], comp


def by_cells(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("cell", *columns).repartition("cell").sortWithinPartitions("cell")


def candidates(rows: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """Rows (cell, t, node, comp): those of `rows` that are in a candidate pair of their cell. No pairs leave a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            i, j, _ = pairs_of(table.combine_chunks(), how)
            if len(i):
                yield from table.select(["cell", "t", "node", "comp"]).take(np.unique(np.concatenate([i, j]))).to_batches()

    full = by_cells(rows.join(marked, "node"), "t", "node", "comp", "n_shingles", "alone", "signature")
    return full.mapInArrow(run, "cell long, t int, node long, comp long")


def confirmed(rows: DataFrame, marked: DataFrame, texts: DataFrame, how: str, words_per_shingle: int) -> DataFrame:
    """Links (u, v) that connect what the full sets of each cell's candidates connect. A cell gets each of its texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            table = table.combine_chunks()
            node, text = table.column("node").to_numpy(), table.column("text")
            first, second, comp = pairs_of(table, how)
            label = {c: c for c in comp.tolist()}
            sets: dict[int, np.ndarray] = {}
            found = []
            for i, j in zip(first.tolist(), second.tolist()):
                a, b = top(label, int(comp[i])), top(label, int(comp[j]))
                if a != b:
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = shingle_set(text[k].as_py(), words_per_shingle)
                    if linked(sets[i], sets[j]):
                        label[max(a, b)] = min(a, b)
                        found.append((int(node[i]), int(node[j])))
            if found:
                yield pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in found]), "v": pa.array([x[1] for x in found])})

    full = by_cells(rows.join(marked, "node").join(texts, "node"), "t", "node", "comp", "n_shingles", "alone", "signature", "text")
    return full.mapInArrow(run, "u long, v long").distinct()


def top(label: dict[int, int], x: int) -> int:
    while label[x] != x:
        label[x] = label[label[x]]
        x = label[x]
    return x


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= 80 * (len(a) + len(b) - common)


def shingles_alone(texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """Rows (node, alone): how many of a node's shingles no other text has; nodes without such a shingle are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            sets = [shingle_set(x, words_per_shingle) for x in batch.column(1).to_pylist()]
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            shingles, first, times = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "shingle": pa.array(shingles.view(np.int64)), "node": pa.array(owner[first]), "times": pa.array(times),
            })

    rows = texts.select("node", "text").mapInArrow(run, "shingle long, node long, times long")
    once_seen = rows.groupBy("shingle").agg(F.sum("times").alias("times"), F.min("node").alias("node")).where("times = 1")
    return once_seen.groupBy("node").agg(F.count("*").alias("alone"))


def links(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words_per_shingle: int) -> DataFrame:
    """Rows (node, root) of the nodes that are linked. `texts_of` gives (node, text) of some nodes."""
    trees = stored(in_trees(nodes, TREES), "trees")
    regions = stored(open_regions(labelled(trees, None)).select("t", "h", "node", "n"), "regions")
    wanted = stored(regions.select("node").distinct(), "wanted")
    texts = texts_of(wanted)
    alone = F.coalesce("alone", F.lit(0)).cast("long").alias("alone")
    marked = nodes.join(wanted, "node").join(shingles_alone(texts, words_per_shingle), "node", "left")
    marked = stored(marked.select("node", "n_shingles", "signature", alone), "marked")
    roots = None
    with partitions_for(nodes.sparkSession, regions.count()):
        for how in ("neighbours", "best", "all"):
            if how == "neighbours":
                rows = leaves(labelled(regions.where(F.col("t") < FIRST_TREES), None), marked)
            else:
                used = regions.where(F.col("t") < SECOND_TREES) if how == "best" else regions
                rows = cells(open_regions(labelled(used, roots)))
            some = stored(candidates(rows, marked, how), "candidates")
            new = stored(confirmed(some, marked, texts, how, words_per_shingle), "links")
            # The components so far are links to their roots, so that only what is new has to be followed.
            known = new if roots is None else new.union(roots.where("node <> root").toDF("u", "v"))
            roots = stored(components(known), "roots")
    return roots


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of the jobs that run inside take as many partitions as the open regions' rows ask for, at most as many as the
    session has: what is left of a large corpus is often little, and is gone through many times."""
    setting = "spark.sql.shuffle.partitions"
    given = spark.conf.get(setting)
    spark.conf.set(setting, str(max(1, min(int(given), -(-rows // ROWS_PER_PARTITION)))))
    try:
        yield
    finally:
        spark.conf.set(setting, given)


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_shingles (the size of its set), component_id and kept.

    Linked are texts whose sets have 100 * intersection >= 80 * union. `kept` says that the row has its component's id.
    """
    marked = stored(signed(docs, words_per_shingle, id, text), "signatures")
    full = marked.where("signature IS NOT NULL")
    distinct = full.groupBy("d1", "d2").agg(
        F.min("id").alias("least"), F.min(F.struct("k1", "k2")).alias("row"), F.max("n_shingles").alias("n_shingles"),
        F.min("signature").alias("signature"),
    )
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = nodes.join(wanted, "node", "left_semi").select("node", "row.k1", "row.k2")
        keyed = docs.select(F.col(f"`{text}`").cast("string").alias("text"), *row_key(docs, id, text))
        return stored(keyed.join(rows, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]), "texts")

    roots = links(nodes, texts_of, words_per_shingle)
    placed = nodes.select("node", "d1", "d2", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("d1", "d2", "component_id")
    found = marked.select("id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("d1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
