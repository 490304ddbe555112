"""Hard-negative mining: scores by Strassen's multiplication of integer tiles, positives and windows as mergeable heaps.

Vectors become integers. Anchors and candidates are dealt to blocks; each pair of blocks is one cell, whose score tile is
the product of two integer matrices, multiplied recursively with seven products of halves in place of eight. Odd sides are
padded with zeros. Additions are exact: with 64-bit integers they are so modulo 2^64, however large a sum of quarters
gets, which is enough where the products themselves fit; other tiles take Python's integers.

A cell gives each of its anchors a heap of the best positives; heaps of several cells merge to the best of their union.
The final positives give windows of scores, and a second pass over the cells gives each window a heap of negatives, which
merge in the same way. Nothing else of a tile leaves its cell, so memory depends on the block sizes alone.

Rows with a null id or label, a null vector, or null or non-finite components take no part; vectors of other lengths than
the anchor's are no candidates of it. Every row is a row of its own: of two rows with one id, each is a candidate of the
other, and each has its own results if it is an anchor. Ties go to the smaller id, then to the row that was read first.
Anchors without positives, and windows without negatives, give no rows. A score that doesn't fit into 64 bits ends the job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.llm.common import stored
from gridwise.llm.topk import quantised

ANCHORS_PER_BLOCK = 1024
CANDIDATES_PER_BLOCK = 4096
#: Sides up to this length are multiplied directly.
DIRECT = 32
#: Cells of an anchor whose heaps meet in one task before the last merge.
MERGED_CELLS = 256
#: Scores below this can be taken in percent within 64 bits.
SMALL = 1 << 56


def padded(a: np.ndarray) -> np.ndarray:
    """With zeros up to even sides."""
    out = np.zeros([n + n % 2 for n in a.shape], a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray, direct: int = DIRECT) -> np.ndarray:
    """The exact product of two integer matrices."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= direct:
        return a @ b
    if rows % 2 or inner % 2 or columns % 2:
        a, b = padded(a), padded(b)
    r, m, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :m], a[:r, m:], a[r:, :m], a[r:, m:]
    b11, b12, b21, b22 = b[:m, :c], b[:m, c:], b[m:, :c], b[m:, c:]
    out = np.zeros((2 * r, 2 * c), a.dtype)
    p = strassen(a11 + a22, b11 + b22, direct)
    out[:r, :c] += p
    out[r:, c:] += p
    p = strassen(a21 + a22, b11, direct)
    out[r:, :c] += p
    out[r:, c:] -= p
    p = strassen(a11, b12 - b22, direct)
    out[:r, c:] += p
    out[r:, c:] += p
    p = strassen(a22, b21 - b11, direct)
    out[:r, :c] += p
    out[r:, :c] += p
    p = strassen(a11 + a12, b22, direct)
    out[:r, :c] -= p
    out[:r, c:] += p
    out[r:, c:] += strassen(a21 - a11, b11 + b12, direct)
    out[:r, :c] += strassen(a12 - a22, b21 + b22, direct)
    return out[:rows, :columns]


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products: 64-bit integers if all of them must fit."""
    high = [int(np.abs(x).max(initial=0)) for x in (anchors, candidates)]
    if anchors.shape[1] * high[0] * high[1] < 1 << 63 and max(high) < 1 << 53:
        return strassen(anchors.astype(np.int64), candidates.astype(np.int64).T)
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (anchors, candidates)]
    found = strassen(whole[0], whole[1].T)
    if max((abs(int(x)) for x in found.flat), default=0) >= 1 << 63:
        raise OverflowError("scores don't fit into 64 bits")
    return found


def heads(tile: np.ndarray, ids: np.ndarray, rows: np.ndarray, keep: int) -> list[np.ndarray]:
    """For each line of `tile` the columns of its `keep` best entries; masked entries (None or the lowest) never count."""
    order = np.lexsort((rows, ids))
    tile = tile[:, order]
    lowest = np.iinfo(np.int64).min  # below any score
    valid = np.count_nonzero(tile > lowest, axis=1)
    out = []
    for line, n in zip(tile, valid.tolist()):
        k = min(keep, n)
        if not k:
            out.append(order[:0])
            continue
        least = np.partition(line, len(line) - k)[len(line) - k]
        some = np.flatnonzero(line >= least)
        out.append(order[some[np.argsort(-line[some], kind="stable")[:k]]])
    return out


def vectors_of(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["v"]), "<f8").reshape(len(frame), -1)


def tile_of(anchors: pd.DataFrame, block: pd.DataFrame) -> np.ndarray:
    return scores(vectors_of(anchors), vectors_of(block)).astype(np.int64)


POSITIVES = "anchor long, anchor_id long, id long, row long, score long, cb long"
NEGATIVES = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, id long, row long, score long, cb long"


def positives_in_cell(anchors: pd.DataFrame, block: pd.DataFrame, keep: int) -> pd.DataFrame:
    tile = tile_of(anchors, block)
    ids, rows = block["id"].to_numpy(), block["row"].to_numpy()
    other = (anchors["label"].to_numpy()[:, None] != block["label"].to_numpy()) | (anchors["row"].to_numpy()[:, None] == rows)
    tile[other] = np.iinfo(np.int64).min
    found = heads(tile, ids, rows, keep)
    line, at = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
    return pd.DataFrame({
        "anchor": anchors["row"].to_numpy()[line], "anchor_id": anchors["id"].to_numpy()[line], "id": ids[at], "row": rows[at],
        "score": tile[line, at],
    })


def negatives_in_cell(anchors: pd.DataFrame, block: pd.DataFrame, keep: int, low: int, high: int) -> pd.DataFrame:
    """`anchors` has one line for each window: positive, positive_id and positive_score."""
    first = anchors.drop_duplicates("row")
    tile = tile_of(first, block)
    ids, rows = block["id"].to_numpy(), block["row"].to_numpy()
    tile[first["label"].to_numpy()[:, None] == block["label"].to_numpy()] = np.iinfo(np.int64).min
    place = pd.Series(np.arange(len(first)), index=first["row"].to_numpy())
    parts = []
    # Some windows at a time, so that their masked scores take no more than the tile.
    for start in range(0, len(anchors), ANCHORS_PER_BLOCK):
        some = anchors.iloc[start : start + ANCHORS_PER_BLOCK]
        window = some["positive_score"].to_numpy()[:, None]
        mine = tile[place[some["row"]].to_numpy()]
        outside = mine == np.iinfo(np.int64).min
        inside = np.where(outside, 0, mine)
        if max(np.abs(inside).max(initial=0), np.abs(window).max(initial=0)) >= SMALL:
            inside, window = inside.astype(object), window.astype(object)
        mine[outside | (100 * inside < low * window) | (100 * inside > high * window)] = np.iinfo(np.int64).min
        found = heads(mine, ids, rows, keep)
        line, at = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
        taken = some.iloc[line]
        parts.append(pd.DataFrame({
            "anchor": taken["row"].to_numpy(), "anchor_id": taken["id"].to_numpy(), "positive": taken["positive"].to_numpy(),
            "positive_id": taken["positive_id"].to_numpy(), "positive_score": taken["positive_score"].to_numpy(),
            "id": ids[at], "row": rows[at], "score": mine[line, at],
        }))
    return pd.concat(parts, ignore_index=True)


def merged(heaps: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The `keep` best of each key, ranked: heaps of some cells first, so that no task takes those of all cells."""
    order = [F.desc("score"), "id", "row"]
    some = Window.partitionBy(*keys, F.floor(F.col("cb") / MERGED_CELLS)).orderBy(*order)
    partly = heaps.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= keep)
    return partly.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: int = 256, id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each anchor's `positives` best other rows of its label, and for each of them the `negatives` best rows of other labels
    whose score is at least `low` and at most `high` percent of the positive's.
    """
    names = {"is_anchor": F.coalesce(is_anchor, F.lit(False)), "label": label.cast("long")}
    given = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector"), *[v.alias(k) for k, v in names.items()])
    usable = quantised(given.where("label IS NOT NULL"), "id", "vector", scale, ["is_anchor", "label"])
    packed = usable.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v")})
    rows = stored(packed, "vectors")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    blocks, anchor_blocks = max(1, -(-n_rows // CANDIDATES_PER_BLOCK)), max(1, -(-n_anchors // ANCHORS_PER_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    cell = ["ab", "cb", "dim"]
    candidates = as_bytes(rows).select("id", "row", "label", "v", "dim", block(blocks).alias("cb"), every(anchor_blocks).alias("ab"))
    anchors = as_bytes(rows.where("is_anchor")).select("id", "row", "label", "v", "dim", block(anchor_blocks).alias("ab"))

    def best_positives(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(block):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor", "anchor_id", "id", "row", "score", "cb")})
        return positives_in_cell(anchors, block, positives).assign(cb=block["cb"].iat[0])

    def best_negatives(windows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(windows) or not len(block):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in NEGATIVES.split(", ")})
        return negatives_in_cell(windows, block, negatives, low, high).assign(cb=block["cb"].iat[0])

    found = anchors.withColumn("cb", every(blocks)).groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInPandas(best_positives, POSITIVES)
    windows = stored(
        merged(found, ["anchor"], positives).select(
            F.col("anchor").alias("row"), F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        ), "windows",
    )
    asking = anchors.join(windows, "row").withColumn("cb", every(blocks))
    mined = asking.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInPandas(best_negatives, NEGATIVES)
    ranked = merged(mined, ["anchor", "positive"], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def as_bytes(rows: DataFrame) -> DataFrame:
    """The vectors as 64-bit floats in one binary value."""

    def run(frames):
        for frame in frames:
            yield frame.assign(v=[np.asarray(v, "<f8").tobytes() for v in frame["v"]])

    return rows.mapInPandas(run, ", ".join(f"{n} {'binary' if n == 'v' else t}" for n, t in rows.dtypes))
