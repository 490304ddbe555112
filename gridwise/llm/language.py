"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is parsed into the longest phrases that occur in
that labelled text; the fewer phrases, weighted by the logarithm of the labelled text's length and divided by the text's
length, the closer the language. The language with the fewest normalised phrases wins, ties go to the first by name.

Parsing runs over lanes, one for each language and block of a text: a step moves all lanes one byte forward through one
table. Phrases end at block edges, equally for all languages; all blocks of a text count.

A null text, or one without a letter, is `und` with score 0, and so is every text if nothing could be learned. The score
is one minus the ratio of the lowest to the second lowest value (1 if there is one language only).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from gridwise.llm.common import by_bytes, once, tidied

#: Bounds of what is learned from: the languages with the most different texts, so many different texts of each, so many
#: bytes of them together.
LANGUAGES = 256
TEXTS_PER_LANGUAGE = 64
BYTES_PER_LANGUAGE = 1 << 15
BLOCK = 2048
BATCH_BYTES = 1 << 20
UNKNOWN = "und"
LATIN = re.compile("[A-Za-z]")
# Letters of ASCII are kept, its other characters become spaces, bytes of longer characters stay.
PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return LATIN.search(text) is not None or any(map(str.isalpha, text))


def plain(text: str) -> bytes:
    return text.lower().encode().translate(PLAIN)


@dataclass(frozen=True)
class Samples:
    """Labelled text by language, in the order of names."""

    names: tuple[str, ...]
    texts: tuple[bytes, ...]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Samples:
    """Take bounded labelled text: of each language the texts with the lowest hashes.

    Hashes are counted first, so that only about eight times the wanted number is sorted however many rows there are.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where(
        F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}")
    ).select("l", F.substring("t", 1, BYTES_PER_LANGUAGE).alias("t"), F.xxhash64("t").alias("h"))
    sizes = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).withColumn(
        "most", F.least(F.lit(1.0), 8.0 * TEXTS_PER_LANGUAGE / F.col("n"))
    ).orderBy(F.desc("n"), "l").limit(LANGUAGES)
    near = rows.join(F.broadcast(sizes), "l").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("most"))
    order = Window.partitionBy("l").orderBy("h", "t")
    kept = near.select("l", "t", "h").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= TEXTS_PER_LANGUAGE)
    found: dict[str, list[bytes]] = {}
    for row in sorted(kept.collect(), key=lambda r: (r["l"], r["at"])):
        found.setdefault(row["l"], []).append(plain(row["t"]))
    share = {name: max(BYTES_PER_LANGUAGE // len(texts), 1) for name, texts in found.items()}
    joined = {name: b"\n".join(t[: share[name]] if sum(map(len, texts)) > BYTES_PER_LANGUAGE else t for t in texts) for name, texts in found.items()}
    return Samples(tuple(sorted(joined)), tuple(joined[name] for name in sorted(joined)))


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Next states by state, from state 0, and symbol, of the automaton that reads exactly the substrings of `symbols`; -1 for
    none."""
    moves = np.full((2 * len(symbols) + 1, width), -1, np.int32)
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and moves[at, symbol] < 0:
            moves[at, symbol] = state
            at = link[at]
        if at >= 0:
            to = int(moves[at, symbol])
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                copy = len(length)
                moves[copy] = moves[to]
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[state] = copy
                while at >= 0 and moves[at, symbol] == to:
                    moves[at, symbol] = copy
                    at = link[at]
        last = state
    return moves[: len(length)]


class Parser:
    """Counts phrases of texts against all samples at once."""

    def __init__(self, samples: Samples) -> None:
        used = sorted(set(b"".join(samples.texts)) - {10})
        self.symbol = np.zeros(256, np.int32)  # 0: no sample has it
        self.symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        tables, roots, at = [], [], 0
        for sample in samples.texts:
            # The line breaks between samples are symbol 0 here, which no text has in its samples.
            table = suffix_automaton(self.symbol[np.frombuffer(sample, np.uint8)].tolist(), width)
            table[:, 0] = -1
            # An entry is four times the next state's place, plus the phrases that end: one where the byte starts the next
            # phrase, two where no phrase can hold it, so that it is one by itself.
            start = np.where(table[0] < 0, 0, table[0])
            ends = (table < 0).astype(np.int8)
            ends[1:, table[0] < 0] = 2
            table = np.where(ends > 0, start[None, :], table).astype(np.int32 if (at + len(table)) * width < 1 << 28 else np.int64)
            tables.append(((table + at) * width) << 2 | ends)
            roots.append(at * width)
            at += len(table)
        self.table = np.concatenate(tables).ravel()
        self.roots = np.array(roots, self.table.dtype)
        self.weight = np.array([math.log2(max(len(x), 2)) for x in samples.texts])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases by text and language."""
        parts = [(len(t[i : i + BLOCK]), k, t[i : i + BLOCK]) for k, t in enumerate(texts) for i in range(0, len(t), BLOCK)]
        parts.sort(key=lambda x: -x[0])
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        if not parts:
            return out
        longest = parts[0][0]
        grid = np.frombuffer(b"".join(p[2].ljust(longest, b"\n") for p in parts), np.uint8).reshape(len(parts), longest)
        grid = np.ascontiguousarray(self.symbol[grid].T.astype(self.table.dtype))
        active = np.searchsorted(-np.array([p[0] for p in parts]), -np.arange(longest), side="left")
        state = np.repeat(self.roots[:, None], len(parts), axis=1)
        count = np.zeros(state.shape, self.table.dtype)
        for step, n in enumerate(active.tolist()):
            entry = self.table.take(state[:, :n] + grid[step, :n])
            count[:, :n] += entry & 3
            state[:, :n] = entry >> 2
        count += state != self.roots[:, None]  # the open phrase at the end of a block
        np.add.at(out, [p[1] for p in parts], count.T)
        return out


def predictions(parser: Parser | None, names: tuple[str, ...], texts: list[str | None]) -> tuple[list[str], list[float]]:
    usable = [i for i, t in enumerate(texts) if t and has_letter(t)] if parser else []
    language, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not usable:
        return language, score
    data = [plain(texts[i]) for i in usable]
    cost = parser.phrases(data) * parser.weight / np.array([[len(x)] for x in data])
    best = cost.argmin(axis=1)
    low = cost[np.arange(len(cost)), best]
    cost[np.arange(len(cost)), best] = np.inf
    second = cost.min(axis=1)
    for i, b, x, y in zip(usable, best.tolist(), low.tolist(), second.tolist()):
        language[i] = names[b]
        score[i] = min(1.0, max(0.0, 1.0 - x / y)) if y > 0 else 0.0
    return language, score


def identify(docs: DataFrame, samples: Samples, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with all its columns, the predicted language and its score; columns of those names are replaced."""
    rest = [c for c in docs.columns if c not in (label, score)]
    at = rest.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # bounded for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        parser = once("language parser", known, lambda: Parser(known)) if known.names else None
        for batch in by_bytes(batches, at, BATCH_BYTES):
            found = predictions(parser, known.names, batch.column(at).to_pylist())
            added = [pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*rest, label, score])

    columns = [f"`{c}`" for c in rest]
    schema = docs.select(*columns, F.lit("").alias(label), F.lit(0.0).alias(score)).schema
    return docs.select(*columns).mapInArrow(tidied(run), schema)
