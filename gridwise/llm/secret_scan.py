"""Secret scans: assigned values, access keys, long hexadecimal runs, and strings that pass tests of randomness.

Base spans are regular expressions. The method adds maximal runs of token characters that hold digits and letters and that
no test tells from random ones: the encoding is inferred from the characters, then a chi-squared test of uniformity over
the alphabet, a runs test and a test of serial correlation are combined. The corpus decides how small a combined value
must be to call a run structured: in each stratum of encoding and length the false discovery rate among the runs so called
is held at `RATE` by step-up counts. Short runs, whose tests have little power, need more bits to be taken at all.

Everything is DataFrame expressions within a row; only counts by stratum and bin leave it. Null and empty texts have no
spans. Positions are code points, ends exclusive. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Pattern, the group whose length counts, and that length. Runs of one class that are long enough are the
# same as maximal runs filtered by length, so the length stands in the pattern there.
BASE = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
RANDOM = "random"
TOKEN = r"[A-Za-z0-9+/_-]{20,}=*"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Encodings in the order in which they are tried, with their alphabets.
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + LOWER[:6]),
    "base32": ("^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    "upper36": ("^[A-Z0-9]+$", DIGITS + UPPER),
    "lower36": ("^[a-z0-9]+$", DIGITS + LOWER),
    "base62": ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    "base64": ("", UPPER + LOWER + DIGITS + "+/"),
}
#: False discovery rate, bins of the logarithm of a combined value, least information in a run.
RATE = 0.05
BINS_PER_UNIT, MOST_BINS = 20, 400
LEAST_BITS = 100.0
LEAST_P = 1e-12
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,size:int>>"


def located(text: Column, pattern: str, group: int, kind: str, rank: int) -> Column:
    """Leftmost, not overlapping matches in order; `size` is the length of the group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.zip_with(F.zip_with(found, sizes, lambda f, s: F.struct(F.length(f).alias("n"), s.alias("s"))), F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.n.alias("n"), m.s.alias("s"), g.alias("g")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(done: Column, part: Column) -> Column:
        start = done.at + part.g
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + part.n).alias("end"), F.lit(kind).alias("kind"), part.s.alias("size"))
        return F.struct((start + part.n).alias("at"), F.concat(done.spans, F.array(span)).cast(SPAN).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(parts, first, step, lambda done: done.spans)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind."""
    def long_enough(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        return F.filter(located(text, pattern, group, kind, rank), lambda s: s.size >= least)

    return F.array_sort(F.concat(*[long_enough(rank, kind, *rule) for rank, (kind, rule) in enumerate(BASE.items())]))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often the expression names it."""
    return F.transform(F.array(value), then)[0]


def normal_tail(z: Column) -> Column:
    """Chance of a larger value of the standard normal distribution, by a logistic approximation."""
    return let(F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)), lambda x: 1 / (1 + F.exp(1.5976 * x + 0.07056 * x * x * x)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def encoding_of(token: Column) -> Column:
    bare = F.regexp_replace(token, "=+$", "")
    names = list(ENCODINGS)
    chosen = F.lit(names[-1])
    for name in reversed(names[:-1]):
        chosen = F.when(bare.rlike(ENCODINGS[name][0]), name).otherwise(chosen)
    return chosen


def uniform_chance(x: Column, n: Column, a: Column) -> Column:
    """Chi-squared test over the alphabet, in bins that expect about five characters or more."""

    def test(bins: Column) -> Column:
        def part(b: Column) -> Column:
            expected = n * (F.ceil((b + 1) * a / bins) - F.ceil(b * a / bins)) / a
            seen = F.size(F.filter(x, lambda v: F.floor(v * bins / a) == b))
            return let(expected, lambda e: (seen - e) * (seen - e) / e)

        chi = total(F.transform(F.sequence(F.lit(0), bins - 1), part))
        free = (bins - 1).cast("double")
        return normal_tail((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))

    return let(F.greatest(F.lit(2), F.least(a, F.floor(n / 5)).cast("int")), test)


def runs_chance(x: Column, n: Column, a: Column) -> Column:
    """Runs above and below the middle of the alphabet."""

    def test(high: Column) -> Column:
        above = F.aggregate(high, F.lit(0.0), lambda s, h: s + h)
        changes = total(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda v, w: F.abs(v - w)))
        both = 2 * above * (n - above)
        return let(both, lambda b: F.when(b == 0, 0.0).otherwise(
            2 * normal_tail(F.abs(changes - b / n) / F.sqrt(F.greatest(b * (b - n) / (n * n * (n - 1)), F.lit(1e-9))))
        ))

    return let(F.transform(x, lambda v: (v * 2 >= a).cast("double")), test)


def serial_chance(x: Column, n: Column, a: Column) -> Column:
    """Correlation of neighbours around the middle of the alphabet."""

    def test(y: Column) -> Column:
        beside = total(F.zip_with(F.slice(y, 1, F.size(y) - 1), F.slice(y, 2, F.size(y) - 1), lambda v, w: v * w))
        square = total(F.transform(y, lambda v: v * v))
        return let(square, lambda q: F.when(q == 0, 0.0).otherwise(2 * normal_tail(F.abs(beside / q) * F.sqrt(n))))

    return let(F.transform(x, lambda v: v - (a - 1) / 2), test)


def battery(token: Column, encoding: Column) -> Column:
    """Combined chance of a random string of this encoding to look as uneven as `token`, and its bits: (p, bits)."""
    alphabet, size = F.lit(""), F.lit(2.0)
    for name, (_, letters) in ENCODINGS.items():
        alphabet = F.when(encoding == name, letters).otherwise(alphabet)
        size = F.when(encoding == name, float(len(letters))).otherwise(size)
    bare = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    bare = F.when(encoding == "hex", F.lower(bare)).otherwise(bare)

    def indexes(s: Column) -> Column:
        place = lambda i: (F.call_function("locate", F.substr(s.t, i, F.lit(1)), s.letters) - 1).cast("double")
        return F.transform(F.sequence(F.lit(1), F.length(s.t)), place)

    def combined(s: Column) -> Column:
        n = F.size(s.x).cast("double")
        chances = F.array(*[test(s.x, n, s.a) for test in (uniform_chance, runs_chance, serial_chance)])
        half = F.aggregate(chances, F.lit(0.0), lambda h, p: h - F.log(F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(1.0))))
        return let(half, lambda h: F.struct((F.exp(-h) * (1 + h + h * h / 2)).alias("p"), (n * F.log2(s.a)).alias("bits")))

    letters = let(F.struct(bare.alias("t"), alphabet.alias("letters")), indexes)
    return let(F.struct(letters.alias("x"), size.alias("a")), combined)


def rests(text: Column, run: Column, base: Column) -> Column:
    """What lies outside of base spans in a run, without the separators next to them; stretches below 20 characters go."""
    def cut(inside: Column) -> Column:
        ends = F.concat(F.array(run.start), F.transform(inside, lambda b: b.end))
        starts = F.concat(F.transform(inside, lambda b: b.start), F.array(run.end))
        # Base spans may overlap: a stretch starts after the furthest end so far.
        gaps = F.transform(starts, lambda end, i: F.struct(F.array_max(F.slice(ends, 1, i + 1)).alias("start"), end.alias("end"), i.alias("i")))
        bare = F.transform(F.filter(gaps, lambda g: g.end - g.start >= 20), lambda g: let(
            F.substr(text, g.start + 1, g.end - g.start), lambda t: F.struct(
                (g.start + F.when(g.i > 0, F.length(t) - F.length(F.regexp_replace(t, "^[+/_=-]+", ""))).otherwise(0)).alias("start"),
                (g.end - F.when(g.i < F.size(inside), F.length(t) - F.length(F.regexp_replace(t, "[+/_-]+$", ""))).otherwise(0)).alias("end"),
            )
        ))
        spans = F.transform(bare, lambda g: F.struct(
            g.start.alias("start"), run["rank"].alias("rank"), g.end.alias("end"), run.kind.alias("kind"), (g.end - g.start).alias("size")
        ))
        return F.filter(spans, lambda s: s.size >= 20)

    inside = F.filter(base, lambda b: (b.start < run.end) & (run.start < b.end))
    return F.when(F.exists(base, lambda b: (b.start < run.end) & (run.start < b.end)), let(inside, cut)).otherwise(F.array(run))


def candidates(text: Column, base: Column) -> Column:
    """Runs of token characters with digits and letters, and what base spans leave of them: start, end, stratum, bin, bits."""
    runs = F.flatten(F.transform(located(text, TOKEN, 0, RANDOM, len(BASE)), lambda s: rests(text, s, base)))

    def tested(span: Column) -> Column:
        return let(F.substr(text, span.start + 1, span.end - span.start), lambda token: let(
            F.struct(token.alias("t"), encoding_of(token).alias("e")), lambda s: judged(span, s.t, s.e)
        ))

    def judged(span: Column, token: Column, encoding: Column) -> Column:
        usable = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.length(F.regexp_replace(token, "=+$", "")) >= 20)
        band = F.least(F.lit(4), F.floor(F.log2((span.end - span.start) / F.lit(16.0))))
        return let(F.when(usable, battery(token, encoding)), lambda found: F.struct(
            span.alias("span"), F.concat(encoding, F.lit("/"), band.cast("string")).alias("stratum"),
            F.least(F.lit(MOST_BINS), F.floor(-F.log(F.greatest(found.p, F.lit(LEAST_P))) * BINS_PER_UNIT)).cast("int").alias("bin"),
            found.bits.alias("bits"),
        ))

    return F.filter(F.transform(runs, tested), lambda c: c.bits >= LEAST_BITS)


def structured_from(counts: dict[str, dict[int, int]], rate: float = RATE) -> dict[str, int]:
    """For each stratum the lowest bin of runs that are called structured (beyond the last bin: none)."""
    limits = {}
    for stratum, bins in counts.items():
        rows, rejected, limit = sum(bins.values()), 0, MOST_BINS + 1
        for bin in range(MOST_BINS, -1, -1):
            rejected += bins.get(bin, 0)
            if rejected and math.exp(-bin / BINS_PER_UNIT) <= rate * rejected / rows:
                limit = bin
        limits[stratum] = limit
    return limits


def with_candidates(docs: DataFrame, text: str, base: str, found: str) -> DataFrame:
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = docs.withColumn(base, base_spans(value))
    return marked.withColumn(found, F.when(value.rlike(TOKEN), candidates(value, F.col(base))).otherwise(F.array()))


def limits_of(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[str, int]:
    """Count the candidates of all documents by stratum and bin (at most a few thousand rows) and place the limits."""
    each = with_candidates(docs.select(F.col(f"`{text}`").alias("text")), "text", "base", "found").select(F.explode("found").alias("c"))
    counts: dict[str, dict[int, int]] = {}
    for stratum, bin, n in each.groupBy("c.stratum", "c.bin").agg(F.count("*")).collect():
        counts.setdefault(stratum, {})[bin] = n
    return structured_from(counts, rate)


def scan(docs: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans", rate: float = RATE) -> DataFrame:
    """`docs` with `base`, the base spans, and `spans`, these and the added ones, as arrays by start, then kind.

    Columns of these names are replaced.
    """
    limits = limits_of(docs, text, rate)
    docs = docs.drop(base, spans)
    marked = with_candidates(docs, text, base, spans)
    if not limits:
        return marked.withColumn(spans, F.col(f"`{base}`"))
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    passed = F.filter(F.col(f"`{spans}`"), lambda c: c.bin < F.element_at(table, c.stratum))
    return marked.withColumn(spans, F.array_sort(F.concat(F.col(f"`{base}`"), F.transform(passed, lambda c: c.span))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with a mark in place of each stretch that spans cover; overlapping spans are one stretch."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substr(text, done.at + 1, F.greatest(span.start - done.at, F.lit(0)))
        new = (span.start >= done.at) & ((span.start > done.at) | (done.out == ""))
        out = F.when(new, F.concat(done.out, gap, F.lit(mark))).otherwise(done.out)
        return F.struct(F.greatest(done.at, span.end).alias("at"), out.alias("out"))

    end = F.aggregate(spans, first, step, lambda done: F.concat(done.out, F.substr(text, done.at + 1, F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)
