"""Slow plain versions that the operators are held against, and rows that are awkward."""

import hashlib
import re
from collections import Counter

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
SHARED = " ".join(f"shared{i} passage" for i in range(60))

# Nulls, empty and blank texts, ties, repeated rows, a null id, a very long text.
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", "de", None, 0), (3, " \t\n ", None, "a", 4), (4, "One", "en", "b", None),
    (5, "The same text, twice. " + SHARED, "en", "b", 1), (5, "The same text, twice. " + SHARED, "en", "b", 1),
    (6, "The same text, twice. " + SHARED, "en", "c", 1), (7, "Elsewhere: " + SHARED + " and more words at the end", "en", "c", 1),
    (None, "No id here, but " + SHARED, None, "d", 2), (8, LONG, "en", "d", 3), (9, "12345 !!! ---", "en", "d", 3),
    (10, "naïve Œuvre ß ’quoted’ 日本語 \U0001f600", "fr", "e", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, SCHEMA)


def cut(texts, length):
    """(bytes, removed, spans, digest of the rest) by comparing all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        marks = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                marks[p : p + length] = b"\1" * length
        kept = bytes(b for b, m in zip(d, marks) if not m)
        out.append((len(d), sum(marks), len(re.findall(rb"\x01+", bytes(marks))), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, size=4):
    import xxhash

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    parts = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fingerprints, distance=4):
    """Component number of each fingerprint."""
    label = list(range(len(fingerprints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= distance:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fingerprints))]


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def contaminated(docs, items, shingle=5, least=0.8):
    """(doc, item): best similarity and first best start, over all item-sized windows."""
    found = {}
    for item, item_text in items:
        w = words(item_text)
        if not w:
            continue
        k = min(shingle, len(w))
        cut_up = lambda x: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
        mine = Counter(cut_up(w))
        for doc, text in docs:
            x = words(text)
            for start in range(len(x) - len(w) + 1):
                other = Counter(cut_up(x[start : start + len(w)]))
                common = sum((mine & other).values())
                similarity = common / (2 * sum(mine.values()) - common)
                if similarity >= least - 1e-12 and similarity > found.get((doc, item), (0,))[0]:
                    found[doc, item] = (similarity, start)
    return found


def base_spans(text):
    rules = [
        ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
    ]
    found = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, group, least) in enumerate(rules)
        for m in re.finditer(pattern, text or "", re.A) if len(m[group]) >= least
    ]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]
