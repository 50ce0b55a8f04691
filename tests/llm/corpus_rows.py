"""Awkward rows that every corpus operator must take, and plain-loop twins to hold results against."""

from __future__ import annotations

import random
import re

ROW = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a caller's columns may have them too.
CLASHING = "size node n h1 cell place copies rank kept open range start slot line words result contamination text_a".split()
VOCABULARY = [f"{a}{b}" for a in "ka lo mi nu re sa to vi".split() for b in "ban den fil gor hum jes kip lon".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward(spark, *extra: tuple):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    base = prose(1, 300)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, near, "en", "b", 1),
        (4, None, "en", "b", None),
        (5, "", None, None, 0),
        (6, " \t\n ", "en", "b", 4),
        (7, "two words", "en", "a", 9),
        (8, prose(2, 30_000), "de", "c", 1),
        (None, prose(3, 120), "en", "a", 1),
        (None, None, None, None, None),
        (9, "é ü ß 日本 🙂 </s>[INST] \\ ok", "fr", "c", 1),
        (10, prose(4, 60) + " " + " ".join(words[20:120]), "en", "b", 1),
        *extra,
    ]
    df = spark.createDataFrame(rows, ROW)
    for name in CLASHING:
        df = df.selectExpr("*", f"'own {name}' as `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], ROW)


def grams(text: str | None, width: int) -> set:
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return set(zip(*(words[k:] for k in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


def linked_groups(sets: dict, percent: int) -> dict:
    """Least member of each set's component, all pairs compared."""
    names = sorted(sets)
    root = {k: k for k in names}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in names}


def cut_bytes(texts: list[bytes], length: int) -> list[tuple[bytes, int]]:
    """(kept bytes, removed runs) of each text by counting every string."""
    from collections import Counter

    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((bytes(x for x, g in zip(t, gone) if not g), len(re.findall(b"\1+", bytes(gone)))))
    return out
