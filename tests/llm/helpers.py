"""Plain Python re-statements used as brute force."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingle_set(text, n=5):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def components(ids, links):
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                moved = True
    return low


def docs_frame(spark, rows):
    """rows of (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def hostile_rows():
    """Nulls, empties, blanks, ties, repeats, one very long text."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "Same text here, twice.", "en", None),
            (4, "Same text here, twice.", "en", None), (None, "No id at all", "fr", "b"), (None, None, None, None),
            (5, long, "en", "b"), (6, "42 !!! ???", None, "b"), (7, "é à ü \U0001F600 tail", "fr", "c")]
