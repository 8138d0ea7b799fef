"""Brute-force versions of the operators, and rows that are hard on them."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=0, n=60):
    """Documents with copies, near copies, shared passages, nulls, empties, ties and a very long text."""
    rng = random.Random(seed)
    words = ["the", "river", "über", "né", "stone", "walks", "slowly", "7", "a+b", "x_y", "ÀÉ", "light", "and", "of", "corner", "bread", "seven", "house", "Tree", "tree"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(k))
    shared, out = text(30), []
    for i in range(n):
        t = text(rng.choice([1, 2, 5, 30, 80]))
        if i % 4 == 1:
            t = t + "\n" + shared + " " + text(5)
        if i % 6 == 5 and i > 6:
            t = out[i - 6][1]
        if i % 6 == 4 and i > 6:
            w = out[i - 5][1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        out.append((i, t, "en", f"s{i % 3}" if i % 10 else "s0", len(t)))
    out += [(n, None, None, None, None), (n + 1, "", "en", None, 0), (n + 2, " \n\t ", "en", "s1", 4), (None, shared, "en", "s1", 1), (n + 3, "solo", "en", "é", 4), (n + 4, text(6000), "en", "s2", 1), out[3], out[3], (n + 5, "mail a@b.co and +1 (784) 555-9999 or 4111 1111 1111 1111 from 10.0.0.1", "en", "s1", 1), (n + 6, "word " * 400, "de", "s1", 1)]
    return out


def documents(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def clashing(df):
    """With more columns, named as the operators name their own."""
    from pyspark.sql import functions as F

    for c in ("kept", "bucket", "kind", "node", "cluster", "size", "base", "spans", "row", "target", "n", "component_id", "page_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def brute_repeats(data, width=50):
    texts = [(i, (t or "").encode()) for i, t, *_ in data]
    first = {}
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - width + 1):
                w = b[p : p + width]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - width + 1):
                if first[b[p : p + width]] < i:
                    gone[p : p + width] = b"\1" * width
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if c > "4" else 0) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_personal(text):
    digits = lambda h: re.sub("[^0-9]", "", h)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= len(digits(h)) <= 19 and luhn(digits(h))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= len(digits(h)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, r, ok in rules for m in re.finditer(r, text or "") if ok(m.group())]


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_near(data, width, percent):
    s = [(i, shingles(t, width)) for i, t, *_ in data if i is not None]
    up = {i: i for i, _ in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(s):
        for j, y in s[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: root(i) for i, _ in s}


def brute_quality(text, min_words=5, max_covered=0.4, max_longest=0.25):
    t = text or ""
    w = WORD.findall(t)
    n = len(w)

    def covered(k):
        seen, on = {}, set()
        for i in range(n - k + 1):
            seen.setdefault(tuple(w[i : i + k]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                for i in at:
                    on.update(range(i, i + k))
        return len(on)

    longest = 0
    lo, hi = min_words, n
    while lo <= hi:
        mid = (lo + hi) // 2
        grams = [tuple(w[i : i + mid]) for i in range(n - mid + 1)]
        lo, hi, longest = (mid + 1, hi, mid) if len(set(grams)) < len(grams) else (lo, mid - 1, longest)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    rep = covered(8)
    failed = n < 20 or 100 * rep > 30 * n
    kept = not failed and covered(min_words) <= max_covered * n and longest <= max_longest * n
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, failed, kept)
