"""Small hand-made tables and brute-force counterparts for the training-data operators."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, length long"


def docs_frame(spark, rows):
    """``documents`` with extra columns whose names the operators use themselves."""
    out = [(i, t, "en", s, None if t is None else len(t), 7.0, 1, 1) for i, t, s in rows]
    return spark.createDataFrame(out, DOCS)


def odd_rows():
    """Null texts and ids, empty and blank texts, repeated rows and one long text."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "Same text here now again", "b"), (6, "same TEXT here now again", "a"),
        (7, long, "a"), (8, long + " tail", "c"), (9, "x" * 5000, None), (None, "lost and found by nobody", "a"), (10, "a\tb c  d \n\n e", "c"),
        (11, "Grüße! 你好 <|endoftext|> it's 42", "b"), (5, "Same text here now again", "b"),
    ]


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def repeats(texts, length):
    """(n_bytes, n_removed, n_spans, sha256) of each text."""
    blobs = [(t or "").encode() for t in texts]
    seen = {}
    for b in blobs:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in blobs:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def line_repeats(docs, stretch, window):
    """Texts that stay, by the definition: ``docs`` are (doc_id, text) in order."""
    parsed = []
    for _, text in docs:
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\r\v\f")]
        parsed.append((lines, at, [lines[i].strip(" \t\r\v\f") for i in at]))

    def words(run):
        return sum(len(WORD.findall(x)) for x in run)

    def shortest(lines, i, least):
        return next((e for e in range(i + 1, len(lines) + 1) if words(lines[i:e]) >= least), None)

    import numpy as np
    import xxhash

    def key(run):
        return xxhash.xxh3_128_digest(np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in run], dtype=np.uint64).tobytes())

    first, places = {}, set()
    for d, (_, _, lines) in enumerate(parsed):
        windows = [(i, shortest(lines, i, window)) for i in range(len(lines))]
        windows = [(i, e) for i, e in windows if e] or ([(0, len(lines))] if lines else [])
        for i, e in windows:
            inside = [(s, shortest(lines, s, stretch)) for s in range(i, e)]
            inside = [(key(lines[s:t]), s) for s, t in inside if t and t <= e]
            if not inside:
                continue
            k, s = min(inside)
            # A fingerprint stands for itself, for its window, and for longer runs that are the shortest up to their last line.
            keys = {k}
            if words(lines[i:e]) >= window:
                tails = [t for t in range(e + 1, len(lines) + 1) if words(lines[i:t]) >= window > words(lines[i + 1 : t])]
                keys |= {(k, key(lines[i:t])) for t in (e, *tails)}
            for x in keys:
                places.add((x, d, s))
                first[x] = min(first.get(x, (d, s)), (d, s))
    gone = [[False] * len(p[2]) for p in parsed]
    for k, d, s in places:
        if first[k] == (d, s):
            continue
        e, t = first[k]
        own, other = parsed[d][2], parsed[e][2]
        shift = s - t
        a, b = s, s
        while a - 1 >= 0 and a - 1 - shift >= 0 and own[a - 1] == other[a - 1 - shift]:
            a -= 1
        while b < len(own) and b - shift < len(other) and own[b] == other[b - shift]:
            b += 1
        for i in range(a, b):
            gone[d][i] = True
    out = []
    for (lines, at, _), g in zip(parsed, gone, strict=True):
        stay = [True] * len(lines)
        for k, i in enumerate(at):
            if g[k]:
                for j in range(i, at[k + 1] if k + 1 < len(at) else len(lines)):
                    stay[j] = False
        out.append(("\n".join(x for x, s in zip(lines, stay, strict=True) if s), sum(g)))
    return out
