"""Repeated bytes, repeated lines and near-duplicate documents against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from trafficlake.llm import lines, minhash, queries, repeats
from trafficlake.llm.common import components

from .helpers import components as slow_components
from .helpers import docs_frame, line_repeats, odd_rows, shingles
from .helpers import repeats as slow_repeats


def made_up(seed, n=60, words=40):
    """Texts that share passages, lines and whole copies."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(words)]
    line = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    shared = [[line(rnd.randrange(3, 40)) for _ in range(rnd.randrange(1, 6))] for _ in range(6)]
    out = []
    for i in range(n):
        if i > 5 and rnd.random() < 0.2:
            text = out[rnd.randrange(len(out))]
            if rnd.random() < 0.7:
                parts = text.split(" ")
                parts[rnd.randrange(len(parts))] = "changed"
                text = " ".join(parts)
        else:
            parts = [[line(rnd.randrange(1, 25))] for _ in range(rnd.randrange(1, 6))] + ([rnd.choice(shared)] if rnd.random() < 0.5 else [])
            rnd.shuffle(parts)
            text = "\n".join(x for p in parts for x in p)
        out.append(text)
    return out


def test_common_prefix_rounds_match_counts():
    rnd = random.Random(3)
    for _ in range(150):
        length, letters = rnd.choice([1, 2, 3, 9, 17, 40]), rnd.choice([1, 2, 4])
        part = lambda k: bytes(rnd.randrange(97, 97 + letters) for _ in range(rnd.randrange(k)))  # noqa: B023, E731
        base = part(80)
        strings = [part(10) + base[rnd.randrange(len(base) + 1) :] + part(10) for _ in range(rnd.randrange(1, 6))]
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
        assert [x.tolist() for x in repeats.repeated_starts(strings, length)] == want


def test_passages_of_over_50_words_go_by_their_bytes(spark):
    long, short = (" ".join(f"{c}{i:0{k}d}" for i in range(52)) for c, k in (("p", 8), ("q", 5)))  # 519 and 363 bytes
    texts = [f"own{i} " * 9 + p + f" end{i}" * 9 for i, p in enumerate([long, short] * 4)]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(8)] == [n for _, n, *_ in slow_repeats(texts, 400)]
    assert all(got[i] >= len(long) for i in (0, 2, 4, 6)) and all(got[i] == 0 for i in (1, 3, 5, 7))


def test_a_string_that_counts_twice_is_a_pair():
    rnd = random.Random(5)
    for _ in range(80):
        length = rnd.choice([1, 3, 9, 40])
        base = bytes(rnd.randrange(97, 99) for _ in range(60))
        strings = [base[rnd.randrange(40) : rnd.randrange(20, 61)] + bytes([rnd.randrange(97, 100)]) for _ in range(rnd.randrange(1, 6))]
        times = np.array([rnd.randrange(1, 3) for _ in strings])
        pairs = [(i, s) for i, (s, k) in enumerate(zip(strings, times, strict=True)) for _ in range(k)]
        want = {i: x.tolist() for (i, _), x in zip(pairs, repeats.repeated_starts([s for _, s in pairs], length), strict=True)}
        assert {i: x.tolist() for i, x in enumerate(repeats.repeated_starts(strings, length, times))} == want


@pytest.mark.parametrize("n", [1 << 16, (1 << 21) + 999])
def test_places_that_need_long_keys(n):
    rng = np.random.default_rng(n)
    data = rng.integers(97, 101, n, dtype=np.uint8)
    for k in range(1, 9):  # a passage of 399 + k bytes twice: k places each
        at = n // 9 * k
        data[at : at + 399 + k] = data[at - 5000 : at - 5000 + 399 + k]
    want = {at + i for k in range(1, 9) for at in (n // 9 * k, n // 9 * k - 5000) for i in range(k)}
    found = set(repeats.repeated_starts([data.tobytes()], 400)[0].tolist())
    assert want <= found and all(min(abs(x - y) for y in want) < 12 for x in found)  # chance lengthens a passage by some bytes


def test_equal_contexts_enter_a_transform_once(spark, tmp_path, monkeypatch):
    passage = "".join(chr(0x4E00 + i * 7 % 997) for i in range(700))
    plain = repeats.repeated_starts

    def noted(strings, *rest):  # runs in the Python workers
        with open(tmp_path / "sizes", "a") as f:
            f.write("".join(f"{s!r}\n" for s in strings))
        return plain(strings, *rest)

    monkeypatch.setattr(repeats, "repeated_starts", noted)
    texts = [f"own {i} {passage} end {i}" for i in range(6)]
    got = sorted(repeats.remove_repeats(docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect())
    entered = (tmp_path / "sizes").read_text().splitlines()
    assert entered and len(entered) == len(set(entered))
    assert [tuple(r)[1:] for r in got] == slow_repeats(texts, 400)


@pytest.mark.parametrize(("length", "transform_bytes"), [(100, 4 << 20), (100, 500), (30, 3000)])
def test_repeats_match_brute_force(spark, length, transform_bytes):
    texts = made_up(length) + ["ab" * 300, "ab" * 300, None, "", "z" * 350, "é" * 90]
    docs = docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = sorted(repeats.remove_repeats(docs, length, transform_bytes).collect())
    assert [tuple(r)[1:] for r in got] == slow_repeats(texts, length)
    kept = repeats.remove_repeats(docs, length, transform_bytes, keep_text=True).collect()
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in kept)


def test_repeats_of_odd_rows(spark):
    rows = odd_rows()
    got = repeats.remove_repeats(docs_frame(spark, rows)).collect()
    want = slow_repeats([t for _, t, _ in rows], 400)
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == sorted((str(i), *w) for (i, _, _), w in zip(rows, want, strict=True))
    assert repeats.remove_repeats(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize(("stretch", "window"), [(25, 50), (1, 1), (5, 30), (10, 10)])
def test_lines_match_brute_force(spark, stretch, window):
    texts = made_up(stretch + window) + ["same line\n" * 9, "", None, " \n\n x\n\n", "\n".join(["k " * 60] * 3)]
    docs = docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = sorted(lines.remove_repeated_lines(docs, stretch, window).collect())
    assert [(r["text"], r["n_removed"]) for r in got] == line_repeats(list(enumerate(texts)), stretch, window)


def repeated_runs(texts, least):
    """Per text, whether each line with words is in a run of lines with ``least`` words that stands earlier: all pairs of lines."""
    parsed = [[x.strip(" \t\r\v\f") for x in (t or "").split("\n") if x.strip(" \t\r\v\f")] for t in texts]
    gone = [[False] * len(p) for p in parsed]
    for d, own in enumerate(parsed):
        for e in range(d + 1):
            for i in range(len(own)):
                for j in range(len(parsed[e]) if e < d else i):
                    k = 0
                    while i + k < len(own) and j + k < len(parsed[e]) and own[i + k] == parsed[e][j + k]:
                        k += 1
                    if sum(len(x.split()) for x in own[i : i + k]) >= least:
                        gone[d][i : i + k] = [True] * k
    return parsed, gone


def beside_their_parts(seed):
    """Passages after documents that hold only their lines or parts, which then are the first places."""
    rnd = random.Random(seed)
    line = lambda k: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(k))
    passages = [[line(k) for k in sizes] for sizes in ([30, 20, 20], [40, 12, 9, 3], [9, 12, 40], [26, 26, 26, 26], [5] * 14, [60, 2, 2])]
    texts = []
    for p in passages:
        for _ in range(4):
            a = rnd.randrange(len(p))
            texts.append("\n".join([line(4), *p[a : rnd.randrange(a, len(p)) + 1], line(4)]))
    rnd.shuffle(texts)
    return texts + ["\n".join([line(3), *p, line(3)]) for p in passages for _ in range(3)]


def test_repeated_runs_go_whole(spark):
    texts = []
    for seed in range(12):
        texts += beside_their_parts(seed)
    docs = docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    kept = {r["doc_id"]: r["text"].split("\n") for r in lines.remove_repeated_lines(docs).collect()}
    parsed, gone = repeated_runs(texts, 50)
    before = set()
    for d, (own, away) in enumerate(zip(parsed, gone, strict=True)):
        assert not {x for x, g in zip(own, away, strict=True) if g} & set(kept[d])
        assert set(own) - set(kept[d]) <= before
        before |= set(own)


def test_every_shared_passage_is_cut(spark):
    passage = "\n".join(" ".join(f"p{i}q{j}" for j in range(12)) for i in range(5))  # 60 words on five lines
    rows = [(i, f"own{i} " * 9 + "\n" + passage + "\n" + f"end{i} " * 9, "s") for i in range(40)]
    got = {r["doc_id"]: r for r in lines.remove_repeated_lines(docs_frame(spark, rows)).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 5 and "p0q0" not in got[i]["text"] for i in range(1, 40))


def test_lines_of_odd_rows(spark):
    docs = docs_frame(spark, odd_rows())
    got = lines.remove_repeated_lines(docs, keep=("lang", "source", "n_chars"))
    assert got.count() == len(odd_rows()) and {"lang", "source", "n_chars"} <= set(got.columns)
    assert lines.remove_repeated_lines(docs_frame(spark, [])).count() == 0


def test_the_query_shows_what_stays(spark, tmp_path):
    passage = "".join(chr(0x4E00 + i * 7 % 997) for i in range(300))
    # The blank after the passage ends a repeated string of its own in 1 and 5.
    docs_frame(spark, [(1, "abc " + passage + " tail", "s"), (2, passage, "s"), (3, None, "s"), (4, "alone", "s"), (5, "x" + passage[1:] + " e", "s")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_bwt_repeats"](spark, str(tmp_path)).collect()}
    assert (got[1]["text"], got[3]["text"], got[4]["text"]) == ("abc tail", "", "alone")
    assert got[5]["text"] == "xe" and got[2]["text"] == "" and got[2]["n_removed"] == 900


def test_words_that_polynomial_hashes_confuse_are_not_linked(spark):
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
    pairs = [(n, word[:n], word[:n].translate({97: 98, 98: 97})) for n in (1024, 2048, 4096)]
    rows = [r for n, a, b in pairs for r in ((n, a, "s"), (n + 1, b, "s"), (n + 2, a + " one two three four", "s"), (n + 3, b + " one two three four", "s"))]
    got = minhash.near_duplicates(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80), (2, 50)])
def test_near_duplicates_match_brute_force(spark, k, percent):
    texts = made_up(k, n=120) + [None, "", "one two", "ONE two", "one two three"]
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)]
    got = sorted(minhash.near_duplicates(docs_frame(spark, rows), k, percent).collect())
    rows.sort()
    sets = [shingles(t, k) for _, t, _ in rows]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    reach = slow_components(len(sets), links)
    want = [(i, len(s), rows[r][0], rows[r][0] == i) for (i, _, _), s, r in zip(rows, sets, reach, strict=True)]
    assert links and [tuple(r) for r in got] == want


def test_groups_that_stars_leave_open(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    base = [f"w{i}" for i in range(60)]  # a chain: each text differs from its neighbours by two words
    texts = [" ".join([f"x{k}_{i}" if i < 2 * k else w for i, w in enumerate(base)]) for k in range(12)]
    texts = [" ".join(base[k : k + 50]) for k in range(11)] + texts
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    sets = [shingles(t, 4) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = sorted(minhash.near_duplicates(docs_frame(spark, rows)).collect())
    assert [r["component_id"] for r in got] == slow_components(len(sets), links)


def test_near_duplicates_of_odd_rows(spark):
    docs = docs_frame(spark, odd_rows())
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert {(1, 1, True), (2, 2, True), (6, 5, False), (8, 7, False), (None, None, True)} <= got
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(odd_rows()) - 2
    assert minhash.near_duplicates(docs_frame(spark, [])).count() == 0


def test_register_compression_orders_and_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    b = np.concatenate((a[:3600], rng.integers(0, 1 << 63, 400, dtype=np.uint64)))
    sk = minhash.sketches([np.unique(a), np.unique(b), np.empty(0, dtype=np.uint64)])
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    n = np.array([4000])
    assert abs(float(minhash.estimate(np.array([(sk[0] == sk[1]).sum()]), n, n)[0]) - j) < 0.15
    assert not sk[2].any() and minhash.collision_rate(n, n)[0] < 0.01


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
