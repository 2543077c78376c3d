"""Token counts against the libraries; spelling groups and ranked search against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trafficlake.llm import ranked_search, spelling, token_counts, tokens

from .helpers import docs_frame, odd_rows

ODD = ["a\t b", " a", "  \n", "a  b", "̈ x é", "one <|endoftext|> two", "x<|endoftext|> y", "東京 は 夜", "it's 7 o'clock", "A B C D", "▁ ▁a b"]


def plain_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_pieces_and_small_batches_equal_those_of_whole_texts(name):
    rng = np.random.default_rng(3)
    parts = ["<|endoftext|>", " ", "  ", "\n", "a", "It's", "9", "é", "̈", "<|", ".", " the", " b ", "Σ", "一", "▁"]
    texts = ODD + [t or "" for _, t, _ in odd_rows()] + ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(1500)]
    counter = token_counts.Counter(public_tokenizers.path(name))
    assert counter.skip is not None
    sizes = [len(t.encode()) for t in texts]
    want = plain_counts(name, texts)
    for batch, piece in ((1 << 18, 1 << 16), (64, 8), (1, 1)):
        assert counter.count(texts, sizes, batch, piece).tolist() == want
    assert any(len(counter.pieces(t, n, 8)) > 1 for t, n in zip(texts, sizes, strict=True))


def test_count_tokens_over_odd_rows_and_an_empty_table(spark):
    docs = docs_frame(spark, odd_rows())
    got = [tuple(r) for r in token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect()]
    texts = [t or "" for _, t, _ in odd_rows()]
    want = plain_counts("word_bpe_49k.json", texts)
    rows = [(i, len(t.encode()), n, n > 2048) for (i, _, _), t, n in zip(odd_rows(), texts, want, strict=True)]
    assert sorted(got, key=str) == sorted(rows, key=str)
    assert token_counts.count_tokens(docs.where("false"), public_tokenizers.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_repeated_words_are_not_encoded_again(name):
    class Counted:
        def __init__(self, library):
            self.library, self.taken = library, 0

        def __getattr__(self, called):
            def run(texts, **options):
                self.taken += len(texts) if isinstance(texts, str) else sum(map(len, texts))
                return getattr(self.library, called)(texts, **options)

            return run

    texts = [" ".join(f"Wörd{chr(97 + i * k % 26)} and, more." for i in range(300)) for k in range(1, 40)]
    sizes, want = [len(t.encode()) for t in texts], plain_counts(name, texts)
    tokens._OPEN.clear()
    counter, chunked = token_counts.Counter(public_tokenizers.path(name)), tokens.encoder(public_tokenizers.path(name))
    chunked.tokenizer, chunked.words = Counted(chunked.tokenizer), Counted(chunked.words)
    tokens._OPEN.clear()
    assert counter.count(texts, sizes).tolist() == want
    assert 0 < chunked.tokenizer.taken + chunked.words.taken < 2000 < sum(sizes)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    a, b = sorted((a, b), key=len)
    return a[i:] == b[i + 1 :]


def spellings(docs, rate=199, least=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if rate and h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    out = {}
    for w, c in n.items():
        found = [x for x in n if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x)) if found else None
        out[w] = (c, len(found), *((best, n[best]) if found and n[best] >= 5 * c else (None, None)))
    root = {}
    for w in n:
        at = w
        while out[at][2]:
            at = out[at][2]
        root[w] = at
    return {(w, *out[w], root[w]) for w in n}


def test_spelling_groups_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abcéÿ×"), rng.integers(6, 9))) for _ in range(30)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "x" * 3000]
    rows = []
    for i in range(40):
        words = []
        for w in rng.choice(base, 60, p=np.r_[np.full(6, 0.1), np.full(30, 0.4 / 30)]):
            if rng.random() < 0.4:
                at = int(rng.integers(0, len(w) + 1))
                w = [w[:at] + "b" + w[at:], w[:at] + w[at + 1 :], w[:at] + "c" + w[at + 1 :]][rng.integers(0, 3)]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, "; ".join(words), "s"))
    rows += odd_rows()
    docs = docs_frame(spark, rows)
    for rate, least in ((199, 5), (3, 2), (0, 1)):
        got = spelling.group_spellings(docs, rate=rate, least=least).collect()
        want = spellings([(i, t) for i, t, _ in rows if t is None or len(t) < 50_000] if least == 1 else [(i, t) for i, t, _ in rows], rate, least)
        if least == 1:
            got = [r for r in spelling.group_spellings(docs.where("text IS NULL OR length(text) < 50000"), rate=rate, least=least).collect()]
        assert len(got) == len(want)
        assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == want
    assert spelling.group_spellings(docs.where("false")).collect() == []


@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), min_size=3, max_size=9))
@settings(max_examples=200, deadline=None)
def test_pivots_are_the_cheapest_disjoint_pair(places):
    cost = np.array([[c for c, _ in places]], dtype=float)
    prefix = np.array([[p for _, p in places]])
    pairs = [(i, j) for i in range(len(places)) for j in range(i + 2, len(places)) if prefix[0, i] and prefix[0, j]]
    if pairs:
        i, j = spelling.pivots(cost, prefix)[0]
        assert (i, j) in pairs and cost[0, i] + cost[0, j] == min(cost[0, a] + cost[0, b] for a, b in pairs)


def test_a_word_and_its_edits_always_meet(spark):
    word = "strengthening"
    letters = "aezñ"
    edits = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    edits |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} - {word}
    words = sorted(edits | {word})
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}


def ranked(docs, items, k):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, ts in asked.items():
        rows = []
        for i, c in bags:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                rows.append((-score, i is not None, i))
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)}
    return out


@pytest.mark.parametrize(("block", "postings", "item_bytes"), [(8192, 1 << 20, 8 << 20), (7, 1 << 20, 8 << 20), (50, 40, 300)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block, postings, item_bytes):
    for name, value in (("BLOCK_DOCS", block), ("BLOCK_POSTINGS", postings), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(60)] + ["É", "ü\xa0x", "A1", "​"])
    weight = 1 / np.arange(1, len(words) + 1)
    docs = [(int(i) % 290, " ".join(rng.choice(words, rng.integers(1, 60), p=weight / weight.sum())), "s") for i in range(300)]
    docs += [(1000 + i, "w3 w3 w59 tie", "s") for i in range(30)] + odd_rows()
    items = [(i, "-".join(rng.choice(words, rng.integers(1, 25)))) for i in range(20)]
    items += [(3, "w1 w2"), (None, "W7 w59"), (50, None), (51, "!?"), (52, "unheard-of"), (53, "w5x5 lost")]
    got = ranked_search.rank_documents(docs_frame(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), 10)
    assert {tuple(r) for r in got.collect()} == ranked([(i, t) for i, t, _ in docs], items, 10)


def test_ranked_search_of_empty_tables(spark):
    docs, items = docs_frame(spark, odd_rows()), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked_search.rank_documents(docs.where("false"), items).collect() == []
    assert ranked_search.rank_documents(docs, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in ranked_search.rank_documents(docs, items).collect()] == [(1, 1, 4)]


def test_intervals_are_pruned():
    rng = np.random.default_rng(1)
    n, terms = 4000, 200
    term = [np.unique(rng.integers(0, terms, 12)) for _ in range(n)]
    block = ranked_search.Block.build([(i, True) for i in range(n)], [20] * n, np.repeat(np.arange(n), [len(t) for t in term]), np.concatenate(term), np.ones(sum(map(len, term)), dtype=np.int64))
    searcher = block.ready(np.arange(1, terms + 1, dtype=np.int64) ** 2, n, 20 * n)
    scored = searcher.top(np.array([150, 190, 199]), 10)[2]
    assert scored < n / 5
