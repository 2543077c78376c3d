"""Token codes and packing: exact round trips and the bounds of packing."""

import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from trafficlake.llm import packing, queries, token_codes, tokens
from trafficlake.llm.tokens import Encoder
from trafficlake.session import scratch_path

from .helpers import docs_frame, odd_rows


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_ids_equal_whole_text_ids(name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [t or "" for _, t, _ in odd_rows()] + ["a\t b", "a \n\n b\t\n\nc  ", " a", "  \n", "a b  ", "a \x01 b", "!\x01? b", "̈ x é", ".", "a  \nb"]
    encoder = Encoder(public_tokenizers.path(name))
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_each(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode_each([]) == [] and [len(x) for x in encoder.encode_each(["", ""])] == [0, 0]


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("n", [128, 1024, 4096])
def test_chunks_that_polynomial_hashes_confuse_keep_their_own_ids(name, n):
    plain, encoder = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
    texts = [*thue_morse(n), " " + thue_morse(n)[1] + " x", "x\t" * n]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_each(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("buckets", [1, 7])
def test_chunks_of_equal_hash_keep_their_own_ids(name, buckets, monkeypatch):
    plain, hashed = Tokenizer.from_file(public_tokenizers.path(name)), tokens.span_hash
    monkeypatch.setattr(tokens, "span_hash", lambda *a: hashed(*a) % np.uint64(buckets))
    encoder = Encoder(public_tokenizers.path(name))
    texts = [" ".join(f"w{i}" for i in range(k)) for k in range(30)] + ["a b c", "b c a", "ab cd\nef", "", "y" * 600]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_each(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_kept_once_whatever_sign_follows(name):
    plain, encoder = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
    words = ["word", "Été", "straße", "ÿÞ", "don't", "a²", "x×y", "e\u0301", "İx"]
    texts = [" " + w + sign for w in words for sign in ("", ",", ".", "!!", "%%%", "'", "<", "'s", "\u0338", "<|endoftext|>", "<\u0338", "9", ".x\x01", "\t.", "a.b'll")]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_each(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert encoder.lengths(texts).tolist() == [len(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]
    few = Encoder(public_tokenizers.path(name))
    few.encode_each([f" {w}{sign} end" for w in ("word", "été", "über") for sign in (".", ",", ";", "!", "?!", ":", "...")])
    assert len(few.hashes) == 3 + 7 + 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_letters_and_signs_in_any_order(name):
    rng = np.random.default_rng(6)
    parts = [*"aZ9 \n\t.,'<|>~", "É", "ß", "×", "÷", "ñ", "\u0300", "\u0338", "\u0149", "Σ", "'ll", "'S", "<|endoftext|>", " the", "word", "\x01", "東", "²", "_", "\x7f", "\xad", "\xa0"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 20))) for _ in range(4000)]
    plain, encoder = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_each(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_other_splittings_are_not_cut_at_signs(tmp_path):
    for change in ({"use_regex": False}, {"add_prefix_space": True}):
        state = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
        state["pre_tokenizer"] |= change
        (tmp_path / "other.json").write_text(json.dumps(state))
        assert not Encoder(str(tmp_path / "other.json")).cuts
    assert Encoder(public_tokenizers.path("byte_bpe_50k.json")).cuts and Encoder(public_tokenizers.path("word_bpe_49k.json")).cuts


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_full_cache_starts_anew(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 50)
    plain, encoder = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
    for k in range(6):
        texts = [" ".join(f"w{i * k % 71}" for i in range(40)), "y" * 900, f"{k} \n"]
        assert [x.tolist() for x in encoder.encode_each(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.hashes) < 150


SPECIAL = [
    "one <|endoftext|> two", "one<|endoftext|>two", " <|endoftext|> <|endoftext|>\n two", "x  <|endoftext|>  \n y", "<|endoftext|>", "a\t<|endoftext|> b", "<|endoftext|>\x01 b",
    "<|startoftext|>É <|endoftext|>'s  ", "<|ENDOFTEXT|> <|end oftext|>", "\n\n<|endoftext|><|endoftext|>\n", "e<|endoftext|>́ x", "<|endoftext|",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens_as_in_the_tokenizer_as_loaded(name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    rng = np.random.default_rng(4)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\t", "a", "It's", "9", "é", "̈", "\x01", "<|", "|>", "."]
    texts = SPECIAL + [t or "" for _, t, _ in odd_rows()] + ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(3000)]
    encoder = Encoder(public_tokenizers.path(name))
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_each(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_queries_take_special_tokens_as_loaded(spark, tmp_path):
    docs = docs_frame(spark, [(i, t, "s") for i, t in enumerate(SPECIAL)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for name, end in (("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 0)):
        plain, start = Tokenizer.from_file(public_tokenizers.path(name)), 0
        for i, text in enumerate(SPECIAL):
            ids = np.array([*plain.encode(text, add_special_tokens=False).ids, end], dtype="<u4")
            want[end, i] = (start if end == 0 else 0, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    packed = [queries.QUERIES["op3_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, "")]
    for got in packed:
        assert {(1, r["doc_id"]): (r["start"], r["length"], r["ids_crc32"]) for r in got.collect()} == {k: v for k, v in want.items() if k[0] == 1}
    got = queries.QUERIES["op4_token_codes"](spark, str(tmp_path)).collect()
    assert {(0, r["doc_id"]): (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == {k: v for k, v in want.items() if k[0] == 0}


@pytest.mark.parametrize("widths", [(1, 1, 2), (2, 2), (4,)])
def test_any_token_by_random_access(widths):
    rng = np.random.default_rng(2)
    ids = np.where(rng.random(5000) < 0.5, rng.integers(0, 300, 5000), rng.integers(0, 1 << 24, 5000)).astype("<u4")
    lengths = np.array([0, 1, 511, 512, 513, 3463])
    f = token_codes.TokenFile.from_bytes(token_codes.TokenFile.encode(1, 2, [3, None, 5, 6, 7, 8], lengths, ids, widths).to_bytes())
    at = rng.integers(0, 5000, 3000)
    assert (f.access(at) == ids[at]).all() and (f.access(np.arange(5000)) == ids).all()
    assert [(d, b, x.tolist()) for d, b, x in f.documents()][1:3] == [(None, 0, ids[:1].tolist()), (5, 1, ids[1:512].tolist())]
    with pytest.raises(IndexError):
        f.access(np.array([5000]))


def test_files_hold_all_ids_in_order(spark):
    rows = odd_rows()
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = scratch_path(spark, "tokens-test")
    token_codes.write_tokens(docs_frame(spark, rows), folder, path, tokens_per_file=1000)
    got = [tuple(r) for r in token_codes.read_tokens(spark, folder).orderBy("start").collect()]
    encoder = Encoder(path)
    rows = sorted(((-1 if i is None else i, t or "") for i, t, _ in rows))
    start = 0
    for (i, text), r in zip(rows, got, strict=True):
        ids = np.append(encoder.encode_each([text])[0], 0).astype("<u4")
        assert r == (None if i < 0 else i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_codes.token_round_trip(docs_frame(spark, []), path).count() == 0


def test_pieces_fill_sequences_without_gaps(spark):
    rows = odd_rows()
    got = packing.pack_documents(docs_frame(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["piece"] == 0 for r in got) == len(rows)
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack_documents(docs_frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_configurations_pack_as_well_as_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(np.exp(rng.normal(5, 1.2, size=3000)).astype(int) + 1, 1000) if seed % 2 else rng.integers(300, 700, size=900)
    n, counts = np.unique(sizes, return_counts=True)
    histogram = dict(zip(n.tolist(), counts.tolist(), strict=True)) | {1000: 4}
    plan = packing.pack_histogram(histogram, 1000)
    assert plan.used == histogram
    total = sum(k * v for k, v in histogram.items())
    plain = 4 + sum(c for _, c in packing.best_fit(n, counts, 1000))
    assert plan.n_sequences >= -(-total // 1000) and plan.n_sequences <= plain


def test_pricing_finds_the_best_multiset():
    lengths, weights = np.array([3, 5, 7]), np.array([0.31, 0.55, 0.68])
    best, item = packing.best_values(weights, lengths, 10)
    config = packing.unwind(item, lengths, 10)
    assert best[10] == pytest.approx(max(a * 0.31 + b * 0.55 + c * 0.68 for a in range(4) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= 10))
    assert sum(weights[k] * a for k, a in config.items()) == pytest.approx(best[10])
