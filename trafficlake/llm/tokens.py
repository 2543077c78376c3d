"""Token ids by public tokenizers, with a per-worker cache of ids by chunk of text.

The vocabularies split a text before merging, and never across the end of a run of non-blank characters, nor (those of
``_SPLITS``) between a letter and an ASCII sign after it. Distinct chunks are therefore encoded once and looked up afterwards;
the ids equal those of the whole text. A hash finds a chunk in the cache and its bytes are compared before its ids are used.
The vocabularies' special tokens hold no blank, so one in a text lies inside a run of other characters, which is then one chunk.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import prefix_hash, span_hash

#: Chunks, ids and bytes kept per worker before the cache starts anew; longer chunks are not kept.
CACHED_CHUNKS = 900_000
CACHED_IDS = 8_000_000
LONGEST_CHUNK = 256
#: Chunks of one string that the library encodes; longer strings cost more per chunk.
GLUED = 500

_OTHER_BLANK = re.compile(r"[^\S \n]")
_MARK = "\x01"
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x0A]] = True
#: First bytes of white space other than blank and newline (many other characters start so, too).
_ODD = np.zeros(256, dtype=bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is C3.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_SIGN = np.zeros(256, dtype=bool)
_SIGN[0x21:0x7F] = True
_SIGN[0x30:0x3A] = False
_SIGN &= ~_LETTER
#: How vocabularies whose words and signs are known to be split apart do so: the expression, or None for byte level's own.
_SPLITS = {None, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: The characters that byte-level vocabularies write for the mark, a blank and the bytes of U+00C0 to U+00FF.
_BYTE_LEVEL = np.arange(256, dtype="<u4")
_BYTE_LEVEL[[0x01, 0x20, 0xAD]] = 0x101, 0x120, 0x143
_BYTE_LEVEL[0x80:0xA1] = np.arange(0x122, 0x143)
#: The same with letters A-Z and U+00C0 to U+00DE (by their second byte) lower-cased.
_LOWERED = _BYTE_LEVEL.copy()
_LOWERED[0x41:0x5B] += 0x20
_LOWERED[0x80:0x9F] = _BYTE_LEVEL[0xA0:0xBF]
_OPEN: dict[str, "Encoder"] = {}


def _split_of(tokenizer) -> tuple[str | None, bool] | None:
    """The expression of ``_SPLITS`` a byte-level tokenizer splits by, and whether it lower-cases; None for other tokenizers."""
    state = [json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    steps, splits = (x.get("normalizers", x.get("pretokenizers", [x])) for x in state)
    kinds = [x.get("type") for x in splits]
    if kinds == ["ByteLevel"] and splits[0]["use_regex"] and not splits[0]["add_prefix_space"] and not state[0]:
        return None, False
    names = [(x.get("type"), x.get("pattern", {}).get("Regex")) for x in steps]
    if kinds != ["Split", "ByteLevel"] or splits[1]["use_regex"] or splits[1]["add_prefix_space"] or names != [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]:
        return None
    by = splits[0]["pattern"].get("Regex")
    return (by, True) if by in _SPLITS and splits[0]["behavior"] == "Removed" and splits[0]["invert"] else None


def _letters(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a letter A-Z, a-z or one of U+00C0 to U+00FF."""
    out = _LETTER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
    out[latin] = out[latin + 1] = True
    return out


def _positions(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of runs that begin ``at`` and are ``n`` long, one run after another."""
    total = np.cumsum(n)
    return np.repeat(at - (total - n), n) + np.arange(total[-1] if len(n) else 0)


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes of ``a`` from each of ``at`` are those of ``b`` from ``begins``; eight at a time, so both go on for eight more."""
    a, b = (np.ndarray(len(x) - 7, dtype="<u8", buffer=x, strides=(1,)) for x in (a, b))
    out, which, done = np.ones(len(at), dtype=bool), np.flatnonzero(size > 0), 0
    while len(which):
        left = np.minimum(size[which] - done, 8).astype(np.uint64)
        diff = (a[at[which] + done] ^ b[begins[which] + done]) << (np.uint64(64) - np.uint64(8) * left)
        out[which[diff != 0]] = False
        done += 8
        which = which[size[which] > done]
    return out


class _Pool:
    """Runs of values put one after another; grows by doubling."""

    def __init__(self, dtype: str):
        self.values, self.used = np.empty(1 << 12, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        while self.used + len(values) + 8 > len(self.values):  # eight more, so that any byte begins a word
            self.values = np.resize(self.values, 2 * len(self.values))
        self.values[self.used : self.used + len(values)] = values
        self.used += len(values)


class Encoder:
    """Encodes texts to unsigned 32-bit ids as the tokenizer of a vocabulary file does as loaded; a special token's text is its id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join([*map(re.escape, special), _MARK]))
        self.special_bytes = [t.encode() for t in special]
        split = _split_of(self.tokenizer)
        self.cuts, self.lowers = split is not None, split is not None and split[1]
        # The same model for chunks that are one word: nothing is left to split in them but one from another.
        self.words = Tokenizer(self.tokenizer.model)
        mark = chr(_BYTE_LEVEL[ord(_MARK)])
        self.words.pre_tokenizer = pre_tokenizers.Split(mark, "isolated")
        self.word_mark = self.words.encode(mark, add_special_tokens=False).ids
        self.cuts &= len(self.word_mark) == 1
        # Blanks are dropped where " a" and "a" are the same; else they belong to the chunk that follows.
        self.drops_blanks = self._ids(" \n a").tolist() == self._ids("a").tolist()
        mark = self._ids(("a " if self.drops_blanks else "a\n") + _MARK)[len(self._ids("a")) :]
        self.mark_len, self.mark_id = len(mark), mark[-1]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slot = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)  # by hash: which chunk
        self.at, self.n, self.begins, self.sizes = (_Pool(t) for t in ("u4", "i4", "u4", "i4"))  # of each chunk: its ids and its bytes
        self.ids, self.bytes = _Pool("u4"), _Pool("u1")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode_words(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that are one word each, one after another, and how many each has."""
        signs = _LOWERED if self.lowers else _BYTE_LEVEL
        texts = [_MARK.encode().join(chunks[b : b + GLUED]) for b in range(0, len(chunks), GLUED)]
        texts = [signs[np.frombuffer(t, dtype=np.uint8)].tobytes().decode("utf-32-le") for t in texts]
        found, sizes = [], []
        for enc in self.words.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(enc.ids, dtype="<u4")
            mark = ids == self.word_mark[0]
            sizes.append(np.diff(np.concatenate(([-1], np.flatnonzero(mark), [len(ids)]))) - 1)
            found.append(ids[~mark])
        n = np.concatenate(sizes)
        assert len(n) == len(chunks)
        return np.concatenate(found), n

    def _encode_new(self, chunks: list[str], glued: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and how many each has.

        Chunks marked in ``glued`` stay apart from a mark: they are encoded in a few strings and cut at the marks, unless one of
        them holds a mark or a special token; the others go one by one.
        """
        glue = f" {_MARK} " if self.drops_blanks else f"\n{_MARK}"
        which = np.flatnonzero(glued)
        if self.special.search(joined := "\n".join(chunks)) or (not self.drops_blanks and _OTHER_BLANK.search(joined)):
            bad = [i for i in which.tolist() if self.special.search(chunks[i]) or (not self.drops_blanks and _OTHER_BLANK.search(chunks[i]))]
            which = np.setdiff1d(which, bad)
        parts = [[chunks[i] for i in which[b : b + GLUED].tolist()] for b in range(0, len(which), GLUED)]
        found, sizes = [], []
        for part, enc in zip(parts, self.tokenizer.encode_batch_fast([glue.join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, dtype="<u4")
            marks = np.flatnonzero(ids == self.mark_id)
            edges = np.concatenate(([-1], marks, [len(ids) + self.mark_len - 1]))
            sizes.append(np.diff(edges) - self.mark_len)
            found.append(np.delete(ids, (marks[:, None] - np.arange(self.mark_len)).ravel()) if len(marks) else ids)
            assert len(sizes[-1]) == len(part)
        n = np.zeros(len(chunks), dtype=np.int64)
        n[which] = np.concatenate(sizes) if sizes else 0
        alone = np.setdiff1d(np.arange(len(chunks)), which)
        single = [self._ids(chunks[i]) for i in alone.tolist()]
        n[alone] = [len(x) for x in single]
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype="<u4")
        for where, ids in ((which, found), (alone, single)):
            if len(where):
                out[_positions(at[where], n[where])] = np.concatenate(ids)
        return out, n

    def _spans(self, data: np.ndarray, letter: np.ndarray, special: np.ndarray, begins: np.ndarray, stops: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of all chunks in order; ``special``: where special tokens begin."""
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[data], [True])).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        if self.cuts and len(start):
            cut = np.flatnonzero(letter[:-1] & _SIGN[data[1:]]) + 1
            if len(special):
                cut = cut[~np.isin(np.searchsorted(stop, cut), np.searchsorted(stop, special, side="right"))]
            start, stop = (np.sort(np.concatenate((x, cut)), kind="stable") for x in (start, stop))
        if self.drops_blanks:
            return start, stop
        doc = np.searchsorted(stops, start, side="right")
        before = np.concatenate(([0], stop[:-1]))
        start = np.maximum(before, begins[doc])
        last = np.searchsorted(doc, np.arange(len(texts)), side="right") - 1
        ended = np.where((last >= 0) & (doc[last] == np.arange(len(texts))), stop[last], begins) if len(stop) else begins
        tail = ended < stops
        start, stop, doc = np.concatenate((start, ended[tail])), np.concatenate((stop, stops[tail])), np.concatenate((doc, np.flatnonzero(tail)))
        odd = np.flatnonzero(np.add.reduceat(_ODD[data], begins)) if len(data) else []
        # Other white space can join blanks of both sides in one chunk: such a text is one chunk.
        whole = np.array([i for i in odd if stops[i] > begins[i] and _OTHER_BLANK.search(texts[i])], dtype=np.int64)
        if len(whole):
            keep = ~np.isin(doc, whole)
            start, stop = np.concatenate((start[keep], begins[whole])), np.concatenate((stop[keep], stops[whole]))
        order = np.argsort(start, kind="stable")
        return start[order], stop[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The chunk of each hash, -1 where none is kept."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.slot[place], -1)

    def _learn(self, hashes: np.ndarray, chunks: list[bytes], glued: np.ndarray, words: np.ndarray) -> None:
        """Keep the ids of new chunks; those in ``words`` are one word each."""
        order = np.argsort(words, kind="stable")
        hashes, chunks, n_others = hashes[order], [chunks[i] for i in order.tolist()], int((~words).sum())
        ids, n = self._encode_new([c.decode("utf-8", "surrogatepass") for c in chunks[:n_others]], glued[order[:n_others]])
        if n_others < len(chunks):
            ids, n = (np.concatenate(x) for x in zip((ids, n), self._encode_words(chunks[n_others:]), strict=True))
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        order = np.argsort(hashes)
        where = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.slot = np.insert(self.hashes, where, hashes[order]), np.insert(self.slot, where, self.at.used + order)
        self.at.add(self.ids.used + np.cumsum(n) - n)
        self.begins.add(self.bytes.used + np.cumsum(sizes) - sizes)
        self.n.add(n)
        self.sizes.add(sizes)
        self.ids.add(ids)
        self.bytes.add(np.frombuffer(b"".join(chunks), dtype=np.uint8))

    def _encode(self, texts: list[str], lengths: bool) -> tuple[np.ndarray | None, np.ndarray]:
        blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join([*blobs, b""])
        data = np.frombuffer(raw, dtype=np.uint8)
        stops = np.cumsum([len(b) + 1 for b in blobs], dtype=np.int64) - 1
        begins = stops - np.array([len(b) for b in blobs], dtype=np.int64)
        letter = _letters(data) if self.cuts else np.empty(0, dtype=bool)
        special = np.array([m.start() for t in self.special_bytes if t in raw for m in re.finditer(re.escape(t), raw)], dtype=np.int64)
        start, stop = self._spans(data, letter, special, begins, stops, texts)
        if not len(start):
            return np.empty(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        if len(self.hashes) > CACHED_CHUNKS or self.ids.used > CACHED_IDS:
            self._forget()
        hashes = span_hash(prefix_hash(data), start, stop)
        short = stop - start <= LONGEST_CHUNK
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        kept = self._find(uniq)
        new = (kept < 0) & short[first]
        if new.any():
            at = first[new]
            chunks = [raw[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
            glued = np.ones(len(at), dtype=bool) if self.drops_blanks else _BLANK[data[start[at]]] & ~_BLANK[data[stop[at] - 1]]
            words = np.zeros(len(at), dtype=bool)
            if self.cuts:
                first_letter = start[at] + (0 if self.drops_blanks else data[start[at]] == 0x20)
                others = np.concatenate(([0], np.cumsum(~letter)))
                words = (others[stop[at]] == others[first_letter]) & (first_letter < stop[at])
            self._learn(uniq[new], chunks, glued, words)
            kept = self._find(uniq)
        known = kept[inverse]
        known[~short] = -1
        # A chunk has its ids only if its bytes are those of the chunk that is kept.
        size = stop - start
        same = (known >= 0) & (self.sizes.values[known] == size)
        here = np.flatnonzero(same)
        padded = np.frombuffer(raw + bytes(8), dtype=np.uint8)
        same[here] = _equal(padded, start[here], self.bytes.values, self.begins.values[known[here]].astype(np.int64), size[here])
        other = np.flatnonzero(~same)
        single = [self._ids(raw[start[i] : stop[i]].decode("utf-8", "surrogatepass")) for i in other.tolist()]
        n = np.where(same, self.n.values[known], 0)
        n[other] = [len(x) for x in single]
        total = np.concatenate(([0], np.cumsum(n)))
        ends = total[np.searchsorted(start, stops, side="right")]
        if lengths:
            return None, ends
        if not len(other):
            ids = self.ids.values[_positions(self.at.values[known], n)]
        else:
            ids = np.empty(total[-1], dtype="<u4")
            here = np.flatnonzero(same)
            ids[_positions(total[here], n[here])] = self.ids.values[_positions(self.at.values[known[here]], n[here])]
            ids[_positions(total[other], n[other])] = np.concatenate(single)
        return ids, ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end."""
        return self._encode(texts, lengths=False)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        return np.diff(self._encode(texts, lengths=True)[1], prepend=0)

    def encode_each(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.encode(texts)
        return np.split(ids, ends[:-1]) if len(texts) else []


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, opened once."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
