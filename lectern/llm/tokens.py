"""Token ids of the public tokenizers for batches of texts, with a bounded cache per worker.

A text is cut at single blanks, where the tokenizer cuts it as well, so a word is encoded
once and looked up afterwards.  Words are found by a 64-bit hash; new ones are encoded by the
tokenizer in one call.  Where the vocabulary keeps white space, marks after an ASCII letter or digit are a word
of their own, as they are to the tokenizer.  A text with runs of white space is encoded whole where they matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import xxhash

#: Words kept by a worker (about 30 bytes each); later new ones are encoded each time.
CACHED = 2_000_000
#: Text bytes handled at a time.
SLICE = 500_000
SEPARATOR = "<|endoftext|>"
_IRREGULAR = re.compile(r"\s\s|^\s|\s\Z")
# ASCII letters and digits (1), other printing ASCII (2), blank and line feed (4), all else.
_CLASS = bytes(4 if b in (10, 32) else 0 if not 33 <= b < 127 else 1 if chr(b).isalnum() else 2 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_ENCODERS: dict[str, Encoder] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64, kept for the worker."""
    have = powers.__dict__.setdefault("kept", None)
    if have is None or len(have[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        size = max(n, SLICE + SLICE // 4)
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        powers.kept = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]`` from one pass over the bytes; long spans take xxh64."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > 64):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``offset .. offset + length - 1`` of every item, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(offsets - before, lengths) + np.arange(int(lengths.sum()))


class Encoder:
    """``drops_space``: the vocabulary knows no white space, so words stand for themselves."""

    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.splitter = Tokenizer.from_file(path)
        self.mark = self.splitter.token_to_id(SEPARATOR)
        self.drops_space = drops_space
        # Ids whose text begins with the blank or line end before a word, as the byte-level alphabet writes them.
        self.leads = np.zeros(max(self.tokenizer.get_vocab(True).values(), default=0) + 1, bool)
        self.leads[[i for text, i in self.tokenizer.get_vocab(True).items() if text[:1] in ("\u0120", "\u010a")]] = True
        self.keys = np.empty(0, np.uint64)
        self.offsets = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _led(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_words``, for words that each begin with the blank or line end before them: one text, cut where an id
        begins with it; None if the vocabulary does not tell."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        begin = np.flatnonzero(self.leads[ids])
        if len(begin) != len(words) or begin[0]:
            return None
        return ids, np.diff(np.append(begin, len(ids)))

    def _new(self, words: list[str], led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_words``; ``led`` marks those that begin with the blank or line end before them."""
        found = self._led([words[i] for i in np.flatnonzero(led)]) if led.any() else None
        if found is None:
            return self._words(words)
        if led.all():
            return found
        ids, sizes = found
        others, other_sizes = self._words([words[i] for i in np.flatnonzero(~led)])
        counts = np.empty(len(words), np.int64)
        counts[led], counts[~led] = sizes, other_sizes
        out, own = np.empty(len(ids) + len(others), np.uint32), np.repeat(led, counts)
        out[own], out[~own] = ids, others
        return out, counts

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has; one call for all,
        with a special token between them (a word that spells one is encoded by itself)."""
        odd = {i: None for i, w in enumerate(words) if "<|" in w}
        joined = SEPARATOR.join("" if i in odd else w for i, w in enumerate(words))
        ids = np.array(self.splitter.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        counts = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        ids = np.delete(ids, marks)
        if odd:
            whole = self._whole([words[i] for i in odd])
            at = (np.cumsum(counts) - counts)[list(odd)]
            ids = np.insert(ids, np.repeat(at, [len(w) for w in whole]), np.concatenate([np.array(w, np.uint32) for w in whole]))
            counts[list(odd)] = [len(w) for w in whole]
        return ids, counts

    def _irregular(self, data: np.ndarray, doc: np.ndarray, texts: list[str], last: np.ndarray) -> np.ndarray:
        """Texts where runs of white space, or white space at an end, change the cuts."""
        out = np.zeros(len(texts), bool)
        if self.drops_space:
            return out
        space = ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 32))
        at = np.flatnonzero(space[:-1] & space[1:])
        out[np.searchsorted(last, at, side="right")] = True  # the byte that closes a text is white space
        first = np.concatenate([[0], last[:-1]])
        out |= space[first] & (last - first > 1)
        out[last - first == 1] = False
        wide = np.zeros(len(data), bool)
        for lead, follow in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
            here = np.flatnonzero(data[:-1] == lead)
            wide[here[np.isin(data[here + 1], follow)]] = True
        for i in np.unique(np.searchsorted(last, np.flatnonzero(wide), side="right")):
            out[i] = out[i] or bool(_IRREGULAR.search(texts[i]))
        return out

    def _slice(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        whole = b"\n".join(raw) + b"\n"
        data, kinds = np.frombuffer(whole, np.uint8), np.frombuffer(whole.translate(_CLASS), np.uint8)
        last = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        cut = kinds == 4
        if not self.drops_space:
            cut[1:] |= (kinds[:-1] == 1) & (kinds[1:] == 2)
        ends = np.flatnonzero(cut)
        apart = kinds[ends] == 4  # a blank or line end stands between this word and the next
        starts = np.concatenate([[0], ends[:-1] + apart[:-1]])
        doc = np.searchsorted(last, starts, side="right")
        odd = self._irregular(data, doc, texts, last)
        real = (ends > starts) & ~odd[doc]
        led = np.concatenate([[False], apart[:-1]])[real]
        starts, ends, doc = starts[real], ends[real], doc[real]
        hashes = span_hashes(data, starts, ends)
        if not self.drops_space:
            # A word carries the blank or line end before it; the first of a text, and marks after a word, have none.
            lead = np.where(led & (starts != (last - np.diff(last, prepend=0))[doc]), data[starts - 1], 0).astype(np.uint64)
            hashes = mix(hashes + lead)
        # As np.unique, but of equal words any may stand for all, so the sort need not be stable.
        order = np.argsort(hashes)
        ranked = hashes[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        unique, first, inverse = ranked[fresh], order[fresh], np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        slot = np.searchsorted(self.keys, unique)
        hit = self.keys[np.minimum(slot, len(self.keys) - 1)] == unique if len(self.keys) else np.zeros(len(unique), bool)
        offsets, lengths, flat = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64), self.flat
        offsets[hit], lengths[hit] = self.offsets[slot[hit]], self.lengths[slot[hit]]
        if not hit.all():
            new = np.flatnonzero(~hit)
            begin = starts[first[new]]
            if not self.drops_space:
                begin = begin - (lead[first[new]] > 0)
            words = [whole[s:e].decode("utf-8", "replace") for s, e in zip(begin.tolist(), ends[first[new]].tolist(), strict=True)]
            ids, counts = self._words(words) if self.drops_space else self._new(words, lead[first[new]] > 0)
            lengths[new], offsets[new] = counts, len(flat) + np.cumsum(counts) - counts
            flat = np.concatenate([flat, ids])
            if len(self.keys) + len(new) <= CACHED:
                self.flat = flat
                at = np.searchsorted(self.keys, unique[new])
                self.keys = np.insert(self.keys, at, unique[new])
                self.offsets = np.insert(self.offsets, at, offsets[new])
                self.lengths = np.insert(self.lengths, at, lengths[new])
        sizes = lengths[inverse]
        ids = flat[ragged(offsets[inverse], sizes)]
        per_doc = np.bincount(doc, weights=sizes, minlength=len(texts)).astype(np.int64)
        if odd.any():
            at = np.flatnonzero(odd)
            found = self._whole([texts[i] for i in at])
            where = (np.cumsum(per_doc) - per_doc)[at]
            ids = np.insert(ids, np.repeat(where, [len(f) for f in found]), np.concatenate([np.array(f, np.uint32) for f in found]))
            per_doc[at] = [len(f) for f in found]
        return np.insert(ids, np.cumsum(per_doc), np.uint32(end)), per_doc + 1

    def flat_batches(self, texts: Sequence[str | None], end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first text, ids, ids per text)`` of bounded slices; ``end`` closes every text, null counts as empty."""
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size < SLICE):
                size += len(texts[to] or "")
                to += 1
            ids, counts = self._slice([t or "" for t in texts[at:to]], end)
            yield at, ids, counts
            at = to

    def batch(self, texts: Sequence[str | None], end: int) -> list[np.ndarray]:
        """Ids of each text with ``end`` appended."""
        return [x for _, ids, counts in self.flat_batches(texts, end) for x in np.split(ids, np.cumsum(counts)[:-1])]


def encoder(file: str, drops_space: bool = False) -> Encoder:
    """The worker's encoder of one vocabulary file (a name of ``public_tokenizers`` or a path)."""
    if file not in _ENCODERS:
        path = file if os.path.isabs(file) else public_tokenizers.path(file)
        _ENCODERS[file] = Encoder(path, drops_space)
    return _ENCODERS[file]
