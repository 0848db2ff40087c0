"""Exact, batch-wise application of a public BPE vocabulary.

The vocabulary's pre-tokeniser cuts a text into words that are merged independently, so each
distinct word needs to be merged once. Texts whose characters are all Latin-1 are segmented
with numpy and looked up word by word in a bounded cache; every other text, and every text that
could hold an added token, is given whole to the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from eventloom.llm.common import ranges, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: The word pattern that the numpy segmentation reproduces (fixed value of the vocabulary file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def _tables() -> tuple[np.ndarray, np.ndarray]:
    import unicodedata

    kind, lower = np.full(256, OTHER, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    for i in range(256):
        c = unicodedata.category(chr(i))
        kind[i] = LETTER if c[0] == "L" else DIGIT if c[0] == "N" else OTHER
        if i in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
            kind[i] = SPACE
        if len(low := chr(i).lower()) == 1 and ord(low) < 256:
            lower[i] = ord(low)
    return kind, lower


KIND, LOWER = _tables()


def grown(array: np.ndarray, used: int, least: int) -> np.ndarray:
    """``array``, or a longer one with the same first ``used`` entries that has room for ``least``; what is not used yet takes no memory."""
    if least <= len(array):
        return array
    out = np.empty(max(least, len(array) * 5 // 4), dtype=array.dtype)
    out[:used] = array[:used]
    return out


class WordTable:
    """Numbers and ids of words in flat arrays, which take about half the memory of a dict.

    Words are found by sorted 64-bit hashes and compared byte by byte; words that share the hash
    of another one are kept beside them.
    """

    def __init__(self):
        self.clear()

    def __len__(self) -> int:
        return self.n

    def clear(self) -> None:
        self.n = 0
        self.keys, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.clashing: dict[bytes, int] = {}
        self.text, self.text_edge = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        self.ids, self.ids_edge = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def find(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Numbers of the words ``data[edge[i]:edge[i + 1]]``, none of them empty; -1 for unknown ones."""
        out = np.full(len(edge) - 1, -1, dtype=np.int64)
        if not self.n or not len(out):
            return out
        hashes = span_hashes(data, edge[:-1], edge[1:])
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes)
        number, size = self.number[at[hit]].astype(np.int64), edge[hit + 1] - edge[hit]
        same = self.text_edge[number + 1] - self.text_edge[number] == size
        k, n, size = hit[same], number[same], size[same]
        if len(k):
            differ = self.text[ranges(self.text_edge[n], size)] != data[ranges(edge[k], size)]
            alike = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
            out[k[alike]] = n[alike]
        if self.clashing:
            for i in hit[out[hit] < 0].tolist():
                out[i] = self.clashing.get(data[edge[i] : edge[i + 1]].tobytes(), -1)
        return out

    def add(self, data: np.ndarray, edge: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Append distinct unknown words with their ids, of which each has ``size``."""
        k, n, old, used = len(edge) - 1, self.n, int(self.text_edge[self.n]), int(self.ids_edge[self.n])
        self.text = grown(self.text, old, old + len(data))
        self.text[old : old + len(data)] = data
        self.ids = grown(self.ids, used, used + len(ids))
        self.ids[used : used + len(ids)] = ids
        self.text_edge, self.ids_edge = (grown(a, n + 1, n + k + 1) for a in (self.text_edge, self.ids_edge))
        self.text_edge[n + 1 : n + k + 1] = old + edge[1:]
        self.ids_edge[n + 1 : n + k + 1] = used + np.cumsum(size)
        self.n += k
        hashes = span_hashes(data, edge[:-1], edge[1:])
        fresh, first = np.unique(hashes, return_index=True)
        if len(self.keys):
            at = np.searchsorted(self.keys, fresh)
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != fresh
            fresh, first, at = fresh[new], first[new], at[new]
        else:
            at = np.zeros(len(fresh), dtype=np.int64)
        if len(first) < k:
            for i in np.setdiff1d(np.arange(k), first).tolist():
                self.clashing[data[edge[i] : edge[i + 1]].tobytes()] = n + i
        self.keys = np.insert(self.keys, at, fresh)
        self.number = np.insert(self.number, at, (n + first).astype(np.int32))


class WordEncoder:
    """Ids of batches of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, max_words: int = 700_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        split = (pre.get("pretokenizers") or [{}])[0]
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fast = (
            split.get("pattern", {}).get("Regex") == PATTERN
            and norm == ["NFC", "Replace", "Lowercase"]
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.known = np.array([self.tok.id_to_token(i) is not None for i in range(size)])
        self.ends = np.array([t.endswith("</w>") for t in self.tokens])
        self.plain_decoder = spec.get("decoder") is None
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.spaced = re.compile("|".join(re.escape(t) for t in added if re.search(r"\s", t)) or r"(?!)")  # texts with these have no safe cut
        self.max_words = max_words
        self.words = WordTable()

    def _learn(self, data: np.ndarray, edge: np.ndarray, most: int = 1 << 16) -> None:
        """Merge unseen words, about ``most`` characters at a time; the last id of each word is one with the end mark."""
        part = edge[:-1] // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            own, at = data[edge[a] : edge[b]], edge[a : b + 1] - edge[a]
            words = [own[i:j].tobytes().decode("latin-1") for i, j in zip(at.tolist(), at[1:].tolist())]
            ids = np.array(self.tok.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.int32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(words):  # can't happen with a pre-tokeniser of this kind; stays exact if it does
                parts = [self.tok.encode(w, add_special_tokens=False).ids for w in words]
                ids = np.array([i for p in parts for i in p], dtype=np.int32)
                stop = np.cumsum([len(p) for p in parts])
            self.words.add(own, at, ids, np.diff(stop, prepend=0))

    def _latin(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each) for Latin-1 texts."""
        import pyarrow as pa

        sizes = np.array([len(b) + 1 for b in blobs], dtype=np.int64)
        raw = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
        low = LOWER[raw]
        kind = KIND[low]
        begins = np.ones(len(raw), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == DIGIT
        keep = kind != SPACE
        begins &= keep
        quote = np.flatnonzero(low == 39)
        quote = quote[(kind[quote + 1] == LETTER) & begins[quote]]
        if len(quote):
            a, b = low[quote + 1], low[np.minimum(quote + 2, len(low) - 1)]
            one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for hit, n in ((quote[one], 1), (quote[two], 2)):
                begins[hit + 1] = False
                after = hit + 1 + n
                begins[after[kind[after] == LETTER]] = True
        place = np.cumsum(keep, dtype=np.int32)  # Arrow's offsets have 32 bits too
        at = np.flatnonzero(begins)
        offsets = np.append(place[at] - 1, place[-1]).astype(np.int32)
        data = low[keep]
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        slot = self._numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.words.ids_edge[slot + 1] - self.words.ids_edge[slot]
        ids = self.words.ids[ranges(self.words.ids_edge[slot], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        edge = np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]))
        return ids, np.diff(total[edge])

    def _numbers(self, unique) -> np.ndarray:
        """Numbers in the table of an Arrow array of distinct words; unknown ones are learnt."""
        if not len(unique):
            return np.zeros(0, dtype=np.int64)
        if len(self.words) + len(unique) > self.max_words and len(self.words) > self.max_words // 2:
            self.words.clear()
        _, offsets, data = unique.buffers()
        edge = np.frombuffer(offsets, dtype=np.int32)[unique.offset : unique.offset + len(unique) + 1].astype(np.int64)
        data, edge = np.frombuffer(data, dtype=np.uint8)[edge[0] : edge[-1]], edge - edge[0]
        number = self.words.find(data, edge)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.words) + np.arange(len(new))
            size = edge[new + 1] - edge[new]
            self._learn(data[ranges(edge[new], size)], np.concatenate([[0], np.cumsum(size)]))
        return number

    def _slow(self, texts: list[str], most: int = 1 << 16):
        """Ids of each text by the library, about ``most`` characters at a time: what it returns takes a hundred times the ids."""
        part = np.cumsum([len(t) for t in texts]) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            for e in self.tok.encode_batch(texts[a:b], add_special_tokens=False):
                yield np.array(e.ids, dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        blobs: list[bytes] = []
        where: list[int] = []
        slow: list[int] = []
        for i, t in enumerate(texts):
            try:
                if not self.fast or self.added.search(t):
                    raise UnicodeError
                blobs.append(t.encode("latin-1"))
                where.append(i)
            except UnicodeError:
                slow.append(i)
        count = np.zeros(len(texts), dtype=np.int64)
        ids, n = self._latin(blobs) if blobs else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
        count[where] = n
        if not slow:
            return ids, count
        found = list(self._slow([texts[i] for i in slow]))
        count[slow] = [len(f) for f in found]
        out = np.empty(int(count.sum()), dtype=np.int32)
        at = np.cumsum(count) - count
        out[ranges(at[where], n)] = ids
        for i, f in zip(slow, found):
            out[at[i] : at[i] + len(f)] = f
        return out, count


_CACHE: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _CACHE:
        _CACHE[path] = WordEncoder(path)
    return _CACHE[path]


def default_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
