"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.bpe_words import default_vocabulary, encoder
from eventloom.llm.common import drop_clashes, fmix, powers, text_batches

#: Characters at which every word pattern of the vocabulary ends (Unicode White_Space).
WHITE = "\t\n\v\f\r \x85\xa0                　"
_WHITE = np.array([ord(c) for c in WHITE], dtype=np.uint32)
_LATIN_WHITE = np.isin(np.arange(256), _WHITE)


def code_points(text: str) -> np.ndarray:
    try:
        return np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def chunk_cuts(points: np.ndarray, average: int, window: int) -> np.ndarray:
    """Places where the rolling hash of the last ``window`` characters has its low bits zero."""
    if len(points) <= window:
        return np.zeros(0, dtype=np.int64)
    pw, inv = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * pw[: len(points)], out=total[1:])
    rolled = fmix((total[window:] - total[:-window]) * inv[: len(points) - window + 1])
    cuts = np.flatnonzero((rolled & np.uint64(average - 1)) == 0) + window
    return cuts[cuts < len(points)]


def run_starts(white: np.ndarray) -> np.ndarray:
    """Places of the first of each row of white space."""
    before = np.empty_like(white)
    before[:1] = False
    before[1:] = white[:-1]
    return np.flatnonzero(white & ~before)


class ChunkEncoder:
    """Encodes each distinct chunk once while it stays in a cache of bounded size, and repairs the joins.

    What is kept of a chunk is its interior, from its first to its last white space. What lies
    between the interiors of two chunks is the join: it is encoded again together with the last
    word before and the first word after it, and it holds if the ids of these two words come out
    as they do alone. Where they don't, the two chunks and the join are encoded as one piece,
    widened by a chunk on either side until what it shares with the outermost chunks agrees with
    their ids, or the piece is the whole text.
    """

    def __init__(self, path: str, average: int = 1024, window: int = 32, cache_chars: int = 8_000_000):
        self.words = encoder(path)
        self.average, self.window, self.cache_chars = average, window, cache_chars
        self.young: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}
        self.held = 0
        self.encoded = self.reused = self.repaired = 0

    def _cached(self, chunk: str) -> np.ndarray | None:
        found = self.young.get(chunk)
        if found is None and (found := self.old.get(chunk)) is not None:
            self._keep(chunk, found)
        return found

    def _keep(self, chunk: str, ids: np.ndarray) -> None:
        self.young[chunk] = ids
        self.held += len(chunk)
        if self.held > self.cache_chars // 2:
            self.young, self.old, self.held = {}, self.young, 0

    def interiors(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, start of the second word, start of the last word, end) of each chunk's interior of two words or more."""
        if self.words.spaced.search(text):
            return []
        points = code_points(text)
        runs = run_starts(_LATIN_WHITE[points] if points.dtype == np.uint8 else np.isin(points, _WHITE))
        cuts = chunk_cuts(points, self.average, self.window)
        first = np.searchsorted(runs, np.concatenate([[0], cuts]))
        last = np.searchsorted(runs, np.append(cuts, len(points))) - 1
        good = last - first >= 2
        first, last = first[good], last[good]
        return list(zip(runs[first].tolist(), runs[first + 1].tolist(), runs[last - 1].tolist(), runs[last].tolist()))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        todo: list[str] = []
        fresh: dict[str, int] = {}
        known: dict[str, np.ndarray] = {}
        plans: list[tuple[list, list, list]] = []  # of a text: interiors, their texts, joins as (window, word before, word after) in todo
        for text in texts:
            inner = self.interiors(text)
            chunks, joins = [text[h:t] for h, _, _, t in inner], []
            for chunk in chunks:
                if chunk in known or chunk in fresh:
                    self.reused += 1
                elif (ids := self._cached(chunk)) is not None:
                    known[chunk] = ids
                    self.reused += 1
                else:
                    fresh[chunk] = len(todo)
                    todo.append(chunk)
            for left, right in zip([None, *inner], [*inner, None]):
                at = len(todo)
                todo.append(text[left[2] if left else 0 : right[1] if right else len(text)])
                todo.append(text[left[2] : left[3]] if left else "")
                todo.append(text[right[0] : right[1]] if right else "")
                joins.append(at)
            plans.append((inner, chunks, joins))
        ids, count = self.words.encode(todo)
        cut = np.concatenate([[0], np.cumsum(count)])
        piece = lambda k: ids[cut[k] : cut[k + 1]]
        for chunk, k in fresh.items():
            known[chunk] = piece(k).copy()
            self._keep(chunk, known[chunk])
        self.encoded += len(fresh)
        out: list[np.ndarray] = []
        total = np.zeros(len(texts), dtype=np.int64)
        for i, (inner, chunks, joins) in enumerate(plans):
            parts: list[np.ndarray] | None = []
            for j, k in enumerate(joins):
                whole, left, right = piece(k), piece(k + 1), piece(k + 2)
                a, b = len(left), len(whole) - len(right)
                if a > b or not np.array_equal(whole[:a], left) or not np.array_equal(whole[b:], right):
                    parts = None
                    break
                parts.append(whole[a:b])
                if j < len(chunks):
                    parts.append(known[chunks[j]])
            if parts is None:
                parts = self.repair(texts[i], inner, [known[c] for c in chunks])
            out += parts
            total[i] = sum(map(len, parts))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), total

    def _alone(self, text: str) -> np.ndarray:
        return self.words.encode([text])[0]

    def repair(self, text: str, inner: list[tuple], ids: list[np.ndarray]) -> list[np.ndarray]:
        """Parts of the ids of a text of which some join doesn't hold."""
        self.repaired += 1
        pieces = [[h, n, p, t, found] for (h, n, p, t), found in zip(inner, ids)]
        joins: list[np.ndarray | None] = [None] * (len(pieces) + 1)
        j = 0
        while j <= len(pieces):
            left, right = pieces[j - 1] if j else None, pieces[j] if j < len(pieces) else None
            whole = self._alone(text[left[2] if left else 0 : right[1] if right else len(text)])
            before = self._alone(text[left[2] : left[3]]) if left else whole[:0]
            after = self._alone(text[right[0] : right[1]]) if right else whole[:0]
            a, b = len(before), len(whole) - len(after)
            if a <= b and np.array_equal(whole[:a], before) and np.array_equal(whole[b:], after):
                joins[j] = whole[a:b]
                j += 1
                continue
            lo, hi = j - 1, j
            while True:
                if lo < 0 or hi >= len(pieces):
                    return [self._alone(text)]
                wide = self._alone(text[pieces[lo][0] : pieces[hi][3]])
                head = pieces[lo][4][: len(pieces[lo][4]) - len(self._alone(text[pieces[lo][2] : pieces[lo][3]]))]
                tail = pieces[hi][4][len(self._alone(text[pieces[hi][0] : pieces[hi][1]])) :]
                if len(head) + len(tail) <= len(wide) and np.array_equal(wide[: len(head)], head) and np.array_equal(wide[len(wide) - len(tail) :], tail):
                    break
                lo, hi = lo - 1, hi + 1
            pieces[lo : hi + 1] = [[pieces[lo][0], pieces[lo][1], pieces[hi][2], pieces[hi][3], wide]]
            joins = [*joins[: lo + 1], *[None] * (len(pieces) - lo)]
            j = lo + 1
        return [x for k, join in enumerate(joins) for x in ([join, pieces[k][4]] if k < len(pieces) else [join])]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def chunk_encoder(path: str, average: int, window: int, cache_chars: int) -> ChunkEncoder:
    key = (path, average, window, cache_chars)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


def encode_decode(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    average: int = 1024,
    window: int = 32,
    cache_chars: int = 8_000_000,
    decode: bool = True,
) -> DataFrame:
    """Ids of every whole text and, with ``decode``, the text decoded from them: (id, ids array<int>, decoded string).

    Equal to the ``tokenizers`` library's ``encode(text, add_special_tokens=False)`` and
    ``decode(ids, skip_special_tokens=False)`` without truncation or padding, for any vocabulary
    file of that library that parts texts at white space. Chunks are cut where a rolling hash of
    the content says so; equal chunks are encoded once per worker process while they are among
    the last ``cache_chars`` characters seen (see ``ChunkEncoder`` for the joins). No shuffle:
    texts stay in the tasks that read them, so no key can be hot and a lost task is simply repeated.

    A null or empty text has no ids and decodes to the empty string. Repeated rows and null ids
    are kept as they are. An empty table gives an empty result. Other columns are not read.
    The vocabulary file must lie at the same path on all executors.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        coder = chunk_encoder(path, average, window, cache_chars)
        tokens = pa.array(coder.words.tokens if decode else [], pa.string())
        for keys, texts in text_batches(batches):
            ids, count = coder.encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            columns = [keys.cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
            if decode and coder.words.plain_decoder:
                parts = pa.ListArray.from_arrays(offsets, tokens.take(pa.array(ids, pa.int32())))
                columns.append(pc.binary_join(parts, " ").cast(pa.string()))
            elif decode:
                at = offsets.to_pylist()
                lists = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
                columns.append(pa.array(coder.words.tok.decode_batch(lists, skip_special_tokens=False), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, ids array<int>" + ", decoded string" * decode
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return drop_clashes(rows, "doc_id", "text").mapInArrow(run, schema)


def op6_bpe_chunks(spark, sf_dir: str) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the decoded text."""
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
