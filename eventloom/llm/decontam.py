"""Benchmark decontamination by latent semantic retrieval with a check of the words in order."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import fmix, give_back, ranges, scratch, span_hashes, stored, text_batches, unused, word_spans

#: Words of half a passage; a passage is two halves, so any 33 words in a row lie in one.
HALF = 32


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw, starts, ends, count = word_spans(texts)
    return span_hashes(raw, starts, ends), count


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row."""
    out = np.full(max(0, len(hashes) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        out = fmix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return out


@dataclass
class Items:
    """A block of benchmark items: parts of at most a passage's length and the space they are sought in."""

    short: dict  # of items too short for parts: words -> (sorted hashes of their sequences, item ids)
    item_ids: np.ndarray  # of each part
    words: list[np.ndarray]  # word hashes of each part
    answers: list[np.ndarray]  # word hashes of the answer of each part's item
    terms: np.ndarray  # sorted hashes of the words that count
    weight: np.ndarray | None = None  # inverse document frequency of each term
    space: np.ndarray | None = None  # terms x rank, orthonormal columns
    parts: np.ndarray | None = None  # parts x rank, unit rows
    known: np.ndarray | None = None  # sorted hashes of the terms, the listed words and the anchors of answers
    latent: np.ndarray | None = None  # the term of each known word, -1 for one that is none
    listed: tuple | None = None  # (first entry of each known word, parts, places in the part): the rarest words of each part
    needed: np.ndarray | None = None  # how many of a part's listed places a leak holds at least
    anchors: tuple | None = None  # (first entry of each known word, parts, place in the answer): the rarest word of each long answer

    def __post_init__(self):
        self.bits = None

    def __getstate__(self):
        return self.__dict__ | {"bits": None}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the known words, which of these); before ``informative`` all terms are known."""
        known = self.terms if self.known is None else self.known
        if not len(known):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if self.bits is None:
            self.bits = np.zeros(1 << 22, dtype=bool)
            self.bits[known >> np.uint64(42)] = True
        at = np.flatnonzero(self.bits[hashes >> np.uint64(42)])
        found = np.searchsorted(known, hashes[at])
        found[found == len(known)] = 0
        same = known[found] == hashes[at]
        return at[same], found[same]

    def terms_in(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are terms, their terms)."""
        at, found = self.find(hashes)
        term = self.latent[found]
        return at[term >= 0], term[term >= 0]


def answer_of(text: str) -> str:
    """What follows the last "answer:", else the last sentence of four words or more, else nothing."""
    if m := re.search(r"answers?\s*[:=]\s*(.+)\Z", text, re.I | re.S):
        return m[1]
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if len(s.split()) >= 4]
    return sentences[-1] if sentences else ""


def items_of(rows: list[tuple[int, str]], least: int) -> Items | None:
    """Parts of the items with ``least`` words or more, longer items being cut into overlapping parts; the word sequences of shorter ones."""
    rows = [(i, t) for i, t in rows if i is not None and t]
    if not rows:
        return None
    hashes, count = word_hashes([t for _, t in rows])
    answers, sizes = word_hashes([answer_of(t) for _, t in rows])
    ids, words, ans, few = [], [], [], {}
    at, to = np.cumsum(count) - count, np.cumsum(sizes) - sizes
    for k, (i, _) in enumerate(rows):
        own = hashes[at[k] : at[k] + count[k]]
        if len(own) < least:
            if len(own):
                few.setdefault(len(own), []).append((int(sequences(own, len(own))[0]), i))
            continue
        for s in range(0, max(1, len(own) - HALF), HALF):
            ids.append(i)
            words.append(own[s : s + 2 * HALF])
            ans.append(answers[to[k] : to[k] + sizes[k]])
    short = {n: (np.array([h for h, _ in sorted(found)], dtype=np.uint64), np.array([i for _, i in sorted(found)])) for n, found in few.items()}
    if not ids and not short:
        return None
    return Items(short, np.array(ids, dtype=np.int64), words, ans, np.unique(np.concatenate(words)) if words else np.zeros(0, dtype=np.uint64))


def term_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""
    given = docs.sparkSession.sparkContext.broadcast(items)  # a block of items, see ``block``

    def run(batches):
        import pyarrow as pa

        items = given.value
        total, n = np.zeros(len(items.terms), dtype=np.int64), 0
        for (texts,) in text_batches(batches, 0):
            hashes, count = word_hashes(texts)
            at, term = items.find(hashes)
            doc = np.searchsorted(np.cumsum(count), at, side="right")
            pairs = np.unique(doc * len(items.terms) + term)
            total += np.bincount(pairs % len(items.terms), minlength=len(items.terms))
            n += len(texts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long")
    found = rows.groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per term of the block
    out, n = np.zeros(len(items.terms), dtype=np.int64), 0
    for r in found:
        if r.term < 0:
            n = r.n
        else:
            out[r.term] = r.n
    return out, n


def entries(words: list[np.ndarray], parts: list[int], places: list[np.ndarray], known: np.ndarray) -> tuple:
    """(first entry of each known word, parts, places) of the words listed for each part."""
    word = np.searchsorted(known, np.concatenate([*words, np.zeros(0, dtype=np.uint64)]))
    part = np.repeat(np.array(parts, dtype=np.int64), [len(w) for w in words])
    order = np.argsort(word, kind="stable")
    return np.searchsorted(word[order], np.arange(len(known) + 1)), part[order], np.concatenate([*places, np.zeros(0, dtype=np.int64)])[order]


def informative(items: Items, df: np.ndarray, n: int, most: float, rarest: int, copied: float, paraphrased: float) -> Items:
    """Items whose terms are the words in at most ``most`` of the documents, and the ``rarest`` words of each part.

    A leak holds ``copied`` of a part's words, or ``paraphrased`` of them and the answer. So it
    can't do without some of the part's rarest words: each part lists so many that a leak holds
    ``needed`` of the listed places, by the lower share where the answer has less than four
    words. A longer answer has to stand in the text; its rarest word is its anchor.
    """
    keep = df <= max(1.0, most * n)
    listed, places, needed, anchors, offsets, anchored = [], [], [], [], [], []
    for k, words in enumerate(items.words):
        term, times = np.unique(np.searchsorted(items.terms, words), return_counts=True)
        order = np.argsort(df[term], kind="stable")
        keep[term[order[:rarest]]] = True
        answer = items.answers[k]
        least = max(1, int(np.ceil((paraphrased if 0 < len(answer) < 4 else copied) * len(words))))
        missing = len(words) - least  # places that a leak may lack
        order = order[: int(np.searchsorted(np.cumsum(times[order]), missing + max(1, least // 6))) + 1]
        listed.append(items.terms[term[order]])
        places.append(times[order])
        needed.append(int(times[order].sum()) - missing)
        if len(answer) >= 4:
            at = np.minimum(np.searchsorted(items.terms, answer), len(items.terms) - 1)
            count = np.where(items.terms[at] == answer, df[at], n + 1)  # a word of the answer may lie in another part
            offset = int(np.argmin(count))
            anchors.append(answer[offset : offset + 1])
            offsets.append(np.array([offset]))
            anchored.append(k)
    out = Items(items.short, items.item_ids, items.words, items.answers, items.terms[keep])
    out.weight = np.log((1 + n) / (1 + df[keep])) + 1.0
    out.known = np.unique(np.concatenate([out.terms, *listed, *anchors]))
    at = np.minimum(np.searchsorted(out.terms, out.known), len(out.terms) - 1)
    out.latent = np.where(out.terms[at] == out.known, at, -1)
    out.listed = entries(listed, list(range(len(listed))), places, out.known)
    out.needed = np.array(needed)
    out.anchors = entries(anchors, anchored, offsets, out.known)
    return out


def term_rows(items: Items, hashes: np.ndarray, count: np.ndarray):
    """(places and numbers of the known words, text and half of each, first half of each text, halves of each text)."""
    at, found = items.find(hashes)
    first = np.cumsum(count) - count
    halves = np.maximum(1, -(-count // HALF))
    base = np.cumsum(halves) - halves
    doc = np.searchsorted(first + count, at, side="right")
    return at, found, doc, base[doc] + (at - first[doc]) // HALF, base, halves


def latent_rows(items: Items, found: np.ndarray, doc: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, half, term) of the known words that are terms."""
    term = items.latent[found]
    ok = term >= 0
    return doc[ok], half[ok], term[ok]


def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of the values of each)."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order][cut], np.add.reduceat(values[order], cut)


def fan_out(entry: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the found word, index of the entry) of all entries of the found words."""
    size = entry[found + 1] - entry[found]
    return np.repeat(np.arange(len(found)), size), ranges(entry[found], size)


def possible(items: Items, hashes: np.ndarray, count: np.ndarray, at: np.ndarray, found: np.ndarray, doc: np.ndarray, half: np.ndarray, base: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first half of the passage, part), in order, of all pairs that can be leaks by the words in the text around the passage.

    The text around passage h is the halves h - 1 to h + 2. It is given at least the listed words
    that it holds, since words count once a half, and every answer that stands in it: no leak is
    left out, whatever its cosine.
    """
    n, m = len(items.known), len(items.words)
    entry, part, places = items.listed
    own = np.unique(half * n + found)
    half_, word = own // n, own % n
    k, e = fan_out(entry, word)
    keys, held = sums(half_[k] * m + part[e], places[e])
    half_, part = keys // m, keys % m
    doc_ = np.searchsorted(base, half_, side="right") - 1
    around, value = [], []
    for step in (-2, -1, 0, 1):
        ok = (half_ + step >= base[doc_]) & (half_ + step < base[doc_] + halves[doc_])
        around.append(((half_ + step) * m + part)[ok])
        value.append(held[ok])
    keys, held = sums(np.concatenate(around), np.concatenate(value))
    out = [keys[held >= items.needed[keys % m]]]
    entry, part, offset = items.anchors
    k, e = fan_out(entry, found)
    start, part, doc_ = at[k] - offset[e], part[e], doc[k]
    first = np.cumsum(count) - count
    size = np.array([len(a) for a in items.answers])[part] if len(part) else part
    ok = (start >= first[doc_]) & (start + size <= first[doc_] + count[doc_])
    start, part, doc_, size = start[ok], part[ok], doc_[ok], size[ok]
    ends = np.array([[a[0], a[1], a[-1]] if len(a) else [0, 0, 0] for a in items.answers], dtype=np.uint64)[part]
    same = (hashes[start] == ends[:, 0]) & (hashes[start + 1] == ends[:, 1]) & (hashes[start + size - 1] == ends[:, 2])
    for s, p, d, z in zip(start[same].tolist(), part[same].tolist(), doc_[same].tolist(), size[same].tolist()):
        if np.array_equal(hashes[s : s + z], items.answers[p]):
            s -= int(first[d])
            low, high = max(0, -(-(s + z) // HALF) - 3), min(int(halves[d]) - 1, s // HALF + 1)
            out.append((int(base[d]) + np.arange(low, high + 1)) * m + p)
    keys = np.unique(np.concatenate(out))
    return keys // m, keys % m


def passage_rows(doc: np.ndarray, half: np.ndarray, term: np.ndarray, base: np.ndarray, least: int, also: np.ndarray | None = None):
    """(first half of each passage that holds ``least`` terms or is in ``also``, segment starts, terms): terms of each passage one after another."""
    before = np.flatnonzero(half > base[doc])
    passage = np.concatenate([half, half[before] - 1])
    term = np.concatenate([term, term[before]])
    order = np.argsort(passage, kind="stable")
    passage, term = passage[order], term[order]
    cut = np.flatnonzero(np.diff(passage, prepend=-1))
    size = np.diff(np.append(cut, len(passage)))
    keep = size >= least
    if also is not None:
        keep |= np.isin(passage[cut], also)
    mask = np.repeat(keep, size)
    size = size[keep]
    return passage[cut[keep]], np.cumsum(size) - size, term[mask]


def tfidf(weight: np.ndarray, starts: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of the TF-IDF matrix's entries by row, rows scaled to unit length, and the first entry of each row."""
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
    pair, tf = np.unique(row * len(weight) + term, return_counts=True)
    row, term = pair // len(weight), pair % len(weight)
    value = tf * weight[term]
    cut = np.flatnonzero(np.diff(row, prepend=-1))
    norm = np.sqrt(np.add.reduceat(value**2, cut))
    return row, term, (value / norm[row]).astype(np.float32), cut


def embedded(items: Items, starts: np.ndarray, term: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows of the TF-IDF matrix, scaled to unit length, times ``matrix``."""
    if not len(starts):
        return np.zeros((0, matrix.shape[1]), dtype=np.float32)
    _, term, value, cut = tfidf(items.weight, starts, term)
    return np.add.reduceat(matrix[term] * value[:, None], cut, axis=0)


def add_product(total: np.ndarray, weight: np.ndarray, starts: np.ndarray, term: np.ndarray, matrix: np.ndarray) -> None:
    """Add A'(A ``matrix``) to ``total`` for the rows A of the TF-IDF matrix."""
    row, term, value, cut = tfidf(weight, starts, term)
    y = np.add.reduceat(matrix[term] * value[:, None], cut, axis=0)
    order = np.argsort(term, kind="stable")
    first = np.flatnonzero(np.diff(term[order], prepend=-1))
    total[term[order][first]] += np.add.reduceat(y[row[order]] * value[order][:, None], first, axis=0)


def slices(starts: np.ndarray, term: np.ndarray, most: int = 1000):
    """(segment starts, terms) of ``most`` segments at a time."""
    for s in range(0, len(starts), most):
        end = starts[s + most] if s + most < len(starts) else len(term)
        yield starts[s : s + most] - starts[s], term[starts[s] : end]


def item_rows(items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(segment starts, terms) of the parts; a part without terms can't be and isn't."""
    terms = [items.terms_in(w)[1] for w in items.words]
    size = np.array([len(t) for t in terms])
    return np.cumsum(size) - size, np.concatenate(terms)


#: Terms whose rows of a sum travel together.
TERMS = 64


def summed_product(passages: DataFrame, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'(A ``matrix``) for the TF-IDF rows A of all passages: tasks add up their own passages, then blocks of terms are added up across tasks."""
    given, rank = passages.sparkSession.sparkContext.broadcast((weight, matrix)), matrix.shape[1]

    def share(batches):
        import pyarrow as pa

        weight, matrix = given.value
        total = np.zeros(matrix.shape)
        for batch in batches:
            for starts, term in zip(*[batch.column(i).to_pylist() for i in (0, 1)]):
                add_product(total, weight, np.frombuffer(starts, dtype=np.int32), np.frombuffer(term, dtype=np.int32), matrix)
        for k in range(0, len(total), TERMS):
            if total[k : k + TERMS].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k : k + TERMS].tobytes()], pa.binary())], ["first", "share"])
        give_back()

    def add_up(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, rows in zip(*[batch.column(i).to_pylist() for i in (0, 1)]):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(rows).reshape(-1, rank)
        for k, rows in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([rows.tobytes()], pa.binary())], ["first", "share"])

    schema = "first long, share binary"
    shares = passages.mapInArrow(share, schema).repartition(max(8, len(weight) // (8 * TERMS)), "first")
    total = np.zeros(matrix.shape)
    for r in shares.mapInArrow(add_up, schema).collect():  # terms x rank numbers, however many documents there are
        total[r["first"] : r["first"] + TERMS] = np.frombuffer(r.share).reshape(-1, rank)
    given.destroy()
    return total


def fit_space(docs: DataFrame, items: Items, n: int, rank: int, mass: int, seed: int) -> Items:
    """Latent space by a distributed randomised SVD of TF-IDF passages.

    Rows are the items' parts and the passages of all ``n`` documents that hold two terms, which
    are stored as numbers of terms. Each round computes A'(A M) for the terms-by-rank matrix M; M
    is random first, then the orthonormal basis of the sum: two rounds. Cosines don't depend on
    the basis of the space, so the last one is the result. More than ``mass`` documents weigh as
    much as ``mass`` beside the items, so that these keep their share of the space.
    """
    rank = min(rank, len(items.terms))
    rng = np.random.Generator(np.random.PCG64(seed))
    matrix = np.linalg.qr(rng.standard_normal((len(items.terms), rank)))[0].astype(np.float32)
    given = docs.sparkSession.sparkContext.broadcast(items)

    def cut(batches):
        import pyarrow as pa

        items = given.value
        for (texts,) in text_batches(batches, 0):
            hashes, count = word_hashes(texts)
            _, found, doc, half, base, _ = term_rows(items, hashes, count)
            doc, half, term = latent_rows(items, found, doc, half)
            _, starts, term = passage_rows(doc, half, term, base, 2)
            rows = [(s.astype(np.int32).tobytes(), t.astype(np.int32).tobytes()) for s, t in slices(starts, term)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["starts", "terms"])

    passages = stored(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(cut, "starts binary, terms binary"), "passages")
    given.destroy()
    starts, term = item_rows(items)
    scale = max(1.0, len(starts) and float(np.sqrt(mass / len(starts))))
    for _ in range(2):
        total = summed_product(passages, items.weight, matrix) * min(1.0, mass / max(1, n))
        for part in slices(starts, term):
            own = np.zeros(matrix.shape)
            add_product(own, items.weight, *part, matrix)
            total += scale * own
        matrix = np.linalg.qr(total)[0].astype(np.float32)
    items.space = matrix
    parts = np.concatenate([embedded(items, *part, matrix) for part in slices(starts, term)])
    items.parts = parts / np.maximum(np.linalg.norm(parts, axis=1, keepdims=True), 1e-9)
    return items


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of item words at a time."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    state = full
    for w in text.tolist():
        if mask := masks.get(w):
            hit = state & mask
            state = (state + hit | state - hit) & full
    return len(item) - state.bit_count()


def holds(text: np.ndarray, answer: np.ndarray) -> bool:
    """Whether the words of ``answer`` occur in a row."""
    n = len(answer)
    if not n or len(text) < n:
        return False
    at = np.flatnonzero(text[: len(text) - n + 1] == answer[0])
    return any(np.array_equal(text[a : a + n], answer) for a in at)


def short_leaks(items: Items, hashes: np.ndarray, count: np.ndarray):
    """(text, item id, its words) of the items too short for parts that stand in a text word for word."""
    end = np.cumsum(count)
    for n, (sought, ids) in items.short.items():
        found = sequences(hashes, n)
        at = np.flatnonzero(np.isin(found, sought))
        doc = np.searchsorted(end, at, side="right")
        at, doc = at[at + n <= end[doc]], doc[at + n <= end[doc]]
        pairs = np.unique(np.stack([doc.astype(np.uint64), found[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), dtype=np.uint64)
        for d, h in pairs:
            for k in range(*(int(np.searchsorted(sought, h, side=side)) for side in ("left", "right"))):
                yield int(d), int(ids[k]), n


def leaks_in(items: Items, hashes: np.ndarray, count: np.ndarray, cosine: float, copied: float, paraphrased: float):
    """(text, part, words in common, cosine, answer found) of each leak of an item in parts found in a batch; a pair may repeat."""
    if not len(items.terms):
        return
    first = np.cumsum(count) - count
    at, found, doc, half, base, halves = term_rows(items, hashes, count)
    around, held = possible(items, hashes, count, at, found, doc, half, base, halves)
    doc, half, term = latent_rows(items, found, doc, half)
    passage, starts, term = passage_rows(doc, half, term, base, 2, around)

    def checked(half: int, k: int, near: float):
        doc = int(np.searchsorted(base, half, side="right")) - 1
        a = (half - int(base[doc])) * HALF
        own = hashes[first[doc] + max(0, a - HALF) : first[doc] + min(int(count[doc]), a + 3 * HALF)]
        words = items.words[k]
        n = common_subsequence(words, own)
        if n < paraphrased * len(words):
            return
        answered = holds(own, items.answers[k])
        if n >= copied * len(words) or answered:
            yield doc, k, n, near, answered

    for s in range(0, len(passage), 2000):
        e = min(len(passage), s + 2000)
        stop = starts[e] if e < len(starts) else len(term)
        x = embedded(items, starts[s:e] - starts[s], term[starts[s] : stop], items.space)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        near = x @ items.parts.T
        # of the candidates by cosine those whose words can suffice, and the pairs whose words can suffice below it
        mine = slice(*np.searchsorted(around, [passage[s], passage[e - 1] + 1]))
        row = np.searchsorted(passage[s:e], around[mine])
        same = passage[s:e][row] == around[mine]
        row, part = row[same], held[mine][same]
        close = near[row, part]
        for p in np.argsort(close < cosine, kind="stable"):
            yield from checked(int(passage[s + row[p]]), int(part[p]), float(close[p]))
    bare = ~np.isin(around, passage)  # passages without a term, between halves that hold the words
    for h, k in zip(around[bare].tolist(), held[bare].tolist()):
        yield from checked(h, k, 0.0)


def prepared(docs: DataFrame, benchmark: DataFrame, block: int, least: int, rank: int, mass: int, common: float, seed: int, shares: tuple[float, float]):
    """The benchmark in blocks of at most ``block`` items, each with its own terms and space; the driver holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    held = []

    def ready(rows):
        if not rows or (items := items_of(rows, least)) is None:
            return
        if len(items.terms):
            df, n = term_counts(docs, items)
            with scratch(docs.sparkSession):
                items = fit_space(docs, informative(items, df, n, common, 8, *shares), n, rank, mass, seed)
        yield items

    for r in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        if len(held) == block:
            yield from ready(held)
            held = []
    yield from ready(held)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    cosine: float = 0.3,
    copied: float = 0.8,
    paraphrased: float = 0.6,
    least: int = 6,
    rank: int = 256,
    mass: int = 2000,
    common: float = 0.02,
    block: int = 4096,
    seed: int = 11,
) -> DataFrame:
    """Leaks of benchmark items in whole documents: doc_id, item_id, n_words, n_common, coverage, cosine, answered.

    Every document is cut into overlapping passages of 64 words, and every passage that holds
    two informative terms is compared by cosine with all items (their parts of 64 words) in a
    latent space; terms count over all documents, and the space is fitted on all documents and
    the items (see ``fit_space``). Candidates are the pairs that reach ``cosine`` and, whatever their
    cosine, all whose words leave a leak possible (see ``possible``), so the space loses none;
    candidates whose words can't suffice end there. A candidate is a leak if its longest common
    subsequence with the text around the passage covers ``copied`` of the item's words, or
    ``paraphrased`` of them and the item's answer (see ``answer_of``) stands there word for word.
    One row per document and item with the best figures; the benchmark is a stated query set,
    taken in blocks of ``block`` items, one of which is held at a time, and ``docs`` is read three
    times a block.

    Items with fewer than ``least`` words are sought word for word in every text: such an item
    leaks where all its words stand in a row. Null items, and null or empty texts, have no leak.
    Repeated ids of either side are taken together. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_words long, n_common long, cosine double, answered boolean"
    out = spark.createDataFrame([], schema)
    for items in prepared(docs, benchmark, block, least, rank, mass, common, seed, (copied, paraphrased)):
        given = spark.sparkContext.broadcast(items)

        def run(batches, given=given):
            import pyarrow as pa

            items = given.value
            for keys, texts in text_batches(batches):
                keys = keys.to_pylist()
                best: dict[tuple, tuple] = {}
                hashes, count = word_hashes(texts)
                found = [(d, int(items.item_ids[k]), len(items.words[k]), n, c, answered) for d, k, n, c, answered in leaks_in(items, hashes, count, cosine, copied, paraphrased)]
                found += [(d, i, n, n, 1.0, False) for d, i, n in short_leaks(items, hashes, count)]
                for d, i, size, *row in found:
                    row = (row[0] / size, size, *row)
                    best[d, i] = max(best.get((d, i), row), row)
                if best:
                    cells = zip(*[(keys[d], i, w, n, c, a) for (d, i), (_, w, n, c, a) in best.items()])
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], ["doc_id", "item_id", "n_words", "n_common", "cosine", "answered"])

        out = out.union(stored(rows.mapInArrow(run, schema), "leaks", kept=True))
        given.destroy()
    best = F.max(F.struct((F.col("n_common") / F.col("n_words")).alias("coverage"), "n_words", "n_common", "cosine", "answered")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_words", "best.n_common", "best.coverage", "best.cosine", "best.answered")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a leak (see ``contamination``); rows with null ids are judged by their texts too.

    The blocks of the benchmark leave their findings one after another, as digests of the texts
    that leak, so no more than one block is held at a time; a benchmark of one block is applied
    as the documents are read, without a shuffle.
    """
    defaults = {"cosine": 0.3, "copied": 0.8, "paraphrased": 0.6, "least": 6, "rank": 256, "mass": 2000, "common": 0.02, "block": 4096, "seed": 11} | options
    limits = [defaults.pop(k) for k in ("cosine", "copied", "paraphrased")]
    spark, text_at = docs.sparkSession, docs.columns.index("text")
    one = benchmark.limit(defaults["block"] + 1).count() <= defaults["block"]

    def leaking(items: Items, batch):
        import pyarrow as pa

        found = np.zeros(batch.num_rows, dtype=bool)
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text_at)], ["row", "text"])
        for at, texts in text_batches([numbered]):
            hashes, count = word_hashes(texts)
            at = at.to_numpy()
            found[[at[d] for d, *_ in leaks_in(items, hashes, count, *limits)]] = True
            found[[at[d] for d, *_ in short_leaks(items, hashes, count)]] = True
        return pa.array(found)

    key = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    out, digests = docs, []
    for items in prepared(docs, benchmark, **{k: defaults[k] for k in ("block", "least", "rank", "mass", "common", "seed")}, shares=tuple(limits[1:])):
        given = spark.sparkContext.broadcast(items)

        def run(batches, given=given):
            import pyarrow.compute as pc

            for batch in batches:
                found = leaking(given.value, batch)
                yield batch.filter(pc.invert(found) if one else found)

        if one:
            return docs.mapInArrow(run, docs.schema)
        digests.append(stored(docs.mapInArrow(run, docs.schema).select(key.alias("leak")).distinct(), "leaking-texts", kept=True))
        given.destroy()
    name = unused("text_key", docs)
    for found in digests:
        out = out.withColumn(name, key).join(found, F.col(name) == found["leak"], "left_anti").drop(name)
    return out


def op5_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per contaminated document and benchmark item found in it."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark)
