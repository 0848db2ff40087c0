"""Toxicity scores by a convolutional text classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import SpanHasher, text_batches, word_spans

#: Hash space of features, embedding size, filter widths, filters of each width, byte prefixes that are features beside the word.
SPACE_BITS, DIM, WIDTHS, FILTERS, PREFIXES = 22, 8, (1, 2, 3), 8, (4, 5, 6)
FEATURES = 1 + len(PREFIXES)
LEAST_THRESHOLD = 0.3


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word's features, row by word; number of words of each text).

    Words are runs of letters and digits of the lower-cased text; a bucket of -1 marks a prefix as long as the word.
    """
    raw, starts, ends, count = word_spans(texts)
    hasher = SpanHasher(raw)
    out = np.empty((len(starts), FEATURES), dtype=np.int32)
    shift = np.uint64(64 - SPACE_BITS)
    out[:, 0] = (hasher(starts, ends) >> shift).astype(np.int32)
    for k, n in enumerate(PREFIXES, 1):
        found = ((hasher(starts, np.minimum(ends, starts + n)) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> shift).astype(np.int32)
        out[:, k] = np.where(ends - starts > n, found, -1)
    return out, count


@dataclass
class Model:
    """Weights; ``buckets`` are those with an embedding, in ascending order, row 0 of ``table`` being zero."""

    buckets: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    slope: float = 1.0  # calibration of the logit
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.index = None

    def rows(self, found: np.ndarray) -> np.ndarray:
        if self.index is None:
            self.index = np.zeros((1 << SPACE_BITS) + 1, dtype=np.int32)
            self.index[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return self.index[found]  # -1 is the last entry, which stays 0

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def layout(self, count: np.ndarray) -> tuple[np.ndarray, int]:
        """Places of the texts' first words when each text is followed by a gap as wide as the widest filter."""
        at = np.cumsum(count + max(WIDTHS)) - count - max(WIDTHS)
        return at, int((count + max(WIDTHS)).sum())

    def embed(self, rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, size = self.layout(count)
        x = np.zeros((size + max(WIDTHS), DIM), dtype=np.float32)
        place = np.arange(len(rows)) + np.repeat(at - (np.cumsum(count) - count), count)
        known = np.flatnonzero(rows.any(axis=1))
        x[place[known]] = self.table[rows[known]].sum(axis=1)
        return x, at

    def maps(self, x: np.ndarray):
        for w, bank, shift in zip(WIDTHS, self.filters, self.shifts):
            n = len(x) - max(WIDTHS)
            z = x[:n] @ bank[0]
            for k in range(1, w):
                z += x[k : n + k] @ bank[k]
            yield z + shift

    def logits(self, rows: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(count):
            return np.zeros(0)
        x, at = self.embed(rows, count)
        # windows that start at a text's words or at the first row of its gap: none reaches the next text
        spans = np.stack([at, at + count + 1], axis=1).ravel()
        pooled = np.concatenate([np.maximum.reduceat(z, spans, axis=0)[::2] for z in self.maps(x)], axis=1)
        return np.maximum(pooled, 0) @ self.out + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        found, count = features(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(self.rows(found), count) + self.offset, -30, 30)))


def initial(docs: list[np.ndarray], labels: np.ndarray, most: int, seed: int) -> Model:
    """Embeddings for buckets of five documents or more, at most ``most``; the first component starts as the label's log odds given the bucket, shrunk to 0 where it is uncertain."""
    rng = np.random.Generator(np.random.PCG64(seed))
    seen = np.zeros((2, 1 << SPACE_BITS), dtype=np.int32)
    for found, y in zip(docs, labels):
        u = np.unique(found)
        seen[y, u[u >= 0]] += 1
    total = seen.sum(axis=0)
    chosen = np.flatnonzero(total >= 5)
    chosen = np.sort(chosen[np.argsort(-total[chosen], kind="stable")[:most]])
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    a, b = seen[1, chosen] + 0.5, seen[0, chosen] + 0.5 * n0 / n1
    odds = np.log(a / n1) - np.log(b / n0)
    error = np.sqrt(1 / a + 1 / b)
    odds = np.sign(odds) * np.maximum(0, np.abs(odds) - 3 * error)
    table = np.zeros((len(chosen) + 1, DIM), dtype=np.float32)
    table[1:] = rng.normal(0, 0.05, (len(chosen), DIM)) * (np.abs(odds) > 0)[:, None]
    table[1:, 0] = odds / 2
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for bank in filters:
        bank[:, 0, : FILTERS // 2] += 1 / len(bank)
    out = np.full(len(WIDTHS) * FILTERS, 0.2)
    return Model(chosen, table, filters, [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], out, -2.0)


def train(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, langs: list[str], epochs: int = 3, rate: float = 0.02, most: int = 1 << 17, seed: int = 7) -> Model:
    """Fit on nine tenths of the rows; calibrate logits and thresholds on the rest. Empties ``docs``.

    weights: how many rows of the whole each row stands for. A language's threshold is the score
    that gives the best F1 there; languages with fewer than 12 rows of either label use "".
    """
    n = len(docs)
    held = np.arange(n) % 10 == 9
    fit = np.flatnonzero(~held)
    model = initial([docs[i] for i in fit], labels[fit], most, seed)
    rows = [model.rows(d) for d in docs]
    docs.clear()  # the rows stand for them from here on
    sizes = np.array([len(r) for r in rows])
    rng = np.random.Generator(np.random.PCG64(seed))
    squares = {"table": np.full(len(model.table), 1e-3), "out": np.full_like(model.out, 1e-3), "filters": [np.full_like(b, 1e-3) for b in model.filters]}
    for _ in range(epochs):
        order = rng.permutation(fit)
        for s in range(0, len(order), 32):
            part = order[s : s + 32]
            count = sizes[part]
            joined = np.concatenate([rows[i] for i in part])
            first = np.cumsum(count) - count
            x, at = model.embed(joined, count)
            tops, values = [], []
            for z in model.maps(x):
                top = np.array([z[a : a + n + 1].argmax(axis=0) + a for a, n in zip(at, count)])
                tops.append(top)
                values.append(np.take_along_axis(z, top, axis=0))
            pooled = np.concatenate(values, axis=1)
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.bias, -30, 30)))
            delta = (p - labels[part]) / len(part)
            d_pooled = delta[:, None] * model.out[None, :] * (pooled > 0)
            d_out = active.T @ delta
            squares["out"] += d_out**2
            model.out -= rate * d_out / np.sqrt(squares["out"])
            model.bias -= rate * delta.sum()
            words, grads = [], []
            for j, (w, bank) in enumerate(zip(WIDTHS, model.filters)):
                d = d_pooled[:, j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
                change = np.zeros_like(bank)
                for k in range(w):
                    place = tops[j] + k
                    change[k] = np.einsum("dfe,df->ef", x[place], d)
                    local = place - at[:, None]
                    valid = (local < count[:, None]) & (d != 0)
                    words.append((local + first[:, None])[valid])
                    grads.append((d[:, :, None] * bank[k].T[None])[valid])
                squares["filters"][j] += change**2
                model.filters[j] = bank - (rate * change / np.sqrt(squares["filters"][j])).astype(np.float32)
                model.shifts[j] = model.shifts[j] - rate * d.sum(axis=0)
            words, grads = np.concatenate(words), np.concatenate(grads)
            if len(words):
                touched = joined[words]
                flat, grad = touched.ravel(), np.repeat(grads, FEATURES, axis=0)
                keep = flat > 0
                unique, inverse = np.unique(flat[keep], return_inverse=True)
                total = np.zeros((len(unique), DIM), dtype=np.float32)
                np.add.at(total, inverse, grad[keep])
                squares["table"][unique] += (total**2).mean(axis=1)
                model.table[unique] -= (rate * total / np.sqrt(squares["table"][unique])[:, None]).astype(np.float32)
    rest = np.flatnonzero(held)
    if not len(rest) or len(set(labels[rest].tolist())) < 2:
        rest = np.arange(n)
    logit = np.concatenate([model.logits(np.concatenate([rows[i] for i in rest[s : s + 200]]), sizes[rest[s : s + 200]]) for s in range(0, len(rest), 200)])
    y, share = labels[rest], weights[rest] / weights[rest].sum()
    for _ in range(200):  # Newton steps of a ridge regression of the label on the logit
        p = 1 / (1 + np.exp(-np.clip(model.slope * logit + model.offset, -30, 30)))
        g = np.array([(share * (p - y) * logit).sum() + 1e-3 * (model.slope - 1), (share * (p - y)).sum()])
        v = share * p * (1 - p)
        h = np.array([[(v * logit**2).sum() + 1e-3, (v * logit).sum()], [(v * logit).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1, 1 / max(1e-9, np.abs(step).max()))
        model.slope, model.offset = max(0.05, model.slope - step[0]), model.offset - step[1]
    score = 1 / (1 + np.exp(-np.clip(model.slope * logit + model.offset, -30, 30)))
    model.thresholds = {"": best_threshold(score, y, share)}
    spoken = np.array([langs[i] or "" for i in rest])
    for lang in set(spoken.tolist()) - {""}:
        own = spoken == lang
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= 12:
            model.thresholds[lang] = best_threshold(score[own], y[own], share[own])
    model.index = None
    return model


def best_threshold(score: np.ndarray, y: np.ndarray, share: np.ndarray) -> float:
    """The score between the last row above and the first below the cut with the best weighted F1, LEAST_THRESHOLD at least: no clean document goes for want of labels."""
    order = np.argsort(-score, kind="stable")
    s, t, w = score[order], y[order], share[order]
    hit, out = np.cumsum(w * (t == 1)), np.cumsum(w)
    f1 = np.where(np.append(s[:-1] != s[1:], True), 2 * hit / (out + (w * (t == 1)).sum()), -1)
    k = int(np.argmax(f1))
    return max(LEAST_THRESHOLD, float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2000, clean_rows: int = 2500, most_words: int = 20000) -> Model | None:
    """A model from at most ``toxic_rows`` and ``clean_rows`` labelled documents, the first by a hash of doc_id.

    Of these, documents of more than ``most_words`` words are not learnt from, so the driver holds
    at most their number times ``most_words`` times 16 bytes, whatever the texts. Rows whose
    crc32(doc_id) mod 4 is 2 are never used. Null labels, ids and texts are left out. None without
    a row of each label.
    """
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~is_held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    numbers = dict(usable.groupBy("toxic").count().collect())
    first = lambda y, n: usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("labelled"), "labelled").limit(n)
    chosen = F.broadcast(first(1, toxic_rows).union(first(0, clean_rows)))  # at most toxic_rows + clean_rows short rows
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    rows = rows.join(chosen, F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "lang", "toxic")

    def run(batches):
        import pyarrow as pa

        for ids, texts, langs, toxic in text_batches(batches):
            found, count = features(texts)
            at = np.concatenate([[0], np.cumsum(count)])
            blobs = [found[a:b].tobytes() for a, b in zip(at, at[1:])]
            usable = pa.array(count <= most_words)
            yield pa.RecordBatch.from_arrays([ids, langs, toxic, pa.array(blobs, pa.binary())], ["doc_id", "lang", "toxic", "features"]).filter(usable)

    sample = rows.mapInArrow(run, "doc_id long, lang string, toxic int, features binary").toArrow()
    ids, y = sample.column("doc_id").to_numpy(), sample.column("toxic").to_numpy().astype(np.int64)
    langs, data = sample.column("lang").to_pylist(), sample.column("features").cast("large_binary").combine_chunks()
    if not (y == 0).any() or not (y == 1).any():
        return None
    at = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
    found = [np.frombuffer(data.buffers()[2], dtype=np.int32, count=(b - a) // 4, offset=a).reshape(-1, FEATURES) for a, b in zip(at.tolist(), at[1:].tolist())]
    order = sorted(range(len(ids)), key=lambda i: (int(ids[i]) * 0x9E3779B97F4A7C15 % (1 << 64), len(found[i])))
    y, found = y[order], [found[i] for i in order]
    del sample, data
    weights = np.array([numbers.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])[y]
    return train(found, y, weights, [langs[i] for i in order])


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row of ``docs`` by (doc_id, lang, score, threshold, toxic): the score of the whole text and the decision at its language's threshold.

    Only the text is an input of the score; empty and null texts have the score of a text without
    words. Without a model every score is 0. Repeated rows and null ids are kept; no shuffle.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    given = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**17 rows of 8 floats

    def run(batches):
        import pyarrow as pa

        model = given.value
        limits = model.thresholds if model else {"": 1.0}
        for ids, texts, langs in text_batches(batches):
            score = model.score(texts) if model else np.zeros(len(texts))
            limit = np.array([limits.get(x or "", limits[""]) for x in langs.to_pylist()])
            yield pa.RecordBatch.from_arrays([ids, langs, pa.array(score), pa.array(limit), pa.array(score >= limit)], ["doc_id", "lang", "score", "threshold", "toxic"])

    return rows.mapInArrow(run, "doc_id long, lang string, score double, threshold double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold of their language. Columns and order of columns stay; no shuffle."""
    schema, names = docs.schema, docs.columns
    given = docs.sparkSession.sparkContext.broadcast(model)
    text_at = names.index("text")
    lang_at = names.index("lang") if "lang" in names else None

    def run(batches):
        import pyarrow as pa

        model = given.value
        for batch in batches:
            if model is None:
                yield batch
                continue
            keep = []
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text_at)], ["row", "text"])
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * batch.num_rows
            for rows, texts in text_batches([numbered]):
                score = model.score(texts)
                keep += [s < model.thresholds.get(langs[r] or "", model.thresholds[""]) for r, s in zip(rows.to_pylist(), score)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op10_cnn_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: whether its label was held out, its score, and whether that reaches 0.3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity(docs, model)
    return out.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
