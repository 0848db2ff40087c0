"""Secret scan by patterns and sliding-window entropy, in SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import unused

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidate strings by character class: pattern, window length, least entropy in bits, what a candidate has to hold.
CLASSES = {
    "hexadecimal": (r"(?<![A-Za-z0-9+/_-])[0-9a-fA-F]{20,}(?![A-Za-z0-9+/_=-])", 20, 3.0, r"^(?=.*[0-9])(?=.*[a-fA-F])"),
    "upper": (r"(?<![A-Za-z0-9+/_-])[A-Z0-9]{20,}(?![A-Za-z0-9+/_=-])", 20, 3.5, r"^(?=.*[0-9])(?=.*[G-Z])"),
    "base64": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])", 24, 3.9, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
}
#: Candidates that are known not to be secrets. No pattern of this module repeats a group without a
#: bound: Java's matcher goes one call deeper for every repetition and overflows its stack.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]?(?:key|token|secret)",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij|1234567890",
    r"^[a-z0-9_/-]+/[A-Za-z0-9_-]{0,23}$",
    r"^(.)\1{4}|^(..)\2{4}|^(...)\3{4}|^(....)\4{4}",
)


def quoted(pattern: str) -> str:
    """``pattern`` as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value``, evaluated once, under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def matches(text: str, pattern: str, group: int = 256) -> str:
    """SQL for the leftmost non-overlapping matches as array<struct<start, stop, found>>, in code points.

    Texts without a match are scanned once; in the others the pieces between the matches give
    the places, added up in groups of ``group`` matches and then over the groups, so that no
    long array is copied at every match.
    """
    p = quoted(pattern)
    spans = "array<struct<start:int,stop:int,found:string>>"
    steps = f"""zip_with(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0),
      (g, m) -> struct(length(g) AS skip, length(m) AS size, m AS found))"""
    one_group = f"""aggregate(slice(steps, k * {group} + 1, {group}), struct(0 AS at, CAST(array() AS {spans}) AS spans),
      (s, x) -> struct(s.at + x.skip + x.size AS at,
        concat(s.spans, array(struct(s.at + x.skip AS start, s.at + x.skip + x.size AS stop, x.found AS found))) AS spans))"""
    placed = f"""aggregate(transform(sequence(0, CAST((size(steps) - 1) DIV {group} AS INT)), k -> {one_group}),
      struct(0 AS at, CAST(array() AS array<{spans}>) AS parts),
      (s, x) -> struct(s.at + x.at AS at,
        concat(s.parts, array(transform(x.spans, y -> struct(y.start + s.at AS start, y.stop + s.at AS stop, y.found AS found)))) AS parts),
      s -> flatten(s.parts))"""
    return f"IF(coalesce({text}, '') RLIKE {p}, {bound(steps, 'steps', placed)}, CAST(array() AS {spans}))"


def windows(candidate: str, width: int, least: float, piece: int = 256) -> str:
    """SQL for the joined windows of ``width`` characters with ``least`` bits of entropy, as array<struct<start, stop>>.

    With n of a window's characters equal, its entropy is log2(width) - sum(n * log2(n)) / width.
    The sum is carried along: each step adds one character to the counts and takes one from them.
    The windows are taken in pieces of ``piece`` starts, so that no list grows with the candidate.
    """
    term = "element_at(array(%s), %%s + 1)" % ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(width + 2))
    most = width * (math.log2(width) - least)
    one_piece = f"""
    aggregate(
      sequence(p * {piece} + 1, least(p * {piece} + {piece + width - 1}, size(codes))),
      struct(array_repeat(0, 128) AS counts, 0.0D AS total, CAST(array() AS array<int>) AS hits),
      (s, i) -> transform(array(struct(
          element_at(codes, i) AS a,
          IF(i > p * {piece} + {width}, element_at(codes, i - {width}), -1) AS r)),
        c -> transform(array(struct(
            transform(s.counts, (n, k) -> n + IF(k = c.a, 1, 0) - IF(k = c.r, 1, 0)) AS counts,
            IF(c.a = c.r, s.total, s.total
              + {term % "(element_at(s.counts, c.a + 1) + 1)"} - {term % "element_at(s.counts, c.a + 1)"}
              + IF(c.r < 0, 0.0D, {term % "greatest(element_at(s.counts, greatest(c.r, 0) + 1) - 1, 0)"} - {term % "element_at(s.counts, greatest(c.r, 0) + 1)"})) AS total)),
          t -> struct(t.counts AS counts, t.total AS total,
            IF(i < p * {piece} + {width} OR t.total > {most!r}D, s.hits, concat(s.hits, array(i - {width}))) AS hits))[0])[0],
      s -> s.hits)"""
    hits = f"flatten(transform(sequence(0, CAST((size(codes) - {width}) DIV {piece} AS INT)), p -> {one_piece}))"
    # windows that touch are one span: it begins after a gap and ends before one
    begins = f"filter(hits, (x, k) -> k = 0 OR x > element_at(hits, greatest(k, 1)) + {width})"
    ends = f"filter(hits, (x, k) -> k = size(hits) - 1 OR element_at(hits, least(k + 2, size(hits))) > x + {width})"
    joined = f"zip_with({begins}, {ends}, (b, e) -> struct({candidate}.start + b AS start, {candidate}.start + e + {width} AS stop))"
    # a place in a string is found by a walk from its start, one in an array at once
    codes = f"transform(slice(split({candidate}.found, ''), 1, length({candidate}.found)), x -> ascii(x))"
    return bound(codes, "codes", bound(hits, "hits", joined))


def spans_column(text: str) -> str:
    """SQL for all spans of a text: array<struct<start, rank, stop, kind>> in the order of KINDS at equal starts."""
    named = lambda k, found: f"transform({found}, x -> struct(x.start AS start, {k} AS rank, x.stop AS stop, '{KINDS[k]}' AS kind))"
    allowed = " OR ".join(f"x.found RLIKE {quoted(p)}" for p in ALLOWED)
    parts = [
        named(0, f"filter({matches(text, ASSIGN)}, x -> length(regexp_extract(x.found, {quoted(ASSIGN)}, 1)) >= 6)"),
        named(1, matches(text, ACCESS)),
        named(2, matches(text, HEX)),
    ]
    entropy = []
    for pattern, width, least, needs in CLASSES.values():
        good = f"filter({matches(text, pattern)}, x -> x.found RLIKE {quoted(needs)} AND NOT ({allowed}))"
        entropy.append(f"flatten(transform({good}, cand -> {windows('cand', width, least)}))")
    # classes can find the same span; numbers are told apart by a hash table, structs pair by pair
    numbers = f"array_distinct(transform(concat({', '.join(entropy)}), x -> CAST(x.start AS BIGINT) * 4294967296 + x.stop))"
    spans = f"transform({numbers}, v -> struct(CAST(v DIV 4294967296 AS INT) AS start, CAST(v % 4294967296 AS INT) AS stop))"
    return f"array_sort(concat({', '.join([*parts, named(3, spans)])}))"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of secrets in every whole text: doc_id, text, secrets (array of start, rank, stop, kind).

    Places are code points, the end exclusive. A null or empty text has no spans. Nothing is
    shuffled; null ids and repeated rows are kept; an empty table gives an empty result. Only the
    two columns named are read. Work is linear in the text, and no pattern or list goes deeper or
    grows faster than that, so one long candidate can't stop a task.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("secrets", F.expr(spans_column("text")))


def listed(spans: str, kinds: str) -> Column:
    return F.expr(f"array_join(transform(filter({spans}, x -> x.kind IN ({kinds})), x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced in its text, and ``n_chars`` counted anew where there is such a column.

    Overlapping spans are replaced by one mark. Texts without a span, null texts included, stay as they are, as do all other columns whatever their names.
    """
    spans = unused("spans", docs)
    merged = f"""aggregate({spans_column("text")}, CAST(array() AS array<struct<start:int,stop:int>>),
      (s, x) -> IF(size(s) > 0 AND element_at(s, -1).stop >= x.start,
        concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).start AS start, greatest(element_at(s, -1).stop, x.stop) AS stop))),
        concat(s, array(struct(x.start AS start, x.stop AS stop)))))"""
    before = f"IF(i = 0, 0, {spans}[greatest(i - 1, 0)].stop)"
    piece = f"transform({spans}, (x, i) -> substr(text, {before} + 1, x.start - {before}))"
    cut = f"array_join(concat({piece}, array(substr(text, element_at({spans}, -1).stop + 1))), {quoted(mark)})"
    out = docs.withColumn(spans, F.expr(merged))
    out = out.withColumn("text", F.expr(f"IF(size({spans}) = 0, text, {cut})")).drop(spans)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_entropy_secrets(spark, sf_dir: str) -> DataFrame:
    """Per document: numbers of spans of the base kinds, digest of the base spans, and all spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda kind: F.expr(f"CAST(size(filter(secrets, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[number(k) for k in KINDS[:3]],
        F.sha2(listed("secrets", "'assign', 'access', 'hex'").cast("binary"), 256).alias("base_sha256"),
        listed("secrets", ", ".join(f"'{k}'" for k in KINDS)).alias("spans"),
    )
