"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import bisect
import html as entities
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import text_batches

#: Elements whose content is never text and holds no markup.
RAW = "script|style|textarea|title|iframe"
#: Elements whose content is never text where they have an end tag; others of them are plain tags.
CLOSED = frozenset("noscript template svg select button object audio video canvas".split())
#: Those of them that a second start tag ends.
FLAT = frozenset("select button audio video canvas".split())
#: One piece of markup at a time; raw elements run to their own end tag or to the end of the page, options to the next tag.
PIECE = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*\Z)"
    r"|<option(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>[^<]*"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6 body html".split())
#: Containers of what is never the article.
BOILER_TAGS = frozenset("nav footer aside menu dialog head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog menu menubar alert form".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside footer header masthead topbar notice notices cookie cookies consent gdpr "
    "privacy popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "recommendations comment comments disqus reply replies widget toolbar pagination pager copyright legal disclaimer".split()
)
#: Words that say where a container stands or what it is made of: a name of these and of BOILER_WORDS only is that of boilerplate.
NEUTRAL_WORDS = frozenset(
    "site page main top bottom left right primary secondary global local inner outer upper lower center box block section container wrapper wrap "
    "area bar slot unit list links link button buttons item items panel row col column content text body post posts article articles user form group area js".split()
)
#: Words that turn the meaning of a name: a container "with-sidebar" is none.
TURNING_WORDS = frozenset("with without no has have had hide hides show shows less free not non".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies discussion".split())
#: How sure it is that a container is boilerplate: not at all, a form (pages are wrapped in forms), by its name, by its element or role.
PLAIN, FORM, NAMED, HARD = range(4)
#: Frequent function words of the languages served (a fixed list).
STOP_WORDS = frozenset(
    "the and of to in a is that it for with on as was be by this are from or an at not have you but they his her which "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "le la les des et de un une du en que qui dans pour pas sur au avec ce il est plus par se ne son sa "
    "el los las del y en por con para una lo su al como más pero sus le ya o este sí porque esta entre".split()
)
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in CLOSED}
STARTS = {tag: re.compile(rf"<{tag}(?=[\s/>])", re.I) for tag in FLAT}
WORD = re.compile(r"[^\W\d_]+")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def named_boilerplate(names: str) -> set[str]:
    """Words of those of the names (of classes or an id) that say boilerplate and nothing else."""
    found: set[str] = set()
    for name in names.split():
        words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())) - {""}
        if words & BOILER_WORDS and words <= BOILER_WORDS | NEUTRAL_WORDS:
            found |= words
    return found


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    links: int  # characters inside links
    level: int  # PLAIN, FORM, NAMED or HARD: the surest of the boilerplate containers around it
    article: bool  # inside <article> or <main>
    heading: bool


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in page order, tags removed, references decoded, white space joined."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, level, article
    opened: dict[str, int] = {}  # how often a tag is on the stack
    parts: list[str] = []
    state = {"links": 0, "anchor": False, "heading": False}
    level, article = PLAIN, False

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, min(state["links"], len(text)), level, article, state["heading"]))
        parts.clear()
        state["links"] = 0

    def say(text: str) -> None:
        parts.append(text)
        if state["anchor"]:
            state["links"] += len(" ".join(entities.unescape(text).split()))

    ends: dict[str, re.Match | None] = {}  # the next end tag of each element sought so far

    def content_end(tag: str, at: int) -> int | None:
        """Where the element that starts before ``at`` ends; each end tag is sought once."""
        if tag not in ends or ends[tag] and ends[tag].start() < at:
            ends[tag] = ENDS[tag].search(page, at)
        end = ends[tag]
        if end is None or tag in FLAT and STARTS[tag].search(page, at, end.start()):
            return None
        return end.end()

    at = 0
    while m := PIECE.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = bool(m["end"] or m["end2"])
        if tag in CLOSED and not closing:
            if tag == "svg" and (m["attrs"] or m["attrs2"] or "").rstrip().endswith("/"):
                continue
            if end := content_end(tag, at):
                at = end
                continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            state["anchor"] = not closing
        if tag in INLINE:
            continue
        flush()
        state["anchor"] = False
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            state["heading"] = not closing
        elif tag in LOOSE and tag not in ("body", "html"):
            state["heading"] = False
        attrs = "" if closing else m["attrs"] or m["attrs2"] or ""
        if tag in VOID or tag in LOOSE and not attrs.strip() and not (closing and opened.get(tag)):
            continue
        if closing:
            while opened.get(tag):
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            else:
                continue
        else:
            if attrs.rstrip().endswith("/") and tag not in ("div", "section", "article", "main", "p"):
                continue
            names, hard = set(), tag in BOILER_TAGS or tag == "header" and not article
            for key, value in ATTRIBUTE.findall(attrs):
                value = value.strip("\"'")
                if key.lower() == "role":
                    hard |= value.lower() in BOILER_ROLES
                else:
                    names |= named_boilerplate(value)
            if tag in LOOSE and tag not in ("body", "html") and not names and not hard:
                continue
            if tag in ("body", "html"):
                entry = (tag, PLAIN, article)
            elif tag in ("article", "main") and not names & COMMENT_WORDS and level <= FORM:
                entry = (tag, PLAIN, True)
            else:
                own = HARD if hard else NAMED if names else FORM if tag == "form" else PLAIN
                entry = (tag, max(level, own), article or tag in ("article", "main"))
            stack.append(entry)
            opened[tag] = opened.get(tag, 0) + 1
        level, article = stack[-1][1:] if stack else (PLAIN, False)
    if at < len(page):
        say(page[at:])
    flush()
    return found


def stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def labels_of(blocks: list[Block], long_block: int = 140, short_block: int = 60, density: float = 0.18, linked: float = 0.4) -> list[bool]:
    """Which blocks are main text.

    First pass: blocks in boilerplate containers and link-dense blocks are out; long blocks, and
    blocks of middle length with many stop words, are in; where the page marks its article,
    blocks outside it are out. The rest is ambiguous. Second pass: an ambiguous block takes the
    label of the nearest decided block, first among those of its own region (inside or outside
    the marked article); of two as near that differ, the one that is in. Where no block is
    decided, an ambiguous one is in if it has a stop word or is the page's only one.

    Boilerplate is what an element or role says, or a class or id that names nothing else
    ("sidebar", "cookie-notice"; not "with-sidebar" or "privacy-law-essay"). Where a page has
    no prose outside such containers, those that only a name condemns give up their articles,
    and forms what they hold: these are wrappers of the whole page.
    """

    def prose(b: Block) -> bool:
        stops = stop_share(b.text)
        return not b.heading and b.links <= linked * len(b.text) and (len(b.text) >= long_block and (b.article or stops >= density / 2) or len(b.text) >= short_block and stops >= density)

    if not any(b.level == PLAIN and (b.article or prose(b)) for b in blocks):
        if any(b.level == NAMED and b.article for b in blocks):
            blocks = [replace(b, level=PLAIN) if b.level == NAMED and b.article else b for b in blocks]
        elif any(b.level == FORM and prose(b) for b in blocks):
            blocks = [replace(b, level=PLAIN) if b.level == FORM else b for b in blocks]
    marked = any(b.article and b.level == PLAIN for b in blocks)
    decided: list[bool | None] = []
    for b in blocks:
        if b.level != PLAIN or marked and not b.article or b.links > (0.9 if b.article else linked) * len(b.text):
            decided.append(False)
        else:
            decided.append(True if prose(replace(b, links=0)) else None)
    known = [j for j, d in enumerate(decided) if d is not None]
    regions = {r: [j for j in known if blocks[j].article == r and blocks[j].level == PLAIN] for r in (False, True)}
    out: list[bool] = []
    for k, b in enumerate(blocks):
        if decided[k] is not None:
            out.append(decided[k])
            continue
        near = regions[b.article] or ([] if b.article else known)
        at = bisect.bisect(near, k)
        sides = near[max(0, at - 1) : at + 1]
        gap = min((abs(j - k) for j in sides), default=0)
        if sides:
            out.append(any(decided[j] for j in sides if abs(j - k) == gap))
        else:
            out.append(b.article or len(blocks) == 1 or stop_share(b.text) > 0)
    return out


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, keep in zip(blocks, labels_of(blocks)) if keep)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Main text of every whole page: page_id, url, text.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    reader comments are left out; references are decoded, white space inside a block becomes one
    space, blocks are joined by one space, and nothing is capped. A null or empty page, and one
    without main text, gives the empty string. Null ids and urls, repeated rows and empty tables
    pass through; other columns are not read. Each page is read once, without a shuffle.
    """

    def run(batches):
        import pyarrow as pa

        for ids, urls, texts in text_batches(batches, 2):
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array([main_text(t) for t in texts], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op2_html_blocks(spark, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in code points."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
