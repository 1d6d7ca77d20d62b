"""Main text of web pages by a maximum-scoring subsequence."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import stored

#: The weights are learned from about this many labelled pages, taken by the hash of their
#: keys; a page is labelled if its markup names its content (article or main).
SAMPLE = 4_000

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var wbr".split()
)
CONTENT = frozenset("article main".split())
# Elements and class, id or role words of what is not content.
BOILERPLATE = frozenset(
    "head script style template noscript nav header footer aside form button select option textarea input iframe"
    " svg canvas object dialog menu title xmp noembed noframes".split()
)
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices alert popup modal overlay"
    " newsletter subscribe subscription share sharing social related recommended comment comments reply replies respond"
    " disqus login signup search form widget contentinfo complementary dialog".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPLIT = frozenset("p li dt dd tr td th option".split())

#: Class, id and role words are not believed where they would leave less of the words than this.
LEFT = 0.1

TOKEN = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass
class Block:
    """A run of text and the tags in front of it."""

    text: str
    words: int
    context: str
    boilerplate: bool
    content: bool
    tags: list[str] = field(default_factory=list)
    #: Those of the tags that belong to boilerplate.
    aside: list[str] = field(default_factory=list)


def marked(attributes: str) -> bool:
    """Whether class, id or role name something that is not content."""
    for value in NAMED.findall(attributes):
        if not MARKS.isdisjoint(re.split(r"[^a-z]+", value.lower())):
            return True
    return False


def believed(found: list[Block], depths: list[int]) -> int:
    """The marks around a block that say nothing: the fewest that keep a share of LEFT of the
    words of the named content, or of the page if it names none."""
    named = [(d, b.words) for b, d in zip(found, depths, strict=True) if b.content and not b.boilerplate]
    open_ = named or [(d, b.words) for b, d in zip(found, depths, strict=True) if not b.boilerplate]
    total, kept = sum(w for _, w in open_), 0
    for depth, words in sorted(open_):
        kept += words
        if kept >= LEFT * total:
            return depth
    return 0


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, the last one for the tags behind all text."""
    out: list[Block] = []
    text: list[str] = []
    tags: list[str] = []
    around: list[float] = []  # marks around each tag since the last block, itself among them
    arounds: list[list[float]] = []
    depths: list[int] = []  # marks around each block, those of article and main count half
    stack: list[tuple[str, int]] = []  # name and sum of 1: boilerplate, 2: content, 4: link, 8: marked, 16: marked content
    held = Counter()
    flags = Counter()
    place = 0

    def count(flag: int, by: int) -> None:
        for bit in (1, 2, 4, 8, 16):
            if flag & bit:
                flags[bit] += by

    def marks() -> float:
        return float("inf") if flags[1] else 2 * flags[8] + flags[16]

    def close() -> None:
        nonlocal tags, around
        whole = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if whole:
            name = next((n for n, _ in reversed(stack) if n not in INLINE), "")
            block = Block(whole, whole.count(" ") + 1, "", flags[1] > 0, flags[2] > 0, tags)
            block.context = f"{name}/{'link' if flags[4] else ''}/"
            out.append(block)
            arounds.append(around)
            depths.append(2 * flags[8] + flags[16])
            tags, around = [], []

    def pop_to(name: str) -> None:
        while stack:
            top, flag = stack.pop()
            held[top] -= 1
            count(flag, -1)
            if top == name:
                return

    end = len(page)
    while place < end:
        found = TOKEN.search(page, place)
        if not found:
            text.append(page[place:])
            break
        text.append(page[place : found.start()])
        place = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        name = name.lower()
        if name not in INLINE and name != "br":
            close()
        if name == "br":
            text.append(" ")
        elif closing:
            tags.append("/" + name)
            around.append(marks())
            if held[name] > 0:
                if name == "a" or name not in INLINE:
                    pop_to(name)
                else:  # markup that overlaps closes only itself
                    at = max(i for i, (n, _) in enumerate(stack) if n == name) if stack[-1][0] != name else -1
                    _, flag = stack.pop(at)
                    held[name] -= 1
                    count(flag, -1)
        else:
            tags.append(name)
            around.append(marks())
            if name in VOID:
                continue
            if name in RAW:
                behind = re.compile(rf"</{name}[\s/>]", re.I).search(page, place)
                place = behind.start() if behind else end
                if behind:
                    place = page.find(">", place) + 1 or end
                continue
            if name in SPLIT and held[name] > 0 and stack and stack[-1][0] in INLINE | {name}:
                above = next((n for n, _ in reversed(stack) if n not in INLINE), "")
                if above == name:  # the last one was not closed
                    pop_to(name)
            odd, unseen = marked(attributes), bool(HIDDEN.search(attributes))
            if odd:  # names of headings are often made of their words
                odd = (next((n for n, _ in reversed(stack) if n not in INLINE), "") if name in INLINE else name) not in HEADINGS
            if name in CONTENT and not unseen and all(n in ("nav", "header", "menu") for n, f in stack if f & 1):
                while flags[1]:  # a menu that was not closed
                    pop_to(stack[-1][0])
            inner_header = name == "header" and flags[2] > 0 and not unseen
            root = name in ("html", "body")
            flag = 1 if unseen and not root or name in BOILERPLATE and not inner_header else 0
            flag = flag or (2 if name in CONTENT else 4 if name == "a" else 0) + (0 if root or not odd else 16 if name in CONTENT else 8)
            stack.append((name, flag))
            held[name] += 1
            count(flag, 1)
            around[-1] = marks()
    close()
    base = believed(out, depths)
    for block, depth in zip(out, depths, strict=True):
        if block.boilerplate or depth > base:
            block.boilerplate, block.context = True, block.context + "boilerplate"
    out.append(Block("", 0, "", False, False, tags))
    for block, marked_by in zip(out, [*arounds, around], strict=True):
        block.aside = [t for t, n in zip(block.tags, marked_by, strict=True) if n > base]
    return out


def counts(page: str) -> Counter:
    """What a labelled page teaches: words by context and tags, in all and inside the content."""
    found = blocks(page)
    out: Counter = Counter()
    if not any(b.content and not b.boilerplate for b in found):
        return out
    for i, b in enumerate(found):
        inside = b.content and not b.boilerplate
        if b.words:
            out["word", b.context, "all"] += b.words
            out["word", b.context, "in"] += b.words * inside
        between = inside and i > 0 and found[i - 1].content and not found[i - 1].boilerplate
        for t in b.tags:
            if t.lstrip("/") not in CONTENT:
                out["tag", t, "all"] += 1
                out["tag", t, "in"] += between
    return out


@dataclass
class Weights:
    """Positive scores of words by context and negative scores of tags."""

    word: dict[str, float]
    tag: dict[str, float]
    cost: float

    def words(self, block: Block, labelled: bool) -> float:
        if block.boilerplate or labelled and not block.content:
            return 0.0
        usual = 0.25 if "/link/" in block.context else 0.9
        return block.words * self.word.get(block.context, usual)

    def tags(self, block: Block, labelled: bool = False) -> float:
        """Tags of what is left out in any case cost nothing."""
        if block.boilerplate or labelled and not block.content:
            return 0.0
        rest = Counter(block.tags) - Counter(block.aside) if block.aside else Counter(block.tags)
        return -self.cost * sum(n * (1.02 - self.tag.get(t, 0.5)) for t, n in rest.items())


def region(found: list[Block], weights: Weights) -> tuple[int, int]:
    """First and last block of the contiguous run with the largest score, by one scan; the
    shorter and earlier one of equals. (0, -1) if no words score."""
    labelled = any(b.content and not b.boilerplate for b in found)
    best, first, last, total, start = 0.0, 0, -1, 0.0, 0
    for i, b in enumerate(found):
        cost = weights.tags(b, labelled)
        if total + cost > 0:
            total += cost
        else:
            total, start = 0.0, i
        total += weights.words(b, labelled)
        if total > best:
            best, first, last = total, start, i
    return first, last


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best region that are not boilerplate, one to a line."""
    if not page:
        return ""
    found = blocks(page)
    first, last = region(found, weights)
    labelled = any(b.content and not b.boilerplate for b in found)
    return "\n".join(
        b.text for b in found[first : last + 1] if b.text and not b.boilerplate and (b.content or not labelled)
    )


def learn(pages: DataFrame, key: str = "page_id", page: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from labelled pages: the share of a context's words, or of a tag, inside the
    content; and how much tags cost against words, by the words that regions get right."""
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    rows = pages.select(part.alias("h"), F.col(page).alias("html"))
    total = rows.count()
    limit = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    chosen = rows.filter((F.col("h") < limit) & F.col("html").isNotNull()).select("html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: Counter = Counter()
            for t in batch["html"].to_pylist():
                out.update(counts(t))
            data = [(*k, n) for k, n in out.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in data], pa.string()) for i in range(3)] + [pa.array([x[3] for x in data], pa.int64())],
                names=["kind", "name", "place", "n"],
            )

    tallies = stored(
        chosen.mapInArrow(work, "kind string, name string, place string, n long")
        .groupBy("kind", "name")
        .agg(
            F.sum(F.when(F.col("place") == "all", F.col("n"))).alias("n"),
            F.sum(F.when(F.col("place") == "in", F.col("n"))).alias("inside"),
        ),
        "html-weights",
    )
    # a name must be common enough to be learned, which bounds the table
    rows = tallies.filter("n >= 20").orderBy(F.desc("n"), "kind", "name").limit(2_000).collect()
    share = {(r.kind, r.name): (r.inside or 0) / r.n for r in rows}
    word = {n: s for (k, n), s in share.items() if k == "word"}
    tag = {n: s for (k, n), s in share.items() if k == "tag"}

    costs = (0.5, 1.0, 2.0, 3.25, 5.0, 8.0)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[c, 0.0] for c in costs]
            for t in batch["html"].to_pylist():
                found = blocks(t)
                truth = [b.content and not b.boilerplate for b in found]
                if not any(truth):
                    continue
                for row in out:
                    # the label is not shown to the scan here
                    hidden = [Block(b.text, b.words, b.context, b.boilerplate, False, b.tags, b.aside) for b in found]
                    first, last = region(hidden, Weights(word, tag, row[0]))
                    row[1] += sum(
                        b.words * (1 if (first <= i <= last and not b.boilerplate) == truth[i] else -1)
                        for i, b in enumerate(found)
                    )
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.float64()) for i in (0, 1)], names=["c", "s"])

    scores = {r.c: r.s for r in chosen.mapInArrow(judged, "c double, s double").groupBy("c").agg(F.sum("s").alias("s")).collect()}
    cost = max(costs, key=lambda c: (scores.get(c, 0.0), -abs(c - 3.25)))
    return Weights(word, tag, cost)


def extract(
    pages: DataFrame,
    weights: Weights,
    key: str = "page_id",
    url: str = "url",
    page: str = "html",
) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``.

    Null and empty pages, and pages without words of content, have empty text. Unclosed
    elements and comments, and markup that overlaps, are read as browsers do. A page whose
    markup names its content is cut to it; any other one to its best region. Boilerplate
    inside the region (menus, adverts, forms, comments) is left out. Repeated rows give a
    row each; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t, weights) for t in batch["html"].to_pylist()]
            lengths = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(lengths, pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")


__all__ = ["SAMPLE", "Weights", "blocks", "extract", "learn", "main_text", "region"]
