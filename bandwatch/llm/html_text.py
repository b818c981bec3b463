"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks, each with its tag path from the root. Per path, characters outside links and
punctuation are summed and divided by the path's blocks; both ratios are smoothed along the page, fused into one
score, and paths below a share of the best score are dropped. Elements whose tag says so (navigation, footer, script
...) and hidden ones never take part; those that only a class, id or role says to be something else, and forms, take
part if they hold most of the page's text or its article. One pass over a page, a row for a row, no shuffle. Paths are
numbers, and open elements are found by their tag, so work and memory grow with the page, however deep it nests.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

SHARE = 0.2  # of the best path's score that a content path reaches
WEIGHTS = (0.25, 0.5, 1.0, 0.5, 0.25)  # of the blocks around, for smoothing
PUNCTUATION = frozenset(".,;:!?…·。、，！？；：—–\"'“”‘’«»()")

#: Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = RAW | frozenset("head nav footer aside noscript template svg math canvas object audio video select option button menu dialog".split())
FORMS = frozenset(("form", "fieldset"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Words of class, id and role that mark what is not the article.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer contentinfo sidebar complementary widget "
    "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription paywall "
    "comment comments commentlist reply replies respond disqus related recommended trending share sharing social search login signup form".split()
)
OUTSIDE = frozenset(("header", "masthead", "topbar"))  # unwanted unless inside the article
#: Whole classes and ids of what may be the article, and words that make the next one no role.
WANTED = frozenset("article content entry main page post story text".split())
ABOUT = frozenset("has have is no non not show hide with without".split())
LITTLE = 0.1  # of an element's text: what may be left outside it if its class plainly says that it is no article

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+|[^>]*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*\Z""", re.S)
TAIL = re.compile("<!--|<[a-zA-Z]")  # where markup begins that no > ends
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Doubt:
    """Elements alike in tag and classes that may be no part of an article; plain if nothing speaks for them."""

    tag: str
    words: str
    plain: bool


@dataclass
class Element:
    tag: str
    path: int
    holder: Element | None  # the innermost element that is not inline: itself or one around it
    skipped: bool
    main: int  # number of the innermost article or main element, 0: none
    link: bool
    doubts: tuple[Doubt, ...] = ()  # the elements around it, and itself, that may be no part of an article


@dataclass
class Block:
    """Text between block borders under one path."""

    path: int = 0
    parent: int = 0  # the path of the element around
    tag: str = ""
    main: int = 0
    doubts: tuple[Doubt, ...] = ()
    held: tuple[Doubt, ...] = ()  # those around its article or main element
    text: list[str] = field(default_factory=list)
    linked: int = 0

    def done(self) -> str:
        return " ".join("".join(self.text).split())


def _unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, Doubt | None, str]:
    """Whether the element is no part of an article, whether it may be none, and the first class for its path."""
    if tag in SKIPPED or (tag == "header" and not inside):
        return True, None, ""
    told: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        told.setdefault(name.lower(), value.strip("\"'").lower())
    words = NAME.findall(told.get("class", ""))
    first = words[0] if words else ""
    if "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in "".join(told.get("style", "").split()):
        return True, None, first
    if tag in ("html", "body"):
        return False, None, first
    tokens = [x for name in ("class", "id", "role") for x in told.get(name, "").split()]
    bad, plain = False, False
    for token in tokens:
        before = ""
        for w in NAME.findall(token):
            if w in UNWANTED or (w in OUTSIDE and not inside):
                bad, plain = True, plain or before not in ABOUT
            before = w
    if bad or tag in FORMS:
        plain = plain and not WANTED & set(tokens)
        return False, Doubt(tag, told.get("class") or told.get("id", ""), plain), first
    return False, None, first


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text and may be content, in page order."""
    out: list[Block] = []
    root = Element("", 0, None, False, 0, False)
    root.holder = root
    stack = [root]
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
    paths: dict[tuple[int, str], int] = {}  # path of a step below a path
    above = [0]  # path around each path
    block = Block()
    mains: list[tuple[Doubt, ...]] = [()]

    def flush() -> None:
        nonlocal block
        if block.text:
            out.append(block)
        block = Block()

    def say(text: str) -> None:
        top = stack[-1]
        if top.skipped or not text:
            return
        if not block.text:
            if not text.strip():
                return
            holder = top.holder
            block.path, block.main, block.tag = holder.path, holder.main, holder.tag
            block.parent = above[holder.path]
            block.doubts, block.held = top.doubts, mains[top.main]
        clear = html.unescape(text) if "&" in text else text
        block.text.append(clear)
        if top.link:
            block.linked += len(clear)

    def close(k: int) -> None:
        """Closes the elements from place k on."""
        gone = stack[k:]
        if any(e.tag not in INLINE for e in gone) or gone[-1].doubts != stack[k - 1].doubts:
            flush()
        for e in gone:
            opened[e.tag].pop()
        del stack[k:]

    def innermost(names: tuple[str, ...]) -> int:
        """Place of the innermost open element of these, 0 for none."""
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    def close_open(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        k = innermost(names)
        if k > innermost(stops):
            close(k)

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        if at > last:
            m = TAIL.search(page, at)
            say(page[at : m.start() if m else n])
            break
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if k := innermost((tag,)):
                close(k)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not block.text or tag != "wbr":
                say(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            close_open(("p", *(HEADINGS if tag in HEADINGS else ())), ("table", "td", "button", "object"))
        if tag in ENDS:
            names, stops = ENDS[tag]
            close_open(tuple(names.split()), stops)
        up = stack[-1]
        gone, doubt, first = _unwanted(tag, m[3] or "", up.main > 0)
        if tag not in INLINE or gone or doubt:
            flush()
        main, doubts = up.main, up.doubts
        if doubt and doubt not in doubts:
            doubts = (*doubts, doubt)
        if tag in MAIN and not gone:
            # an article that is plainly a comment, say, is no sign of the article
            mains.append(up.doubts if doubt and doubt.plain else doubts)
            main = len(mains) - 1
        path = up.path
        if tag not in INLINE:
            step = path, f"{tag}.{first}" if first else tag
            path = paths.setdefault(step, len(above))
            if path == len(above):
                above.append(up.path)
        if (m[3] or "").rstrip().endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        element = Element(tag, path, up.holder, up.skipped or gone, main, up.link or tag == "a", doubts)
        if tag not in INLINE:
            element.holder = element
        opened[tag].append(len(stack))
        stack.append(element)
    flush()
    return _settled(out)


def _settled(found: list[Block]) -> list[Block]:
    """The blocks without those of doubted elements, unless these hold what the page is about.

    From the outside in: elements stay if they hold most of the text outside links, most of it in paragraphs, or
    the only article; where the class plainly speaks against them, nearly no text may be left outside.
    """
    if not any(b.doubts for b in found):
        return found
    size = [max(0, len(b.done()) - b.linked) for b in found]
    kept: set[Doubt] = set()
    while True:
        text: dict[Doubt | None, int] = defaultdict(int)
        paragraphs: dict[Doubt | None, int] = defaultdict(int)
        articles: dict[Doubt | None, int] = defaultdict(int)
        gates = [next((d for d in b.doubts if d not in kept), None) for b in found]
        for b, gate, n in zip(found, gates, size, strict=True):
            text[gate] += n
            paragraphs[gate] += n * (b.tag == "p")
            articles[gate] += n * (b.main > 0 and (gate is None or gate in b.held))
        outside, every, spoken = text[None], sum(text.values()), sum(paragraphs.values())
        more = set()
        for d, n in text.items():
            if d is None:
                continue
            most = 2 * n > every and outside < LITTLE * n if d.plain else 2 * n > every or 2 * paragraphs[d] > spoken
            if most or (articles[d] > outside and not articles[None]):
                more.add(d)
        if not more:
            return [b for b, gate in zip(found, gates, strict=True) if gate is None]
        kept |= more


def select(found: list[Block]) -> list[Block]:
    """The blocks of content paths, in page order."""
    if not found:
        return []
    texts = [b.done() for b in found]
    length: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    number: dict[int, int] = defaultdict(int)
    for b, text in zip(found, texts, strict=True):
        length[b.path] += max(0, len(text) - b.linked)
        marks[b.path] += sum(map(text.count, PUNCTUATION))
        number[b.path] += 1
    ratios = [(length[b.path] / number[b.path], marks[b.path] / number[b.path]) for b in found]

    def smooth(i: int, which: int) -> float:
        half = len(WEIGHTS) // 2
        near = [(WEIGHTS[j - i + half], ratios[j][which]) for j in range(max(0, i - half), min(len(found), i + half + 1)) if found[j].main == found[i].main]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    fused: dict[int, float] = defaultdict(float)
    for i, (b, text) in enumerate(zip(found, texts, strict=True)):
        plain = max(0, len(text) - b.linked) / max(1, len(text))
        fused[b.path] += plain * math.sqrt(smooth(i, 0) * (1 + smooth(i, 1))) / number[b.path]
    limit = SHARE * max(fused.values())
    content = {p for p, x in fused.items() if x >= limit and x > 0}
    # an article element that holds a content path is content throughout; headings follow the text beside them
    weight: dict[int, float] = defaultdict(float)
    for b, text in zip(found, texts, strict=True):
        if b.path in content:
            weight[b.main] += len(text)
    best = max(weight, key=lambda m: (weight[m], -m), default=0)
    if any(m and x >= SHARE * weight[best] for m, x in weight.items()):
        chosen = {m for m, x in weight.items() if m and x >= SHARE * weight[best]}
        return [b for b in found if b.main in chosen]
    parents = {b.parent for b in found if b.path in content}
    return [b for b in found if b.path in content or (b.tag in HEADINGS and b.parent in parents)]


def extract(page: str | None) -> str:
    """The main text of a page, a line for a block; empty if there is none."""
    if not page:
        return ""
    return "\n".join(x for x in (b.done() for b in select(blocks(page))) if x)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of each page, a row for a row. Null or empty html: empty text.

    Broken markup is read as browsers do in the common cases (unclosed p, li, td, inline tags; unclosed scripts
    and comments run to the end). Repeated pages give repeated rows; very long ones are read whole.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(picked.dtypes)
    return picked.mapInArrow(by_batch(rows), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
