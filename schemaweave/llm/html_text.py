"""Main text of HTML pages by tag-path ratios.

A page is read as blocks: stretches of text between the start and end tags of
block-level elements, each with the path of such elements from the root (tag and class or id
words).  Over all pages, every path's blocks, characters, punctuation marks and link
characters are summed.  A path's ratios are characters a block and marks a block.

In a page, the paths in page order are smoothed: a path takes the ratios of its
neighbours by a Gaussian weight of their distance and by the part of the path that they
have in common, so a headline or list inside an article gains from the paragraphs around
it.  The smoothed ratios are fused, sqrt(characters x (1 + marks)), times the part of the
characters outside links.  Names are evidence as well: parts that are never main text
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) count as 0, the inside of an article or main element counts ``MAIN`` times.  Paths
whose value exceeds ``share`` standard deviations of the page's values, before that
factor, are content.

Text is whole: character references decoded, white space inside a block (a line
break element too) one space, blocks joined by one newline in page order.

Null and empty html give an empty text.  Broken markup is read as browsers do in short: an
unclosed paragraph ends where the next block starts, an unclosed comment or script
takes the rest, an end tag without start is skipped.  Every row is a page, so repeated rows
count each in the sums and are extracted each.  Extra columns are ignored; an empty table
gives no rows.  Extraction holds one page and the table of paths: up to ``max_paths``
paths are broadcast; a larger table is joined to the pages' paths instead, with equal results.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm.common import chunks, materialise, table

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?:script|style|title|textarea|xmp|iframe|noembed|noframes)\b"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: elements of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                           "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("html body table ul ol dl select div article section aside main nav header footer form blockquote td th".split())
# parts that hold no main text: elements, ARIA roles, and words of class and id
NEVER_TAGS = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select style "
                       "svg template textarea title search".split())
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NEVER_WORDS = frozenset("ad ads advert advertisement adverts advertising alert aside banner breadcrumb breadcrumbs comment comments consent "
                        "cookie cookies copyright disclaimer disqus discussion footer form gdpr login masthead menu modal nav navbar "
                        "navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies "
                        "reply responses search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser "
                        "toolbar widget".split())
HEADER_WORDS = frozenset(["header"])
MAIN_TAGS, MAIN_WORDS = frozenset(["article", "main"]), frozenset("article content entry main post story".split())
HEADLINE = -1.0
MAIN = 4.0  # factor of paths inside an article or main element
WHOLE = frozenset(["html", "body", "article", "main"])  # their class words describe the page, not a part
MARKS = frozenset(".,;:!?…、。，；：！？¿¡")


class Block:
    """A stretch of text with its path."""

    __slots__ = ("path", "weight", "text", "links")

    def __init__(self, path: str, weight: float, text: str, links: int):
        self.path, self.weight, self.text, self.links = path, weight, text, links


def _element(tag: str, attrs: str, weight: float) -> tuple[str, float]:
    """Path step and weight of an element inside one of ``weight``: 0 never, 1 plain, ``MAIN`` inside the main
    part, ``HEADLINE`` inside the main part's header, of which only headings are content."""
    words: set[str] = set()
    never = tag in NEVER_TAGS
    step = tag
    if attrs and not attrs.isspace():
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id"):
                words.update(w.lower() for w in _NAME.findall(html.unescape(value)))
            elif name == "role":
                never = never or value.strip().lower() in NEVER_ROLES
                if value.strip().lower() == "main":
                    words.add("main")
            elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
                never = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                never = True
        if words:
            step += "." + ".".join(sorted(words))
    if tag not in WHOLE:
        never = never or bool(words & NEVER_WORDS)
    if never or not weight:
        return step, 0.0
    if weight == HEADLINE:
        return step, MAIN if re.fullmatch("h[1-6]", tag) else HEADLINE
    if tag == "header" or tag not in WHOLE and words & HEADER_WORDS and not words & MAIN_WORDS:
        return step, HEADLINE if weight == MAIN else 0.0
    main = tag in MAIN_TAGS or tag not in ("html", "body") and bool(words & MAIN_WORDS)
    return step, MAIN if main else weight


def blocks(source: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str, float]] = [("", "", 1.0)]  # tag, path, weight
    parts: list[str] = []
    linked = 0  # characters of link text in ``parts``
    depth = 0  # open links

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, path, weight = next(e for e in reversed(stack) if e[0] not in INLINE)
                out.append(Block(path, max(0.0, min(weight, stack[-1][2])), text, min(linked, len(text))))
            parts.clear()
            linked = 0

    def pop(at: int) -> None:
        nonlocal depth
        if any(e[0] not in INLINE for e in stack[at:]) or any(e[2] != stack[at - 1][2] for e in stack[at:]):
            close()
        depth -= sum(e[0] == "a" for e in stack[at:])
        del stack[at:]

    def text(s: str) -> None:
        nonlocal linked
        if s:
            s = html.unescape(s)
            parts.append(s)
            if depth:
                linked += len(s.strip())

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            found = re.match(r"<([a-zA-Z]+)", m[0])
            if found and not m[0].startswith("<!"):  # raw text up to its end tag, or the end
                close()
                end = re.compile(rf"</{found[1]}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else n
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i][0] in SCOPES:
                    break
            else:
                if tag == "p":  # ends an empty paragraph of its own
                    close()
            continue
        if tag in ENDS_PARAGRAPH or tag in SIBLINGS:
            stop = ("p",) if tag in ENDS_PARAGRAPH else SIBLINGS[tag]
            cut = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stop:
                    cut = i
                elif stack[i][0] in SCOPES or stack[i][0] == "button":
                    break
            if cut is not None:
                pop(cut)
        if tag in VOID:
            if tag == "hr":
                close()
            elif tag == "br":
                parts.append(" ")
            continue
        _, path, weight = stack[-1]
        step, own = _element(tag, m["attrs"], weight)
        if tag in INLINE:
            if own != weight:
                close()
            stack.append((tag, path, own))
            depth += tag == "a"
        else:
            close()
            if not m["attrs"].rstrip().endswith("/") or path.find("svg") < 0:
                stack.append((tag, f"{path}/{step}" if path else step, own))
    close()
    return out


def path_sums(pages: list[Block]) -> dict[str, list[int]]:
    """path -> blocks, characters, punctuation marks, link characters; parts of no weight are left out."""
    sums: dict[str, list[int]] = {}
    for b in pages:
        if b.weight:
            own = sums.setdefault(b.path, [0, 0, 0, 0])
            own[0] += 1
            own[1] += len(b.text)
            own[2] += sum(map(b.text.count, MARKS))
            own[3] += b.links
    return sums


def likeness(a: list[str], b: list[str]) -> float:
    """Sixth power of the part of the longer path that both have in common from the root."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return (same / max(len(a), len(b))) ** 6


def content(page: list[Block], ratios, share: float, radius: int) -> list[Block]:
    """The content blocks of a page; ``ratios`` maps a path to its sums over all pages."""
    never = {b.path for b in page if not b.weight}
    page = [b for b in page if b.weight]
    order: list[str] = []  # paths in page order, a run of equal ones once
    weight: dict[str, float] = {}
    for b in page:
        if not order or order[-1] != b.path:
            order.append(b.path)
        weight[b.path] = max(weight.get(b.path, 0.0), b.weight)
    steps = {p: p.split("/") for p in weight}
    raw = {p: (ratios[p][1] / ratios[p][0], ratios[p][2] / ratios[p][0]) for p in weight}
    near = [math.exp(-0.5 * (2 * d / radius) ** 2) for d in range(radius + 1)]
    total: dict[str, list[float]] = {p: [0.0, 0.0, 0.0] for p in weight}
    for i, p in enumerate(order):
        own = total[p]
        for j in range(max(0, i - radius), min(len(order), i + radius + 1)):
            w = near[abs(i - j)] * likeness(steps[p], steps[order[j]])
            chars, marks = raw[order[j]]
            own[0] += w * chars
            own[1] += w * marks
            own[2] += w
    value = {}
    for p, (chars, marks, w) in total.items():
        value[p] = (1 - ratios[p][3] / max(1, ratios[p][1])) * math.sqrt(chars / w * (1 + marks / w))
    n = max(1, len(value) + len(never - set(value)))
    mean = sum(value.values()) / n
    sigma = math.sqrt(max(0.0, sum(v * v for v in value.values()) / n - mean * mean))
    return [b for b in page if weight[b.path] * value[b.path] > share * sigma]


def _joined(found: list[Block]) -> str:
    return "\n".join(b.text for b in found)


def path_table(pages: DataFrame, held: int = 50_000) -> DataFrame:
    """path, n, chars, marks, links over all pages (column html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            cols = [pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *cols], names=["path", "n", "chars", "marks", "links"])

        for _, texts in chunks(batches, "html"):
            for t in texts:
                for path, own in path_sums(blocks(t)).items():
                    got = sums.setdefault(path, [0, 0, 0, 0])
                    for i in range(4):
                        got[i] += own[i]
                if len(sums) > held:
                    yield out()
                    sums = {}
        yield out()

    parts = pages.select("html").mapInArrow(run, "path string, n long, chars long, marks long, links long")
    return parts.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "marks", "links")])


def extract(pages: DataFrame, share: float = 0.5, radius: int = 3, max_paths: int = 50_000) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    paths = materialise(path_table(rows), "html-paths")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"page_id {types['page_id']}, url {types['url']}, text string"

    def result(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    few = paths.limit(max_paths + 1).collect()
    if len(few) <= max_paths:
        known = rows.sparkSession.sparkContext.broadcast({r["path"]: (r["n"], r["chars"], r["marks"], r["links"]) for r in few})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, sources in chunks(batches, "html"):
                yield result(batch, [_joined(content(blocks(s), known.value, share, radius)) for s in sources])

        out = rows.mapInArrow(run, schema)
    else:
        keyed = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "html-pages")

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, sources in chunks(batches, "html"):
                at, names = [], []
                for row, s in zip(batch.column("row").to_pylist(), sources):
                    own = list(dict.fromkeys(b.path for b in blocks(s) if b.weight))
                    at += [row] * len(own)
                    names += own
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(names, pa.string())], names=["row", "path"])

        sums = F.struct("path", "n", "chars", "marks", "links")
        own = (keyed.select("row", "html").mapInArrow(listed, "row long, path string").join(paths, "path")
               .groupBy("row").agg(F.collect_list(sums).alias("known")))  # one page's paths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, sources in chunks(batches, "html"):
                known = [{r["path"]: (r["n"], r["chars"], r["marks"], r["links"]) for r in k or ()}
                         for k in batch.column("known").to_pylist()]
                yield result(batch, [_joined(content(blocks(s), k, share, radius)) for s, k in zip(sources, known)])

        out = keyed.join(own, "row", "left").mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
