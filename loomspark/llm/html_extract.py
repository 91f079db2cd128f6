"""Main-text extraction from HTML by minimum-cut labelling of text blocks."""

from __future__ import annotations

import html as html_refs
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import chunks, pack_columns, small_batches

_RAW = "script|style|noscript|template|svg|iframe|canvas|object|textarea|select|title|math"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-z][^>]*+(?:>|\Z)",
    re.I | re.S,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Groups of elements that end one another: opening one of `by` ends the nearest open one of `ends`, unless one of `scope` was opened in between.
ENDS = (
    ("by block tags", {"p"}, {"td", "th", "button"}),
    ({"li"}, {"li"}, {"ul", "ol", "menu", "dir"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"tr"}, {"tr"}, {"table"}),
    ({"td", "th"}, {"td", "th"}, {"table", "tr"}),
    ({"option"}, {"option"}, set()),
)
BOILER_TAGS = frozenset("nav aside footer form menu dialog button search".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu menubar topbar sidebar sidebars side rail aside footer ad ads adslot adsbygoogle advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert newsletter"
    " subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion share sharing social related recommended breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar copyright legal disclaimer masthead skip".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CONTENT_WORDS = frozenset("article post entry story content main body text".split())

#: Names of containers that hold the main text where a page has no article element.
MAIN_WORDS = frozenset("article content entry main post story".split())

#: The block classifier: log-odds of being content, as weights of a block's features.
BIAS = 0.5
LENGTH, SHORT, LONG = 0.9, -2.0, 2.5  # times ln(characters / 40), held between SHORT and LONG
LINKS, LINKS_INSIDE = -4.0, -1.0  # times the share of characters in links; articles have links, too
SENTENCE, PARAGRAPH, HEADING = 0.6, 0.6, 1.0  # ends as a sentence does; kind of its element
OUTSIDE = -3.5  # beside the page's article or main container, where it has one
BOILERPLATE = -5.0  # under an element whose kind, role or name says so
#: Log-odds beyond this are no surer: a terminal stays weaker than the edges of a block amid others.
SUREST = 3.0
#: Smoothness between neighbours in page order (less by each step apart in the tree), across the border of an article or of boilerplate, and between blocks of one parent.
ADJACENT, BORDER, SIBLING = 2.6, 0.05, 0.8


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    tag: str
    parent: int
    depth: int
    article: bool
    main: bool
    hinted: bool


@dataclass(slots=True)
class _Open:
    """An open element, with what it takes over from those around it, so that nothing is searched for in the stack."""

    tag: str
    number: int
    article: bool
    main: bool
    hinted: bool
    link: bool
    holder: str  # tag of the nearest block-level element, itself included
    parent: int  # number of the element around that one
    ends: tuple[int, ...]  # stack index of the element that each group of ENDS would end, or 0


def _holds_main(tag: str, attrs: str) -> bool:
    if tag == "main":
        return True
    for name, *values in _ATTR.findall(attrs):
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", "".join(values)).lower()))
        if words & MAIN_WORDS and tag in ("div", "section", "td") and name.lower() != "role" or name.lower() == "role" and words & {"main", "article"}:
            return True
    return False


def _hinted(tag: str, attrs: str, within_article: bool) -> bool:
    if tag in BOILER_TAGS or tag == "header" and not within_article:
        return True
    for name, *values in _ATTR.findall(attrs):
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", "".join(values)).lower()))
        if name.lower() == "role":
            if words & BOILER_ROLES:
                return True
        elif tag not in ("html", "body", "main", "article") or words & {"comment", "comments"}:
            if words & BOILER_WORDS or "header" in words and not within_article and not words & CONTENT_WORDS:
                return True
    return False


def blocks(page: str) -> list[Block]:
    """Text between block-level tags, in page order, character references decoded and white space folded; in linear time."""
    none = (0,) * len(ENDS)
    stack, opened = [_Open("", 0, False, False, False, False, "", 0, none)], Counter()
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    number = at = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html_refs.unescape("".join(t for t, _ in parts)).split())
            if text:
                links = sum(len(t.strip()) for t, link in parts if link)
                top = stack[-1]
                out.append(Block(text, min(links, len(text)), top.holder, top.parent, len(stack), top.article, top.main, top.hinted))
            parts = []

    def close_to(index: int) -> None:
        for x in stack[index:]:
            opened[x.tag] -= 1
        del stack[index:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], stack[-1].link))
        at = m.end()
        if m["raw"]:
            parts.append((" ", False))
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            parts.append((" ", False))
            continue
        is_block = tag in BLOCK_TAGS
        if is_block:
            flush()
        if m["end"]:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:  # what is passed is closed
                    i -= 1
                close_to(i)
            continue
        for group, (by, _, _) in enumerate(ENDS):
            if (is_block if group == 0 else tag in by) and stack[-1].ends[group]:
                close_to(stack[-1].ends[group])
        if tag in VOID_TAGS:
            continue
        up = stack[-1]
        number += 1
        article = up.article or tag == "article"
        hinted = up.hinted or _hinted(tag, m["attrs"], up.article)
        main = up.main or not hinted and _holds_main(tag, m["attrs"])
        ends = up.ends
        if any(tag in ended or tag in scope for _, ended, scope in ENDS):
            ends = tuple(len(stack) if tag in ended else 0 if tag in scope else old for old, (_, ended, scope) in zip(ends, ENDS))
        holder, parent = (tag, up.number) if is_block else (up.holder, up.parent)
        stack.append(_Open(tag, number, article, main, hinted, up.link or tag == "a", holder, parent, ends))
        opened[tag] += 1
    if at < len(page):
        parts.append((page[at:], stack[-1].link))
    flush()
    return out


def evidence(block: Block, has_article: bool, has_main: bool) -> float:
    """The classifier behind the terminal capacities: positive for content, negative for boilerplate, SUREST at most either way."""
    n, marked = len(block.text), has_article or has_main
    inside = block.article if has_article else block.main
    score = BIAS + LENGTH * min(max(math.log(n / 40), SHORT), LONG) + (LINKS_INSIDE if marked and inside else LINKS) * block.link_chars / n
    score += SENTENCE * (block.text[-1] in ".!?…。\"”")
    score += PARAGRAPH if block.tag in ("p", "pre", "blockquote", "li") else HEADING if block.tag in ("h1", "h2", "h3") else 0.0
    score += OUTSIDE * (marked and not inside)
    score += BOILERPLATE * block.hinted
    return min(max(score, -SUREST), SUREST)


def min_cut(terminal: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: source side) of a minimum cut: terminal[i] > 0 ties i to the source, < 0 to the sink.

    Nodes whose terminal capacity exceeds all their edges keep its label in every minimum cut; they are
    settled first and turn into terminal capacity of their neighbours. Augmenting flows settle the rest.
    """
    n = len(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    force, weight, label = list(terminal), [sum(x.values()) for x in near], [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(force[i]) > weight[i] + 1e-9 or label[i] is None and not near[i]:
            label[i] = force[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    force[j] += w if label[i] else -w
                    weight[j] -= w
                    del near[j][i]
                    queue.append(j)
    seen = [x is not None for x in label]
    for i in range(n):  # what the settled nodes have parted is cut on its own
        if not seen[i]:
            seen[i], part = True, [i]
            for j in part:
                for k in near[j]:
                    if not seen[k]:
                        seen[k] = True
                        part.append(k)
            for j, content in zip(part, _source_side(part, force, near)):
                label[j] = content
    return label


def _source_side(rest: list[int], force: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Of nodes connected by edges: whether the source still reaches each after a maximum flow (Dinic's)."""
    number = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    room: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for i in rest:
        k = number[i]
        room[source][k], room[k][source] = max(force[i], 0.0), 0.0
        room[k][sink], room[sink][k] = max(-force[i], 0.0), 0.0
        for j, w in near[i].items():
            if j in number:
                room[k][number[j]] = w
    while True:
        level = {source: 0}
        wave = deque([source])
        while wave:
            u = wave.popleft()
            for v, c in room[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    wave.append(v)
        if sink not in level:
            break
        left = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:  # a blocking flow along the levels
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                cut = next(i for i, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= 1e-9)
                del path[cut + 1 :]
                left.update({x: iter(list(room[x])) for x in path[-1:]})
                continue
            for v in left[u]:
                if room[u][v] > 1e-9 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                level[u] = -1
    # the search above marks dead ends with -1; what the source still reaches is found anew
    reached, wave = {source}, deque([source])
    while wave:
        u = wave.popleft()
        for v, c in room[u].items():
            if c > 1e-9 and v not in reached:
                reached.add(v)
                wave.append(v)
    return [number[i] in reached for i in rest]


def graph(found: list[Block]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Terminal capacities of the blocks and the edges between them."""
    has_article = any(b.article and not b.hinted for b in found)
    has_main = any(b.main and not b.hinted for b in found)
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            before = found[i - 1]
            apart = abs(b.depth - before.depth) + (b.parent != before.parent)
            edges[i - 1, i] = BORDER if b.hinted != before.hinted or b.article != before.article else ADJACENT / (1 + apart / 4)
        if b.parent in last and b.hinted == found[last[b.parent]].hinted:
            pair = (last[b.parent], i)
            edges[pair] = edges.get(pair, 0.0) + SIBLING
        last[b.parent] = i
    return [evidence(b, has_article, has_main) for b in found], edges


def extract(page: str | None) -> str:
    """The page's main text, one line a block."""
    found = blocks(page or "")
    return "\n".join(b.text for b, content in zip(found, min_cut(*graph(found))) if content)


def extract_pages(pages: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """Adds the main text of every page.

    The whole page is read, however long. Null or empty html, and pages without content, give an empty
    string. Each row stands alone, so repeated rows give equal results; an empty table gives no rows.
    Other columns pass through.
    """
    pages, unpack = pack_columns(small_batches(pages), html_col)
    names = pages.columns
    source = pages.select("*", F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    schema = pages.select("*", F.lit("").alias("__main")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__html"):
            made = pa.array([extract(x) for x in batch.column(len(names)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], made], names=[*names, "__main"])

    return unpack(source.mapInArrow(run, schema).withColumnRenamed("__main", out))


def op4_min_cut_extraction(spark, sf_dir: str) -> DataFrame:
    pages = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
