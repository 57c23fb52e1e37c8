"""Main text of HTML pages by minimum-cut labelling of blocks.

A page is read once into blocks of text: markup that never shows (scripts, styles, comments, head) is left out, block
elements end a block, inline elements don't. A small linear classifier over a block's element path, class and id
words, length and link share gives the cost of either label; the costs are capacities to the two terminals. Blocks
that follow each other, and blocks of one parent, are joined by smoothness edges that weaken with their distance in
the tree. The minimum cut, by augmenting paths, separates content from boilerplate. Blocks whose own cost exceeds
all their edges together keep their label in every minimum cut, so they are folded into their neighbours' costs and
only undecided blocks enter the flow network. Elements that are boilerplate by their kind (menus, footers, forms and the
like) or by a class word cost ten, a run of like neighbours can outweigh two to five: so hints usually win, and where a
page has none the neighbourhood decides the short and doubtful blocks.

Null and empty pages have an empty text. Character references are decoded, white space inside a block becomes one
space, blocks are joined by one newline in page order. Unclosed and stray tags are tolerated. Blocks for which both
labels cost the same count as boilerplate. Each page is read on its own, repeated rows alike; no rows give no rows, and
columns other than the id, the html and those to keep are not read.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Elements by kind.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILER = frozenset("nav footer aside form menu button select dialog head search".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that tell boilerplate or content.
BAD = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner sidebar side rail nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations popular trending comment comments commentlist disqus reply replies respond responses discussion feedback widget toolbar pagination pager copyright disclaimer legal tags taglist skip contentinfo complementary search form".split())
GOOD = frozenset("article content main post entry story text body maincontent articlebody storybody".split())
TOP = frozenset("header topbar topnav branding".split())
LAYOUT = frozenset("with has no without".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HARD, NEAR, PARENT = 10.0, 2.4, 0.8


def blocks(html: str) -> list[tuple[str, int, int, tuple[str, ...], float]]:
    """(text, characters in links, depth, element path, hint) of each block in page order."""
    out: list = []
    stack: list[tuple[str, float]] = []  # element, hint of itself and all above
    text: list[str] = []
    linked, links, hint, at, size = 0, 0, 0.0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            text.clear()
            body = " ".join((unescape(raw) if "&" in raw else raw).split())
            if body:
                out.append((body, linked, len(stack), tuple(t for t, _ in stack), hint))
        linked = 0

    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            run = html[at : m.start()]
            text.append(run)
            if links:
                linked += len(run)
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK or name in BOILER:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if name == "p" and stack[i][0] != "p":
                        break
                hint = stack[-1][1] if stack else 0.0
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if not m[3].endswith("/"):
                at = end.end() if end else size
            continue
        if name == "a":
            links += 1
        elif name in ("br", "wbr"):
            text.append(" " if name == "br" else "")
        elif name in BLOCK or name in BOILER:
            flush()
            if name in VOID:
                continue
            if stack and (stack[-1][0] == "p" or name == stack[-1][0] in ("li", "dd", "dt", "tr", "td", "th", "option")):
                stack.pop()
            links = 0
            above = stack[-1][1] if stack else 0.0
            own = own_hint(name, m[3], stack)
            stack.append((name, hint := max(-HARD, min(above + own, HARD))))
    flush()
    return out


def own_hint(name: str, attributes: str, stack: list) -> float:
    """What an element adds to its blocks' score: positive for content."""
    inside = any(t in CONTENT for t, _ in stack)
    if name in BOILER or name == "header" and not inside:
        return -HARD * 2
    out = 3.0 if name in CONTENT else 0.0
    if attributes:
        if HIDDEN.search(attributes):
            return -HARD * 2
        good = False
        for token in " ".join(NAMED.findall(attributes)).replace('"', " ").replace("'", " ").split():
            words = {w.lower() for w in WORDS.findall(token)}
            if words & LAYOUT:  # with-sidebar and the like tell how a page is laid out, not what an element is
                continue
            own = bool(words & GOOD)
            if words & BAD and not (own and name in ("body", "html", "main")) or words & TOP and not own and not inside:
                return -HARD * 2
            good |= own
        if good:
            out += 2.0
    return out


def content_score(text: str, linked: int, path: tuple[str, ...], hint: float) -> float:
    """Log odds that a block is content."""
    words = text.count(" ") + 1
    out = hint - 0.6 + min(words, 40) * 0.06 + (0.5 if text[-1] in ".!?:\"" else 0.0)
    out -= 4.0 * min(1.0, linked / len(text))
    last = path[-1] if path else ""
    if last in ("p", "blockquote", "pre"):
        out += 0.8
    if last in HEADINGS:
        out += 1.0
    if last in ("li", "td", "option"):
        out -= 0.4
    return out


def edges(found: list) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in the page, and between consecutive blocks of one parent path."""
    out, last = [], {}
    for i, (_, _, depth, path, _) in enumerate(found):
        if i:
            before = found[i - 1][3]
            shared = next((k for k, (a, b) in enumerate(zip(before, path)) if a != b), min(len(before), len(path)))
            out.append((i - 1, i, NEAR / (1 + len(before) + len(path) - 2 * shared)))
        up = path[:-1]
        if up in last and last[up] != i - 1:
            out.append((last[up], i, PARENT))
        last[up] = i
    return out


def minimum_cut(score: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for blocks on the content side of the minimum cut."""
    n = len(score)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in links:
        near[a].append((b, w))
        near[b].append((a, w))
    score, fixed, todo = list(score), [None] * n, deque(range(n))
    pull = [sum(w for _, w in e) for e in near]
    while todo:
        i = todo.popleft()
        if fixed[i] is None and abs(score[i]) > pull[i]:
            fixed[i] = score[i] > 0
            for j, w in near[i]:
                if fixed[j] is None:
                    score[j] += w if fixed[i] else -w
                    pull[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if fixed[i] is None]
    if rest:
        inside = set(rest)
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: {} for i in [*rest, source, sink]}
        for i in rest:
            a, b = (source, i) if score[i] > 0 else (i, sink)
            room[a][b] = room[a].get(b, 0) + abs(score[i])
            room[b].setdefault(a, 0.0)
            for j, w in near[i]:
                if j in inside:
                    room[i][j] = room[i].get(j, 0) + w
        while True:
            came, queue = {source: source}, deque([source])
            while queue and sink not in came:
                i = queue.popleft()
                for j, r in room[i].items():
                    if r > 1e-9 and j not in came:
                        came[j] = i
                        queue.append(j)
            if sink not in came:
                break
            path, j = [], sink
            while j != source:
                path.append((came[j], j))
                j = came[j]
            flow = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= flow
                room[b][a] = room[b].get(a, 0) + flow
        for i in rest:
            fixed[i] = i in came
    return [bool(x) for x in fixed]


def main_text(html: str) -> str:
    found = blocks(html)
    if not found:
        return ""
    keep = minimum_cut([content_score(t, k, p, h) for t, k, _, p, h in found], edges(found))
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text, n_chars) of every whole page."""
    names = [id_col, *keep]
    src = pages.select(*names, F.coalesce(F.col(html_col), F.lit("")).alias("__html"))

    def run(batches):
        for b in batches:
            got = [main_text(h) for h in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return map_arrow(src, run, f"{schema}, text string, n_chars long")
