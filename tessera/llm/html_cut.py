"""Main text of web pages by minimum cuts.

A page is cut into blocks of text at its block elements. A naive Bayes classifier over each block's text and place gives
the log odds that it is content; they are the capacities between the block and the two terminals. Neighbouring blocks,
and blocks that are near in the element tree (next of one parent, next of one grandparent), are joined by edges, the
stronger the nearer they are. The minimum cut between the terminals is the labelling of least cost; of several, that
with the fewest content blocks. Blocks whose own evidence outweighs all their edges are settled first, which leaves the
cut unchanged and most pages nothing to flow.

The classifier is trained on a sample of about ``SAMPLE`` pages, on blocks whose role their markup tells: in an article or
main element, or in a navigation, footer, aside or form, or one whose class or id says so. Where markup tells a block's
role, ``ROLE`` is added to its log odds.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE, ROLE, SHARPNESS, SCALE = 4000, 2.0, 0.5, 1000
#: Strength of edges, as log odds: to the next block by nearness in the tree, to the next of a parent, of a grandparent.
NEXT, SIBLING, COUSIN = (1.0, 0.6, 0.25), 0.5, 0.25

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: The rest of a tag up to its >, which a quoted value may hold; no step is ever taken back.
_REST = re.compile(r"""((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>""")
#: Elements whose content isn't text; those of SHUT are that also where nothing closes them.
_MUTE = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in "script style noscript template title svg iframe textarea".split()}
_SHUT = frozenset(("script", "style"))
_NAMED = re.compile(r"""\b(?:class|id)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
_HINT = re.compile(r"(?<![a-z])(?:ads?|advert\w*|banner|nav\w*|menu|footer|sidebar|comments?|share|social|promo|cookies?|related|breadcrumbs?|widget|popup|sponsor\w*)(?![a-z])", re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_GOOD, _BAD = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "form", "button", "select"))
_TAGS = {"p": 1, "li": 2, "h1": 3, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "div": 4, "td": 5, "th": 5, "blockquote": 6, "pre": 6, "dd": 7, "dt": 7, "section": 4, "article": 4, "main": 4}
FEATURES, CLASSES = 13, 16


class Block:
    __slots__ = ("text", "linked", "tag", "parent", "grand", "role")

    def __init__(self, text: str, linked: int, tag: str, parent: int, grand: int, role: int):
        self.text, self.linked, self.tag, self.parent, self.grand, self.role = text, linked, tag, parent, grand, role


def tokens(page: str) -> Iterator[tuple[bool, str | None, str]]:
    """(False, None, text) and (closes, name in lower case, rest of the tag) in order, in time linear in the page.

    A tag ends at the first > outside of quoted values; where quotes don't pair up so that there is none, at the first >,
    from there to the end of the page. A < that begins no tag is text. Comments, declarations and the content of mute
    elements are left out; a mute element that nothing closes, but for scripts and styles, is taken for its tag alone, and
    so is an svg that closes itself.
    """
    i, size, last, quoted, open_ended = 0, len(page), page.rfind(">"), True, set()
    while i < size:
        j = page.find("<", i)
        if j < 0:
            yield False, None, page[i:]
            return
        if j > i:
            yield False, None, page[i:j]
        if page.startswith("<!--", j):
            end = page.find("-->", j + 4)
            i = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), j) and j < last:
            i = page.index(">", j) + 1
            continue
        m = _NAME.match(page, j) if j < last else None
        if m is None:
            yield False, None, "<"
            i = j + 1
            continue
        found = _REST.match(page, m.end()) if quoted else None
        if found is None:
            quoted, end = False, page.index(">", m.end())
            rest = page[m.end() : end]
        else:
            rest, end = found[1], found.end() - 1
        name, i = m[2].lower(), end + 1
        if name in _MUTE and not m[1]:
            if name == "svg" and rest.endswith("/"):
                continue
            end = None if name in open_ended else _MUTE[name].search(page, i)
            if end:
                i = end.end()
            elif name in _SHUT:
                return
            else:
                open_ended.add(name)
            continue
        if name not in _MUTE:
            yield bool(m[1]), name, rest


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space collapsed and entities resolved. Any text parses."""
    out: list[Block] = []
    # open elements: name, number, role
    stack: list[tuple[str, int, int]] = [("body", 0, 0)]
    solid: list[tuple[str, int, int]] = [stack[0]]  # those that aren't inline
    count: dict[str, int] = {"body": 1}
    serial, text, linked = 0, [], 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                name, number, role = solid[-1]
                out.append(Block(joined, linked, name, number, solid[-2][1] if len(solid) > 1 else -1, role))
        linked = 0

    def pop(to: int) -> None:
        while len(stack) > to:
            name = stack.pop()[0]
            count[name] -= 1
            if name not in _INLINE:
                flush_needed()
                solid.pop()

    def flush_needed() -> None:
        if text:
            flush()

    for closing, name, rest in tokens(page):
        if name is None:
            if "&" in rest:
                rest = entities.unescape(rest)
            text.append(rest)
            if count.get("a"):
                linked += len(rest.split())
            continue
        if closing:
            if count.get(name) and name != "body":
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            elif name not in _INLINE:
                flush_needed()
            continue
        if name in _VOID:
            if name == "hr":
                flush_needed()
            else:
                text.append(" ")
            continue
        if name in ("html", "body", "head"):
            continue
        if name in _ENDS_P and count.get("p"):
            _imply(stack, solid, ("p",), pop)
        if name in _CLOSES:
            if any(count.get(x) for x in _CLOSES[name]):
                _imply(stack, solid, _CLOSES[name], pop)
        inline = name in _INLINE
        if not inline:
            flush_needed()
        serial += 1
        role = solid[-1][2]
        if name in _GOOD:
            role = 1
        elif name in _BAD or (not inline and rest and any(_HINT.search(x[1]) for x in _NAMED.finditer(rest))):
            role = -1
        if rest.endswith("/"):
            continue
        element = (name, serial, role)
        stack.append(element)
        count[name] = count.get(name, 0) + 1
        if not inline:
            solid.append(element)
    flush()
    return out


def _imply(stack: list, solid: list, names: tuple, pop) -> None:
    while len(solid) > 1 and solid[-1][0] in names:
        k = len(stack) - 1
        while stack[k] is not solid[-1]:
            k -= 1
        pop(k)


def _share(n: int, of: int) -> int:
    return 0 if n == 0 else 1 if 50 * n <= of else 2 if 10 * n <= of else 3 if 3 * n <= of else 4


def features(page: list[Block]) -> np.ndarray:
    """(blocks, FEATURES) classes."""
    out = np.zeros((len(page), FEATURES), np.int64)
    words = [len(b.text.split()) for b in page]
    size = np.minimum(np.floor(2 * np.log2(np.array(words, float) + 1)), CLASSES - 1).astype(np.int64) if page else np.zeros(0, np.int64)
    total, before, same = sum(words), 0, {}
    for b in page:
        same[b.parent] = same.get(b.parent, 0) + 1
    siblings: dict[int, int] = {}
    for b in page:
        siblings[b.grand] = siblings.get(b.grand, 0) + 1
    for k, b in enumerate(page):
        t, w, n = b.text, words[k], len(b.text)
        marks = t.count(".") + t.count("?") + t.count("!")
        out[k] = (
            _TAGS.get(b.tag, 0), size[k], min(4, 5 * b.linked // max(w, 1)), (t[-1] in '.?!…:;"»”') + 2 * (marks > 1), _share(t.count(","), w), _share(marks, w),
            min(CLASSES - 1, n // max(w, 1)), min(4, 5 * before // max(total, 1)), size[k - 1] if k else 0, size[k + 1] if k + 1 < len(page) else 0,
            min(5, same[b.parent].bit_length()), min(5, siblings[b.grand].bit_length()), _share(t.count("©") + t.count("·") + t.count("|") + t.count("»"), w),
        )
        before += w
    return out


def edges(page: list[Block]) -> list[tuple[int, int, int]]:
    """(block, later block, capacity)."""
    out = []
    parent: dict[int, int] = {}
    grand: dict[int, int] = {}
    for k, b in enumerate(page):
        if k:
            a = page[k - 1]
            near = 0 if a.parent == b.parent else 1 if a.grand == b.grand or a.parent == b.grand or a.grand == b.parent else 2
            out.append((k - 1, k, int(NEXT[near] * SCALE)))
        p, g = parent.get(b.parent, -1), grand.get(b.grand, -1)
        if -1 < p < k - 1:
            out.append((p, k, int(SIBLING * SCALE)))
        if -1 < g < k - 1 and g != p:
            out.append((g, k, int(COUSIN * SCALE)))
        parent[b.parent], grand[b.grand] = k, k
    return out


def cut_labels(unary: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """True for the blocks on the source's side of the minimum cut, the least such side. unary: capacity from the source,
    or, if negative, to the sink."""
    n = len(unary)
    u, around = list(unary), [[] for _ in range(n)]
    total = [0] * n
    for a, b, c in links:
        around[a].append((b, c))
        around[b].append((a, c))
        total[a] += c
        total[b] += c
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        k = todo.pop()
        if label[k] is None and (u[k] > total[k] or -u[k] >= total[k]):
            label[k] = u[k] > total[k]
            for j, c in around[k]:
                if label[j] is None:
                    u[j] += c if label[k] else -c
                    total[j] -= c
                    todo.append(j)
    left = [k for k in range(n) if label[k] is None]
    if left:
        at = {k: i for i, k in enumerate(left)}
        inner = [(at[k], at[j], c) for k in left for j, c in around[k] if k < j and label[j] is None]
        for k, side in zip(left, _max_flow([u[k] for k in left], inner)):
            label[k] = side
    return [bool(x) for x in label]


def _max_flow(u: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Dinic's algorithm; true for what the source still reaches."""
    n = len(u)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def join(a: int, b: int, forth: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, x in enumerate(u):
        if x > 0:
            join(s, k, x, 0)
        elif x < 0:
            join(k, t, -x, 0)
    for a, b, c in links:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for v in queue:
            for e in head[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        arc, path, v = [0] * (n + 2), [], s
        while True:
            if v == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if not room[e])
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while arc[v] < len(head[v]):
                e = head[v][arc[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                arc[v] += 1
            if arc[v] < len(head[v]):
                path.append(e)
                v = to[e]
            elif path:
                level[v] = -1
                v = to[path.pop() ^ 1]
            else:
                break


def content(page: str | None, weights: np.ndarray) -> tuple[str, int, int]:
    """Content, one block a line, with the numbers of blocks and of content blocks."""
    found = blocks(page or "")
    if not found:
        return "", 0, 0
    log = weights[np.arange(FEATURES), features(found)].sum(axis=1) * SHARPNESS + weights[FEATURES, 0]
    unary = [round(SCALE * (x + ROLE * b.role)) for x, b in zip(log.tolist(), found)]
    kept = [b.text for b, side in zip(found, cut_labels(unary, edges(found))) if side]
    return "\n".join(kept), len(found), len(kept)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, FEATURES, CLASSES), np.int64)
    for batch in batches:
        for page in batch["html"]:
            found = blocks(page.as_py() or "")
            role = np.array([b.role for b in found])
            if found:
                x = features(found)
                for y in (0, 1):
                    mine = x[role == (1 if y else -1)]
                    np.add.at(total[y], (np.broadcast_to(np.arange(FEATURES), mine.shape), mine), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n"])


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log odds by feature and class, and the intercept; where the sample lacks blocks of either role, all blocks are
    taken for content unless their markup tells otherwise."""
    n = max(1, pages.count())
    picked = pages.filter(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)) + 1)
    counts = np.zeros(2 * FEATURES * CLASSES)
    for r in picked.select("html").mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(2, FEATURES, CLASSES)
    weights = np.zeros((FEATURES + 1, CLASSES))
    if not counts[0].any() or not counts[1].any():
        weights[FEATURES, 0] = 0.5
        return weights
    p = (counts + 1.0) / (counts + 1.0).sum(axis=2, keepdims=True)
    weights[:FEATURES] = np.log(p[1]) - np.log(p[0])
    return weights


def extracted(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, text, n_blocks, n_content) of every page; text is the content blocks in order, one a line.

    A null or empty page, or one without text, has an empty text and no blocks. Pages are read whole, also where markup
    is broken (see tokens); scripts, styles, comments and titles that are closed are never text. Repeated rows have equal results, a null page_id is
    carried along, other columns play no part. ``sample`` bounds, about, the pages that the classifier is trained on.
    """
    mine = pages.select("page_id", F.col("html").cast("string").alias("html"))
    weights, kind = fit(mine, sample), pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [content(x.as_py(), weights) for x in batch["html"]]
            text, n, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "text", "n_blocks", "n_content"])

    return mine.mapInArrow(run, f"page_id {kind}, text string, n_blocks long, n_content long")
