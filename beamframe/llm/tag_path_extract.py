"""Main text of web pages by tag-path ratios.

A page becomes a sequence of blocks, each with the path of tags (and classes) from the root down to the
element that holds its text. Menus, headers, footers, sidebars, notices, adverts, forms, reader comments
and hidden parts go by their tags, roles and names, unless what is so named wraps the article itself.
Of the rest, every path gets

* its text ratio: characters outside links a block, and
* its punctuation ratio: punctuation marks a block,

both smoothed over neighbouring blocks by a Gaussian window and averaged by path. Text * (1 + punctuation) of
the ratios and of the smoothed ones are fused to one score, their geometric mean. Paths that reach the standard deviation of the page's scores (or the best path,
where none does) are content paths. Their blocks name the content node: from the top, the walk goes
down into the element that holds nearly all of their text. Inside it, headings, short paragraphs and
list items are the article's as well; other blocks of rejected paths, and rejected runs of links, go.

A page is one row of an Arrow batch and is worked on alone; no rows are shuffled. Memory and time follow the
longest page, as every step is linear in it.

Defined cases: null and empty pages, and pages without text, give an empty text; repeated rows and ids
are returned each; other columns are ignored; markup that is never closed ends where HTML's rules end it,
or at the end of the page; character references are decoded once, also without a semicolon where HTML
knows them; any Unicode white space counts, and `<br>` is white space inside a block."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from beamframe.llm.common import small_batches

# --- fixed values: HTML's elements ------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSE_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an open element that a new one of the key closes, and what keeps it open
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("button caption object table td th template".split())

# --- fixed values: what is not main text ---------------------------------------------------------
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog form button select fieldset input template svg math canvas object audio video map search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADER_NAMES = frozenset("header masthead topbar".split())
BOILERPLATE_NAMES = re.compile(
    r"(?:ad|ads|adv|adbox|adslot|adunit|adsense|adsbygoogle|advert\w*|sponsor\w*|promo|promos|promoted|promotion|banner|banners|cookie\w*|consent|gdpr|notice|notices|notification\w*|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall"
    r"|sidebar\w*|sidenav|rail|related|recommended|recommendations|trending|nav|navbar|navigation|menu|menus|submenu|breadcrumb\w*|pager|pagination|toolbar|footer\w*|copyright|disclaimer|share|sharing|sharebar|social"
    r"|comment|comments|commentlist|commentbox|commentform|reply|replies|disqus\w*|respond|search|searchbox|skiplink)"
)
TEXT_TAGS = HEADINGS | frozenset("p li blockquote pre dd dt td th figcaption caption summary address".split())
WRAPPERS = frozenset("html body div section article main center table tbody tr td span form ul ol dl".split())

_TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?P<end>>|\Z)|[!?/][^>]*+(?:>|\Z))")
_COMMENT_END = re.compile(r"--!?>|\Z")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'/])hidden(?=[\s/=]|$)", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？।؟،]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


@dataclass(frozen=True)
class ExtractConfig:
    sigma: float = 1.0  # of the smoothing, in blocks
    radius: int = 2
    descend: float = 0.8  # share of content text that an element holds to be walked into
    link_share: float = 0.8  # of a rejected path's text, to be a run of links


@dataclass
class _Page:
    """Elements in page order, blocks with their element, path, text and characters in links."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    named: list[str] = field(default_factory=lambda: [""])  # "", "header" or "other": what the element is by itself
    paths: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _kind(tag: str, attrs: str) -> tuple[str, str]:
    """What an element is by tag, role and names ("", "header", "other"), and its names for the path."""
    kind = "header" if tag == "header" else "other" if tag in BOILERPLATE_TAGS else ""
    if not attrs.strip(" \t\r\n\f/"):
        return kind, ""
    names = ""
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), html.unescape(a or b or c)
        if key == "role" and value.strip().lower() in BOILERPLATE_ROLES:
            kind = "other" if tag not in ("html", "body", "main") else kind
        elif key == "style" and _HIDING.search(value) or key == "aria-hidden" and value.strip().lower() == "true":
            kind = "other"
        elif key in ("class", "id"):
            if key == "class":
                names = " ".join(sorted(value.split()))
            for name in value.split():
                words = [w.lower() for w in _WORD.findall(name)]
                if not words or words[0] in ("no", "has", "with", "without", "is"):
                    continue
                words += [a + b for a, b in zip(words, words[1:], strict=False)]  # side-bar, pop-up
                # an article's classes often name its subjects, after a first word
                if tag not in ("html", "body", "main") and any(BOILERPLATE_NAMES.fullmatch(w) for w in (words[:1] if tag == "article" else words)):
                    kind = "other"
                elif not kind and not HEADER_NAMES.isdisjoint(words):
                    kind = "header"
    if _HIDDEN.search(re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", "=", attrs)):
        kind = "other"
    return kind, names


def _read(page: str) -> _Page:
    """Blocks and elements of a page; ends that are implied are put in as HTML's rules say."""
    out = _Page()
    stack: list[int] = [0]  # open elements, the root first
    open_: dict[str, int] = {}
    path_ids: dict[tuple[int, str], int] = {}
    texts: list[str] = []
    links, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                # the block's element: what is open below inline markup
                i = len(stack) - 1
                while i > 0 and out.tag[stack[i]] in INLINE and not out.named[stack[i]]:
                    i -= 1
                out.blocks.append((stack[i], text, min(linked, len(text))))
        linked = 0

    def cut(to: int) -> None:
        """Close all elements from place `to` of the stack on."""
        nonlocal links
        for e in stack[to:]:
            open_[out.tag[e]] -= 1
            links -= out.tag[e] == "a"
        del stack[to:]

    def close_open(which: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        if any(open_.get(t) for t in which):
            for i in range(len(stack) - 1, 0, -1):
                t = out.tag[stack[i]]
                if t in which:
                    cut(i)
                    return
                if t in scope:
                    return

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            raw = page[at:end]
            text = html.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m["comment"] is not None:
            at = at if page.startswith(">", at) else _COMMENT_END.search(page, at).end()
            continue
        if m["name"] is None or not m["end"]:
            continue
        tag = m["name"].lower()
        if tag in RAW:
            if not m["close"]:
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else size if tag != "title" else at
                if tag not in ("title", "script", "style"):
                    flush()
            continue
        if tag in ("html", "head", "body"):
            flush()
            continue
        inline = tag in INLINE
        if m["close"]:
            if tag == "br":
                texts.append(" ")
                continue
            if not inline:
                flush()
            if tag in HEADINGS:
                close_open(HEADINGS, P_SCOPE)
            elif open_.get(tag):
                i = len(stack) - 1
                while out.tag[stack[i]] != tag:
                    i -= 1
                if inline and any(out.tag[e] not in INLINE for e in stack[i + 1 :]):
                    open_[tag] -= 1
                    links -= tag == "a"
                    del stack[i]
                else:
                    if out.named[stack[i]]:
                        flush()
                    cut(i)
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if not inline:
            flush()
            if tag in CLOSE_P:
                close_open({"p"}, P_SCOPE)
            if tag in HEADINGS and out.tag[stack[-1]] in HEADINGS:
                cut(len(stack) - 1)
            if tag in SIBLINGS:
                close_open(*SIBLINGS[tag])
        if tag in VOID:
            continue
        kind, names = _kind(tag, m["attrs"])
        if kind:
            flush()
        e = len(out.tag)
        out.parent.append(stack[-1])
        out.tag.append(tag)
        out.named.append(kind)
        out.paths.append(path_ids.setdefault((out.paths[stack[-1]], f"{tag}.{names}"), len(path_ids) + 1))
        if m["attrs"].endswith("/") and (tag in ("svg", "math") or open_.get("svg") or open_.get("math")):
            continue
        stack.append(e)
        open_[tag] = open_.get(tag, 0) + 1
        links += tag == "a"
    flush()
    return out


def _dropped(page: _Page) -> list[bool]:
    """Elements that are, or stand in, menus and the like."""
    n = len(page.tag)
    core = [page.tag[e] in ("article", "main") and page.named[e] != "other" for e in range(n)]
    if not any(core):
        heads = [e for e in range(n) if page.tag[e] == "h1"]

        def in_header(e: int) -> bool:
            while e > 0:
                if page.named[e]:
                    return True
                e = page.parent[e]
            return False

        heads = [e for e in heads if not in_header(e)] or heads[:1]
        for e in heads:
            core[e] = True
    within = [False] * n  # stands in an article
    around = core[:]  # holds one
    for e in range(1, n):
        within[e] = within[page.parent[e]] or core[page.parent[e]] and page.tag[page.parent[e]] in ("article", "main")
    for e in range(n - 1, 0, -1):
        if around[e]:
            around[page.parent[e]] = True
    gone = [False] * n
    for e in range(1, n):
        kind = page.named[e]
        own = kind == "other" and not around[e] or kind == "header" and not within[e] and not around[e]
        gone[e] = gone[page.parent[e]] or own
    return gone


def _smooth(values: list[float], cfg: ExtractConfig) -> list[float]:
    weights = [math.exp(-0.5 * (d / cfg.sigma) ** 2) for d in range(cfg.radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d in range(-cfg.radius, cfg.radius + 1):
            if 0 <= i + d < len(values):
                total += weights[abs(d)] * values[i + d]
                weight += weights[abs(d)]
        out.append(total / weight)
    return out


def content_paths(blocks: list[tuple[int, int, int]], cfg: ExtractConfig = ExtractConfig()) -> dict[int, bool]:
    """blocks of (path, characters outside links, punctuation marks), in page order -> whether a path is content."""
    size: dict[int, list[float]] = {}
    for path, chars, marks in blocks:
        s = size.setdefault(path, [0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += chars
        s[2] += marks
    text = _smooth([size[p][1] / size[p][0] for p, _, _ in blocks], cfg)
    mark = _smooth([size[p][2] / size[p][0] for p, _, _ in blocks], cfg)
    fused: dict[int, float] = {}
    for (p, _, _), t, k in zip(blocks, text, mark, strict=True):
        fused[p] = fused.get(p, 0.0) + t * (1 + k) / size[p][0]
    # a path's own ratios, so that a line beside the article doesn't live on its neighbours
    fused = {p: math.sqrt(f * size[p][1] / size[p][0] * (1 + size[p][2] / size[p][0])) for p, f in fused.items()}
    scores = [fused[p] for p, _, _ in blocks]
    mean = sum(scores) / len(scores)
    deviation = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    least = min(deviation, max(fused.values()))
    return {p: s >= least for p, s in fused.items()}


def main_text(page: str | None, cfg: ExtractConfig = ExtractConfig()) -> str:
    """The article of one page, a line a block."""
    read = _read(page or "")
    gone = _dropped(read)
    blocks = [b for b in read.blocks if not gone[b[0]]]
    if not blocks:
        return ""
    chosen = content_paths([(read.paths[e], max(0, len(t) - link), len(_PUNCTUATION.findall(t)) if link < len(t) else 0) for e, t, link in blocks], cfg)
    # content text below every element, and the way down to the content node
    weight = [0] * len(read.tag)
    titles = [0] * len(read.tag)
    for e, t, link in blocks:
        weight[e] += max(1, len(t) - link) if chosen[read.paths[e]] else 0
        titles[e] += read.tag[e] == "h1"
    children: dict[int, list[int]] = {}
    for e in range(len(read.tag) - 1, 0, -1):
        weight[read.parent[e]] += weight[e]
        titles[read.parent[e]] += titles[e]
        if read.tag[e] in WRAPPERS and weight[e]:
            children.setdefault(read.parent[e], []).append(e)
    node, total = 0, weight[0]
    while True:
        best = max(children.get(node, []), key=lambda e: (weight[e], -e), default=None)
        article = best is not None and read.tag[best] in ("article", "main")
        if best is None or weight[best] < cfg.descend * total or titles[best] < titles[node] and not article:
            break
        node = best
    inside = [False] * len(read.tag)
    inside[node] = True
    semantic = False
    e = node
    while e > 0:
        semantic |= read.tag[e] in ("article", "main")
        e = read.parent[e]
    for e in range(node + 1, len(read.tag)):
        inside[e] = inside[read.parent[e]]
    links: dict[int, list[int]] = {}
    for e, t, link in blocks:
        s = links.setdefault(read.paths[e], [0, 0])
        s[0] += link
        s[1] += len(t)
    out = []
    for e, t, _ in blocks:
        p = read.paths[e]
        menu = links[p][0] > cfg.link_share * links[p][1] and read.tag[e] not in HEADINGS
        if inside[e] and (chosen[p] or not menu and (semantic or read.tag[e] in TEXT_TAGS)):
            out.append(t)
    return "\n".join(out)


_OUT = "page_id bigint, url string, text string, n_chars bigint"


def extract_pages(pages: DataFrame, cfg: ExtractConfig = ExtractConfig()) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, one row a row."""
    small_batches(pages.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, cfg) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html").mapInArrow(texts, _OUT)
