"""Main-text extraction by a tree-structured graphical model over the DOM.

Block elements are the variables (content or not). Each has a potential from its own features (tag,
class and id tokens, text length, link share, punctuation, controls, the share of the page's text in
it and in its parent, its place in the page, like siblings, the nearest element above it that HTML
gives a role), and each parent-child pair has a potential by the child's tag. Sum-product message passing, once upward and once downward, gives
exact marginals, since the graph is a tree. All potentials are smoothed counts over labelled
pages. These pages are made by ``labelled_pages``: ``TRAIN_PAGES`` pages (a fixed bound) with
random layouts, in which every element is labelled by construction; none of the input is read.
Names of classes and ids are missing, neutral or wrong in part of these pages, so that none decides
alone.

A block is a run of text between block boundaries. Blocks of elements with a content marginal
above one half are the main text. The parser is one pass with a stack: it knows void and raw-text
elements, implied and missing end tags, comments and unbalanced quotes, and never recurses.

Cases: null and empty pages give the empty string; markup that never closes is read to its end;
script, style and similar elements never give text; repeated rows each get a row; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

TRAIN_PAGES = 1_000
SEED = 7
#: Features of a node other than names are not independent; their evidence counts for this share.
TEMPER = 0.5
SCHEMA = "page_id long, url string, text string, n_chars long"

#: HTML's own lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title head".split())
RAW_TEXT = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
#: Elements by which HTML names a part of a page.
ROLES = frozenset("article main aside nav footer header form dialog address".split())
CONTROLS = frozenset("button input select textarea".split())
#: tag: open elements of these tags end where it starts, if no element of the second set is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
LABEL = re.compile(r'data-y="([01])"')


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: list[str]
    label: int = -1
    chars: int = 0
    link_chars: int = 0
    commas: int = 0
    ends: int = 0
    blocks: int = 0
    marks: int = 0  # copyright signs
    at: int = 0  # characters of the page before it
    like: int = 0  # siblings with its tag, itself included
    role: str = ""  # nearest tag above with a role
    below: int = 0  # characters of the whole subtree, of links in it, and form controls
    below_links: int = 0
    controls: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # owner, text


def parse(source: str) -> Page:
    """Block elements in page order (a parent before its children), and the blocks of text."""
    page = Page([Node("#root", -1, 0, [])])
    nodes, blocks = page.nodes, page.blocks
    stack: list[tuple[str, int]] = [("#root", 0)]  # tag, node that owns its text
    opened: dict[str, int] = {}  # how many of each tag are on the stack
    run: list[str] = []
    total = 0
    links, hidden, link_chars = 0, 0, 0

    def flush() -> None:
        nonlocal link_chars, total
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                owner = stack[-1][1]
                node = nodes[owner]
                node.chars += len(text)
                node.link_chars += min(link_chars, len(text))
                node.commas += text.count(",")
                node.ends += sum(text.count(c) for c in ".!?")
                node.marks += text.count("\u00a9")
                node.blocks += 1
                total += len(text)
                blocks.append((owner, text))
        link_chars = 0

    def pop() -> None:
        nonlocal links, hidden
        tag, _ = stack[-1]
        if tag not in INLINE:
            flush()
        stack.pop()
        opened[tag] -= 1
        links -= tag == "a"
        hidden -= tag in RAW

    def text(s: str) -> None:
        nonlocal link_chars
        if s and not hidden:
            s = html.unescape(s)
            run.append(s)
            if links:
                link_chars += len(s.strip())

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m["end"] or m["end2"]:
            if tag == "br":
                run.append(" ")
            elif opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in VOID:
            if tag in CONTROLS:
                nodes[stack[-1][1]].controls += 1
            if tag == "hr":
                flush()
            else:
                run.append(" ")
            continue
        if tag in CLOSES_P and opened.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in IMPLIED and any(opened.get(t) for t in IMPLIED[tag][0]):
            ends, scope = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in scope:
                    break
                if stack[k][0] in ends:
                    while len(stack) > k:
                        pop()
                    if tag != "tr":
                        break
        if attrs.endswith("/") and tag in ("svg", "iframe"):
            continue
        if tag in CONTROLS:
            nodes[stack[-1][1]].controls += 1
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag == "body":  # the head ends here, closed or not
            while len(stack) > 1 and stack[-1][0] != "html":
                pop()
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
        else:
            flush()
            owner = stack[-1][1]
            names = [w.lower() for v in NAMES.findall(attrs) for w in WORD.findall(v)]
            above = nodes[owner]
            node = Node(tag, owner, above.depth + 1, names, at=total, role=above.tag if above.tag in ROLES else above.role)
            if label := LABEL.search(attrs):
                node.label = int(label[1])
            nodes.append(node)
            stack.append((tag, len(nodes) - 1))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        hidden += tag in RAW
    while len(stack) > 1:
        pop()
    flush()
    like: dict[tuple[int, str], int] = {}
    for node in reversed(nodes):
        node.below += node.chars
        node.below_links += node.link_chars
        if node.parent >= 0:
            up = nodes[node.parent]
            up.below += node.below
            up.below_links += node.below_links
            up.controls += node.controls
            like[node.parent, node.tag] = like.get((node.parent, node.tag), 0) + 1
    for node in nodes:
        node.like = like.get((node.parent, node.tag), 1)
    return page


def _share(links: int, chars: int) -> str:
    share = links / chars if chars else -1
    return "none" if share < 0 else "0" if share == 0 else "1" if share < 0.4 else "2"


def _mass(part: int, total: int) -> int:
    share = part / max(total, 1)
    return sum(share > x for x in (0, 0.02, 0.1, 0.3, 0.5, 0.8))


def features(node: Node, page: Page) -> list[str]:
    root, up = page.nodes[0].below, page.nodes[max(node.parent, 0)]
    at = (node.at + node.below / 2) / max(root, 1)
    out = [
        f"tag={node.tag}",
        f"len={min(10, node.chars.bit_length())}",
        f"link={_share(node.link_chars, node.chars)}",
        f"below={node.below.bit_length() // 3}",
        f"below_link={_share(node.below_links, node.below)}",
        f"ends={min(3, node.ends)}",
        f"commas={min(2, node.commas)}",
        f"blocks={min(3, node.blocks)}",
        f"controls={min(2, node.controls)}",
        f"marks={min(1, node.marks)}",
        f"mass={_mass(node.below, root)}",
        f"up_mass={_mass(up.below, root)}",
        f"up_link={_share(up.below_links, up.below)}",
        f"up_controls={min(2, up.controls)}",
        f"at={sum(at > x for x in (0.02, 0.08, 0.3, 0.7, 0.92, 0.98))}",
        f"like={node.tag if node.tag in ('p', 'li', 'div', 'td') else '*'}:{sum(node.like > x for x in (1, 3))}",
        f"role={node.role}:{node.tag in ('p', 'h1', 'h2', 'h3')}",
        f"role={node.role}",
    ]
    return out + [f"name={w}" for w in dict.fromkeys(node.names)] + [f"in={w}" for w in dict.fromkeys(up.names)]


class TreeModel:
    """Potentials from labelled pages; marginals by sum-product."""

    def __init__(self, pages: list[Page]):
        seen: dict[str, np.ndarray] = {}
        prior = np.ones(2)
        edges: dict[str, np.ndarray] = {}
        for page in pages:
            for node in page.nodes:
                if node.label < 0:
                    continue
                prior[node.label] += 1
                for f in features(node, page):
                    seen.setdefault(f, np.zeros(2))[node.label] += 1
                up = page.nodes[node.parent].label if node.parent >= 0 else -1
                if up >= 0:
                    for key in (node.tag, "*"):
                        edges.setdefault(key, np.zeros((2, 2)))[up, node.label] += 1
        self.local = {f: np.log((c + 0.5) / (prior + 1)).tolist() for f, c in seen.items()}
        everywhere = edges["*"] + 0.5
        everywhere /= everywhere.sum(1, keepdims=True)
        # Counts of a tag, drawn towards the table of all tags.
        self.edges = {t: np.log((c + 4 * everywhere) / (c + 4 * everywhere).sum(1, keepdims=True)) for t, c in edges.items()}
        self.root = np.log(prior / prior.sum())

    def potential(self, node: Node, page: Page) -> tuple[float, float]:
        """The log potentials of a node by its own features."""
        a = b = 0.0
        for f in features(node, page):
            if x := self.local.get(f):
                weight = 1.0 if f.startswith(("name=", "in=")) else TEMPER
                a += weight * x[0]
                b += weight * x[1]
        return a, b

    def marginals(self, page: Page) -> np.ndarray:
        """P(content) of each node. Node features are weighed against the edge from the parent, so
        a node's own potential is the likelihood of its features."""
        nodes = page.nodes
        n = len(nodes)
        local = []
        for node in nodes:
            a, b = self.potential(node, page)
            local.append((a - b, 0.0))
        edge = [self.edges.get(node.tag, self.edges["*"]).tolist() for node in nodes]
        add = lambda a, b: a + np.log1p(np.exp(b - a)) if a > b else b + np.log1p(np.exp(a - b))
        up = [list(x) for x in local]  # own potential times messages from children
        sent: list = [None] * n
        for i in range(n - 1, 0, -1):
            e, (a, b) = edge[i], up[i]
            msg = (add(e[0][0] + a, e[0][1] + b), add(e[1][0] + a, e[1][1] + b))
            sent[i] = msg
            parent = up[nodes[i].parent]
            parent[0] += msg[0]
            parent[1] += msg[1]
        down: list = [tuple(self.root)] + [None] * (n - 1)
        out = np.zeros(n)
        for i in range(n):
            if i:
                p, e = nodes[i].parent, edge[i]
                a = up[p][0] + down[p][0] - sent[i][0]
                b = up[p][1] + down[p][1] - sent[i][1]
                down[i] = (add(a + e[0][0], b + e[1][0]), add(a + e[0][1], b + e[1][1]))
            out[i] = 1 / (1 + np.exp(min(700.0, up[i][0] + down[i][0] - up[i][1] - down[i][1])))
        return out

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        good = self.marginals(page) > 0.5
        return "\n\n".join(text for owner, text in page.blocks if good[owner])


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[Page]:
    """Pages of random layouts, in which data-y labels each element."""
    rng = random.Random(seed)
    syllables = "ba re ti no mel sor in the an und que es la or st vi ka du po lin".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(a, b)))

    def sentences(k: int) -> str:
        return " ".join(words(4, 18).capitalize() + rng.choice([".", ".", ".", ", " + words(2, 6) + ".", "!", "?"]) for _ in range(k))

    def el(tag: str, y: int, inner: str, names: str = "") -> str:
        name = f' {rng.choice(["class", "class", "id"])}="{names}"' if names else ""
        return f'<{tag} data-y="{y}"{name}>{inner}' + ("" if tag in ("p", "li") and rng.random() < 0.1 else f"</{tag}>")

    def links(k: int, tag: str = "ul") -> str:
        items = "".join(el("li", 0, f'<a href="/{i}">{words(1, 3)}</a>') for i in range(k))
        return el(tag, 0, items)

    def named(names: list[str], wrong: list[str]) -> str:
        """One of the names; or none, a neutral or a wrong one."""
        x = rng.random()
        return rng.choice(names) if x < 0.8 else "" if x < 0.87 else rng.choice(neutral) if x < 0.96 else rng.choice(wrong)

    neutral = "box c1 row wrap inner block col-2 x3 item unit panel group layer clearfix u-mt4 css-1ab grid cell module widget".split()
    good_names = "content article post-content entry-content article-body main story post main-text text body copy prose".split()
    bad_names = "sidebar related promo banner-note footer-note comment-policy share notice menu-guide ad-review nav-history widget social sponsored".split()

    def region(names: list[str], tags: list[str], inner: str) -> str:
        return el(rng.choice(tags), 0, inner, named(names, good_names))

    def advert() -> str:
        return region(["ad", "ads", "advert", "banner ad", "ad-slot", "sponsored", "promo", "advertisement"], ["div", "div", "aside", "section"],
                      rng.choice([sentences(1), words(2, 8), el("p", 0, sentences(rng.randint(1, 2))), f'<a href="/x">{words(3, 8)}</a>']))

    def comments() -> str:
        one = lambda: el("div", 0, el("p", 0, sentences(rng.randint(1, 4))) + rng.choice(["", el("span", 0, words(1, 2))]), rng.choice(["comment", "comment-body", "reply"]))
        return region(["comments", "comment-list", "responses", "discussion", "disqus"], ["section", "div", "div", "aside"],
                      el("h3", 0, words(1, 2)) + "".join(one() for _ in range(rng.randint(1, 6))))

    def form() -> str:
        return el("form", 0, rng.choice([el("p", 0, sentences(1)), el("label", 0, words(1, 3)), ""]) + el("button", 0, words(1, 2)), rng.choice(["", "newsletter", "subscribe", "search", "login"]))

    def notice() -> str:
        return region(["cookie-notice", "cookies", "consent", "notice", "gdpr", "alert", "modal", "popup"], ["div", "div", "section", "aside"],
                      el("p", 0, sentences(rng.randint(1, 3))) + rng.choice(["", el("button", 0, words(1, 2))]))

    def sidebar() -> str:
        inner = el("h3", 0, words(1, 3)) + rng.choice([links(rng.randint(3, 8)), el("p", 0, sentences(rng.randint(1, 3))), advert() + links(4)])
        return region(["sidebar", "side", "widget", "right-rail", "related", "recommended", "trending", "share", "social"], ["aside", "div", "section"], inner)

    def prose(k: int) -> str:
        return el("p", 1, sentences(k))

    def part() -> str:
        """A part of an article."""
        x = rng.random()
        if x < 0.62:
            p = sentences(rng.choice([1, 1, 2, 4, 8]))
            if rng.random() < 0.2:
                p = f"<b>{words(2, 5)}</b> " + p
            if rng.random() < 0.15:
                p += f' <a href="/r">{words(1, 3)}</a> {words(2, 6)}.'
            return el("p", 1, p) if rng.random() < 0.85 else el("div", 1, p, named([""], bad_names))
        if x < 0.65:
            return el("p", 1, f'<a href="/r">{words(2, 12)}</a>' + rng.choice(["", ".", " " + words(1, 2)]))
        if x < 0.72:
            return el(rng.choice(["h2", "h3", "h4"]), 1, words(1, 7).capitalize())
        if x < 0.77:
            return el(rng.choice(["ul", "ol"]), 1, "".join(el("li", 1, rng.choice([words(2, 12), words(1, 3), sentences(1)])) for _ in range(rng.randint(2, 7))))
        if x < 0.79:
            return el("dl", 1, "".join(el("dt", 1, words(1, 3)) + el("dd", 1, rng.choice([words(2, 9), sentences(1)])) for _ in range(rng.randint(1, 5))))
        if x < 0.82:
            return el("blockquote", 1, rng.choice([prose(2), sentences(2)]))
        if x < 0.84:
            return el("pre", 1, words(5, 30))
        if x < 0.87:
            return el("table", 1, "".join(el("tr", 1, "".join(el("td", 1, words(1, 3)) for _ in range(3))) for _ in range(rng.randint(2, 6))))
        if x < 0.89:
            return el("figure", 1, "<img src=x>" + el("figcaption", 1, words(3, 9)))
        if x < 0.92:
            return el("div", 1, rng.choice([words(1, 5), words(2, 8) + ".", prose(2)]), named(["", "section", "text", "lead", "byline", "date"], bad_names))
        return el(rng.choice(["section", "section", "div"]), 1, rng.choice(["", el("h2", 1, words(1, 5))]) + "".join(prose(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 3))), named(["", "section", "chapter"], bad_names))

    def article() -> str:
        heads = el(rng.choice(["h1", "h1", "h2"]), 1, words(3, 10).capitalize())
        if rng.random() < 0.2:
            heads = el("header", 1, heads + rng.choice(["", el("p", 1, words(2, 6))]))
        parts = []
        for _ in range(rng.randint(1, 14)):
            parts.append(part())
            x = rng.random()
            if x < 0.07:
                parts.append(advert() if x < 0.03 else sidebar() if x < 0.05 else form() if x < 0.06 else notice())
        inner = heads + "".join(parts)
        if rng.random() < 0.15:
            inner += comments()
        kind = rng.random()
        if kind < 0.35:
            return el("article", 1, inner, named(["", "post", "story"], bad_names))
        if kind < 0.45:
            return el("main", 1, inner, named(["", "content", "main"], bad_names))
        if kind < 0.55:
            return el("main", 1, el("article", 1, inner))
        if kind < 0.62:
            return el("table", 1, el("tr", 1, el("td", 1, inner)))
        return el(rng.choice(["div", "div", "section"]), 1, inner, named(good_names, bad_names))

    out = []
    for _ in range(n):
        before, after = [], []
        if rng.random() < 0.8:
            nav = el("nav", 0, links(rng.randint(3, 9))) if rng.random() < 0.6 else el("div", 0, links(rng.randint(3, 9)), rng.choice(["menu", "nav", "navbar", "breadcrumb", "topbar"]))
            before.append(nav if rng.random() < 0.6 else el("header", 0, rng.choice(["", el("h1", 0, words(1, 3))]) + nav, rng.choice(["", "header", "site-header"])))
        for make, p in ((notice, 0.25), (advert, 0.5), (form, 0.15), (sidebar, 0.25)):
            if rng.random() < p:
                before.append(make())
        for make, p in ((sidebar, 0.35), (comments, 0.3), (advert, 0.3), (form, 0.2), (notice, 0.15)):
            if rng.random() < p:
                after.append(make())
        if rng.random() < 0.85:
            after.append(region(["", "footer", "site-footer"], ["footer", "footer", "div"] if rng.random() < 0.5 else ["footer"],
                                rng.choice([f"&copy; {words(1, 3)} &middot; {sentences(1)}", el("p", 0, words(3, 9)), el("p", 0, f"&copy; 20{rng.randint(10, 29)} {words(1, 4)}. {sentences(1)}"), links(4)])))
        elif rng.random() < 0.6:
            after.append(el(rng.choice(["p", "div"]), 0, f"&copy; {rng.randint(1990, 2029)} {words(1, 4)}" + rng.choice(["", ". " + sentences(1)])))
        inner = "".join(before) + article() + "".join(after)
        if rng.random() < 0.4:
            inner = el("div", 1, inner, rng.choice(["", "page", "wrapper", "container"]))
        out.append(parse(f'<html data-y="1"><head><title>t</title></head><body data-y="1">{inner}</body></html>'))
    return out


def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> TreeModel:
    return TreeModel(labelled_pages(pages, seed))


def extract_text(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())  # a few hundred potentials

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [own.extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return bounded_batches(rows).mapInArrow(run, SCHEMA)
