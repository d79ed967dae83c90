"""Main-text extraction by gradient-boosted trees over DOM nodes.

A tolerant parser makes the page's tree and its runs of text. Each block node gets features of itself, its subtree, its
attributes' words, its ancestors and its siblings; boosted trees, fitted in numpy, give the probability that the subtree
holds main text. Decoding picks the likeliest labelling of the whole tree in which nothing under a dropped node is kept, so
choices of ancestor and descendant can't contradict each other.

Labels for fitting come from at most SAMPLE distinct pages, chosen by a hash of the page: those that mark their article are taken
as they are, from first to last character, and every sampled page's text is laid out anew in random layouts, whose main part is known, so that the trees
don't depend on one site's markup.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, sample_texts

#: Pages that the trees are fitted on, and random layouts for each.
SAMPLE = 240
LAYOUTS = 5
TREES, DEPTH, BINS, SHRINK = 60, 4, 32, 0.2

# Fixed values of HTML: elements without end tag, inline elements, other elements that are blocks, elements whose text is never page text,
# and what a start tag closes. An element of any other name is inline until a block begins in it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math meter nobr output picture progress q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
RAW = "script|style|template|iframe|textarea|title|svg|select|button|audio|video|canvas"
#: Of these, the elements that reach to the page's end where they have no end tag, and those that `/>` closes.
TO_END = frozenset("script style textarea title".split())
SELF_CLOSED = frozenset("svg math".split())
BLOCK = frozenset("body caption frameset hgroup legend noframes noscript object optgroup option search summary".split())
CLOSES = {t: frozenset({"p"}) for t in "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()} | {
    "li": frozenset({"p", "li"}), "dt": frozenset({"p", "dt", "dd"}), "dd": frozenset({"p", "dt", "dd"}), "option": frozenset({"option"}),
    "tr": frozenset({"p", "td", "th", "tr"}), "td": frozenset({"p", "td", "th"}), "th": frozenset({"p", "td", "th"}), "tbody": frozenset({"p", "td", "th", "tr", "thead", "tbody"}), "tfoot": frozenset({"p", "td", "th", "tr", "thead", "tbody"}),
}
SCOPES = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "tbody": frozenset({"table"}), "tfoot": frozenset({"table"})}
#: Tag groups, and words of class, id and role by what they tell.
TAGS = ("article main", "section", "div center", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu dir", "li dt dd", "table tbody thead tfoot tr td th", "nav", "header", "footer", "aside", "form fieldset", "blockquote pre figure figcaption details", "body html")
HINTS = {
    "main": "article content main post entry story text body",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header masthead banner top logo hero",
    "foot": "footer bottom copyright legal colophon",
    "side": "sidebar aside side rail widget widgets related recommended more trending popular tags tag",
    "ad": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion commercial",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner disclaimer message",
    "form": "form newsletter subscribe signup login search contact",
    "talk": "comment comments reply replies discussion disqus respond feedback reviews",
    "share": "share social sharing follow byline meta author",
}
_GROUP = {t: i for i, ts in enumerate(TAGS) for t in ts.split()}
_HINT: dict[str, set[int]] = {}
for _i, _words in enumerate(HINTS.values()):
    for _w in _words.split():
        _HINT.setdefault(_w, set()).add(_i)
JUNK_TAGS = frozenset("nav header footer aside form".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?P<rawattrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)[^>]*>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z""",
    re.S | re.I,
)
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW.split("|")}
_ATTR = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Page:
    """Block nodes in page order, with their parents (-1 for the root), and the runs of text between block borders."""

    tags: list[str]
    parents: list[int]
    hints: list[set[int]]
    marked: list[bool]
    runs: list[tuple[int, str, int]]  # owner, text, characters inside links


def parse(page: str) -> Page:
    tags, parents, hints, marked, runs = ["html"], [-1], [set()], [False], []
    stack: list[tuple[str, int]] = [("html", 0)]
    waiting: dict[int, tuple[int, set[int], bool]] = {}  # by depth: inline elements of other names, from which piece on, and what they would be
    piece: list[str] = []
    state = {"links": 0, "linked": 0}

    def say(text: str) -> None:
        piece.append(text)
        if state["links"]:
            state["linked"] += len(text)

    def flush(upto: int | None = None, owner: int | None = None) -> None:
        text = " ".join(entities.unescape("".join(piece[:upto])).split())
        if text:
            runs.append((stack[-1][1] if owner is None else owner, text, state["linked"]))
        del piece[:upto]
        state["linked"] = 0
        for depth, (mark, *rest) in waiting.items():
            waiting[depth] = (0 if upto is None else max(0, mark - upto), *rest)

    def inline(depth: int) -> bool:
        return stack[depth][1] == stack[depth - 1][1]

    def node(name: str, owner: int, told: set[int], main: bool) -> int:
        tags.append(name)
        parents.append(owner)
        hints.append(told)
        marked.append(main)
        return len(tags) - 1

    def settle() -> None:
        """Elements of other names that are open become blocks, as a block begins in them; so does their text up to here."""
        owner = None
        for depth in range(min(waiting, default=len(stack)), len(stack)):
            if depth in waiting:
                owner = stack[depth - 1][1]
                flush(waiting[depth][0], owner)
                owner = node(stack[depth][0], owner, *waiting[depth][1:])
            stack[depth] = (stack[depth][0], owner)
        waiting.clear()

    def pop(depth: int) -> None:
        if not inline(depth) or stack[-1][1] != stack[depth - 1][1]:  # a node ends
            flush()
        for t, _ in stack[depth:]:
            state["links"] -= t == "a"
        for d in [d for d in waiting if d >= depth]:
            del waiting[d]
        del stack[depth:]

    at = 0
    endless: set[str] = set()  # raw elements without a further end tag
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name, attrs = m["name"] or m["name2"], m["attrs"]
        if m["raw"]:
            name, attrs = m["raw"].lower(), m["rawattrs"]
            if name in SELF_CLOSED and attrs.endswith("/"):
                continue
            end = None if name in endless else _END[name].search(page, at)
            if end:
                at = end.end()
                continue
            endless.add(name)
            if name in TO_END:
                at = len(page)
                continue
        if not name:
            continue
        name = name.lower()
        block = name in CLOSES or name in BLOCK
        if m["close"] or m["close2"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    pop(depth)
                    break
                if name in INLINE and not inline(depth):
                    break
            continue
        if name in VOID:
            if name != "wbr":
                piece.append(" ")
            if name == "hr":
                flush()
            continue
        if name in ("html", "head") or name in SELF_CLOSED and (attrs or "").endswith("/"):
            continue
        shut = CLOSES.get(name)
        if shut:
            stop = SCOPES.get(name, ())
            found = 0
            for depth in range(len(stack) - 1, 0, -1):
                t = stack[depth][0]
                if t in shut:
                    found = depth
                    if name not in SCOPES:
                        break
                elif t in stop or (name not in SCOPES and not inline(depth)):
                    break
            if found:
                pop(found)
        words, main = set(), False
        if attrs:
            for key, *values in _ATTR.findall(attrs):
                if key.lower() == "data-main":
                    main = True
                else:
                    words.update(_SPLIT.split("".join(values).lower()))
        told = set().union(*[_HINT[w] for w in words if w in _HINT])
        if not block:
            if name not in INLINE:
                waiting[len(stack)] = (len(piece), told, main)
            stack.append((name, stack[-1][1]))
            state["links"] += name == "a"
            continue
        settle()
        flush()
        stack.append((name, node(name, stack[-1][1], told, main)))
    if at < len(page):
        say(page[at:])
    flush()
    return Page(tags, parents, hints, marked, runs)


N_HINTS = len(HINTS)


def features(p: Page) -> np.ndarray:
    """(nodes, features) of a page."""
    n = len(p.tags)
    parents = p.parents
    own = np.zeros((n, 5))  # characters, those in links, runs, sentence marks, longest run
    for owner, text, linked in p.runs:
        k = len(text)
        row = own[owner]
        row[0] += k
        row[1] += min(linked, k)
        row[2] += 1
        row[3] += text.count(".") + text.count(",")
        row[4] = max(row[4], k)
    total = own.copy()
    size, height, children = np.ones(n), np.zeros(n), np.zeros(n)
    place, same = np.zeros(n), np.zeros(n)
    depth = np.zeros(n)
    above = np.zeros((n, N_HINTS + 2))
    hint = np.zeros((n, N_HINTS))
    group = np.zeros((n, len(TAGS) + 1))
    seen: dict[tuple[int, str], int] = {}
    for i, tag in enumerate(p.tags):
        group[i, _GROUP.get(tag, len(TAGS))] = 1
        for h in p.hints[i]:
            hint[i, h] = 1
        up = parents[i]
        if up >= 0:
            depth[i] = depth[up] + 1
            place[i] = children[up]
            children[up] += 1
            seen[up, tag] = seen.get((up, tag), 0) + 1
            above[i] = above[up]
            above[i, :N_HINTS] += hint[up]
            above[i, N_HINTS] += p.tags[up] in ("article", "main")
            above[i, N_HINTS + 1] += p.tags[up] in JUNK_TAGS
    below = np.zeros((n, 3))  # paragraphs, list items, links' holders marked as main
    for i in range(n - 1, 0, -1):
        up = parents[i]
        longest = max(total[up, 4], total[i, 4])
        total[up] += total[i]
        total[up, 4] = longest
        size[up] += size[i]
        height[up] = max(height[up], height[i] + 1)
        below[i, 0] += p.tags[i] == "p"
        below[i, 1] += p.tags[i] == "li"
        below[i, 2] += p.tags[i] in ("article", "main") or 0 in p.hints[i]
        below[up] += below[i]
    most = np.zeros(n)
    for i in range(1, n):
        most[parents[i]] = max(most[parents[i]], total[i, 0])
    up = np.maximum(np.array(parents), 0)
    same = np.array([seen.get((parents[i], p.tags[i]), 1) for i in range(n)], float)
    chars = np.maximum(total[:, 0], 1)
    before = np.cumsum(own[:, 0]) - own[:, 0]
    columns = [
        np.log1p(total[:, 0]), np.log1p(own[:, 0]), total[:, 1] / chars, total[:, 3] / chars, total[:, 0] / np.maximum(total[:, 2], 1), np.log1p(total[:, 4]),
        total[:, 0] / max(total[0, 0], 1), total[:, 0] / np.maximum(total[up, 0], 1), total[:, 0] / np.maximum(most[up], 1), total[up, 1] / np.maximum(total[up, 0], 1), np.log1p(total[up, 0]),
        size / chars, np.log1p(size), height, children, depth, place, children[up] - place, same, before / max(total[0, 0], 1), *below.T,
    ]
    return np.concatenate([np.stack(columns, axis=1), group, hint, above], axis=1)


@dataclass
class Boosted:
    """Complete trees of one depth: split features and thresholds by level order, then leaves."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Trees fitted to 0/1 labels by second-order boosting on the logistic loss over binned features."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.int64)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    z = np.full(n, base)
    splits = 2**DEPTH - 1
    feature, threshold, leaf = np.zeros((TREES, splits), np.int64), np.full((TREES, splits), np.inf), np.zeros((TREES, splits + 1))
    for tree in range(TREES):
        prob = 1 / (1 + np.exp(-z))
        g, h = prob - y, prob * (1 - prob)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            slot = at - first
            best = [(1e-6, 0, np.inf)] * count
            for j in range(k):
                cells = slot * BINS + binned[:, j]
                gs = np.bincount(cells, g, count * BINS).reshape(count, BINS).cumsum(axis=1)
                hs = np.bincount(cells, h, count * BINS).reshape(count, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                gain = gain[:, : len(cuts[j])]
                for s in range(count) if gain.shape[1] else ():
                    b = int(gain[s].argmax())
                    if gain[s, b] > best[s][0]:
                        best[s] = (float(gain[s, b]), j, float(cuts[j][b]))
            for s, (_, j, t) in enumerate(best):
                feature[tree, first + s], threshold[tree, first + s] = j, t
            at = 2 * at + 1 + (x[np.arange(n), feature[tree][at]] > threshold[tree][at])
        slot = at - splits
        leaf[tree] = -SHRINK * np.bincount(slot, g, splits + 1) / (np.bincount(slot, h, splits + 1) + 1)
        z += leaf[tree][slot]
    return Boosted(feature, threshold, leaf, base)


def decode(parents: list[int], margins: np.ndarray) -> list[bool]:
    """Likeliest labelling of the nodes (log odds given) in which every kept node's parent is kept."""
    gain = margins.tolist()  # of the best labelling of a subtree with its root kept, over dropping it all
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[parents[i]] += gain[i]
    kept = [gain[0] > 0]
    for i in range(1, len(gain)):
        kept.append(kept[parents[i]] and gain[i] > 0)
    return kept


def extract(p: Page, margins: np.ndarray) -> str:
    kept = decode(p.parents, margins)
    return "\n".join(text for owner, text, _ in p.runs if kept[owner])


def holds(p: Page, inside: list[bool]) -> np.ndarray:
    """1 for the nodes whose subtree has text of a node inside the main part."""
    y = np.zeros(len(p.tags))
    for owner, _, _ in p.runs:
        if inside[owner]:
            y[owner] = 1
    for i in range(len(y) - 1, 0, -1):
        if y[i]:
            y[p.parents[i]] = 1
    return y


def marked_article(p: Page) -> list[bool] | None:
    """Nodes inside the page's article or main element, less its menus, headers and the like; None without such."""
    if not {"article", "main"} & set(p.tags):
        return None
    inside, junk = [], []
    for i, tag in enumerate(p.tags):
        up = p.parents[i]
        bad = (up >= 0 and junk[up]) or tag in JUNK_TAGS or bool(p.hints[i] - {0})
        junk.append(bad)
        inside.append(not bad and (tag in ("article", "main") or (up >= 0 and inside[up])))
    return inside


def layout(rng: random.Random, main: list[str], other: list[str]) -> str:
    """A page with `main` as its main text, marked by data-main, and pieces of `other` around and inside it."""
    esc, pick = entities.escape, rng.choice
    hint = lambda kind: pick(HINTS[kind].split())
    bits = lambda n, k: [" ".join(pick(other).split()[:k]) or "x" for _ in range(n)]

    def wrap(kind: str, tag: str, body: str) -> str:
        name = pick([hint(kind), f"{hint(kind)}-{pick(['box', 'wrap', 'inner', 'area', 'list'])}", f"site-{hint(kind)}", f"page_{hint(kind)}"])
        if tag and rng.random() < 0.45:
            return f"<{tag}>{body}</{tag}>" if rng.random() < 0.6 else f'<{tag} class="{name}">{body}</{tag}>'
        return f'<{pick(["div", "div", "section"])} {pick(["class", "id"])}="{name}">{body}</div>'

    def close(text: str) -> str:  # sections end with their own tag
        return re.sub(r"<section (.*)</div>$", r"<section \1</section>", text, flags=re.S)

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{esc(b)}</a></li>' for i, b in enumerate(bits(n, rng.randint(1, 6)))) + "</ul>"

    def paragraphs(n: int, k: int) -> str:
        return "".join(f"<p>{esc(b)}</p>" for b in bits(n, k))

    junk = {
        "menu": lambda: wrap("menu", "nav", links(rng.randint(2, 9))),
        "head": lambda: wrap("head", "header", f"<h1>{esc(bits(1, 5)[0])}</h1>" * (rng.random() < 0.5) + f"<p>{esc(bits(1, 8)[0])}</p>" * (rng.random() < 0.5) + links(4) * (rng.random() < 0.5) or "x"),
        "foot": lambda: wrap("foot", "footer", pick([paragraphs(1, 15), links(4), f"&copy; {esc(bits(1, 8)[0])} &middot; {esc(bits(1, 8)[0])}"])),
        "side": lambda: wrap("side", "aside", f"<h{pick('234')}>{esc(bits(1, 4)[0])}</h4>" * (rng.random() < 0.5) + pick([links(5), paragraphs(rng.randint(1, 4), 30)])),
        "ad": lambda: wrap("ad", "", pick([esc(bits(1, 25)[0]), paragraphs(1, 25), f'<a href="/x">{esc(bits(1, 12)[0])}</a>'])),
        "notice": lambda: wrap("notice", "", pick([esc(bits(1, 25)[0]), paragraphs(1, 30) + "<button>OK</button>"])),
        "form": lambda: wrap("form", "form", f"<label>{esc(bits(1, 4)[0])}</label><input name=q>" + f"<p>{esc(bits(1, 12)[0])}</p>" * (rng.random() < 0.5)),
        "talk": lambda: wrap("talk", "", f"<h3>{esc(bits(1, 3)[0])}</h3>" * (rng.random() < 0.5) + pick([paragraphs(rng.randint(1, 6), 60), "".join(f'<div class="{hint("talk")}">{esc(b)}</div>' for b in bits(3, 40)), "<ul>" + "".join(f"<li><p>{esc(b)}</p></li>" for b in bits(3, 40)) + "</ul>"])),
        "share": lambda: wrap("share", "", pick([links(3), esc(bits(1, 6)[0])])),
    }
    junk = {k: (lambda f=f: close(f())) for k, f in junk.items()}
    body, inner = [], [k for k in ("ad", "share", "side", "form", "notice", "menu", "head", "talk") if rng.random() < 0.12]
    for i, text in enumerate(main):
        tag = "h1" if i == 0 and rng.random() < 0.7 else pick(["p"] * 12 + ["h2", "blockquote", "div", "li", "td"])
        said = esc(text)
        if rng.random() < 0.15:
            said = f"<b>{said}</b>" if rng.random() < 0.5 else re.sub(r" (\w+) ", r' <a href="/y">\1</a> ', said, count=2)
        body.append({"li": f"<ul><li>{said}</li></ul>", "td": f"<table><tr><td>{said}</td></tr></table>"}.get(tag, f"<{tag}>{said}</{tag}>"))
    if rng.random() < 0.2:
        body = [re.sub(r"</p>$", "", b) for b in body]
    for k in inner:
        body.insert(rng.randint(0 if k in ("share", "head") else 1, len(body)), junk[k]())
    tag = pick(["article", "article", "main", "section", "div", "div", "div"])
    name = f' {pick(["class", "id"])}="{pick([hint("main"), "post-" + hint("main"), hint("main") + "-wrap", "entry-content"])}"' if rng.random() < 0.75 else ""
    page = f"<{tag}{name} data-main=1>{''.join(body)}</{tag}>"
    beside = [junk[k]() for k in ("talk", "side", "ad", "share", "form", "menu") if rng.random() < 0.3]
    for _ in range(rng.randint(0, 2)):
        page = "<div" + pick(["", ' class="container"', ' id="wrapper"', ' class="row"', ' id="main"']) + ">" + page + "".join(beside) + "</div>"
        beside = []
    top = [junk[k]() for k in ("notice", "head", "menu", "ad") if rng.random() < 0.6]
    end = [junk[k]() for k in ("talk", "side", "ad", "form", "notice", "foot") if rng.random() < 0.4]
    rng.shuffle(top)
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(top) + page + "".join(beside) + "".join(end) + "</body></html>"


def fit(pages: list[str], seed: int = 1) -> Boosted | None:
    """The trees for these pages; None where none of them has text."""
    rng = random.Random(seed)
    xs, ys, texts = [], [], []
    for page in pages:
        p = parse(page)
        inside = marked_article(p)
        if inside and p.runs:
            xs.append(features(p))
            ys.append(holds(p, inside))
        main = [t for o, t, _ in p.runs if inside is None or inside[o]]
        if main:
            texts.append(main)
    pool = [t for main in texts for t in main]
    for main in texts:
        for _ in range(LAYOUTS):
            n = rng.randint(1, max(1, len(main)))
            p = parse(layout(rng, main[:n], pool))
            inside = []
            for i, m in enumerate(p.marked):
                up = p.parents[i]
                inside.append(m or (up >= 0 and inside[up] and not (p.tags[i] in JUNK_TAGS or p.hints[i] - {0})))
            xs.append(features(p))
            ys.append(holds(p, inside))
    return boost(np.concatenate(xs), np.concatenate(ys)) if xs else None


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Boosted | None:
    """Trees fitted on at most `sample` distinct pages, whatever their ids; None where no page has text (or there is none)."""
    rows = sample_texts(pages.select(F.col(f"`{html_col}`").alias("text")), sample).sort("text").collect()
    return fit([r["text"] for r in rows])


def extract_main_text(pages: DataFrame, trees: Boosted | None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of pages (all when None) with text string and n_chars long, its code points.

    The whole page is read; a null or empty page, or one without main text, has an empty text. Without trees (no page
    to fit them on had text) every text outside markup counts. Repeated rows have equal texts; an empty table gives no rows. Columns named like a new one are replaced. No shuffle.
    """

    def add(batch: pa.RecordBatch) -> dict:
        pages = [parse(t or "") for t in pc.fill_null(batch.column(html_col), "").to_pylist()]
        if trees is None:
            texts = ["\n".join(t for _, t, _ in p.runs) for p in pages]
        else:
            margins = trees.margins(np.concatenate([features(p) for p in pages])) if pages else np.zeros(0)
            ends = np.cumsum([len(p.tags) for p in pages])
            texts = [extract(p, margins[e - len(p.tags) : e]) for p, e in zip(pages, ends)]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_arrow(pages, add, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], html_col, keep)
