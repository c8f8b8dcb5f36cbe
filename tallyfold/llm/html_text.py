"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is parsed leniently into a tree: elements, and under them runs of text between block boundaries. Every node is
either content or not. A node potential comes from its features (tag, words of class, id and role, and for text its
length, link share, and punctuation). Elements inside a line are nodes under their run if they have a class, id, role or
hidden mark: text of one that announces itself as something else leaves its run, however the run is decided. An edge potential from how often a child agrees with its parent, apart for
parents that announce themselves as something else, as the main part, as a run, or as nothing. Sum-product messages go up from the leaves and down again, which gives each run's exact marginal; runs above one half are the text, without inline parts below half of what is around them.

The potentials are smoothed counts over labelled pages: of at most about ``SAMPLE`` pages, chosen by hash, those with
one article (or main) element label their own nodes: content inside it, apart from parts that announce themselves as
something else. Fixed pseudo-counts stand for what no sample page shows.

Character references are decoded, white space inside a run becomes one space (so does a line break element), runs are
joined by line feeds in page order. Scripts, styles, comments, form controls and other raw elements have no text;
formulas and drawings have. Null and
empty pages give empty text. Pages of any length are read whole, repeated rows each come back, an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4_000

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"""
    r"""|<(/?)([a-zA-Z][^\s<>/]*+)((?:[^<>"']|"[^"]{0,9999}"|'[^']{0,9999}')*+)>|<(/?)([a-zA-Z][^\s<>/]*+)([^<>]*+)>|[^<]++|<""",
    re.S)
TAG_START = re.compile(r"<(/?)([a-zA-Z][^\s<>/]*+)")
TAG_SIGN = re.compile(r"""[<>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Fixed word lists: elements without end tag, without text, inside a line, and names that announce a part.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe select button annotation desc metadata".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow mstyle mspace msup msub msubsup mfrac msqrt"
    " mroot mover munder munderover".split())
CONTENT_NAMES = set("article main content post entry story body text".split())
OTHER_NAMES = set(
    "nav navigation menu menubar header masthead banner footer contentinfo aside sidebar complementary notice notices"
    " cookie cookies consent ad ads advert adverts advertisement sponsor sponsored promo promotion form login signup"
    " subscribe newsletter search comment comments reply replies discussion disqus respond share sharing social"
    " related recommended breadcrumb breadcrumbs pager pagination widget popup modal toolbar dialog legal copyright"
    " skip alert hidden disclaimer".split())
#: Of these, names that say nothing of an element inside a line.
NOT_INLINE = set("header search alert discussion legal comment".split())
CLOSES_PARAGRAPH = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav"
    " ol p pre section table ul".split())
ENDS_AT = CLOSES_PARAGRAPH - {"p"} | {"td", "th", "button"}
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

#: Fixed pseudo-counts: feature -> (not content, content); edges by kind of parent -> (parent, child).
PSEUDO = {"other": (40.0, 0.1), "main": (1.0, 8.0), "sign": (6.0, 0.3)}
KINDS = ["plain", "other", "main", "run"]
EDGES = [((12.0, 1.0), (1.0, 12.0)), ((500.0, 1.0), (1.0, 12.0)), ((4.0, 1.0), (1.0, 12.0)), ((12.0, 1.0), (1.0, 1.5))]
EDGE_WEIGHT = 20.0
ROOT = (3.0, 1.0)
STRENGTH = 400.0  # labelled nodes that weigh as much as they count; more of them sharpen no further
#: Largest log ratio a feature can give, so that sample pages of one make do not settle all others.
MOST, MOST_NAMED = 1.5, 7.0


class Page:
    """A parsed page: for each node its parent, features and, for runs, their text.

    ``pieces`` has, for runs with inline nodes, their text piece by piece with the node that each belongs to.
    """

    def __init__(self, html: str):
        self.parents, self.tags, self.features, self.texts = [-1], ["#"], [[]], [None]
        self.stack = [0]
        self.inside, self.kinds = [False], [0]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.pieces: dict[int, list[tuple[str, int]]] = {}
        self._pieces: list[tuple[str, bool, int]] = []
        self._run = 0
        self._inline: list[list] = []
        self._inline_open: Counter = Counter()
        self._parse(html)

    def _node(self, parent: int, tag: str, features: list[str], text: str | None, inside: bool) -> int:
        self.parents.append(parent)
        self.tags.append(tag)
        self.features.append(features)
        self.texts.append(text)
        self.inside.append(inside)
        self.kinds.append(0)
        return len(self.tags) - 1

    def _piece(self, text: str, in_link: bool) -> None:
        """Text of the run at hand. The first that shows starts the run's node, and those of the open inline elements."""
        if not self._run and text.strip():
            self._run = self._node(self.stack[-1], "text", [], None, self.inside[self.stack[-1]])
        owner = self._run
        if owner:
            for entry in self._inline[self._ready:]:
                tag, features, _, _ = entry
                outer = self._inline[self._ready - 1][3] if self._ready else owner
                if features:
                    self.kinds[owner] = KINDS.index("run")
                    outer = self._node(outer, tag, features, None, self.inside[owner])
                entry[3] = outer
                self._ready += 1
            owner = self._inline[-1][3] if self._inline else owner
        self._pieces.append((text, in_link, owner))

    def _open_inline(self, tag: str, attributes: str) -> None:
        """A node to be, if it has names; inside code and preformatted text names are those of a highlighter."""
        features, _ = self._features(tag, attributes, NOT_INLINE) if attributes else ([], False)
        plain = len(features) < 2 or self.places["pre"] or self._inline_open["code"]
        self._inline.append([tag, None if plain else features, len(self.stack), 0])
        self._inline_open[tag] += 1

    def _close_inline(self, tag: str) -> None:
        while self._inline_open[tag] > 0:
            last = self._inline.pop()[0]
            self._inline_open[last] -= 1
            self._ready = min(self._ready, len(self._inline))
            if last == tag:
                return

    def _carry_inline(self) -> None:
        """Of inline elements open over a block boundary only the outermost that is something else goes on."""
        others = [e for e in self._inline if e[1] and "other" in e[1] and e[2] <= len(self.stack)][:1]
        self._inline = [[*e[:3], 0] for e in others]
        self._inline_open = Counter(e[0] for e in others)

    def _flush(self) -> None:
        """End the run of text before a block boundary."""
        pieces, run = self._pieces, self._run
        self._pieces, self._run, self._ready = [], 0, 0
        text = " ".join("".join(p for p, _, _ in pieces).split())
        if run:
            linked = sum(len(p) for p, in_link, _ in pieces if in_link) / sum(len(p) for p, _, _ in pieces)
            words = text.count(" ") + 1
            prose = "prose" if words >= 8 and re.search(r"[.!?…]", text) else "plain"
            features = [f"{prose}, {min(6, int(math.log2(words)))}, {round(3 * linked)}"]
            if "©" in text or "all rights reserved" in text.lower():
                features.append("sign")
            self.features[run], self.texts[run] = features, text
            if self.kinds[run]:
                self.pieces[run] = [(p, owner or run) for p, _, owner in pieces]

    def _features(self, tag: str, attributes: str, ignored: Iterable[str] = ()) -> tuple[list[str], bool]:
        """Features of an element, and whether it announces itself as something else."""
        features, names = [f"<{tag}>"], {tag}
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "hidden" or m[1].lower() == "style" and re.search(r"display\s*:\s*none", value):
                names.add("hidden")
            elif m[1].lower() != "style":
                names.update(name.lower() for name in NAME.findall(value))
        if tag in ("html", "body"):
            names = set()
        named = (names & OTHER_NAMES).difference(ignored)
        if named:
            features.append("other")
        elif names & CONTENT_NAMES:
            features.append("main")
        return features + sorted(f".{name}" for name in names - {tag}), bool(named)

    def _open(self, tag: str, attributes: str) -> None:
        inside = self.inside[self.stack[-1]] or tag in ("article", "main")
        features, named = self._features(tag, attributes, {"header"} if tag == "header" and inside else ())
        self.places[tag].append(len(self.stack))
        self.stack.append(self._node(self.stack[-1], tag, features, None, inside))
        self.kinds[self.stack[-1]] = KINDS.index("other") if named else KINDS.index("main") if "main" in features else 0

    def _end(self, at: int) -> None:
        """End the open element at a place of the stack, and all inside it."""
        for node in self.stack[at:]:
            self.places[self.tags[node]].pop()
        del self.stack[at:]

    def _close(self, tag: str) -> None:
        if self.places[tag]:
            self._end(self.places[tag][-1])

    def _imply(self, tag: str) -> None:
        """End elements that a start tag ends unsaid: the innermost of its like, if nothing open inside that forbids it."""
        same, until = ("p", ENDS_AT) if tag in CLOSES_PARAGRAPH else (tag, CLOSED_BY_SAME.get(tag, set()))
        if until and self.places[same]:
            at = self.places[same][-1]
            if all(not self.places[name] or self.places[name][-1] < at for name in until):
                self._end(at)

    def _tag_end(self, html: str, at: int) -> int:
        """Where the tag ends whose name ends at a place, quoted values of any length left out; 0 if it doesn't.

        Quotes from which no end was found are remembered, so all searches of a page together are linear.
        """
        seen, end = [], 0
        while sign := TAG_SIGN.search(html, at):
            at = sign.start()
            if sign[0] in "<>":
                end = at + 1 if sign[0] == ">" else 0
                break
            if at in self._endless or sign[0] in self._unquoted:
                break
            seen.append(at)
            if (close := html.find(sign[0], at + 1)) < 0:
                self._unquoted.add(sign[0])
                break
            at = close + 1
        if not end:
            self._endless.update(seen)
        return end

    def _parse(self, html: str) -> None:
        at, links, unclosed = 0, 0, set()
        self._endless, self._unquoted = set(), set()
        self._ready = 0  # so many of the open inline elements know which node of the run their text belongs to
        while m := TOKEN.match(html, at):
            start, at = at, m.end()
            ends, tag, attributes = bool(m[1] or m[4]), (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
            if (m[5] or m[0] == "<") and (name := TAG_START.match(html, start)) and (end := self._tag_end(html, name.end())):
                at, ends, tag, attributes = end, bool(name[1]), name[2].lower(), html[name.end():end - 1]
            if not tag:
                if m[0][0] != "<" or len(m[0]) == 1:
                    self._piece(unescape(m[0]), links > 0)
                continue
            if tag in RAW:
                if ends or tag in unclosed:
                    continue
                if close := re.compile(rf"</{re.escape(tag)}\b[^<>]*>", re.I).search(html, at):
                    at = close.end()
                elif tag in ("script", "style", "textarea", "title"):
                    at = len(html)
                else:
                    unclosed.add(tag)
                continue
            if tag in INLINE:
                links = max(0, links + (1, -1)[ends]) if tag == "a" else links
                if tag == "br":
                    self._piece(" ", False)
                elif ends:
                    self._close_inline(tag)
                elif tag not in VOID:
                    self._open_inline(tag, attributes)
                continue
            self._flush()
            links = 0
            if ends:
                self._close(tag)
            elif tag not in VOID:
                self._imply(tag)
                self._open(tag, attributes)
            self._carry_inline()
        self._flush()

    def labels(self) -> list[int] | None:
        """1 for content, if the page labels itself: one article (or main) that isn't part of another."""
        tops = [n for n, tag in enumerate(self.tags) if tag in ("article", "main") and not self.inside[self.parents[n]]]
        if len(tops) != 1:
            return None
        label = [0] * len(self.tags)
        for n in range(1, len(self.tags)):
            label[n] = int((n == tops[0] or label[self.parents[n]] == 1) and "other" not in self.features[n])
        return label


class Model:
    """Log ratios of features, edge potentials by kind of parent, and the root's."""

    def __init__(self, counts: dict[tuple, float]):
        nodes = [sum(n for k, n in counts.items() if k[0] == "node" and k[1] == label) for label in (0, 1)]
        scale = [min(1.0, STRENGTH / n) if n else 0.0 for n in nodes]
        self.features: dict[str, float] = {}
        names = {k[1] for k in counts if k[0] == "feature"} | set(PSEUDO)
        for name in names:
            pseudo = PSEUDO.get(name, (0.5, 0.5))
            chance = [
                (counts.get(("feature", name, label), 0) * scale[label] + pseudo[label]) / (nodes[label] * scale[label] + sum(pseudo))
                for label in (0, 1)]
            ratio, most = math.log(chance[1] / chance[0]), MOST_NAMED if name in ("other", "main") else MOST
            self.features[name] = max(-most, min(most, ratio))
        self.edges = []
        for kind, pseudo in enumerate(EDGES):
            rows = []
            for parent in (0, 1):
                row = [counts.get(("edge", f"{kind}{parent}", child), 0) for child in (0, 1)]
                weight = min(1.0, STRENGTH / sum(row)) if sum(row) else 0.0
                share = [EDGE_WEIGHT * p / sum(pseudo[parent]) for p in pseudo[parent]]
                row = [n * weight + p for n, p in zip(row, share, strict=True)]
                least = pseudo[parent][1 - parent] / sum(pseudo[parent]) / 4
                rows.append([min(1 - least, max(least, n / sum(row))) for n in row])
            self.edges.append(rows)
        self.root = math.log(ROOT[1] / ROOT[0])

    def marginals(self, page: Page) -> list[float]:
        """Probability that each node is content, by messages up to the root and down to the leaves."""
        n, known = len(page.tags), self.features
        own0, own1 = [0.0] * n, [sum(known.get(name, 0.0) for name in names) for names in page.features]
        own1[0] += self.root
        up0, up1 = [0.0] * n, [0.0] * n
        for at in range(n - 1, 0, -1):
            parent = page.parents[at]
            e0, e1 = self.edges[page.kinds[parent]]
            top = max(own0[at], own1[at])
            x0, x1 = math.exp(own0[at] - top), math.exp(own1[at] - top)
            up0[at] = math.log(e0[0] * x0 + e0[1] * x1) + top
            up1[at] = math.log(e1[0] * x0 + e1[1] * x1) + top
            own0[parent] += up0[at]
            own1[parent] += up1[at]
        for at in range(1, n):  # own* hold beliefs: all messages so far; a parent's is complete before its children's
            parent = page.parents[at]
            e0, e1 = self.edges[page.kinds[parent]]
            rest0, rest1 = own0[parent] - up0[at], own1[parent] - up1[at]
            top = max(rest0, rest1)
            x0, x1 = math.exp(rest0 - top), math.exp(rest1 - top)
            own0[at] += math.log(e0[0] * x0 + e1[0] * x1) + top
            own1[at] += math.log(e0[1] * x0 + e1[1] * x1) + top
            shift = max(own0[at], own1[at])
            own0[at] -= shift
            own1[at] -= shift
        return [1 / (1 + math.exp(min(700.0, max(-700.0, a - b)))) for a, b in zip(own0, own1, strict=True)]

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        content = self.marginals(page)
        return "\n".join(filter(None, (self._shown(page, content, n) for n, p in enumerate(content) if p > 0.5)))

    @staticmethod
    def _shown(page: Page, content: list[float], run: int) -> str | None:
        """The text of a run that is content, without its inline parts that are not, given that it is."""
        if run not in page.pieces:
            return page.texts[run]
        shown, kept = {run: True}, []
        for piece, owner in page.pieces[run]:
            chain = []
            while owner not in shown:
                chain.append(owner)
                owner = page.parents[owner]
            for node in reversed(chain):
                shown[node] = shown[owner] and content[node] > content[run] / 2
                owner = node
            if shown[owner]:
                kept.append(piece)
        return " ".join("".join(kept).split())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of features, edges and nodes by label over labelled pages."""
    counts: Counter = Counter()
    for batch in batches:
        for html in batch.column(0).to_pylist():
            page = Page(html)
            if (label := page.labels()) is None:
                continue
            for n in range(1, len(label)):
                counts["node", str(label[n]), 0] += 1
                counts["edge", f"{page.kinds[page.parents[n]]}{label[page.parents[n]]}", label[n]] += 1
                for name in page.features[n]:
                    counts["feature", name, label[n]] += 1
    rows = [(*key, n) for key, n in counts.items()]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "name", "label", "n"])


def learned(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """Potentials from a bounded sample of pages: all of them, or a share chosen by hash."""
    rows = pages.count()
    drawn = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, rows)))
    table = pages.where(drawn & F.col("html").isNotNull()).select("html").mapInArrow(
        _counted, "part string, name string, label long, n long")
    counts = {}
    for row in table.groupBy("part", "name", "label").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        name = row["name"]
        key = ("node", int(name)) if row["part"] == "node" else (row["part"], name, row["label"])
        counts[key] = row["n"]
    return Model(counts)


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text) of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sent = pages.sparkSession.sparkContext.broadcast(learned(rows, sample))

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = pa.array([model.text(html) for html in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], ["page_id", "url", "text"])

    return rows.mapInArrow(batchwise, "page_id long, url string, text string")
