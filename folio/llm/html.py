"""Main text of web pages by composite text density.

Each page becomes a tree. Boilerplate elements are cut off by tag or role; by class or id, and forms, only if they
don't have most of the text or hold an article, and never if nothing else is left. For every node the
composite density is its characters per tag, adjusted by its share of link text (markup within a line, as b and br, is no node);
the node whose children's densities have the largest sum is the article. The smallest density on its path to
body is the threshold: other subtrees at or above it, off that path, have their own maximum-sum
node taken too, and headings before the article on its way to body are part of it. A tag named article only decides
between equal sums.

The time is linear in the page: stray end tags are told by counts, and at most _DEEP open elements are looked through for one
that a start tag closes (deeper ones stay open).
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import bounded_batches

_TAG = re.compile(
    r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Markup within a line: no node of the tree, as it says nothing about the page's parts.
_INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: So many open elements are looked through for one that a start tag closes.
_DEEP = 200
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in "script style textarea title noscript iframe xmp template".split()}
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that close an open p.
_ENDS_P = _BLOCK - frozenset("br td th tr tbody thead tfoot option optgroup body html head".split())
#: An open element of a kind is closed by a start tag of these, up to one of the outer kinds.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_CUT_TAGS = frozenset("head nav footer aside button select menu dialog svg canvas object video audio".split())
#: Cut like elements with the names below: where their texts agree.
_SUSPECT_TAGS = frozenset(["form", "fieldset"])
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_CUT_NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars aside ad ads adsense advert adverts advertisement "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments disqus reply replies respond widget pagination pager toolbar skip".split()
)
_CUT_OUTSIDE = frozenset(["header", "masthead", "banner", "topbar"])  # unless within the article
_NAME = re.compile(r"[a-z]+", re.I)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_cut(tag: str, attrs: str, inside: bool) -> tuple[bool, str]:
    """(whether an element goes; what else speaks against it: its tag and names, with a ! if a whole name does, or an empty text)."""
    if tag in _CUT_TAGS or tag == "header" and not inside:
        return True, ""
    against = tag if tag in _SUSPECT_TAGS else ""
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
        if name == "role" and value.lower() in _CUT_ROLES:
            if value.lower() != "form":
                return True, ""
            against = against or tag
        if name in ("class", "id"):
            words = {x.lower() for x in _NAME.findall(_SPLIT_CAMEL.sub(" ", value))}
            if words & _CUT_NAMES or not inside and words & _CUT_OUTSIDE:
                whole = not _CUT_NAMES.isdisjoint(value.lower().split())
                against = f"{'!' * whole}{against} {tag} {value}"
    return False, against


class Page:
    """The tree of a page, its boilerplate cut or gone: node i has tag[i], parent[i] < i; runs are (node, text) in page order."""

    def __init__(self, source: str, by_name: bool = True):
        self.tag, self.parent = ["html"], [-1]
        self.against = [""]  # of each node, why it may go
        self.runs: list[tuple[int, str]] = []
        open_: list[tuple[str, int]] = [("html", 0)]  # node -1: within a part that is cut off
        count: dict[str, int] = {"html": 1}  # of the open elements
        cut = 0  # open elements from the cut one on
        inside = 0  # open article and main elements
        pos = 0
        last = source.rfind(">") + 1  # behind it there's no whole tag to look for
        while True:
            m = _TAG.search(source, pos, last)
            end = m.start() if m else len(source)
            if not m and (open_comment := source.find("<!--", pos)) >= 0:
                end = open_comment
            if end > pos and not cut:
                text = source[pos:end]
                self.runs.append((open_[-1][1], entities.unescape(text) if "&" in text else text))
            if not m:
                break
            pos = m.end()
            if pos == last and source.startswith("<!--", end) and not source.endswith("-->", end + 4, pos):
                break
            name = m[2] or m[5]
            if not name:
                continue
            tag, attrs, closing = name.lower(), m[3] or m[6] or "", bool(m[1] or m[4])
            if closing:
                down = 0
                if count.get(tag, 0) and tag != "html":
                    at = len(open_) - 1
                    while open_[at][0] != tag:  # all of these close now
                        at -= 1
                    down = len(open_) - at
            else:
                down = self._closed_by(tag, open_, count)
            for _ in range(down):
                gone, node = open_.pop()
                count[gone] -= 1
                inside -= gone in ("article", "main")
                if cut and len(open_) < cut:
                    cut = 0
                if gone in _BLOCK and node >= 0:
                    self.runs.append((open_[-1][1], "\n"))
            if closing:
                if tag in ("p", "br") and not cut:
                    self.runs.append((open_[-1][1], "\n"))
                continue
            if tag in _BLOCK and not cut:
                self.runs.append((open_[-1][1], "\n"))
            if tag in _RAW:
                if (e := _RAW[tag].search(source, pos)) or tag != "title":
                    pos = e.end() if e else len(source)
                continue
            if tag in ("html", "body") and count.get(tag, 0):
                continue
            if tag in _VOID:
                if not cut and tag not in _INLINE:
                    self._add(tag, open_[-1][1])
                continue
            count[tag] = count.get(tag, 0) + 1
            if cut:
                open_.append((tag, -1))
            else:
                goes, against = _is_cut(tag, attrs, inside > 0) if tag not in ("html", "body") else (False, "")
                if goes:
                    open_.append((tag, -1))
                    cut = len(open_)
                elif tag in _INLINE and not against:
                    open_.append((tag, open_[-1][1]))
                else:
                    open_.append((tag, self._add(tag, open_[-1][1], against)))
            inside += tag in ("article", "main")
        self.gone = self._cut_by_name() if by_name else [False] * len(self.tag)
        self.runs = [(node, text) for node, text in self.runs if not self.gone[node]]

    def _cut_by_name(self) -> list[bool]:
        """Which nodes go: those under a name of boilerplate, unless their texts say otherwise.

        Elements of the same names are judged together and stay if they have most of the page's text, but not beside
        an article if a whole class or id is a name of boilerplate. One that holds an article stays if most of its text isn't links. So does an article, if all articles have such names.
        """
        n = len(self.tag)
        gone = [False] * n
        if not any(self.against):
            return gone
        chars, links, holds = [0] * n, [0] * n, [False] * n
        for node, text in self.runs:
            chars[node] += len(" ".join(text.split())) if text != "\n" else 0
        for i in range(n - 1, -1, -1):
            if self.tag[i] == "a":
                links[i] = chars[i]
            own = self.tag[i] in ("article", "main") and not self.against[i] and chars[i] > 0
            if (p := self.parent[i]) >= 0:
                chars[p] += chars[i]
                links[p] += links[i]
                holds[p] = holds[p] or holds[i] or own
            holds[i] = holds[i] or own
        kept_alone = not holds[0]
        shares: dict[str, int] = {}
        around: dict[str, int] = {}  # names of the elements around, which are counted already
        path: list[int] = []
        for i in range(1, n):
            while path and path[-1] != self.parent[i]:
                around[self.against[path.pop()]] -= 1
            path.append(i)
            name = self.against[i]
            if name and not around.get(name, 0):
                shares[name] = shares.get(name, 0) + chars[i]
            around[name] = around.get(name, 0) + 1
        within = [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]]
            within[i] = within[self.parent[i]] or self.tag[i] in ("article", "main") and not self.against[i]
            if gone[i] or not self.against[i]:
                continue
            beside = not (kept_alone or holds[i] or within[i]) and "!" in self.against[i]
            if 2 * shares[self.against[i]] > chars[0] and not beside:
                continue
            article = holds[i] or kept_alone and self.tag[i] in ("article", "main")
            gone[i] = not article or 2 * links[i] >= chars[i]
        return gone

    def _add(self, tag: str, parent: int, against: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.against.append(against)
        return len(self.tag) - 1

    @staticmethod
    def _closed_by(tag: str, open_: list[tuple[str, int]], count: dict[str, int]) -> int:
        """How many open elements a start tag closes."""
        down = 0
        if tag == "body" and count.get("head", 0):
            down = next(n for n, (t, _) in enumerate(reversed(open_), 1) if t == "head")
        ends, outer = _CLOSES.get(tag, (frozenset(), frozenset()))
        if not (tag in _ENDS_P and count.get("p", 0) or any(count.get(t, 0) for t in ends)):
            return down
        for i in range(len(open_) - 1, max(0, len(open_) - _DEEP), -1):
            t = open_[i][0]
            if t in ends or t == "p" and tag in _ENDS_P:
                down = max(down, len(open_) - i)
                if t == "p" and not ends:
                    break
            elif t in outer or t in ("table", "article", "section", "div", "body", "td", "nav", "ul", "ol"):
                break
        return down

    def densities(self) -> tuple[list[float], list[float], list[int]]:
        """(composite density, sum of the children's densities, characters) of each node."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.runs:
            chars[node] += len(" ".join(text.split())) if text != "\n" else 0
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if self.gone[i]:
                continue
            if self.tag[i] == "a":
                link_chars[i], link_tags[i] = chars[i], tags[i] + 1
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
        body = self.tag.index("body") if "body" in self.tag else 0
        share = link_chars[body] / max(1, chars[body])
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c, t = chars[i], max(1, tags[i])
            if c:
                lc, lt = link_chars[i], link_tags[i]
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                ratio = c / max(1, lc) * t / max(1, lt)
                density[i] = c / t * math.log(max(ratio, 1.0)) / max(math.log(base), 1.0)
        for i in range(1, n):
            sums[self.parent[i]] += density[i]
        return density, sums, chars

    def main_text(self) -> str:
        density, sums, chars = self.densities()
        n, body = len(self.tag), self.tag.index("body") if "body" in self.tag else 0

        within = [False] * n
        for i in range(n):
            within[i] = not self.gone[i] and (i == body or self.parent[i] >= 0 and within[self.parent[i]])
        # of equal sums, that of an article, then that of the outermost node
        best = max((i for i in range(n) if within[i]), key=lambda i: (sums[i], self.tag[i] in ("article", "main"), -i))
        if not sums[best]:
            best = body
        path, at = {best}, best
        while at != body and self.parent[at] >= 0:
            path.add(at := self.parent[at])
        threshold = min(density[i] for i in path)
        chosen = [False] * n
        chosen[best] = True
        densest = list(range(n))  # of each subtree, the node with the largest sum, the outermost of those
        for i in range(n - 1, 0, -1):
            if within[i] and i != body:
                p = self.parent[i]
                if (sums[densest[i]], -densest[i]) > (sums[densest[p]], -densest[p]):
                    densest[p] = densest[i]
        for i in range(n):  # other parts of the page that are as dense as the way to the article
            if not within[i] or i in path:
                continue
            if threshold and density[i] >= threshold:
                chosen[densest[i]] = True
            elif self.tag[i] in _HEADINGS and i < best and self.parent[i] in path:  # what the article begins with
                chosen[i] = True
        for i in range(1, n):
            chosen[i] = chosen[i] or chosen[self.parent[i]]
        return " ".join("".join(text if chosen[node] else "\n" if text == "\n" else "" for node, text in self.runs).split())


def main_text(source: str | None) -> str:
    """The main text of a page; empty if it has none. Null is empty."""
    return Page(source).main_text() or Page(source, by_name=False).main_text() if source else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of pages but the html, and text, n_chars (its code points). Columns of these names are replaced.

    Null and empty pages have an empty text. Pages are handled one by one, each whole.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(kept)).to_pylist()]
            new = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*kept, "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    had = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    return pages.select(*[f"`{c}`" for c in kept], f"`{html_col}`").mapInArrow(run, f"{had}text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
