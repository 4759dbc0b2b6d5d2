"""Main text of web pages by a site style tree.

The DOMs of all pages of a host are merged into one tree. A node is told apart by its path of
element names and classes; containers without a class right below the body by their place as well.
Every node has two importances, both from entropies over the host's pages:

- presentation: the entropy of the sequences of children it has on the pages. Menus, footers and
  adverts look alike on every page, an article does not.
- content: one less the mean entropy of its texts' spread over pages, so what many pages share is
  worth nothing. Times the words it has on a page, this is the information the node carries.

A container's importance is its information as a share of that of its most informative sibling
(VOLUME of it) and its presentation (the rest). A branch below LOW is removed from each page, as is
a text whose node has less content importance than LOW_TEXT. Hosts with few pages lean on the tree of
all hosts, which counts as PRIOR pages.

Names decide only what HTML itself says is no article: scripts, styles, forms and controls, hidden
parts, landmarks of navigation and the like; and reader comments, which are as diverse as articles.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, lean, read
from .op10_urls import host_and_path

LOW, LOW_TEXT = 0.3, 0.3  # containers and texts of less importance are removed
VOLUME = 0.7  # weight of information in a container's importance; the rest is its presentation
PRIOR = 3.0  # the tree of all hosts counts as so many pages of a host
REMOVED = 1_000_000  # removed nodes that are broadcast at most: a long each

#: Element and role names as HTML and ARIA define them, and names of reader comments.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select option datalist noscript template svg math object canvas audio video dialog menu map".split()) | RAW
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption blockquote pre figure figcaption address details summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments replies disqus".split())
ENDS = {
    "p": frozenset("p".split()), "li": frozenset("p li".split()), "dt": frozenset("p dt dd".split()), "dd": frozenset("p dt dd".split()),
    "tr": frozenset("p tr td th li dt dd".split()), "td": frozenset("p td th li dt dd".split()), "th": frozenset("p td th li dt dd".split()),
}
IMPLIED = frozenset("p li dt dd tr td th".split())  # elements that another one may end

_TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_MASK = (1 << 64) - 1
_TURN = 0x9E3779B97F4A7C15


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def _no_article(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    """What HTML itself says is no main text, and reader comments."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return any(w.lower() in COMMENTS for key in ("class", "id") for w in _WORDS.findall(attrs.get(key, "")))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Page:
    """The elements of a page that hold text, and its blocks of text in page order.

    Element k has a node (hash of its path), a parent element (-1 above the first), its key, and
    whether it is a container, which may be judged as a branch. A block is (element, text). All
    work is linear in the page, however deep or broken its markup.
    """

    def __init__(self, page: str):
        self.node, self.parent, self.key, self.container = [_hash("")], [-1], [""], [False]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, element, dropped, in an article
        open_, held, places = {}, [], {}

        def close() -> None:
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    self.blocks.append((stack[-1][1], text))

        def pop_to(k: int) -> None:
            close()
            for name, *_ in stack[k:]:
                open_[name] -= 1
            del stack[k:]

        at, end, lower = 0, len(page), None
        while at < end:
            m = _TAG.search(page, at)
            start = m.start() if m else end
            dropped = stack[-1][2]
            if start > at and not dropped:
                held.append(entities.unescape(page[at:start]))
            if not m:
                break
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if m["end"]:
                if open_.get(name):
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    pop_to(k)
                elif name not in INLINE and not dropped:
                    close()
                continue
            if name in VOID:
                if name in ("br", "hr") and held:
                    held.append(" ")
                continue
            attrs = _attributes(m["attrs"]) if m["attrs"] else {}
            if name in RAW:
                lower = lower if lower is not None else page.lower()
                found = lower.find(f"</{name}", at)
                at = end if found < 0 else page.find(">", found) + 1 or end
                continue
            inside = stack[-1][3]
            drop = dropped or _no_article(name, attrs, inside)
            if name in INLINE and (dropped or not drop):
                continue
            close()
            if name not in INLINE:
                k = len(stack) - 1
                ends = ENDS.get(name, ENDS["p"])
                while stack[k][0] in IMPLIED:
                    if stack[k][0] in ends:
                        pop_to(k)
                    elif stack[k][0] in ("td", "th", "tr") and name not in ("td", "th", "tr"):
                        break
                    k -= 1
                drop = stack[-1][2] or _no_article(name, attrs, stack[-1][3])
                inside = stack[-1][3]
            if m["attrs"].rstrip().endswith("/") and name in ("svg", "math", "path"):
                continue
            above = stack[-1][1]
            element = above
            if not drop:
                kind = "".join(sorted({"." + w.lower() for w in _WORDS.findall(attrs.get("class", ""))})) if attrs else ""
                key, container = name + kind, name not in TEXTUAL and name not in INLINE and name not in ("html", "body")
                if container and not kind and stack[-1][0] in ("body", "html", ""):
                    places[above, name] = place = places.get((above, name), 0) + 1
                    key += f"#{place}"
                element = len(self.node)
                self.node.append(xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), self.node[above]))
                self.parent.append(above)
                self.key.append(key)
                self.container.append(container)
            stack.append((name, element, drop, inside or name in ("article", "main")))
            open_[name] = open_.get(name, 0) + 1
        if not stack[-1][2]:
            close()

    def observations(self):
        """(node, parent's node, container, kind, value, words): 's' once a node, its children and its words; 'c' once for each text of a node."""
        n = len(self.node)
        words, text, children = [0] * n, [0] * n, [0] * n
        for k, block in self.blocks:
            words[k] += block.count(" ") + 1
            text[k] = (text[k] * _TURN + _hash(block)) & _MASK
            children[k] = (children[k] * _TURN + 1) & _MASK
        for k in range(n - 1, 0, -1):  # children come after their parents
            if words[k]:
                up = self.parent[k]
                words[up] += words[k]
                text[up] = (text[up] * _TURN + text[k]) & _MASK
                children[up] = (children[up] * _TURN + _hash(self.key[k])) & _MASK
        merged: dict[int, list] = {}
        for k in range(n):
            if words[k]:
                mine = merged.setdefault(self.node[k], [self.parent[k], self.container[k], 0, 0, set()])
                mine[2] += words[k]
                mine[3] = (mine[3] * _TURN + children[k]) & _MASK
                mine[4].add(text[k])
        for node, (up, container, size, kids, texts) in merged.items():
            above = self.node[up] if up >= 0 else 0
            yield node, above, container, "s", kids, size
            for value in texts:
                yield node, above, container, "c", value, 0

    def text(self, removed) -> str:
        """The blocks that lie in no removed node, joined."""
        gone = [node in removed for node in self.node]
        for k in range(1, len(gone)):
            gone[k] = gone[k] or gone[self.parent[k]]
        return " ".join(block for k, block in self.blocks if not gone[k])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mixed(host: np.ndarray | np.uint64, node: np.ndarray) -> np.ndarray:
    """One number for a host's hash and a node; host 0 is the tree of all hosts."""
    out = (node ^ host) * np.uint64(_TURN)
    return out ^ (out >> np.uint64(29))


def _observed(rows: DataFrame) -> DataFrame:
    schema = "host string, node long, above long, container boolean, kind string, value long, words long"

    def run(batches):
        for pdf in batches:
            out = [(host, signed(a), signed(b), c, kind, signed(v), w) for host, page in zip(pdf["host"], pdf["html"], strict=True) if page for a, b, c, kind, v, w in Page(page).observations()]
            yield pd.DataFrame(out, columns=["host", "node", "above", "container", "kind", "value", "words"])

    return rows.select("host", "html").mapInPandas(lean(run), schema)


def importances(seen: DataFrame, keys: list[str]) -> DataFrame:
    """keys, above, container -> pages, words (of a page), presentation, texts, content.

    Of m observations of which k have the same value, the values' entropy is log(m) less the mean of
    log(k); presentation is that over log(m). Content is one less the mean entropy of the texts'
    spread over pages, the same quotient.
    """
    each = seen.groupBy(*keys, "above", "container", "kind", "value").agg(F.sum("k").alias("k"), F.sum("words").alias("words"))
    m, klogk = F.sum("k"), F.sum(F.col("k") * F.log(F.col("k").cast("double")))
    stats = each.groupBy(*keys, "above", "container", "kind").agg(m.alias("m"), klogk.alias("klogk"), F.sum("words").alias("words"))
    spread = 1 - F.col("klogk") / (F.col("m") * F.log(F.col("m").cast("double")))
    value = F.greatest(F.lit(0.0), F.when(F.col("m") <= 1, 1.0).otherwise(spread))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    return stats.withColumn("value", value).groupBy(*keys, "above", "container").agg(of("s", F.col("m")).alias("pages"), of("s", F.col("words") / F.col("m")).alias("words"), of("s", F.col("value")).alias("presentation"), of("c", F.col("m")).alias("texts"), of("c", F.col("value")).alias("content"))


def low(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes that are removed: containers by importance beside their siblings, others by content."""
    most = nodes.groupBy(*keys, "above").agg(F.max(F.col("words") * F.col("content")).alias("most"))
    joined = nodes.join(most, [*keys, "above"])
    share = F.when(F.col("most") > 0, F.col("words") * F.col("content") / F.col("most")).otherwise(0.0)
    importance = VOLUME * share + (1 - VOLUME) * F.col("presentation")
    return joined.where((F.col("container") & (importance < LOW)) | (~F.col("container") & (F.col("above") != 0) & (F.col("content") < LOW_TEXT))).select(*keys, "node")


def style_tree(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, node) of the branches to remove; the tree of all hosts has the null host."""
    seen = _observed(rows).groupBy("host", "node", "above", "container", "kind", "value").agg(F.count("*").alias("k"), F.sum("words").alias("words"))
    seen = scratch.write(seen, "seen")
    own = scratch.write(importances(seen, ["host", "node"]), "own")
    every = scratch.write(importances(seen, ["node"]), "every")
    usual = every.select("node", "above", "container", *(F.col(c).alias(f"usual_{c}") for c in ("words", "presentation", "content")))
    blend = lambda c, m: ((F.col(m) * F.col(c) + PRIOR * F.col(f"usual_{c}")) / (F.col(m) + PRIOR)).alias(c)
    # only small hosts lean on the tree of all; a node of it is met by as many hosts as have it
    blended = own.join(usual, ["node", "above", "container"]).select("host", "node", "above", "container", blend("words", "pages"), blend("presentation", "pages"), blend("content", "texts"))
    found = low(scratch.write(blended, "blended"), ["host"])
    everywhere = low(every, []).select(F.lit(None).cast("string").alias("host"), "node")
    return scratch.write(found.unionByName(everywhere), "removed")


class Removed:
    """Which nodes of a host are removed: a sorted table of hashes, of a bounded size."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def of(self, host: int, nodes: list[int]) -> set[int]:
        own = np.unique(np.array(nodes, dtype=np.uint64))
        if not len(self.table):
            return set()
        marks = mixed(np.uint64(host), own)
        at = np.minimum(np.searchsorted(self.table, marks), len(self.table) - 1)
        return set(own[self.table[at] == marks].tolist())


def main_text(page: str, own: set[int] | frozenset = frozenset(), usual: set[int] | frozenset = frozenset()) -> str:
    """The page's text without the host's removed nodes; if none is left, without those of all hosts; else all."""
    read_ = Page(page)
    return read_.text(own) or read_.text(usual) or read_.text(frozenset())


def host_hash(host: str) -> int:
    return _hash(host) | 1


def by_broadcast(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """rows with their text; the removed nodes, counted to be few, go to the pages."""
    found = removed.toArrow()
    hosts = np.array([0 if h is None else host_hash(h) for h in found.column("host").to_pylist()], dtype=np.uint64)
    nodes = found.column("node").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(np.unique(mixed(hosts, nodes)))

    @F.pandas_udf("string")
    def text_of(host: pd.Series, page: pd.Series) -> pd.Series:
        removed_, out = Removed(shared.value), []
        for h, p in zip(host, page, strict=True):
            if not p:
                out.append("")
                continue
            read_ = Page(p)
            out.append(read_.text(removed_.of(host_hash(h), read_.node)) or read_.text(removed_.of(0, read_.node)) or read_.text(frozenset()))
        give_back()
        return pd.Series(out, dtype=object)

    return rows.select("page_id", "url", text_of("host", "html").alias("text"))


def by_join(rows: DataFrame, removed: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with their text; pages meet the removed nodes that they have by a join on host and node."""

    def run(batches):
        for pdf in batches:
            out = []
            for host, ph, page in zip(pdf["host"], pdf["ph"], pdf["html"], strict=True):
                out += [(host, ph, signed(n)) for n in set(Page(page).node)] if page else []
            yield pd.DataFrame(out, columns=["host", "ph", "node"])

    pages = rows.select("host", F.xxhash64("html").alias("ph"), "html")
    has = scratch.write(pages.mapInPandas(lean(run), "host string, ph long, node long").distinct(), "has")
    every = has.join(removed.where("host is null").select("node"), "node").select("host", "ph", "node", F.lit(False).alias("own"))
    own = has.join(removed.where("host is not null"), ["host", "node"]).select("host", "ph", "node", F.lit(True).alias("own"))
    lists = own.unionByName(every).groupBy(F.col("host").alias("rhost"), F.col("ph").alias("rph"))
    lists = scratch.write(lists.agg(F.collect_list(F.when(F.col("own"), F.col("node"))).alias("own"), F.collect_list(F.when(~F.col("own"), F.col("node"))).alias("usual")), "lists")

    @F.pandas_udf("string")
    def text_of(page: pd.Series, own: pd.Series, usual: pd.Series) -> pd.Series:
        whole = lambda x: {int(n) & _MASK for n in x} if x is not None else frozenset()
        out = [main_text(p, whole(o), whole(u)) if p else "" for p, o, u in zip(page, own, usual, strict=True)]
        give_back()
        return pd.Series(out, dtype=object)

    joined = rows.join(lists, (F.col("host") == F.col("rhost")) & (F.xxhash64("html") == F.col("rph")), "left")
    return joined.select("page_id", "url", text_of("html", "own", "usual").alias("text"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = REMOVED) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Null and empty pages have an empty text; so has a page of markup only. A null url has the empty
    host. Pages that repeat are kept and count in the style tree as often as they occur; a page of
    which the host's tree leaves nothing keeps what the tree of all hosts finds important, or else
    all of it. Broken, unclosed and cut off markup is read as far as it goes, pages of any length
    and depth whole. An empty table gives an empty result. Other columns are ignored. If more than
    `broadcast` nodes are to be removed, pages are joined with them instead, with the same result.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    removed = style_tree(rows, scratch)
    out = by_broadcast(rows, removed) if removed.count() <= broadcast else by_join(rows, removed, scratch)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_html(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))
