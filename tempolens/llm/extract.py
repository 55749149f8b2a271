"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged by path.  A node of the merged
tree is important when its presentation (the sequence of child elements) and its
content (the texts of its blocks) vary from page to page, and unimportant when
they repeat; both are measured as entropies.  Priors by element and name lower
the importance further.  From each page the branches of low importance go, and
the blocks that are left are its text.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

# Element names of the HTML standard and usual words in class names and ids.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
select summary table tbody td tfoot th thead tr ul""".split())
#: An opening element closes open ones of these names, up to the nearest of the others.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "body": (("head",), ("html",)),
}
#: Parts of running text, lists and tables.
TEXT_LEVEL = frozenset("""blockquote caption center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup legend li ol p pre summary
table tbody td tfoot th thead tr ul""".split())
NO_CONTENT = frozenset("""head nav footer aside form dialog menu search button select option textarea script style title noscript
template iframe object embed svg canvas video audio""".split())
#: Elements that hold no text of a page even where nothing else is left.
CONTROLS = NO_CONTENT - frozenset("aside dialog footer form".split())
#: Elements that class names do not make less important.
WHOLE = frozenset("html body main article".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies disqus footer hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup
promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe
subscription toolbar widget widgets""".split())
#: Words that beside a noise word do not change what a name says: ``comment-list``, unlike ``related-work``.
PART_WORDS = frozenset("""area bar block body bottom box container content entry global group head inner item items left links list main
outer page panel placeholder posts right row section site slot thread top unit wrap wrapper""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
AUTHOR_WORDS = frozenset("author avatar byline commenter nick nickname poster reviewer user username vcard".split())
DATE_WORDS = frozenset("ago date datetime posted published time timestamp".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

#: Parts of the pages of one host and shape in the join with their low nodes.
SALT = 8

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_LETTERS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Tree:
    """The block elements of a page in order: path (hash), parent, prior and style; and the text blocks with their node."""

    path: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)  # in an article or main element
    named: list[bool] = field(default_factory=list)
    style: list[list[str]] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    gone: list[bool] = field(default_factory=list)  # hidden
    strict: list[bool] = field(default_factory=list)  # a class name or id says nothing but noise
    marks: list[int] = field(default_factory=list)  # 1 an author, 2 a date in the branch


def _marks(name: str, words: set[str]) -> int:
    return (1 if words & AUTHOR_WORDS else 0) | (2 if name == "time" or words & DATE_WORDS else 0)


def _label(name: str, attrs: str) -> tuple[str, set[str], bool, bool]:
    """Element with its class names and id (digits left out), the words in them, whether one of them is all noise, and whether it is hidden."""
    if not attrs or attrs.isspace():
        return name, set(), False, False
    got = {k.lower(): _html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)}
    names = " ".join(got.get(k, "") for k in ("class", "id"))
    parts = [set(_LETTERS.findall(_CAMEL.sub(" ", x).lower())) for x in names.split()]
    words = set().union(*parts)
    strict = any(x & NOISE_WORDS and x <= NOISE_WORDS | PART_WORDS for x in parts)
    if got.get("role", "").lower() in NOISE_ROLES:
        words.add("nav")
        strict = True
    if got.get("rel", "").lower() == "author" or got.get("itemprop", "").lower() == "author":
        words.add("author")
    gone = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    return " ".join([name, *sorted(set(re.sub(r"\d+", "", names).split()))]), words, strict, gone


def parse(page: str) -> Tree:
    """Blocks of text with the elements around them; unclosed and stray tags are tolerated."""
    t = Tree()
    stack: list[tuple[str, int, bool]] = []  # open elements: name, node around its text, whether that is its own
    text: list[str] = []

    def node() -> int:
        return stack[-1][1] if stack else -1

    def flush() -> None:
        if text:
            s = " ".join(_html.unescape("".join(text)).split())
            if s:
                t.blocks.append((node(), s))
            text.clear()

    def close(name: str, until: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                if any(x[2] for x in stack[k:]):
                    flush()
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    at = 0
    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if name == "p" and not any(x[0] == "p" for x in stack):
                flush()
            elif name == "br":
                text.append(" ")
            else:
                close(name, ("table",) if name not in ("table", "body", "html") else ())
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in RAW:
            found = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if m.group(3).endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK:
            flush()
            if name not in ("html", "body", "head") and any(x[0] == "p" for x in stack):
                close("p", ("article", "aside", "button", "div", "section", "td", "th", "li", "table"))
            for other in CLOSES.get(name, ((), ()))[0]:
                close(other, CLOSES[name][1])
        label, words, strict, gone = _label(name, m.group(3))
        up = node()
        if name not in BLOCK and not (gone or name in NO_CONTENT):  # part of running text, whatever its name
            if up >= 0:
                t.marks[up] |= _marks(name, words)
            stack.append((name, up, False))
            continue
        inside = name in ("article", "main") or up >= 0 and t.inside[up]
        prior = 1.0
        if gone or name in NO_CONTENT or name == "header" and not inside:
            prior = 0.0
        elif name in WHOLE or name in HEADINGS:
            pass
        elif strict or not inside and (words & NOISE_WORDS or "header" in words):
            prior = 0.5
        if up >= 0:
            if not t.style[up] or t.style[up][-1] != label:
                t.style[up].append(label)
        if name not in BLOCK:
            flush()
        t.path.append(xxhash.xxh3_64_intdigest(label.encode(), (t.path[up] if up >= 0 else 0) & (1 << 64) - 1) - (1 << 63))
        t.parent.append(up)
        t.prior.append(prior)
        t.inside.append(inside)
        t.named.append(" " in label)
        t.name.append(name)
        t.gone.append(gone)
        t.strict.append(strict)
        t.marks.append(_marks(name, words))
        t.style.append([])
        stack.append((name, len(t.path) - 1, True))
    flush()
    _spare_content(t)
    _cut_replies(t)
    return t


def _cut_replies(t: Tree) -> None:
    """Take out reader comments by structure, whatever their names: elements of one path, one after another, each with an author and a date.

    Comments stand beside or in an article; where each article of the page is
    one of them (lists of posts, threads) they are its content and stay.  A
    single article in an article with an author and a date is a comment too.
    What stands around them goes along if it holds nothing but them, headings
    and controls.
    """
    if not any(t.marks) or "article" not in t.name:
        return
    n = len(t.path)
    marks, children = list(t.marks), [[] for _ in range(n)]
    for k in range(n - 1, -1, -1):
        if (up := t.parent[k]) >= 0:
            marks[up] |= marks[k]
            children[up].insert(0, k)
    own = {k for k, _ in t.blocks}
    above: list[bool] = []  # in an article
    alike: dict[tuple[int, int], list[int]] = {}
    for k, up in enumerate(t.parent):
        above.append(up >= 0 and (above[up] or t.name[up] == "article"))
        if up >= 0 and marks[k] == 3 and t.name[k] not in ("html", "body", "main", "header", "hgroup", "tr", "td", "p"):
            alike.setdefault((up, t.path[k]), []).append(k)
    replies = {k for ks in alike.values() for k in ks if len(ks) > 1 or t.name[k] == "article" and above[k]}
    within: list[bool] = []
    for k, up in enumerate(t.parent):
        within.append(k in replies or up >= 0 and within[up])
    if not any(t.name[k] == "article" and not within[k] for k in range(n)):
        return
    for k in replies:
        t.prior[k] = 0.0
    for k in {t.parent[k] for k in replies}:
        rest = [c for c in children[k] if c not in replies]
        if t.name[k] not in WHOLE and k not in own and all(t.name[c] in HEADINGS or t.name[c] in NO_CONTENT for c in rest):
            t.prior[k] = 0.0


def _spare_content(t: Tree, clear: float = 0.1) -> None:
    """Take the prior from elements around the page's content: ``has-sidebar`` names a wrapper, not a sidebar.

    Those are html, body and main and what is around one; what is around an
    article, unless a longer one has no prior above it (comments and teasers are
    articles too); and layout elements with most of the page's text, unless
    article and main elements without a prior hold ``clear`` as much.  An element
    whose name is all noise keeps its prior while some article has none.
    """
    if all(p == 1.0 for p in t.prior):
        return
    size = [0] * len(t.path)
    for k, s in t.blocks:
        if k >= 0:
            size[k] += len(s)
    free: list[bool] = []
    for k, p in enumerate(t.prior):
        free.append(p == 1.0 and (t.parent[k] < 0 or free[t.parent[k]]))
    open_text = sum(n for k, n in enumerate(size) if free[k] and t.inside[k])
    longest, whole = [0] * len(t.path), [x in WHOLE and x != "article" for x in t.name]
    for k in range(len(t.path) - 1, -1, -1):  # children come after their parent
        if t.name[k] == "article":
            longest[k] = max(longest[k], size[k])
        if (up := t.parent[k]) >= 0:
            size[up] += size[k]
            longest[up] = max(longest[up], longest[k])
            whole[up] = whole[up] or whole[k]
    best = max((n for k, n in enumerate(size) if free[k] and t.name[k] == "article"), default=0)
    total = sum(len(s) for _, s in t.blocks)
    for k in range(len(t.path)):
        layout = not t.gone[k] and (t.name[k] == "form" or t.name[k] not in NO_CONTENT)
        if best and t.strict[k] and not whole[k]:
            continue
        if whole[k] or longest[k] and longest[k] >= best or layout and 2 * size[k] > total and open_text < clear * size[k]:
            t.prior[k] = 1.0


def main_text(tree: Tree, importance: dict[int, float], low: float = 0.6, low_inside: float = 0.2) -> str:
    """The blocks of which no branch above is of low importance, joined by a space.

    A single heading, paragraph, list item or cell of low importance stays where
    the branch around it is kept as text: headings and values repeat in content.
    In an article or main element only named elements can be low, and by a
    stricter limit; a prior by name comes there only from a name that is all
    noise (``comment-list``, not ``related-work``), and never to headings and
    parts of running text.  When the site's importance would leave nothing, the priors
    alone decide; when they leave nothing either, the branch with the most text
    stays that is not in a control.
    """
    children: list[list[int]] = [[] for _ in tree.path]
    own = {k for k, _ in tree.blocks}
    for k, up in enumerate(tree.parent):
        if up >= 0:
            children[up].append(k)

    def keep(imp: dict[int, float]) -> list[bool]:
        fine, cut = [], []  # by prior and importance; by prior alone
        for k, p in enumerate(tree.path):
            v = imp.get(p, 1.0)
            cut.append(tree.prior[k] < low)
            if tree.inside[k]:
                fine.append(not cut[k] and (v >= low_inside or not tree.named[k]))
            else:
                fine.append(v * tree.prior[k] >= low)
        ok: list[bool] = []
        content: list[bool] = []  # kept, and its parts are text: a list or table, or with text of its own that varies
        for k, up in enumerate(tree.parent):
            part = up >= 0 and content[up] and tree.name[k] in TEXT_LEVEL
            # a list or table below a container is a branch, its rows and a heading are single blocks
            single = part and (not children[k] or tree.name[up] in TEXT_LEVEL)
            ok.append((fine[k] or single and not cut[k]) and (up < 0 or ok[up]))
            text = tree.name[k] in TEXT_LEVEL or tree.inside[k] or tree.name[k] not in ("html", "body") and (
                k in own or any(fine[c] and (tree.name[c] in TEXT_LEVEL or tree.name[k] == "section") for c in children[k]))
            content.append(ok[k] and text)
        return ok

    for imp in (importance, {}):
        ok = keep(imp)
        out = [s for k, s in tree.blocks if k < 0 or ok[k]]
        if out:
            return " ".join(out)
    # texts by the nearest element with a prior
    near: list[int] = []
    branches: dict[int, list[str]] = {}
    for k, up in enumerate(tree.parent):
        control = tree.name[k] in CONTROLS and tree.prior[k] < low
        near.append(-1 if control or up >= 0 and near[up] < 0 else k if tree.prior[k] < low or up < 0 else near[up])
    for k, s in tree.blocks:
        if near[k] >= 0:
            branches.setdefault(near[k], []).append(s)
    return " ".join(max(branches.values(), key=lambda b: sum(map(len, b)), default=[]))


def branch_hashes(t: Tree) -> list[int]:
    """For each node a hash of all text in its branch; 0 without text."""
    own: list[list[int]] = [[] for _ in t.path]
    for k, s in t.blocks:
        if k >= 0:
            own[k].append(xxhash.xxh3_64_intdigest(s.encode()))
    out = [0] * len(t.path)
    for k in range(len(t.path) - 1, -1, -1):  # children come after their parent
        if own[k]:
            out[k] = own[k][0] if len(own[k]) == 1 else xxhash.xxh3_64_intdigest(",".join(map(str, own[k])).encode())
            if t.parent[k] >= 0:
                own[t.parent[k]].append(out[k])
    return out


def copy_key(t: Tree) -> int:
    """Hash of the page's content, shared by its copies under other addresses.

    Made of the blocks at least half as long as the longest one, without those
    under a prior: dates, counters and links beside the text differ in copies.
    """
    ok: list[bool] = []
    for p, up in zip(t.prior, t.parent):
        ok.append(p == 1.0 and (up < 0 or ok[up]))
    blocks = [s for k, s in t.blocks if k < 0 or ok[k]]
    least = max(map(len, blocks), default=0) / 2
    return xxhash.xxh3_64_intdigest("\n".join(s for s in blocks if len(s) >= least).encode()) - (1 << 63)


PAGE = "host string, copy long, shape long, nodes array<struct<path: long, kind: int, feature: long>>"


def page_nodes(pages: DataFrame) -> DataFrame:
    """One row for each page: host, copy (:func:`copy_key`), shape (:func:`shape`) and its nodes, each (path, kind, feature) once.

    Kind 0 is the node itself (path 0 the page), 1 its presentation, 2 the text of its branch.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64()]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                copies, shapes, ends, rows = [], [], [0], []
                for page in part.column("html").to_pylist():
                    t = parse(page or "")
                    once = {(0, 0, 0)}
                    for p, style, text in zip(t.path, t.style, branch_hashes(t)):
                        once.add((p, 0, 0))
                        once.add((p, 1, xxhash.xxh3_64_intdigest(" > ".join(style).encode()) - (1 << 63)))
                        if text:
                            once.add((p, 2, text - (1 << 63)))
                    rows += sorted(once)
                    ends.append(len(rows))
                    copies.append(copy_key(t))
                    shapes.append(shape(t))
                flat = pa.StructArray.from_arrays([pa.array(c, x) for c, x in zip(list(zip(*rows)) or [()] * 3, types)], ["path", "kind", "feature"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), pa.array(copies, pa.int64()), pa.array(shapes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["host", "copy", "shape", "nodes"])

    return pages.select("host", "html").mapInArrow(cut, PAGE)


def shape(t: Tree) -> int:
    """Hash of the page's set of paths."""
    return xxhash.xxh3_64_intdigest(",".join(map(str, sorted(set(t.path)))).encode()) - (1 << 63)


def distinct_pages(nodes: DataFrame) -> DataFrame:
    """One of the pages of each host and copy key (the least by its nodes)."""
    return nodes.groupBy("host", "copy").agg(F.min("nodes").alias("nodes"))


def style_tree(nodes: DataFrame) -> DataFrame:
    """The merged trees: (host, path, m, style, styles, texts, repeats) of every node; path 0 counts the host's pages.

    m: pages that have the node; styles and style: number of its presentations,
    and sum of n ln n over them; texts and repeats: number of distinct texts of
    its branch, and sum of ln n over them.
    """
    n, kind = F.col("n"), F.col("kind")
    return (nodes.select("host", F.explode("nodes").alias("node"))
            .groupBy("host", "node.path", "node.kind", "node.feature").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("host", "path").agg(
                F.sum(F.when(kind == 0, n)).alias("m"),
                F.count(F.when(kind == 1, n)).alias("styles"), F.coalesce(F.sum(F.when(kind == 1, n * F.log(n))), F.lit(0.0)).alias("style"),
                F.count(F.when(kind == 2, n)).alias("texts"), F.coalesce(F.sum(F.when(kind == 2, F.log(n))), F.lit(0.0)).alias("repeats")))


def low_nodes(pages: DataFrame, low: float = 0.6, **options) -> DataFrame:
    """(host, nodes): the paths of low importance of each host with their importance, as a map, every page counted."""
    return (low_rows(page_nodes(pages), low, **options)
            .groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("nodes")))


def low_rows(nodes: DataFrame, low: float = 0.6, min_pages: int = 5, gamma: float = 0.9) -> DataFrame:
    """(host, path, importance): the nodes of low importance.

    Importance of a node: (1 - gamma^s) presentation + gamma^s content, with s its
    number of presentations.  Presentation is their entropy, content 1 less the
    mean of ln n over the branch's texts, both divided by ln m.  Only nodes in
    ``min_pages`` pages count.
    """
    t = materialize(style_tree(nodes), "style-tree")
    m = F.log("m")
    presentation = (m - F.col("style") / F.col("m")) / m
    content = F.when(F.col("texts") > 0, 1 - F.col("repeats") / F.col("texts") / m).otherwise(0.0)
    weight = F.pow(F.lit(gamma), F.col("styles"))
    return (t.where((F.col("path") != 0) & (F.col("m") >= min_pages))
            .select("host", "path", ((1 - weight) * presentation + weight * content).alias("importance"))
            .where(F.col("importance") < low))


def extract_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", low: float = 0.6, **options) -> DataFrame:
    """``pages`` plus ``text``, the main text of each page (a column of that name is replaced).

    Defined cases: a null or empty page has an empty text; pages without a url
    are one host; pages with one content (:func:`copy_key`) count once; an empty
    table gives no rows.  ``options`` go to :func:`low_rows`.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), _HOST, 1), F.lit("")))
    kept = [c for c in pages.columns if c.lower() != "text"]
    src = pages.select(F.struct(*kept).alias("page"), host.alias("host"), F.col(html_col).alias("html"))
    nodes = materialize(page_nodes(src), "page-nodes")
    rows = materialize(low_rows(distinct_pages(nodes), low, **options), "low-nodes")
    # what is low in a page depends on its host and paths only, so each set of paths of a host is looked up once
    paths = (nodes.select("host", "shape", F.explode("nodes").alias("node")).where("node.kind = 0 and node.path <> 0")
             .select("host", "shape", "node.path").distinct())
    found = paths.join(rows, ["host", "path"]).groupBy(F.col("host").alias("l_host"), F.col("shape").alias("l_shape")).agg(
        F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("nodes"))
    # written, so its size is known: a small table is broadcast and the pages are not shuffled; dealt out in SALT parts otherwise
    found = materialize(found, "low-shapes").withColumn("l_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))

    @F.arrow_udf("long")
    def shape_of(html: pa.Array) -> pa.Array:
        return pa.array([shape(parse(h or "")) for h in html.to_pylist()], pa.int64())

    @F.arrow_udf("string")
    def text(html: pa.Array, nodes: pa.Array) -> pa.Array:
        return pa.array([main_text(parse(h), dict(n or ()), low) if h else "" for h, n in zip(html.to_pylist(), nodes.to_pylist())], pa.string())

    keyed = src.withColumns({"shape": shape_of(F.col("html")), "salt": F.pmod(F.xxhash64("html"), F.lit(SALT)).cast("int")})
    same = (F.col("host") == F.col("l_host")) & (F.col("shape") == F.col("l_shape")) & (F.col("salt") == F.col("l_salt"))
    return keyed.join(found, same, "left").select("page.*", text(F.col("html"), F.col("nodes")).alias("text"))
