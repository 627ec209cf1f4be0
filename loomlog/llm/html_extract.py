"""Operator 1: main text of web pages by equivalence classes of a host's tokens.

Tokens of a page are its elements, told apart by their path (names with class and id),
and its blocks of text with the path they stand in. Over the pages of a host each token
has an occurrence vector, its count on every page. Tokens with one vector are an
equivalence class; the vector is summed up as a hash that adds over pages, so classes come
from an aggregation that takes all pages in and gathers none. A class is a candidate
with ``SIZE`` tokens or more on ``SUPPORT`` of the host's pages. A second pass
over all pages tests candidates: on each page a class's tokens must come in its one
order, over and over (ordered), and each occurrence of it must lie apart from those of another
class or between two neighbouring tokens of one, or the other way round (nested; else
the class on fewer pages, or with fewer tokens, is at fault). Classes that hold on ``VALID`` of their pages are the host's template, nested as they
are. Its text tokens are the text that the template itself consists of; slots are the
spaces in its innermost elements, and the slot that holds most text which no class
holds is the main one.

A page without an article (or ``main``) gives the text in its host's main slot, less the
template's own text that stands on ``CONSTANT`` of the pages. In an article, a block is the
template's if its text and its element are tokens of one class: an element that
comes on the same pages, as often, always with that text. A line that is merely
frequent shares its vector with no element and stays. In either case, elements that are no part
of an article by their name, role, class or id go.

Character references are decoded, white space in a block becomes one space, blocks are
joined by a line feed. Null or empty html gives an empty text; an unfinished tag at the
end of a page is dropped; a null url is a host of its own name (""); a host with fewer
than ``LEAST_PAGES`` pages has no template; repeated rows are each answered and count in
the vectors; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caches, common

#: Share of a host's pages that a class stands on, that repeat a text left out without an article, and that a class must hold on.
SUPPORT, CONSTANT, VALID = 0.3, 0.9, 0.95
#: Tokens of a class; pages of a class.
SIZE, LEAST_PAGES = 3, 5

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id\s*=|role|hidden|style|itemprop", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: What a start tag ends, up to the nearest of these.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = frozenset("ul ol dl table td th tr article section div body nav aside footer main blockquote".split())
#: Elements, roles and words of class or id that are no part of an article.
OUT = frozenset("head script style noscript template svg iframe object audio video canvas select option button textarea form nav menu footer aside dialog datalist title".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "nav navbar navigation topnav subnav menu menubar masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notification alert share sharing social comment comments reply replies disqus respond related recommended recommendations breadcrumb breadcrumbs newsletter subscribe subscription signup login search widget widgets pagination pager copyright modal popup overlay toolbar skip tracking hidden".split()
)
#: Beginnings of such words; words that are so only outside an article.
OUT_BEGINS = ("advert", "sponsor", "cookie", "sidebar", "footer", "breadcrumb", "newsletter", "disqus", "sitenav", "sitefooter", "commentlist", "commentform", "commentsection")
OUTER_WORDS = frozenset("header siteheader pageheader legal".split())
ARTICLE_WORDS = frozenset("article entry post story".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """One walk over a page: its tokens in order, counts of element paths, and blocks of text."""

    __slots__ = ("paths", "blocks", "order")

    def __init__(self, html: str):
        self.paths: dict[str, int] = defaultdict(int)
        #: (path, inside an article, left out, text)
        self.blocks: list[tuple[str, bool, bool, str]] = []
        #: Paths of elements, and numbers of blocks.
        self.order: list[str | int] = []
        stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
        held: list[str] = []
        owner = stack[0]
        at = 0

        def flush():
            nonlocal owner
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                if text:
                    self.order.append(len(self.blocks))
                    self.blocks.append((owner[1], owner[2], owner[3], text))
                held.clear()

        def keep(piece: str):
            nonlocal owner
            if piece:
                if not held:
                    owner = stack[-1]
                elif stack[-1][3] != owner[3]:  # an inline part that is left out, or the rest of its block
                    if stack[-1][3]:
                        return
                    flush()
                    owner = stack[-1]
                held.append(piece)

        for m in iter(lambda: TAG.search(html, at), None):
            keep(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            if at == len(html) and html[-1] != ">":
                break  # an unfinished tag
            name = name.lower()
            if m[1] or m[4]:
                if name in BLOCK:
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in BARRIER and name not in BLOCK:
                        break
                continue
            if name in BLOCK:
                flush()
                _close(stack, ("p",))
            if name in CLOSES:
                _close(stack, CLOSES[name])
            if name == "br":
                keep(" ")
            if name in VOID:
                continue
            node = _node(stack[-1], name, m[3] or m[6] or "")
            self.paths[node[1]] += 1
            self.order.append(node[1])
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}", re.I).search(html, at)
                if not end:
                    break
                at = end.start()
                close = html.find(">", at)
                at = len(html) if close < 0 else close + 1
                continue
            stack.append(node)
        else:
            keep(html[at:])
        flush()


def _close(stack: list, names: tuple[str, ...]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in names:
            del stack[k:]
            return
        if stack[k][0] in BARRIER:
            return


_nodes: dict[tuple, tuple[str, str, bool, bool]] = {}
#: Hashes of paths, and classes and templates of hosts, by call and host.
_paths: dict[str, int] = {}
_hosts: dict[tuple[str, str], object] = {}
caches.register("nodes", lambda: (_nodes.clear(), _paths.clear(), _hosts.clear()))


def _of_host(call: str, host: str, column, at: int, read):
    """What ``read`` makes of the host's cell; cells of a host are equal within a call."""
    if (call, host) not in _hosts:
        if len(_hosts) >= 2000:
            _hosts.clear()
        _hosts[call, host] = read(column[at].as_py())
    return _hosts[call, host]


def _node(parent: tuple, name: str, attributes: str) -> tuple[str, str, bool, bool]:
    """name, path, in an article, left out."""
    told = attributes if attributes and TELLING.search(attributes) else ""
    key = (parent[1], name, told)
    found = _nodes.get(key)
    if found is None:
        values = {a.lower(): entities.unescape(b or c or d) for a, b, c, d in ATTRIBUTE.findall(told)}
        label = f"{values.get('class', '')} {values.get('id', '')}".strip()
        words = _SPLIT.split(_CAMEL.sub("-", label).lower())
        outer = () if parent[2] or ARTICLE_WORDS.intersection(words) else OUTER_WORDS
        bad = any((w in OUT_WORDS or w in outer or w.startswith(OUT_BEGINS)) and (k == 0 or words[k - 1] not in ("has", "with", "no", "without")) for k, w in enumerate(words))
        role = values.get("role", "").lower()
        article = parent[2] or name in ("article", "main") or role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody"
        out = (
            parent[3]
            or name in OUT
            or name == "header" and not parent[2]
            or role in OUT_ROLES
            or "hidden" in values
            or "display:none" in values.get("style", "").replace(" ", "").lower()
            or bad and name not in ("html", "body")
        )
        found = (name, f"{parent[1]}>{name}" + (f".{label}" if label else ""), article, out)
        if len(_nodes) < 100_000:
            _nodes[key] = found
    return found


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _path_hash(path: str) -> int:
    found = _paths.get(path)
    if found is None:
        found = _hash(path)
        if len(_paths) < 100_000:
            _paths[path] = found
    return found


def _text_hash(path: str, text: str) -> int:
    return _hash(f"{path}\n{text}")


def _token_of(page: Page, x: str | int) -> int:
    return _path_hash(x) if isinstance(x, str) else _text_hash(page.blocks[x][0], page.blocks[x][3])


def _container(path: str) -> str:
    """The slot that a block lies in: its path without the last element if that's a text element."""
    head, _, last = path.rpartition(">")
    return head if re.match(r"(?:p|h[1-6]|li|b|i|em|strong|a|span|blockquote|pre|dd|dt|td)(?:\.|$)", last) else path


TOKEN = "host string, token long, path string, parent long, pages long, vector long, place long"


def _tokens(batches):
    """A partial sum for each host and token: pages, the vector's hash, places of its first occurrence."""
    caches.only("nodes")
    for b in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, page_id, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            page, own = Page(html), f"{page_id} {_hash(html)}"
            met: dict[int, list] = {}
            for place, x in enumerate(page.order):
                token = _token_of(page, x)
                if token in met:
                    met[token][3] += 1
                elif isinstance(x, str):
                    met[token] = [x, _path_hash(x.rpartition(">")[0]), place, 1]
                else:
                    met[token] = [None, _path_hash(page.blocks[x][0]), place, 1]
            for token, (path, parent, place, n) in met.items():
                s = sums.setdefault((host, token), [path, parent, 0, 0, 0])
                s[2] += 1
                s[3] = (s[3] + _hash(f"{own} {n}")) & 0xFFFFFFFFFFFFFFFF
                s[4] += place
        out = list(sums.items())
        columns = [[k[0] for k, _ in out], [k[1] for k, _ in out], *([v[x] for _, v in out] for x in range(5))]
        columns[5] = np.array(columns[5], np.uint64).view(np.int64) if out else []
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in TOKEN.split(", ")])


def classes_of(pages: DataFrame, hosts: DataFrame, total: int) -> DataFrame:
    """host, n, vector, pages, tokens (in the class's order) of the candidates; hosts: host, n."""
    partial = pages.select("host", "page_id", "html").mapInArrow(_tokens, TOKEN)
    # sums of hashes wrap: they are added as decimals, taken modulo 2^64 and moved into a long's range
    whole = F.sum(F.col("vector").cast("decimal(38,0)"))
    vector = (F.pmod(whole, F.lit("18446744073709551616").cast("decimal(38,0)")) - F.lit("9223372036854775808").cast("decimal(38,0)")).cast("long")
    summed = partial.groupBy("host", "token").agg(F.first("path").alias("path"), F.first("parent").alias("parent"), F.sum("pages").alias("pages"), vector.alias("vector"), F.sum("place").alias("place"))
    # most tokens are texts of one page; a large host's others aren't gathered in one task
    frequent = common.attach(summed.where(F.col("pages") >= LEAST_PAGES), hosts, "host", "n", total).where(F.col("pages") >= SUPPORT * F.col("n"))
    tokens = F.array_sort(F.collect_list(F.struct("place", "token", "parent", "path")))
    return common.materialise(frequent.groupBy("host", "n", "vector", "pages").agg(tokens.alias("tokens")).where(F.size("tokens") >= SIZE), "classes")


class Classes:
    """The candidates of a host, as a page is held against them."""

    def __init__(self, cell: list[dict] | None):
        cell = sorted(cell or (), key=lambda x: (x["pages"], len(x["tokens"]), x["vector"]))
        #: Of each class, in the order of their weight: its number in the table, its size.
        self.vectors = [x["vector"] for x in cell]
        self.sizes = [len(x["tokens"]) for x in cell]
        self.places = {token: (c, k) for c, x in enumerate(cell) for k, token in enumerate(x["tokens"])}

    def faults(self, tokens: list[int]) -> set[int]:
        """Classes that aren't ordered on a page, or cross a weightier one."""
        bad: set[int] = set()
        upto = [0] * len(self.sizes)
        open_: list[int] = []
        for token in tokens:
            if (found := self.places.get(token)) is None or found[0] in bad:
                continue
            c, k = found
            if k != upto[c]:
                bad.add(c)
            elif k == 0:
                open_.append(c)
            else:
                while c not in bad and open_[-1] != c:  # unfinished ones that began inside c
                    bad.add(min(c, open_[-1]))
                    open_ = [x for x in open_ if x not in bad]
            if c in bad:
                open_ = [x for x in open_ if x != c]
                continue
            upto[c] = (k + 1) % self.sizes[c]
            if upto[c] == 0:
                open_.pop()
        return bad.union(open_)


FOUND = "host string, vector long, slot long, value long"


def _judge(batches, call: str):
    """Pages on which classes don't hold, and text that no class holds by the slot it stands in."""
    caches.only("nodes")
    for b in batches:
        sums: dict[tuple, int] = defaultdict(int)
        cells = b.column(2)
        for at, (host, html) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            known = _of_host(call, host, cells, at, Classes)
            if not known.places:
                continue
            page = Page(html)
            tokens = [_token_of(page, x) for x in page.order]
            for c in known.faults(tokens):
                sums[host, known.vectors[c], None] += 1
            for x, token in zip(page.order, tokens, strict=True):
                if isinstance(x, int) and not page.blocks[x][2] and token not in known.places:
                    slot = _container(page.blocks[x][0])
                    while slot and _path_hash(slot) not in known.places:
                        slot = slot.rpartition(">")[0]
                    sums[host, None, _path_hash(slot)] += len(page.blocks[x][3])
        columns = [[k[0] for k in sums], [k[1] for k in sums], [k[2] for k in sums], list(sums.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])


def _beside(rows: DataFrame, known: DataFrame, weight: Column, total: int) -> DataFrame:
    """rows with the columns of their host, if any; known: host, n, ... of some hosts."""
    if known.agg(F.coalesce(F.sum(weight + 64), F.lit(0))).first()[0] <= common.BROADCAST_BYTES:
        return rows.join(F.broadcast(known.drop("n")), "host", "left")
    every = rows.groupBy("host").agg(F.count("*").alias("n")).join(known.drop("n"), "host", "left")
    return common.attach(rows, every, "host", "n", total).drop("n")


def templates(pages: DataFrame) -> DataFrame:
    """host, n (pages), main (path of the main slot), constants (hashes of template texts), twins (those
    whose element is of their class), classes (number of valid ones) of hosts that have
    a template; pages: host, page_id, html."""
    common.prepare(pages.sparkSession)
    hosts = common.materialise(pages.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    classes = classes_of(pages, hosts, total)
    cells = classes.groupBy("host", "n").agg(F.collect_list(F.struct("vector", "pages", F.col("tokens.token").alias("tokens"))).alias("cell"))
    weight = F.aggregate("cell", F.lit(0).cast("long"), lambda acc, x: acc + 8 * F.size(x["tokens"]) + 24)
    call = uuid.uuid4().hex
    held = _beside(pages.select("host", "html"), common.materialise(cells, "class-cells"), weight, total).where("cell is not null").select("host", "html", "cell")
    found = common.materialise(held.mapInArrow(lambda x: _judge(x, call), FOUND).groupBy("host", "vector", "slot").agg(F.sum("value").alias("value")), "judged")
    faults = found.where("vector is not null").select("host", "vector", F.col("value").alias("faults"))
    valid = classes.join(faults, ["host", "vector"], "left").where(F.coalesce("faults", F.lit(0)) <= (1 - VALID) * F.col("pages"))
    valid = common.materialise(valid.drop("faults"), "valid-classes")
    elements = valid.select("host", F.explode(F.filter("tokens", lambda x: x["path"].isNotNull())).alias("x")).select("host", F.col("x.token").alias("slot"), F.col("x.path").alias("path"))
    mains = found.where("slot is not null").join(elements, ["host", "slot"]).groupBy("host").agg(F.max(F.struct("value", "path")).getField("path").alias("main"))
    texts = F.filter("tokens", lambda x: x["path"].isNull())
    own = F.transform(F.filter("tokens", lambda x: x["path"].isNotNull()), lambda x: x["token"])
    parts = valid.select(
        "host", "n",
        F.when(F.col("pages") >= CONSTANT * F.col("n"), F.transform(texts, lambda x: x["token"])).alias("constants"),
        F.transform(F.filter(texts, lambda x: F.array_contains(own, x["parent"])), lambda x: x["token"]).alias("twins"),
    )
    summed = parts.groupBy("host", "n").agg(F.flatten(F.collect_list("constants")).alias("constants"), F.flatten(F.collect_list("twins")).alias("twins"), F.count("*").alias("classes"))
    return summed.join(mains, "host", "left").select("host", "n", "main", "constants", "twins", "classes")


def text_of(html: str, main: str | None, constants: frozenset[int], twins: frozenset[int] = frozenset()) -> str:
    page = Page(html)
    blocks = [x for x in page.blocks if not x[2]]
    if any(x[1] for x in blocks):
        return "\n".join(text for path, article, _, text in blocks if article and not (twins and _text_hash(path, text) in twins))
    blocks = [x for x in blocks if not constants or _text_hash(x[0], x[3]) not in constants]
    if main and (inside := [x for x in blocks if x[0] == main or x[0].startswith(main + ">")]):
        blocks = inside
    return "\n".join(text for *_, text in blocks)


def _template(cell: dict | None) -> tuple:
    cell = cell or {}
    return cell.get("main"), frozenset(cell.get("constants") or ()), frozenset(cell.get("twins") or ())


def _extract(batches, call: str):
    caches.only("nodes")
    for b in batches:
        cells = b.column(4)
        texts = [text_of(html, *_of_host(call, host, cells, at, _template)) for at, (html, host) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").alias("html")).withColumn("host", host_of(F.col("url")))
    cell = F.struct("main", "constants", "twins").alias("cell")
    known = common.materialise(templates(rows).select("host", "n", cell), "templates")
    n = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weight = F.coalesce(F.length("cell.main"), F.lit(0)) + 8 * (F.size("cell.constants") + F.size("cell.twins"))
    call = uuid.uuid4().hex
    held = _beside(rows, known, weight, n).select("page_id", "url", "html", "host", "cell")
    return held.mapInArrow(lambda x: _extract(x, call), "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    return extract(common.table(spark, sf_dir, "pages"))
