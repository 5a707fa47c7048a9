"""Main-text extraction by wrapper induction.

Each host has a reference page, the one with the smallest hash of its identifier. A page's DOM tree is aligned
with the reference's by simple tree matching: two nodes match if their tags do, and the matching of their
children in order is a maximum. Runs of same-tag leaves (paragraphs, list items) are matched as one list. Over
all pages of a host, texts are counted by the node they are aligned with: blocks that stand on a fifth of its
different contents or more, and on five at least or on all, are the template of the host; other blocks are slots, and slots
are the content. A check follows: where the largest article or main element holds half of the slots' text or
more, slots outside it are dropped, and if all of that element's text is template, it is kept. Elements made for
other uses (nav, form, ...) are never content. Parts whose class or identifier is, as a whole, a name of menus,
adverts, comments and the like aren't either, unless they wrap the article, the main element or the slots.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm.common import arrow_map, fresh, materialise, table
from emberflow.llm.language_id import host_of
from emberflow.llm.textkit import slices

#: References are broadcast only up to so many bytes in all; beyond that pages meet theirs in a salted join.
BROADCAST_BYTES, SALTS = 48 << 20, 16
#: Parsed references that a worker remembers.
REMEMBERED = 256
#: A block is template if it is on so large a share of the host's different contents, and on so many at least (or on all).
SHARE, LEAST = 0.2, 5
#: On hosts of fewer pages, what is on most of them says nothing.
FEW = 4
#: Hosts whose pages differ in less than this share of their text have no template: they may be copies of one page.
ALIKE = 0.05

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr dd dt li option optgroup legend summary".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("article aside body html main section table td th ul ol dl div nav header footer form".split())
NEVER = frozenset("nav aside form button select dialog menu svg canvas object audio video head".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words by which parts of pages name themselves.
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond replies disqus pagination pager toolbar skip".split()
)
#: With these, and no other words, a name of the words above is a known compound (site-header, share-buttons).
BESIDE = frozenset("site global top bottom left right main primary secondary box container wrapper wrap inner outer list item items links link block blocks bar buttons button icons icon area section form posts slot unit text message google fixed sticky".split())
#: A named part that holds so large a share of the slots' text, on a page without article or main element, wraps the content.
WRAPS = 0.9

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "never", "named", "children", "parent")

    def __init__(self, tag: str, never: bool, named: bool, parent: Node | None):
        self.tag, self.never, self.named, self.parent = tag, never, named, parent
        self.children: list[Node | str] = []


def _is_never(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in NEVER or tag in ("header", "footer") and not (inside_article and tag == "header"):
        return True
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in NEVER_ROLES:
            return True
    return False


def _is_named(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether a class or identifier is one of NEVER_NAMES as a whole, or a known compound; within an article, header is none of them."""
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for whole in (a or b or c).split():
                words = {w.lower() for w in _NAME.findall(whole)}
                if inside_article:
                    words.discard("header")
                if words & NEVER_NAMES and words <= NEVER_NAMES | BESIDE:
                    return True
    return False


def parse(html: str) -> Node:
    """A tree of elements and texts, with end tags implied where HTML implies them. Never fails; what isn't a tag is text."""
    root = Node("#root", False, False, None)
    at, stack, pos, articles = root, ["#root"], 0, 0
    while m := _TOKEN.match(html, pos):
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[:2] != "<!" and text[:2] != "<?":
                at.children.append(text)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in stack:
                if tag not in SCOPES and tag != "p" and tag not in BLOCK and any(s in BLOCK for s in stack[len(stack) - stack[::-1].index(tag) :]):
                    continue  # an inline end tag doesn't close blocks
                while stack[-1] != tag:
                    articles -= stack.pop() == "article"
                    at = at.parent
                articles -= stack.pop() == "article"
                at = at.parent
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        if tag in CLOSES_P and "p" in stack:
            at = _close(at, stack, ("p",))
        if tag in CLOSED_BY:
            at = _close(at, stack, CLOSED_BY[tag])
        never, named = _is_never(tag, m.group(3), articles > 0), _is_named(tag, m.group(3), articles > 0)
        node = Node(tag, never or named and tag not in BLOCK, named, at)
        at.children.append(node)
        if tag not in VOID and not m.group(3).endswith("/"):
            at = node
            stack.append(tag)
            articles += tag == "article"
    return root


def _close(at: Node, stack: list[str], tags: tuple[str, ...]) -> Node:
    """Closes the innermost open element of ``tags``, unless a container stands between."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k] in tags:
            while len(stack) > k:
                stack.pop()
                at = at.parent
            return at
        if stack[k] in SCOPES:
            return at
    return at


class Block_:
    """A run of text between the edges of block elements."""

    __slots__ = ("node", "parts", "text")

    def __init__(self, node: Node):
        self.node, self.parts, self.text = node, [], ""


def blocks(root: Node) -> list[Block_]:
    """The blocks of a tree in page order, without those of parts that are never content; those of named parts are among them."""
    out: list[Block_] = []
    now = Block_(root)

    def end(node: Node) -> None:
        nonlocal now
        now.text = " ".join(unescape("".join(now.parts)).split())
        if now.text:
            out.append(now)
        now = Block_(node)

    todo: list[tuple[Node | str, bool]] = [(root, False)]
    owner = root
    while todo:
        x, leaving = todo.pop()
        if isinstance(x, str):
            now.parts.append(x)
        elif leaving:
            owner = x.parent or root
            while owner.tag not in BLOCK and owner.parent:
                owner = owner.parent
            end(owner)
        elif x.tag == "br":
            now.parts.append(" ")
        elif not x.never:
            if x.tag in BLOCK:
                end(x)
                todo.append((x, True))
            todo.extend((c, False) for c in reversed(x.children))
        elif x.tag in BLOCK:
            end(now.node)
    end(root)
    return out


def _groups(node: Node) -> list[tuple[str, list[Node]]]:
    """A node's element children, with runs of same-tag leaves as one list."""
    out: list[tuple[str, list[Node]]] = []
    for c in node.children:
        if isinstance(c, str):
            continue
        leaf = not any(isinstance(x, Node) and x.tag in BLOCK for x in c.children)
        if leaf and out and out[-1][0] == f"{c.tag}*":
            out[-1][1].append(c)
        else:
            out.append((f"{c.tag}*" if leaf else c.tag, [c]))
    return out


def match(a: Node, b: Node, pairs: dict[int, Node] | None = None, memo: dict | None = None) -> int:
    """The size of the maximum matching of two trees with equal root tags; ``pairs`` gets the partner in ``b`` of each
    matched node of ``a`` by id(). Trees may be of any depth."""
    memo = {} if memo is None else memo
    grouped: dict[int, list] = {}
    todo = [(a, b)]
    total = _weigh(a, b, memo, grouped)
    if pairs is None:
        return total
    while todo:
        x, y = todo.pop()
        pairs[id(x)] = y
        gx, gy = grouped[id(x)], grouped[id(y)]
        m = _grid(gx, gy, memo)
        i, j = len(gx), len(gy)
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                if gx[i][0].endswith("*"):
                    for p, q in zip(gx[i][1], gy[j][1], strict=False):
                        pairs[id(p)] = q
                else:
                    todo.append((gx[i][1][0], gy[j][1][0]))
    return total


def _weigh(a: Node, b: Node, memo: dict, grouped: dict[int, list]) -> int:
    """The size of the maximum matching; ``memo`` gets those of all pairs of nodes that it needs, children first."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (id(x), id(y)) in memo:
            todo.pop()
            continue
        for n in (x, y):
            if id(n) not in grouped:
                grouped[id(n)] = _groups(n)
        gx, gy = grouped[id(x)], grouped[id(y)]
        open_ = [(p[0], q[0]) for s, p in gx if s[-1] != "*" for t, q in gy if s == t and (id(p[0]), id(q[0])) not in memo]
        if open_:
            todo.extend(open_)
        else:
            memo[(id(x), id(y))] = 1 + _grid(gx, gy, memo)[-1][-1]
            todo.pop()
    return memo[(id(a), id(b))]


def _grid(gx: list, gy: list, memo: dict) -> list[list[int]]:
    m = [[0] * (len(gy) + 1) for _ in range(len(gx) + 1)]
    for i, (tx, nx) in enumerate(gx):
        row, above = m[i + 1], m[i]
        for j, (ty, ny) in enumerate(gy):
            best = row[j] if row[j] > above[j + 1] else above[j + 1]
            if tx == ty:
                w = above[j] + (min(len(nx), len(ny)) if tx.endswith("*") else memo[(id(nx[0]), id(ny[0]))])
                if w > best:
                    best = w
            row[j + 1] = best
    return m


def _under(node: Node, top: Node) -> bool:
    while node is not None:
        if node is top:
            return True
        node = node.parent
    return False


class Reference:
    """A parsed reference page: its tree, and the numbers of its nodes in page order."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.number: dict[int, int] = {}
        todo = [self.root]
        while todo:
            n = todo.pop()
            self.number[id(n)] = len(self.number)
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


def aligned(root: Node, found: list[Block_], ref: Reference) -> list[int]:
    """For each block a digest of its place and text. Its place is the reference's node that its node is aligned with,
    or, where there is none and in runs of same-tag leaves, its tag below the place of its parent."""
    pairs: dict[int, Node] = {}
    match(root, ref.root, pairs)
    place = {id(root): "0"}
    todo = [root]
    while todo:
        n = todo.pop()
        for tag, group in _groups(n):
            below = f"{zlib.crc32(f'{place[id(n)]}/{tag}'.encode()):x}"
            for c in group:
                place[id(c)] = str(ref.number[id(pairs[id(c)])]) if tag[-1] != "*" and id(c) in pairs else below
            todo.extend(group)
    return [int.from_bytes(blake2b(f"{place[id(b.node)]} {b.text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for b in found]


def extract(html: str | None, ref: Reference | None = None, template: frozenset[int] | None = None) -> str:
    """The main text of a page; without ``template``, the digests of the host's constant blocks, every block is a slot."""
    root = parse(html or "")
    found = blocks(root)
    constant: set[int] = set()
    if template and found:
        constant = {id(b) for b, d in zip(found, aligned(root, found, ref), strict=True) if d in template}
    named = _named_slot(found)
    found = _without_named(root, found, constant, named, template is not None)
    slots = [b for b in found if id(b) not in constant]
    if named is None:
        return "\n".join(b.text for b in slots)
    inside = [b for b in found if _under(b.node, named)]
    own = [b for b in inside if id(b) not in constant]
    if template is not None and 2 * _chars(own) < _chars(slots):
        own = slots  # most of what varies is elsewhere
    return "\n".join(b.text for b in own or inside)


def _without_named(root: Node, found: list[Block_], constant: set[int], article: Node | None, told: bool) -> list[Block_]:
    """The blocks but those of named parts, unless a part wraps the article or main element or, where the page has none
    and alignment has ``told`` slots, the slots and half of the page's text."""
    wraps: set[int] = set()
    if article is not None:
        n = article
        while n is not None:
            wraps.add(id(n))
            n = n.parent
    elif told and not _has_article(root):
        size: dict[int, int] = {}
        for b in found:
            n = b.node
            while n is not None and id(b) not in constant:
                if n.named:
                    size[id(n)] = size.get(id(n), 0) + len(b.text)
                n = n.parent
        total = _chars([b for b in found if id(b) not in constant])
        wraps = {i for i, x in size.items() if x >= WRAPS * total and 2 * x >= _chars(found)}
    out = []
    for b in found:
        n = b.node
        while n is not None and not (n.named and id(n) not in wraps):
            n = n.parent
        if n is None:
            out.append(b)
    return out


def _has_article(root: Node) -> bool:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main"):
            return True
        todo.extend(c for c in n.children if isinstance(c, Node))
    return False


def _chars(found: list[Block_]) -> int:
    return sum(len(b.text) for b in found)


def _named_slot(found: list[Block_]) -> Node | None:
    """The article, or else the main element, that holds the most text; of nested ones the outer."""
    size: dict[int, int] = {}
    named: dict[int, Node] = {}
    for b in found:
        outer: dict[str, Node] = {}
        n = b.node
        while n is not None:
            if n.tag in ("article", "main"):
                outer[n.tag] = n
            n = n.parent
        for x in outer.values():
            named[id(x)] = x
            size[id(x)] = size.get(id(x), 0) + len(b.text)
    for tag in ("article", "main"):
        own = [x for x in named.values() if x.tag == tag]
        if own:
            return max(own, key=lambda x: size[id(x)])
    return None


def _meet(rows: DataFrame, facts: DataFrame, host: str, salt_by: str, broadcast: bool) -> DataFrame:
    """``rows`` with their host's row of ``facts``, whose column is ``host`` too; large hosts spread over tasks."""
    facts = facts.withColumnRenamed(host, f"{host}_h")
    if broadcast:
        return rows.join(F.broadcast(facts), F.col(host) == F.col(f"{host}_h"), "left").drop(f"{host}_h")
    salt, own = fresh([*rows.columns, *facts.columns], "salt", "own")
    spread = facts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(own, F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return salted.join(spread, (F.col(host) == F.col(f"{host}_h")) & (F.col(own) == F.col(salt)), "left").drop(own, salt, f"{host}_h")


def templates(pages: DataFrame, body: str, h: str, ref: str, broadcast: bool) -> DataFrame:
    """(``h``, template): the digests of blocks that are constant over the host's pages; ``pages`` has the columns ``body``,
    ``h`` and ``ref``. Hosts without two pages of different content, or whose pages hardly differ, have no row.

    Near copies of one page are no support for what they share: pages count once for each longest block that isn't
    on most of the host's pages (on a host of fewer than ``FEW`` pages, for each longest block).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, Reference] = {}
        for whole in batches:
            for b in slices(whole, body):
                keys, sizes = [], []
                for page, host, x in zip(b.column(body).to_pylist(), b.column(h).to_pylist(), b.column(ref), strict=True):
                    root = parse(page)
                    found = blocks(root)
                    own = {d: len(y.text) for d, y in zip(aligned(root, found, _remembered(parsed, host, x)), found, strict=True)} if found else {}
                    keys.append(list(own))
                    sizes.append(list(own.values()))
                yield pa.RecordBatch.from_arrays([b.column(h), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))], ["h", "keys", "sizes"])

    seen = arrow_map(pages, work, "h string, keys array<bigint>, sizes array<bigint>").where("size(keys) > 0")
    seen = seen.withColumn("page", F.xxhash64(F.array_sort("keys"))).dropDuplicates(["h", "page"])
    seen = materialise(seen, "html-blocks")
    each = seen.select("h", F.explode("keys").alias("key")).groupBy("h", "key").agg(F.count("*").alias("n"))
    n_pages = seen.groupBy("h").agg(F.count("*").alias("pages")).where(F.col("pages") >= 2)
    most = _meet(each.where("n >= 2"), n_pages.where(F.col("pages") >= FEW), "h", "key", broadcast).where("2 * n > pages").groupBy("h").agg(F.collect_list("key").alias("most"))
    with_most = _meet(seen, most, "h", "page", broadcast)
    sized = F.filter(F.arrays_zip("sizes", "keys"), lambda x: F.col("most").isNull() | ~F.array_contains("most", x["keys"]))
    chars = lambda sizes: F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n)
    told = with_most.select("h", "keys", F.coalesce(F.array_max(sized)["keys"], F.lit(0)).alias("content"), chars(sized["sizes"]).alias("own"), chars("sizes").alias("all"))
    support = told.select("h", "content", F.explode("keys").alias("key")).distinct().groupBy("h", "key").agg(F.count("*").alias("n")).where("n >= 2")
    differing = told.groupBy("h", "content").agg(F.sum("own").alias("own"), F.sum("all").alias("all")).groupBy("h").agg(F.count("*").alias("contents"), F.sum("own").alias("own"), F.sum("all").alias("all"))
    contents = differing.where((F.col("contents") >= 2) & (F.col("own") >= ALIKE * F.col("all"))).select("h", "contents")
    constant = _meet(support, contents, "h", "key", broadcast).where(F.col("n") >= F.greatest(SHARE * F.col("contents"), F.least("contents", F.lit(LEAST)))).groupBy("h").agg(F.collect_list("key").alias("template"))
    return contents.join(constant, "h", "left").select(F.col("h").alias(h), F.coalesce("template", F.array().cast("array<bigint>")).alias("template"))


def _remembered(parsed: dict[str, Reference], host: str, html: pa.Scalar) -> Reference:
    if host not in parsed:
        if len(parsed) >= REMEMBERED:
            parsed.pop(next(iter(parsed)))
        parsed[host] = Reference(html.as_py() or "")
    return parsed[host]


def html_extract(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", carry: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each row's ``carry`` columns (default ``key`` and ``url``) and its text and n_chars.

    Blocks have their white space made single spaces and their character references decoded, and are
    joined by line ends in page order. Null and empty pages, and pages without content, have empty text. A
    null or relative address is of the empty host. Broken mark-up is read as browsers do, as far as text goes.
    Repeated rows are treated alike; an empty table stays empty.
    """
    carry = carry or [key, url]
    body, h, one, template, order = fresh(carry, "body", "host", "one", "template", "order")
    quoted = [F.col(f"`{c}`") for c in carry]
    pages = df.select(*quoted, F.coalesce(F.col(html), F.lit("")).alias(body), host_of(F.col(url)).alias(h), F.xxhash64(key, url).alias(order))
    refs = pages.where(F.col(body) != "").groupBy(h).agg(F.min_by(body, F.struct(order, body)).alias(one))
    size = df.select(host_of(F.col(url)).alias("h"), F.octet_length(html).alias("n")).groupBy("h").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    small = 2 * size <= broadcast_bytes
    refs = materialise(refs, "html-references")
    pages = pages.drop(order)
    facts = refs.join(templates(_meet(pages.select(body, h), refs, h, body, small), body, h, one, small), h, "left")
    met = _meet(pages, facts, h, body, small).select(*quoted, body, h, one, template)
    more = T._parse_datatype_string("text string, n_chars bigint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, Reference] = {}
        known: dict[str, frozenset[int] | None] = {}
        for whole in batches:
            for b in slices(whole, body):
                texts = []
                for page, host, x, y in zip(b.column(body).to_pylist(), b.column(h).to_pylist(), b.column(one), b.column(template), strict=True):
                    ref = _remembered(parsed, host, x)
                    if host not in known:
                        if len(known) >= REMEMBERED:
                            known.pop(next(iter(known)))
                        known[host] = frozenset(y.as_py()) if y.is_valid else None
                    texts.append(extract(page, ref, known[host]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*carry, "text", "n_chars"])

    return arrow_map(met, work, T.StructType([*(pages.schema[c] for c in carry), *more.fields]))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


QUERIES, SQL = {"op6_html_extract": op6_html_extract}, {}
