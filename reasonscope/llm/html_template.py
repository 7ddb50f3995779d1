"""HTML extraction by equivalence-class template deduction.

Tokens of a page are the opening and the closing of each element, told apart by
their path (tag names with class, id and role words, from the root), and the text
nodes outside dropped elements. Pages of a host with the same text (outside dropped
and doubted elements) are copies and count once. A token's occurrence vector holds
its count on every such page; it is carried as its support and two sums of a hash of
(page's text, count), so vectors are summed over pages in parallel and compared
exactly but for collisions. Tokens with equal vectors form an equivalence class. A
class is valid if it is frequent (``support`` pages) and large (two tokens), and if
every element in it opens and closes within it, which makes it ordered; valid classes
nest by their paths and are the host's template. A text node must also be on over
half of the host's pages, so that a group of edited pages isn't taken for one.

Between the elements of the template are slots: the text nodes of one path. A slot
whose text mostly recurs on the host (adverts, notices from a pool) is dropped, as are
the text nodes of the template, inside main-text elements (article, main) too. Inside
these, texts found in main elements of several hosts stay, and all stay if over half
of the host's text would go: its pages are then edited copies of each other.

Menus, footers, sidebars, adverts, forms, scripts and comments are dropped by element
or whole class, id or role names, or names of several words that say so (user-comments);
a form around the whole page isn't. Names that are also ordinary words (related, search)
need the template's word: inside main text that their text recurs, elsewhere that the
element is in the template. No ancestor of the page's main element drops by its name.

Of the remaining slots those inside main elements are the text, if their varying text
is at least as long as that outside; only those outside, if it is over four times as
long; else both. The measure of the former is the page's largest main element, raised
to the host's mean of that path (to four times its length at most), so that a short
article isn't lost to long comments. Hosts with too few pages have no template; their
elements are judged by their names and their page's lengths alone.

A template is at most one page's tokens per class. Templates are broadcast (one copy
for a worker, whatever its pages) if their measured size is at most ``BROADCAST`` bytes; else pages are joined to them by host,
and hosts with over a thousandth of all pages (a thousand at most) are split in
parts of that size, so that no host lands in one task.

Defined cases: null html or url count as empty; an empty page has an empty text.
Repeated pages each have their row. Unclosed elements end with their parent; a
text cut off inside a tag loses that tag only.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from reasonscope.llm.common import append, cut_lineage, extended, without

SUPPORT = 3
BROADCAST = 8 << 20
PART = 1000
_SPLIT = "\x1e"
WHOLE = 0.8

# Fixed values of HTML: elements without content, whose text isn't shown, that begin a new block.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select"}
MAIN = {"article", "main"}
# Element names of what isn't main text (a header inside main text may be), and whole class, id or role names: those that
# drop by themselves, also as a prefix, and those that are also ordinary words and need the template's word for it.
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", *RAW}
DROPPED_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "promo", "cookie", "cookies", "gdpr", "popup",
                 "modal", "newsletter", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "topbar",
                 "comment", "comments", "disqus", "complementary", "contentinfo"}
DROPPED_PREFIX = re.compile("(?:ads?|advert|cookie|gdpr|newsletter|breadcrumbs?|navbar|sponsored|promo)[-_]")
NAMED = {"consent", "notice", "notices", "alert", "overlay", "subscribe", "menu", "menus", "side", "aside", "header", "reply", "replies",
         "discussion", "share", "sharing", "social", "related", "recommended", "login", "signup", "search", "skip", "sponsor", "promotion",
         "banner"}
# Words that, in a name of several words, tell what an element holds; all others of the name must be of the second set.
TELLING = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "cookie", "cookies", "newsletter", "notice",
           "notices", "promo", "recommended", "related", "share", "sharing", "social", "sponsored"}
PLAIN = {"area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "card", "cards", "container", "feed", "form", "google",
         "group", "holder", "icons", "inline", "inner", "item", "items", "left", "link", "links", "list", "media", "outer", "page", "panel",
         "post", "posts", "reader", "readers", "right", "row", "section", "site", "slot", "stories", "story", "thread", "top", "unit", "user",
         "users", "widget", "wrap", "wrapper", "zone"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# How sure it is that an element isn't main text: UNSURE, if its text recurs on the host; LIKELY, the same inside main text,
# elsewhere if it belongs to the template; SURE.
UNSURE, LIKELY, SURE = 1, 2, 3
# Whole classes or ids of article elements that aren't the page's article.
DROPPED_ARTICLES = {"comment", "comments", "reply", "ad", "advert", "advertisement", "sponsored", "promo", "related", "recommended"}

# Quotes count behind "=" only (<p title=it's> is a tag); possessive, so that an unclosed tag is read once.
# A self-closed svg is empty; a name that only begins like one of RAW (title-card) is an element of its own.
_ATTRIBUTES = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+"
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<svg(?=[\s/])" + _ATTRIBUTES + r"(?<=/)>"
                     r"|<(" + "|".join(RAW) + r")(?=[\s/>])" + _ATTRIBUTES + r">.*?(?:</\1\s*>|\Z)"
                     r"|<(/?)([a-zA-Z][^\s/>]*)(" + _ATTRIBUTES + r")>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_NODES: dict[tuple[str, str], tuple[str, int, bool, bool]] = {}


def _tells(name: str) -> bool:
    """Whether a name of several words says that an element isn't main text (user-comments, share-buttons)."""
    words = _WORD.findall(name)
    return len(words) > 1 and not TELLING.isdisjoint(words) and all(w in TELLING or w in PLAIN for w in words)


def _node(name: str, attributes: str) -> tuple[str, int, bool, bool]:
    """How an element is written in a path; how surely it is dropped; whether main; whether
    a name of several words alone drops it."""
    key = name, attributes if "=" in attributes else ""
    if key not in _NODES:
        found = [(m[0][:2].lower(), (m[1] or m[2] or m[3] or "").lower()) for m in _NAMED.finditer(key[1])]
        names = {n for _, value in found for n in value.split()}
        words = sorted({w for n in names for w in _WORD.findall(n)})
        if len(_NODES) > 1 << 16:
            _NODES.clear()
        main = name in MAIN or ("ro", "main") in found
        level = 0
        if name in DROPPED or main and names & DROPPED_ARTICLES:
            level = SURE
        elif not main and name not in ("html", "body"):
            if any(n in DROPPED_NAMES or DROPPED_PREFIX.match(n) or _tells(n) for n in names):
                level = UNSURE if name in HEADINGS or name in INLINE else SURE
            elif names & NAMED:  # ids of headings and sections are their titles
                level = UNSURE if name in HEADINGS or name in INLINE or name == "section" else LIKELY
        alone = name not in DROPPED and not any(n in DROPPED_NAMES or DROPPED_PREFIX.match(n) for n in names)
        _NODES[key] = ".".join([name, *words]), level, main and level < SURE, level == SURE and alone and not main
    return _NODES[key]


class Page:
    """A page's elements, in the order of their openings, and its items in page order:
    ("open" | "close", element, "") and ("text", element, raw); element -1 is none."""

    def __init__(self, page: str):
        self.names: list[str] = []
        self.paths: list[str] = []
        self.parents: list[int] = []
        self.own: list[int] = []
        self.mains: list[bool] = []
        self.named: list[bool] = []
        self.items: list[tuple[str, int, str]] = []
        self._read(page)
        self._judge()

    def _open(self, name: str, parent: int, written: str, level: int, main: bool, named: bool = False) -> int:
        self.named.append(named)
        self.names.append(name)
        # the hash of the whole path, from the parent's
        self.paths.append(xxhash.xxh64_hexdigest(f"{self.paths[parent] if parent >= 0 else ''}/{written}"))
        self.parents.append(parent)
        self.own.append(level)
        self.mains.append(main)
        self.items.append(("open", len(self.names) - 1, ""))
        return len(self.names) - 1

    def _read(self, page: str) -> None:
        stack: list[int] = []
        names, items = self.names, self.items
        depths: dict[str, list[int]] = {}   # where on the stack the elements of each name are
        blocks: list[int] = []              # and those that aren't inline

        def close(depth: int) -> None:
            while len(stack) > depth:
                items.append(("close", stack.pop(), ""))
                name = names[items[-1][1]]
                depths[name].pop()
                if name not in INLINE:
                    blocks.pop()

        def last(of) -> int:
            """Where the innermost open element of these names is; -1 if none is open."""
            return max((depths[n][-1] for n in of if depths.get(n)), default=-1)

        at = 0
        for m in _MARKUP.finditer(page):
            if m.start() > at:
                items.append(("text", stack[-1] if stack else -1, page[at: m.start()]))
            at = m.end()
            if m[3] is None:
                if m[1]:
                    self._open(m[1].lower(), stack[-1] if stack else -1, m[1].lower(), SURE, False)
                continue
            name = m[3].lower()
            if m[2]:
                if depths.get(name):
                    close(depths[name][-1])
                elif name not in INLINE:
                    items.append(("close", -1, ""))
                continue
            closing = {"p"} if name in ENDS_P else SIBLINGS.get(name)
            if closing:
                inner = last(closing)
                if inner >= 0 and inner >= (blocks[-1] if name == "p" and blocks else last(SCOPES)):
                    close(inner)
            opened = self._open(name, stack[-1] if stack else -1, *_node(name, m[4]))
            if name not in VOID and not m[4].endswith("/"):
                depths.setdefault(name, []).append(len(stack))
                if name not in INLINE:
                    blocks.append(len(stack))
                stack.append(opened)
        if at < len(page):
            items.append(("text", stack[-1] if stack else -1, page[at:]))

    def _can_frame(self, e: int) -> bool:
        return self.names[e] == "form" or self.named[e]

    def _inherit(self) -> None:
        self.levels, self.roots, self.likely = [], [], []
        for e, parent in enumerate(self.parents):
            level, root, likely = (self.levels[parent], self.roots[parent], self.likely[parent]) if parent >= 0 else (0, -1, -1)
            own = self.own[e]
            if root >= 0 and (own == LIKELY or self.names[e] == "header"):
                own = min(own, UNSURE)
            if own == LIKELY and likely < 0:
                likely = e
            level = max(level, own)
            self.levels.append(level)
            self.likely.append(likely)
            self.roots.append(root if root >= 0 or not self.mains[e] or level == SURE else e)

    def _judge(self) -> None:
        """Sets of each element its level, its outermost main element and its outermost
        LIKELY one. No ancestor of the page's main elements (of those with the most
        text, if all are in dropped elements) is dropped by its name. A form, or an element
        named in several words, that holds ``WHOLE`` of the page's text and no less of
        any main element's is the page's frame and doesn't drop."""
        self._inherit()
        framed = [e for e, level in enumerate(self.own) if level == SURE and self._can_frame(e)]
        if not framed and not any(m and self.levels[e] >= LIKELY for e, m in enumerate(self.mains)):
            return
        plain = [0] * len(self.names)
        total = 0
        for kind, e, raw in self.items:
            if kind == "text":
                total += len(raw.strip())
                if e >= 0:
                    plain[e] += len(raw.strip())
        if framed:
            whole = plain.copy()
            for e in range(len(whole) - 1, 0, -1):
                if self.parents[e] >= 0:
                    whole[self.parents[e]] += whole[e]
            total -= sum(whole[e] for e, name in enumerate(self.names) if name == "head")
            for e in framed:
                if whole[e] >= WHOLE * total > 0 and (self.names[e] == "form" or not any(m and whole[i] for i, m in enumerate(self.mains))):
                    self.own[e] = 0
            self._inherit()
        sizes = plain
        for e in range(len(sizes) - 1, 0, -1):
            if self.parents[e] >= 0 and self.own[e] < SURE:
                sizes[self.parents[e]] += sizes[e]
        mains = [e for e, m in enumerate(self.mains) if m and sizes[e]]
        most = max((sizes[e] for e in mains), default=0)
        if any(self.levels[e] < LIKELY and 2 * sizes[e] >= most for e in mains):
            return
        for e in mains:
            if 2 * sizes[e] >= most:
                while (e := self.parents[e]) >= 0:
                    if self.names[e] != "head":
                        self.own[e] = 0
        self._inherit()

    def place(self, e: int) -> tuple[int, int, int]:
        """Level, main element, LIKELY element (-1: none) of an element."""
        return (self.levels[e], self.roots[e], self.likely[e]) if e >= 0 else (0, -1, -1)

    def token(self, e: int, raw: str) -> str:
        """A text node: the hashes of its path and its main element's path, whether it
        needs the template's word ("?"), the hash of its text."""
        level, root, _ = self.place(e)
        return "".join(["=", self.paths[e] if e >= 0 else NO_PATH, self.paths[root] if root >= 0 else NO_MAIN,
                        "?" if level else ".", xxhash.xxh64_hexdigest(" ".join(html.unescape(raw).split()))])


NO_MAIN = "-" * 16
NO_PATH = "." * 16


def page_tokens(parsed: Page) -> dict[str, list[int]]:
    """Count and size (for text nodes the characters, else the count) of the template
    candidates of a page: the openings ("<"), closings (">") of elements, text nodes
    ("="). Besides, "*" stands for the page, "s" for a slot: a path's distinct text
    nodes without a doubted name, and their characters."""
    counts: dict[str, list[int]] = {"*": [1, 1]}
    for kind, e, raw in parsed.items:
        size = 1
        if kind == "text":
            if not raw.strip() or parsed.place(e)[0] == SURE:
                continue
            token, size = parsed.token(e, raw), len(raw.strip())
        elif e >= 0:
            token = ("<" if kind == "open" else ">") + parsed.paths[e]
        else:
            continue
        one = counts.setdefault(token, [0, 0])
        one[0] += 1
        one[1] += size
    for token, (_, size) in list(counts.items()):
        if token[0] == "=" and token[33] == ".":
            one = counts.setdefault("s" + token[1:33], [0, 0])
            one[0] += 1
            one[1] += size
    return counts


def main_text(page: str, template: frozenset[str], weights: dict[str, int] | None = None) -> str:
    """The text of a page's remaining slots. ``template``: tokens; ``weights``: the mean
    varying text of the host's main elements, by the hash of their path."""
    parsed = Page(page)
    kept: dict[bool | None, list[list[str]]] = {True: [[]], False: [[]], None: [[]]}  # None: inside and outside
    sizes: dict[int, int] = {}
    for kind, e, raw in parsed.items:
        if kind != "text":
            if e < 0 or parsed.names[e] not in INLINE:
                for blocks in kept.values():
                    if blocks[-1]:
                        blocks.append([])
            continue
        level, root, likely = parsed.place(e)
        if level == SURE or level == LIKELY and (not template or "<" + parsed.paths[likely] in template):
            continue
        if template and raw.strip():
            token = parsed.token(e, raw)
            if token in template or not level and "s" + token[1:33] in template:
                continue
        sizes[root] = sizes.get(root, 0) + len(raw.strip())
        kept[root >= 0][-1].append(raw)
        kept[None][-1].append(raw)
    outside = sizes.pop(-1, 0)
    inside = max((max(n, min(4 * n, (weights or {}).get(parsed.paths[e], 0))) for e, n in sizes.items()), default=0)
    blocks = kept[True if outside <= inside else False if outside > 4 * inside else None]
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash of the page's text without doubted names, its tokens)."""
    for batch in batches:
        digests, written = [], []
        for page in batch.column("_html").to_pylist():
            parsed = Page(page or "")
            texts = (" ".join(raw.split()) for kind, e, raw in parsed.items if kind == "text" and not parsed.place(e)[0])
            digests.append(xxhash.xxh128_hexdigest("\0".join(t for t in texts if t)))
            written.append(zlib.compress(" ".join(f"{t} {n} {size}" for t, (n, size) in sorted(page_tokens(parsed).items())).encode(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array(digests, pa.string()), pa.array(written, pa.binary())],
                                         names=["host", "digest", "tokens"])


def _read_tokens(written: bytes) -> Iterator[tuple[str, int, int]]:
    parts = zlib.decompress(written).decode().split(" ")
    return zip(parts[::3], map(int, parts[1::3]), map(int, parts[2::3]))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, two hash sums, size), summed within the batch; a slot's
    pages are its text nodes."""
    for batch in batches:
        sums: dict[tuple[str, str], list[int]] = {}
        for host, digest, written in zip(*(batch.column(c).to_pylist() for c in ("host", "digest", "tokens"))):
            for token, n, size in _read_tokens(written):
                mixed = xxhash.xxh64_intdigest(f"{digest} {n}")
                one = sums.setdefault((host, token), [0, 0, 0, 0])
                one[0] += n if token[0] == "s" else 1
                one[1] += mixed >> 32
                one[2] += mixed & 0xFFFFFFFF
                one[3] += size
        if sums:
            keys, values = zip(*sums.keys()), zip(*sums.values())
            yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.string()) for k in keys], *[pa.array(v, pa.int64()) for v in values]],
                                             names=["host", "token", "pages", "high", "low", "size"])


def _main_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, text) of the text nodes in main elements, each once a batch."""
    for batch in batches:
        found = {(host, t[34:]) for host, written in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist())
                 for t, _, _ in _read_tokens(written) if t[0] == "=" and t[17:33] != NO_MAIN}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()) for k in zip(*found)], names=["other", "text"])


def templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``(host, template)``: the template's tokens, as one string."""
    # One page of each group with the same text stands for it.
    distinct = cut_lineage(pages.mapInArrow(_page_rows, "host string, digest string, tokens binary").groupBy("host", "digest").agg(
        F.min("tokens").alias("tokens")))
    kind = F.substring("token", 1, 1)
    every = cut_lineage(distinct.mapInArrow(_token_rows, "host string, token string, pages long, high long, low long, size long").groupBy(
        "host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "high", "low", "size")]).where((F.col("pages") >= support) | (kind == "s")))
    tokens = every.where(kind.isin("<", ">", "="))
    classes = tokens.groupBy("host", "pages", "high", "low").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") > 1)
    member = lambda t: F.when(t.startswith("<"), F.array_contains("tokens", F.concat(F.lit(">"), F.substring(t, 2, 1 << 30)))).when(
        t.startswith(">"), F.array_contains("tokens", F.concat(F.lit("<"), F.substring(t, 2, 1 << 30)))).otherwise(True)
    valid = classes.select("host", "pages", F.explode(F.filter("tokens", member)).alias("token"))
    structure = valid.where(kind != "=").select("host", "token")
    most = every.where(kind == "*").select("host", F.col("pages").alias("most"))
    fixed = valid.where(kind == "=").join(most, "host").where(2 * F.col("pages") > F.col("most")).select("host", "token", F.lit(True).alias("fixed"))

    # Text nodes that recur; not those in main elements of several hosts.
    slot = [F.substring("token", 2, 16).alias("slot"), F.substring("token", 18, 16).alias("root")]
    inside = F.col("root") != NO_MAIN
    recurring = tokens.where(kind == "=").join(fixed, ["host", "token"], "left").select(
        "host", "token", *slot, F.substring("token", 35, 16).alias("text"), (F.substring("token", 34, 1) == "?").alias("doubted"),
        F.coalesce("fixed", F.lit(False)).alias("fixed"), "pages", "size")
    shared = distinct.mapInArrow(_main_texts, "other string, text string").groupBy("text").agg(
        F.min(F.xxhash64("other")).alias("least"), F.max(F.xxhash64("other")).alias("last")).where(
        F.col("least") != F.col("last")).select("text", F.lit(True).alias("shared"))
    recurring = recurring.join(shared, "text", "left").where(~inside | F.col("shared").isNull())

    # Slots of the template whose text is mostly (over three quarters) from a pool.
    plain = recurring.where(~F.col("doubted")).groupBy("host", "slot", "root").agg(
        *[F.sum(F.when(F.col("fixed") == f, F.col(c)).otherwise(0)).alias(n)
          for n, f, c in (("fixed_pages", True, "pages"), ("fixed_size", True, "size"), ("pool_pages", False, "pages"))])
    opened = structure.where(kind == "<").select("host", F.substring("token", 2, 16).alias("slot"), F.lit(True).alias("bounded"))
    slots = every.where(kind == "s").select("host", *slot, "pages", "size").join(plain, ["host", "slot", "root"], "left").join(
        opened, ["host", "slot"], "left").fillna(0, ["fixed_pages", "fixed_size", "pool_pages"]).withColumn(
        "pool", F.coalesce("bounded", F.lit(False)) & (4 * F.col("pool_pages") > 3 * (F.col("pages") - F.col("fixed_pages"))))
    # Where over half of the text would go so, the host's pages are near copies, and it stays.
    varying = F.col("size") - F.col("fixed_size")
    pooled = F.when(F.col("pool"), varying).otherwise(0)
    copies = slots.groupBy("host", inside.alias("inside")).agg(
        (2 * F.sum(F.when(inside, pooled + F.col("fixed_size")).otherwise(pooled)) > F.sum(F.when(inside, F.col("size")).otherwise(varying))).alias("copies"))
    judged = slots.withColumn("inside", inside).join(copies, ["host", "inside"])
    slots_out = judged.where(F.col("pool") & ~F.col("copies"))
    kept_copies = copies.where(F.col("copies") & F.col("inside")).select("host", F.lit(True).alias("copied"))
    texts = recurring.where(F.col("fixed") | F.col("doubted")).join(kept_copies, "host", "left").where(
        F.col("doubted") | ~inside | F.col("copied").isNull())

    # The mean text that remains in a main element.
    remains = F.when(F.col("copies"), F.col("size")).when(F.col("pool"), 0).otherwise(varying)
    weights = judged.where("inside").groupBy("host", "root").agg(F.sum(remains).alias("remains")).join(
        every.where(kind == "<").select("host", F.substring("token", 2, 16).alias("root"), F.col("size").alias("n")), ["host", "root"])
    entries = [structure, texts.select("host", "token"), slots_out.select("host", F.concat(F.lit("s"), "slot", "root").alias("token")),
               weights.select("host", F.concat(F.lit("@"), "root", F.floor(F.col("remains") / F.col("n")).cast("string")).alias("token"))]
    return reduce(DataFrame.unionAll, entries).groupBy("host").agg(F.array_join(F.sort_array(F.collect_set("token")), _SPLIT).alias("template"))


_SETS: dict[str, tuple[frozenset[str], dict[str, int]]] = {}


def _template_set(written: str | None) -> tuple[frozenset[str], dict[str, int]]:
    if not written:
        return frozenset(), {}
    if written not in _SETS:
        if len(_SETS) >= 256:
            _SETS.clear()
        tokens = written.split(_SPLIT)
        _SETS[written] = frozenset(t for t in tokens if t[0] != "@"), {t[1:17]: int(t[17:]) for t in tokens if t[0] == "@"}
    return _SETS[written]


def _texts(shared=None):
    """Main texts, with the template of each row or of its host in the broadcast ``shared``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is None:
                written = batch.column("template").to_pylist()
            else:
                written = [shared.value.get(h) for h in batch.column("_host").to_pylist()]
            found = [main_text(page or "", *_template_set(t)) for page, t in zip(batch.column("_html").to_pylist(), written)]
            keep = [c for c in batch.schema.names if c not in ("_html", "_url", "_host", "template")]
            yield append(batch.select(keep), text=pa.array(found, pa.string()))
    return run


def _joined(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with their host's template."""
    per_host = pages.groupBy("_host").count()
    every = pages.count()
    hot = per_host.where(F.col("count") * PART > every).select("_host", F.ceil(F.col("count") * PART / every).cast("int").alias("_parts"))
    pages = pages.join(F.broadcast(hot), "_host", "left").withColumn(
        "_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_url", "_html"), F.col("_parts"))).cast("int"))
    found = found.withColumnRenamed("host", "_host").join(F.broadcast(hot), "_host", "left").select(
        "_host", "template", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
    return pages.join(found, ["_host", "_part"], "left").drop("_part", "_parts")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", support: int = SUPPORT) -> DataFrame:
    """``pages`` without its html, with ``text``."""
    source = without(pages, [c for c in ("text", "_url", "_html", "_host", "template") if c not in (url_col, html_col)])
    rest = [f for f in source.schema.fields if f.name != html_col]
    host = F.regexp_replace(F.lower(F.coalesce(F.col(url_col), F.lit(""))), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(host, "^([^/?#]*)", 1), "^.*@", "")
    named = source.select(*[f"`{f.name}`" for f in rest], F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host.alias("_host"))
    found = cut_lineage(templates(named.select("_host", "_html"), support))
    schema = extended(source.select(*[f"`{f.name}`" for f in rest]).schema, StructField("text", StringType()))
    own = [f"`{f.name}`" for f in rest]
    size = found.agg(F.coalesce(F.sum(F.octet_length("template") + F.octet_length("host")), F.lit(0))).first()[0]
    if size <= BROADCAST:   # a worker holds each template once, not once a page
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in found.collect()})
        return named.select(*own, "_html", "_host").mapInArrow(_texts(shared), schema)
    return _joined(named, found).select(*own, "_html", "template").mapInArrow(_texts(), schema)
