"""Main text of web pages, without what the pages of a host have in common.

Each page is parsed into blocks of text that know the element subtrees they
lie in, by hash. Spark counts how many different articles of a host each
subtree stands beside, those of menus, footers and adverts and those outside
the article included; subtrees that recur are the host's template, and their
blocks go wherever they stand. What a tag, role or class names as no part of
the article (menus, headers, footers, sidebars, notices, adverts, forms,
comments) goes too, whether it recurs or not, and so do scripts and styles.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from callcause.llm.common import Kept, map_batches, without

# A subtree is template when it stands beside this many different articles of its host.
TEMPLATE_PAGES = 10
# Prose of an article (_PROSE) needs this many times as many, and over half of the host's different articles: what a
# few articles of a large host share is no template.
PROSE_TIMES = 2
# Bits of the filter that tells most pages which lose nothing by the counts.
_FILTER_BITS = 2**27
RESULTS = ("text", "n_chars")

_MAIN = {"article", "main"}
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp"}
_DROPPED = _RAW | {"head", "nav", "header", "footer", "aside", "menu", "dialog", "form", "button", "select", "input",
                   "label", "svg", "math", "canvas", "object", "audio", "video", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
           "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
           "wbr", "img", "ruby", "rb", "rt", "rp", "label", "input", "button", "select"}
# Blocks that are prose: inside an article they are taken for template only on more evidence.
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "tr", "tbody", "figcaption"}
# Classes and ids that name no part of an article, as whole words; and those of talk about it, which may be longer than it.
_NAMES = re.compile(
    r"ad|ads|adv|advert[a-z]*|banner|sponsor[a-z]*|promo[a-z]*|cookies?|cookieconsent|consent|gdpr|notices?|alert|sidebar|menu|"
    r"nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|related|"
    r"recommended|newsletter|subscribe|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|skip")
_TALK = re.compile(r"comments?|disqus|replies")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu",
          "menubar", "toolbar", "form"}
_TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# What an opening tag closes, and where the search for it stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}
_SCOPE = {"html", "table", "td", "th", "caption", "object", "template", "button"}


def _unwanted(tag: str, attributes: str) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes.strip() or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named(tag: str, attributes: str) -> re.Pattern | None:
    """Which list of names a class or an id of the element stands in, if any; never for those that hold the article by their tag."""
    if not attributes.strip() or tag in _MAIN or tag in ("html", "body"):
        return None
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for word in next((v for v in values if v), "").lower().split():
                for names in (_TALK, _NAMES):
                    if names.fullmatch(word):
                        return names
    return None


class _Open:
    """An element that is not closed yet, and then a subtree."""

    __slots__ = ("tag", "out", "dropped", "main", "article", "named", "holds", "parts", "first", "last", "print")

    def __init__(self, tag: str, out: bool, dropped: bool, main: bool, first: int, article: bool = False,
                 named: re.Pattern | None = None):
        self.tag, self.out, self.dropped, self.main, self.first = tag, out, dropped, main, first
        # Whether it lies in an article or is one, what its class or id says, and whether it holds an article or main part.
        self.article, self.named, self.holds = article, named, False
        self.parts: list[str | _Open] = []
        self.last, self.print = first, 0


class Page:
    """One parsed page: blocks of its main part, the subtrees over them as (print, prose, first, end), and the prints to count."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, tuple[bool, bool]]] = []
        self._subtrees: list[_Open] = []
        self._stack = [_Open("", False, False, False, 0)]
        self._text: list[str] = []
        self._any_main = False
        self._parse(source)
        self._finish()

    def _parse(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            if found is None:
                self._text.append(source[at:])
                break
            if found.start() > at:
                self._text.append(source[at:found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self._close(tag)
                continue
            attributes = found[3] or found[6] or ""
            self._start(tag, attributes)
            if tag in _RAW and not attributes.endswith("/"):
                closing = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(source, at)
                at = closing.end() if closing else end
                self._close(tag)
        self._flush()
        while len(self._stack) > 1:
            self._pop()

    def _flush(self) -> None:
        """End the running block."""
        if not self._text:
            return
        text = " ".join(references.unescape("".join(self._text)).split())
        self._text = []
        top = self._stack[-1]
        if text:
            top.parts.append(text)
            self.blocks.append((text, (top.main, top.dropped)))

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE:
            self._flush()
            if tag in _CLOSES:
                closed, stop = _CLOSES[tag]
                self._close_open(closed, stop)
            elif tag not in _VOID:
                self._close_open({"p"}, _SCOPE)
        elif self._text and (_unwanted(tag, attributes) or _named(tag, attributes)):
            self._flush()
        if tag in _VOID:
            return
        above = self._stack[-1]
        out = _unwanted(tag, attributes)
        dropped = above.dropped or out
        main = above.main or tag in _MAIN or 'role="main"' in attributes
        if main and not dropped:
            self._any_main = True
        if tag in _MAIN or 'role="main"' in attributes:
            for opened in self._stack:
                opened.holds = True
        self._stack.append(_Open(tag, out, dropped, main, len(self.blocks), above.article or tag == "article",
                                 None if out else _named(tag, attributes)))

    def _close_open(self, tags: set[str], stop: set[str]) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[depth].tag
            if tag in tags:
                while len(self._stack) > depth:
                    self._pop()
                return
            if tag in stop:
                return

    def _close(self, tag: str) -> None:
        if tag not in _INLINE:
            self._flush()
        if tag in _VOID:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth].tag == tag:
                if tag in _INLINE and any(o.tag not in _INLINE for o in self._stack[depth + 1:]):
                    return  # misnested formatting ends with its block
                if self._stack[depth].out or self._stack[depth].named:
                    self._flush()
                while len(self._stack) > depth:
                    self._pop()
                return

    def _pop(self) -> None:
        done = self._stack.pop()
        if not done.parts:
            return
        if done.tag in _INLINE and not done.out and not done.named:
            self._stack[-1].parts += done.parts
            return
        done.last = len(self.blocks)
        self._stack[-1].parts.append(done)
        self._subtrees.append(done)

    def _by_name(self) -> None:
        """Drop what a class or an id names, but never what holds the article or most of the text."""
        if not any(tree.named for tree in self._subtrees):
            return
        room, plain = [0], [0]  # characters before each block: all, and those that no tag, role or style drops
        for text, (_, dropped) in self.blocks:
            room.append(room[-1] + len(text))
            plain.append(plain[-1] + len(text) * (not dropped))
        for tree in self._subtrees:
            if not tree.named:
                continue
            size = plain[tree.last] - plain[tree.first]
            # Articles within an article are replies and teasers, and its talk may be longer than itself.
            if tree.holds and not tree.article:
                continue
            if (2 * size > room[-1] or 3 * size >= 2 * plain[-1]) and not (tree.named is _TALK and tree.article):
                continue
            tree.out = True
            for k in range(tree.first, tree.last):
                self.blocks[k] = (self.blocks[k][0], (self.blocks[k][1][0], True))

    def _finish(self) -> None:
        self._by_name()
        shown = [not dropped and (main or not self._any_main) for _, (main, dropped) in self.blocks]
        sizes, place = [0], [0]  # before each block: characters shown, blocks shown
        for (text, _), here in zip(self.blocks, shown):
            sizes.append(sizes[-1] + len(text) * here)
            place.append(place[-1] + here)
        counted, self.inside = set(), []
        for tree in self._subtrees:  # inner ones first
            # What is dropped from within a subtree does not tell it from others.
            parts = [part if isinstance(part, str) else f"\x1e{part.print}" for part in tree.parts
                     if isinstance(part, str) or not part.out]
            print_ = tree.print = xxhash.xxh3_64_intdigest("\x1f".join([tree.tag, *parts])) - 2**63
            if not parts:
                continue
            size = sizes[tree.last] - sizes[tree.first]
            # What holds most of the text is no evidence of a template, but goes if it is known as one.
            if 2 * size <= sizes[-1]:
                counted.add(print_)
            if size:
                prose = tree.main and tree.tag in _PROSE
                self.inside.append((print_, prose, place[tree.first], place[tree.last]))
        self.counted = sorted(counted)
        self.blocks = [block for block, here in zip(self.blocks, shown) if here]
        self.article = xxhash.xxh3_64_intdigest("\n".join(text for text, _ in self.blocks)) - 2**63


_INSIDE = pa.list_(pa.struct([("print", pa.int64()), ("prose", pa.bool_()), ("first", pa.int32()), ("end", pa.int32())]))
_PRINTS = [T.StructField("_counted", T.ArrayType(T.LongType())),
           T.StructField("_inside", T.ArrayType(T.StructType([
               T.StructField("print", T.LongType()), T.StructField("prose", T.BooleanType()),
               *[T.StructField(n, T.IntegerType()) for n in ("first", "end")]]))),
           T.StructField("_article", T.LongType())]
_BLOCKS = [T.StructField("_blocks", T.ArrayType(T.StringType()))]


def _prints_of(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    pages = [Page(source or "") for source in batch.column("_html").to_pylist()]
    names = ("print", "prose", "first", "end")
    return {"_counted": pa.array([page.counted for page in pages], pa.list_(pa.int64())),
            "_inside": pa.array([[dict(zip(names, i)) for i in page.inside] for page in pages], _INSIDE),
            "_article": pa.array([page.article for page in pages], pa.int64())}


def _blocks_of(pages: DataFrame, names: list[str], chosen: np.ndarray, inside: bool) -> DataFrame:
    """Blocks of the pages whose bit in ``chosen`` is set, or of the others."""
    fields = [*[pages.schema[n] for n in names], *_BLOCKS]

    def run(batches):
        for batch in batches:
            bit = batch.column("_p").to_numpy() & (8 * len(chosen) - 1)
            hit = (chosen[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            batch = batch.filter(pa.array(hit == inside))
            if batch.num_rows:
                blocks = [[text for text, _ in Page(source or "").blocks] for source in batch.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in names], pa.array(blocks, pa.list_(pa.string()))], [*names, "_blocks"])

    return pages.mapInArrow(run, T.StructType(fields))


def _filter(own: DataFrame) -> np.ndarray:
    """A bit for each ``_p``, some 16 for each row as far as _FILTER_BITS go; a page's bit may be that of another."""
    bits = min(_FILTER_BITS, 1 << max(10, (16 * own.count()).bit_length()))
    bit = F.col("_p").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = own.select(F.shiftright(bit, 5).alias("at"), bit.bitwiseAND(F.lit(31).cast("long")).cast("int").alias("low")).groupBy("at").agg(
        F.bit_or(F.expr("shiftleft(1L, low)")).alias("word")).toArrow()  # at most bits / 32 rows
    chosen = np.zeros(bits // 32, "<u4")
    chosen[words.column("at").to_numpy()] = words.column("word").to_numpy().astype("<u4")
    return chosen.view(np.uint8)


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", template_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """All rows and their columns but the html, with text and n_chars (code points).

    The text of a page is that of its <article> or <main> elements, or of its
    body if it has none. A null or empty html gives an empty text; pages without
    a url share the host "". Pages that repeat an article count once for the
    template, and a subtree that holds most of a page's text does not count
    there. Input columns of the result's names give way to them; others may have any name.
    """
    kept = Kept(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    # Rows equal in url and html have equal texts; 128 bits of hash stand for both.
    stays = without(pages, (html, *RESULTS)).columns
    source = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in stays]).alias("_row"), F.col(html).cast("string").alias("_html"), host.alias("_host"),
        F.xxhash64(url, html).alias("_p"), F.xxhash64(F.lit("second"), url, html).alias("_q"))
    # Parsing runs once for the prints, which are kept, and once for the blocks, which are not.
    prints = kept.keep(map_batches(source, _prints_of, _PRINTS, keep=["_p", "_q", "_host"]), "prints")
    # Few rows: what recurs. A print stands beside each different article once.
    template = kept.keep(prints.select("_host", "_article", F.explode("_counted").alias("_print")).distinct()
                         .groupBy("_host", "_print").agg(F.count(F.lit(1)).alias("n"))
                         .filter(F.col("n") >= template_pages), "recurring")
    articles = prints.select("_host", "_article").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("articles"))
    template = kept.keep(template.join(articles, "_host"), "template")
    prose_enough = (F.col("n") >= PROSE_TIMES * template_pages) & (2 * F.col("n") > F.col("articles"))
    enough = ~F.col("_in.prose") | prose_enough
    # Only pages that lose blocks by the counts, each with at most as many ranges of blocks as it has elements.
    own = kept.keep(prints.select("_p", "_q", "_host", F.explode("_inside").alias("_in")).withColumn("_print", F.col("_in.print"))
                    .join(template, ["_host", "_print"]).filter(enough)
                    .groupBy("_p", "_q").agg(F.collect_set(F.struct("_in.first", "_in.end")).alias("_gone")), "own")
    # Pages that lose nothing are not shuffled; the others meet their ranges, which are as many, by a sort-merge join.
    chosen = _filter(own)
    left = F.filter("_blocks", lambda _, k: ~F.exists("_gone", lambda g: (g["first"] <= k) & (k < g["end"])))
    some = (_blocks_of(source, ["_row", "_p", "_q"], chosen, True).join(own.hint("merge"), ["_p", "_q"], "left")
            .withColumn("_blocks", F.when(F.col("_gone").isNull(), F.col("_blocks")).otherwise(left)))
    rest = _blocks_of(source, ["_row"], chosen, False)
    found = some.select("_row", "_blocks").union(rest).withColumn("_text", F.array_join("_blocks", " "))
    return found.select("_row.*", F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"))


def query(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
