"""Main text of web pages by wrappers that are inferred for each host.

A page's token stream (tags and texts) nests into blocks. Neighbouring blocks of the same shape
fold into one repeated group. The streams of a host are aligned one after another: blocks found
in both go together, a block found in one only becomes optional, differing texts become a text
slot, equal ones stay template text once pages of ``TEMPLATE_PAGES`` different contents hold them
(copies of a page count once, texts are compared as a whole). The result is a regular expression
without unions, the host's wrapper (:func:`expression` writes it out).

The wrapper decides. Its slots are judged once, by where they stand, what they vary in and how
much they hold: slots of the article are main text, those of menus, notices, adverts and the like
are not. Every page is then matched with its host's wrapper, which gives each of its texts a slot;
what is read are the texts in main slots, without the template that stands before the page's first
or behind its last text of its own. Template between these, and headings, belong to the article. Of a
repeated group the texts that all pages hold in it are template. A page that its wrapper does not match,
or that has no text in any main slot of its host, is judged by its own wrapper.

Judged wrappers go to the tasks once, as a broadcast of at most ``BROADCAST_BYTES``; where a corpus has more of
them they are joined to the pages by host.

A host has a wrapper for each of two layouts: pages with text in an article element, and pages
without. Only the latter are judged by where their text varies.

Pages of one skeleton (labels, groups and slots without texts) are put together first: that is a
sum, whatever the order. The skeletons of a host are then aligned in rounds of groups of about
``GROUP`` skeletons, as many rounds as the host needs, in sorted order, so the result does not
depend on how the pages were dealt to tasks, and no group gathers the pages or skeletons of a host.

A wrapper is bounded whatever the pages hold: nesting below ``MAX_DEPTH`` belongs to the block at
that depth, and of the blocks of one parent ``MAX_BLOCKS`` are kept apart, all others go to the
block of their label or else to a general one of their tag. A wrapper of more than ``MAX_WRAPPER``
blocks (each page has names of its own) shows nothing in common: that host has none, and its pages
are judged by themselves.

Defined results
    Null html: empty text. Null url: pages without a host share a wrapper. Null ``page_id``: a
    row like any other. Repeated rows: one row each. Empty table: empty result. Extra columns:
    not read.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Groups of the rounds that put pages of one skeleton together.
SUMS = (512, 1)
#: Skeletons of a host that one group aligns, on average at most.
GROUP = 128
#: Characters of all judged wrappers up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Different pages that must share a text before it counts as the host's template.
TEMPLATE_PAGES = 3
#: Blocks of one parent that a wrapper keeps apart; further ones fold by label, or by tag if the label is new.
MAX_BLOCKS = 64
#: Characters of a label; a digest with what it marks stands for a longer one.
MAX_LABEL = 200
#: Blocks of a wrapper, all levels together.
MAX_WRAPPER = 8192
#: Nesting that is kept apart; below it only what is marked as no main text gets a block of its own.
MAX_DEPTH = 128

# Tags by their part in a page.
_RAW = "script|style|noscript|template|iframe|svg|textarea|select|object|math"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption legend summary".split())
_NOT_MAIN = frozenset("head title nav footer aside form button fieldset dialog menu".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
# Names in class, id or role that mark what is not main text, and words that may stand beside one in a name.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs "
    "sidebar rail widget widgets footer masthead topbar cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login search share sharing social "
    "comment comments replies responses disqus complementary contentinfo dialog".split()
)
_LEADING = frozenset("ad ads advert advertisement sponsored promo cookie cookies gdpr newsletter comment comments sidebar footer nav navbar menu breadcrumb breadcrumbs widget disqus".split())
_BESIDE = frozenset(
    "a area bar bottom box block button buttons container content desktop field form global google group head header icons inline inner item items left link links list main mobile outer page panel "
    "post posts primary reader region right secondary section site slot text the thread top unit user users view wrap wrapper 0".split()
)
_OF_OTHERS = re.compile(r"(?:related|recommended|popular|more|read)[-_]?(?:articles|content|items|links|news|pages|posts|reading|stories)")
_OF_READERS = re.compile(r"(?:user|reader|customer|visitor)s?[-_]?(?:reviews|opinions|posts|responses)")
# Names of parts of an article although they hold a word of the above.
_OF_ARTICLES = re.compile(r"(?:content|article|story|text)[-_](?:widget|block|section)s?")
_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:svg|math)(?=[\s/])[^>]*/>|<({_RAW})(?=[\s/>]).*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S | re.I,
)
_MARKED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Block:
    """A node of a page or wrapper: label, blocks and texts in order."""

    __slots__ = ("label", "kids", "optional", "repeated", "chars", "pages", "same", "varies", "main", "held")

    def __init__(self, label: str):
        self.label, self.kids = label, []
        self.optional, self.repeated = False, False
        # of a text slot: characters, least digests of up to TEMPLATE_PAGES pages, digests of the texts all pages hold, whether some hold others
        self.chars, self.pages, self.same, self.varies = 0, frozenset(), frozenset(), False
        # of a text slot of a judged wrapper: whether it holds main text
        self.main = False
        # of a text slot of one page: numbers and digests of its texts
        self.held: tuple[tuple[int, str], ...] = ()

    @property
    def template(self) -> bool:
        return not self.varies and len(self.pages) >= TEMPLATE_PAGES

    def dump(self) -> list:
        return [self.label, int(self.optional), int(self.repeated), self.chars, sorted(self.pages), sorted(self.same), int(self.varies), int(self.main), [k.dump() for k in self.kids]]

    @classmethod
    def load(cls, x: list) -> Block:
        b = cls(x[0])
        b.optional, b.repeated, b.chars, b.pages, b.same, b.varies, b.main = bool(x[1]), bool(x[2]), x[3], frozenset(x[4]), frozenset(x[5]), bool(x[6]), bool(x[7])
        b.kids = [cls.load(k) for k in x[8]]
        return b


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _label(tag: str, attributes: str) -> str:
    marks = sorted(f"{m[1].lower()}={re.sub(r'[0-9]+', '0', (m[2] or m[3] or m[4] or '').lower())}" for m in _MARKED.finditer(attributes)) if attributes else []
    label = " ".join([tag, *marks])
    if len(label) <= MAX_LABEL:
        return label
    kind = "class=ad" if _marked_off(label, True) else "role=main" if _is_article(label) else "class=long"
    return f"{tag} {kind} id={digest(label)}"


def parse(source: str | None) -> tuple[list[tuple[tuple[str, ...], str]], Block]:
    """Text blocks of a page with their paths of labels, and the page as a tree."""
    root = Block("#page")
    # open blocks with their tags and paths; a tag nested too deep stands for the block above it
    stack: list[tuple[str, Block, tuple[str, ...]]] = [("#page", root, ("#page",))]
    opened: Counter[str] = Counter()
    texts, slots, held = [], [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            _, block, path = stack[-1]
            slot = Block("#text")
            slot.held = ((len(texts), digest(text)),)
            slot.chars, slot.same = len(text), frozenset([slot.held[0][1]])
            texts.append((path, text))
            block.kids.append(slot)
            slots.append(slot)

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for m in _TOKEN.finditer(source or ""):
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                held.append(m[0])
            elif m[1]:
                held.append(" ")
            continue
        if tag in _INLINE:
            continue
        if tag in _VOID:
            held.append("" if tag == "wbr" else " ")
            continue
        flush()
        if m[2] or m[5]:
            while opened[tag] and close() != tag:
                pass
            continue
        closes = _SELF_CLOSING.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        while stack[-1][0] in closes:
            close()
        _, block, path = stack[-1]
        label = _label(tag, m[4] or m[7] or "")
        if len(path) < MAX_DEPTH or len(path) == MAX_DEPTH and _marked_off(label, True):
            block.kids.append(kid := Block(label))
            block, path = kid, (*path, label)
        stack.append((tag, block, path))
        opened[tag] += 1
    flush()
    # two pages are different if what is not marked off is
    paths: dict[tuple[str, ...], bool] = {}
    for path, _ in texts:
        if path not in paths:
            paths[path] = _unmarked(path)
    page = frozenset([digest("\n".join(text for path, text in texts if paths[path]))])
    for slot in slots:
        slot.pages = page
    return texts, root


def general(label: str) -> str:
    """The label that stands for new ones of its tag once a parent is full."""
    tag = label.split(" ", 1)[0]
    kept = tag if tag in _ENDS_P or tag in _NOT_MAIN or tag in _SELF_CLOSING else "div"
    if _is_article(label) and not _marked_off(label, True):
        return f"{kept} role=main *"
    return f"{kept} class=ad *" if _marked_off(label, True) else f"{kept} *"


def _place(kids: list[Block], at: dict[str, int], kid: Block, one_page: bool) -> None:
    """Put a block behind ``kids``, or into a known one if these are full (``at``: last place of a label)."""
    if len(kids) >= MAX_BLOCKS:
        if kid.label not in at and kid.label != "#text":
            kid.label = general(kid.label)
        if kid.label in at:
            joined = merge(kids[at[kid.label]], kid, one_page)
            joined.repeated = True
            kids[at[kid.label]] = joined
            return
    at[kid.label] = len(kids)
    kids.append(kid)


def fold_repeats(block: Block) -> Block:
    """Fold neighbouring blocks of one label into a repeated group, from the leaves up."""
    kids: list[Block] = []
    at: dict[str, int] = {}
    for kid in map(fold_repeats, block.kids):
        if kids and kids[-1].label == kid.label:
            joined = merge(kids[-1], kid, True)
            joined.repeated = True
            kids[-1] = joined
        else:
            _place(kids, at, kid, True)
    block.kids = kids
    return block


def _aligned(a: list[Block], b: list[Block]) -> list[tuple[Block | None, Block | None]]:
    """Longest common subsequence of the labels; what stands between is optional."""
    if [x.label for x in a] == [x.label for x in b]:
        return list(zip(a, b))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].label == b[j].label else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].label == b[j].label:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out


def merge(a: Block, b: Block, one_page: bool = False) -> Block:
    """Align two streams of one label, of two sets of pages or of ``one_page``; the result accepts both."""
    out = Block(a.label)
    out.chars = a.chars + b.chars
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    out.pages = a.pages if a.pages == b.pages else frozenset(sorted(a.pages | b.pages)[:TEMPLATE_PAGES])
    if one_page:
        out.held = a.held + b.held
    out.same = a.same | b.same if one_page else a.same & b.same
    out.varies = a.varies or b.varies or not one_page and a.same != b.same
    at: dict[str, int] = {}
    for x, y in _aligned(a.kids, b.kids):
        kid = merge(x, y, one_page) if x and y else x or y
        kid.optional = kid.optional or not (x and y)
        _place(out.kids, at, kid, one_page)
    return out


def _is_mark(name: str) -> bool:
    """Whether a name begins with a word that marks what is not main text, or is made of such words and words that may stand beside them."""
    if _OF_ARTICLES.fullmatch(name):
        return False
    words = [w for w in re.split(r"[\W_]+", name) if w]
    return bool(words) and words[0] in _LEADING or bool(_OF_OTHERS.fullmatch(name)) or bool(_OF_READERS.fullmatch(name)) or any(w in _MARKS for w in words) and all(w in _MARKS or w in _BESIDE for w in words)


@lru_cache(1 << 16)
def _marked_off(label: str, inside_article: bool) -> bool:
    tag, *names = re.split(r" (?:(?:class|id|role)=)?|=", label)
    if tag in _NOT_MAIN or tag == "header" and not inside_article:
        return True
    if inside_article and "search" in names and "results" in names:
        return False
    return tag not in ("html", "body", "article", "main") and any(map(_is_mark, names))


def _unmarked(path: tuple[str, ...]) -> bool:
    article = False
    for label in path:
        if _marked_off(label, article):
            return False
        article = article or _is_article(label)
    return True


def _is_article(label: str) -> bool:
    return label.split(" ", 1)[0] in ("article", "main") or "role=main" in label


def has_article(page: Block) -> bool:
    """Whether a page has text in an article element that is not marked off."""
    stack = [(page, False)]
    while stack:
        block, article = stack.pop()
        if block.label == "#text":
            if article:
                return True
        elif not _marked_off(block.label, article):
            article = article or _is_article(block.label)
            stack += [(k, article) for k in block.kids]
    return False


def open_slots(wrapper: Block) -> list[tuple[tuple[str, ...], Block, bool]]:
    """Path and block of the text slots that are not marked off, and whether an article holds them."""
    slots = []

    def walk(block: Block, path: tuple[str, ...], article: bool) -> None:
        if block.label == "#text":
            slots.append((path, block, article))
        elif not _marked_off(block.label, article):
            for k in block.kids:
                walk(k, path if k.label == "#text" else (*path, k.label), article or _is_article(k.label))

    walk(wrapper, (wrapper.label,), False)
    return slots


def expression(block: Block) -> str:
    """The wrapper as a regular expression over tags and text slots."""
    inside = " ".join(map(expression, block.kids))
    body = "#text" if block.label == "#text" else f"<{block.label}>{inside}</>"
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[block.optional, block.repeated]
    return f"({body}){mark}" if mark else body


def judge(wrapper: Block) -> Block:
    """Mark a wrapper's slots of main text, and leave only template texts in them."""
    slots = open_slots(wrapper)
    for _, slot, _ in slots:
        slot.main = False
    inside = [slot for _, slot, article in slots if article]
    for slot in inside or _varying_main(wrapper, [(path, slot) for path, slot, _ in slots]):
        slot.main = True
    main = [slot for _, slot, _ in slots if slot.main]
    known = any(not slot.template for slot in main)  # else nothing tells text from template
    for slot in main:
        slot.same = slot.same if known and len(slot.pages) >= TEMPLATE_PAGES else frozenset()
    return wrapper


def _varying_main(wrapper: Block, slots: list[tuple[tuple[str, ...], Block]]) -> list[Block]:
    """Without an article: the slots below the deepest block that still holds most of the text that varies."""
    varying = [(path, slot) for path, slot in slots if not slot.template]
    if not varying:
        return [slot for _, slot in slots]
    at: tuple[str, ...] = (wrapper.label,)
    while True:
        total = sum(slot.chars for path, slot in varying if path[: len(at)] == at)
        below: Counter[tuple[str, ...]] = Counter()
        for path, slot in varying:
            if path[: len(at)] == at and len(path) > len(at):
                below[path[: len(at) + 1]] += slot.chars
        top = max(sorted(below), key=below.get, default=None)
        # stop above a block that only holds text: its neighbours belong to it
        if top is None or below[top] < 0.7 * total or not any(path[: len(top)] == top and len(path) > len(top) for path, _ in varying):
            paths = {path for path, _ in varying if path[: len(at)] == at}
            return [slot for path, slot in slots if path in paths]
        at = top


def match(page: Block, wrapper: Block) -> Iterator[tuple[Block, Block]] | None:
    """Slots of a folded page, each with the wrapper's slot that it fills; null if the expression does not accept the page."""
    if page.label == "#text":
        return iter([(page, wrapper)])
    found: list[Iterator] = []
    last = {k.label: k for k in wrapper.kids}
    for x, y in _aligned(page.kids, wrapper.kids):
        if x is None:
            if not y.optional:
                return None
            continue
        # what finds no place in order went to the block of its label when its parent was full
        y = y or last.get(x.label) or last.get(general(x.label))
        if y is None or x.repeated and not y.repeated:
            return None
        if _marked_off(x.label, True):
            continue
        inner = match(x, y)
        if inner is None:
            return None
        found.append(inner)
    return chain.from_iterable(found)


#: A host's wrappers: of pages without an article and of pages with one.
Layouts = list[Block | None]


#: Label of the wrapper that stands for one of too many blocks; it accepts no page with text.
_BEYOND = "beyond"


def n_blocks(block: Block) -> int:
    found, stack = 0, [block]
    while stack:
        found += 1
        stack += stack.pop().kids
    return found


def _bounded(wrapper: Block | None) -> Block | None:
    return Block(_BEYOND) if wrapper and n_blocks(wrapper) > MAX_WRAPPER else wrapper


def _joined(a: Layouts, b: Layouts) -> Layouts:
    return [_joined_layout(x, y) if x and y else x or y for x, y in zip(a, b)]


def _joined_layout(a: Block, b: Block) -> Block:
    return Block(_BEYOND) if _BEYOND in (a.label, b.label) else _bounded(merge(a, b))


def _dump(layouts: Layouts) -> str:
    return json.dumps([w and w.dump() for w in layouts], ensure_ascii=False)


def _load(x: str) -> Layouts:
    return [w and Block.load(w) for w in json.loads(x)]


def skeleton(layouts: Layouts) -> str:
    """Digest of the labels, groups and slots of a page, without its texts."""

    def shape(b: Block) -> list:
        return [b.label, int(b.repeated), *map(shape, b.kids)]

    return digest(json.dumps([w and shape(w) for w in layouts]))


def page_layouts(root: Block) -> Layouts:
    article = has_article(root)
    page = fold_repeats(root)
    return [None, page] if article else [page, None]


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a host and skeleton of each batch."""
    for b in batches:
        found: dict[tuple[str, str], Layouts] = {}
        for host, source in zip(b.column(0).to_pylist(), b.column(1)):
            layouts = [_bounded(w) for w in page_layouts(parse(source.as_py())[1])]
            key = host, skeleton(layouts)
            found[key] = _joined(found[key], layouts) if key in found else layouts
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.string()) for i in (0, 1)] + [pa.array(map(_dump, found.values()), pa.string())], names=["host", "skeleton", "wrapper"])


def _merge_wrappers(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers of one group as one; each row is let go once it is merged."""
    whole: Layouts = [None, None]
    for b in rows:
        for x in b.column("wrapper"):
            whole = _joined(whole, _load(x.as_py()))
    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.string()) for k in key[:2]] + [pa.array([_dump(whole)], pa.string())], names=["host", "skeleton", "wrapper"])


def _align_wrappers(key: tuple, rows: pa.Table) -> pa.Table:
    whole: Layouts = [None, None]
    for x in rows.sort_by("skeleton").column("wrapper").to_pylist():
        whole = _joined(whole, _load(x))
    return pa.table({"host": [key[0].as_py()], "skeleton": [skeleton(whole)], "wrapper": [_dump(whole)]})


class Reader:
    """Reads pages with the judged wrappers of their host."""

    def __init__(self, judged: str):
        self.layouts = _load(judged)

    def read(self, source: str | None) -> list[str]:
        """Texts of the main part of a page."""
        texts, root = parse(source)
        layouts = page_layouts(root)
        which = int(layouts[1] is not None)
        page = layouts[which]
        return self._taken(texts, page, self.layouts[which]) or self._taken(texts, page, judge(Block.load(page.dump())))

    @staticmethod
    def _taken(texts: list[tuple], page: Block, wrapper: Block | None) -> list[str]:
        slots = wrapper and match(page, wrapper)
        if not slots:
            return []
        main = sorted((i, d in slot.same) for own, slot in slots if slot.main for i, d in own.held)
        own = [i for i, template in main if not template]
        if not own:
            return []
        return [texts[i][1] for i, template in main if not template or own[0] < i < own[-1] or texts[i][0][-1].split(" ", 1)[0] in _HEADINGS]


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))


_WRAPPERS = "host string, skeleton string, wrapper string"


def wrappers(pages: DataFrame) -> DataFrame:
    """host, skeleton (digest), wrapper (JSON): one regular expression without unions for each layout of a host."""
    found = with_host(pages).select("host", "html").mapInArrow(_wrappers, _WRAPPERS)
    for groups in SUMS:
        found = found.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(groups))).groupBy("host", "skeleton", "salt").applyInArrow(_merge_wrappers, _WRAPPERS)
    while True:
        found = materialise(found)
        sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return found
        # few hosts have more skeletons than one group takes; each round leaves a host one row a group
        large = sizes.where(F.col("n") > GROUP).select(F.col("host").alias("h"), F.ceil(F.col("n") / GROUP).alias("groups"))
        salt = F.pmod(F.xxhash64("skeleton"), F.coalesce("groups", F.lit(1)))
        found = found.join(large, F.col("host") == F.col("h"), "left").select("host", "skeleton", "wrapper", salt.alias("salt")).groupBy("host", "salt").applyInArrow(_align_wrappers, _WRAPPERS)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the blocks of main text of every page."""
    found = wrappers(pages)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [_dump([w and judge(w) for w in _load(x.as_py())]) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.string())], names=["host", "judged"])

    told = materialise(found.select("host", "wrapper").mapInArrow(judged, "host string, judged string"))
    size = told.agg(F.sum(F.length("judged"))).first()[0] or 0
    rows = with_host(pages)
    if size <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast(dict(told.toLocalIterator()))  # bounded by the check above
        return rows.select("page_id", "url", "html", "host").mapInArrow(_read(lambda host: known.value.get(host, _NONE)), _TEXTS)
    # a join in which Spark splits the pages of a large host
    return rows.join(told, "host", "left").select("page_id", "url", "html", F.coalesce("judged", F.lit(_NONE)).alias("judged")).mapInArrow(_read(lambda judged: judged), _TEXTS)


_TEXTS = "page_id long, url string, text string, n_chars long, blocks array<string>"
_NONE = "[null, null]"


def _read(judged_of):
    """Texts of pages whose last column leads to the judged wrappers of their host."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, Reader] = {}
            blocks = []
            for source, told in zip(b.column(2), b.column(3)):
                if (told := told.as_py()) not in known:
                    known[told] = Reader(judged_of(told))
                blocks.append(known[told].read(source.as_py()))
            texts = [" ".join(x) for x in blocks]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(blocks, pa.list_(pa.string()))],
                names=["page_id", "url", "text", "n_chars", "blocks"],
            )

    return read
