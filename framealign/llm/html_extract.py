"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

Token stream. A page is read into blocks of text: the path of block elements (with class, id and role) above each text.
Paths that differ in numbers only are equal. Inline markup adds nothing to a path; scripts, styles, comments and the like give no block.

Inference. Runs of blocks with equal paths, then tandem repeats, become repeated groups. The first stream of a host is its
expression; each further stream is aligned with it (longest common subsequence of items), and what has no partner becomes
optional. So a slot is a place in the expression: two blocks of one path that stand at different places are two slots.
A slot whose text (its blocks in order, if it repeats) is the same, as a whole, on all of two or more pages that have it is
template; several texts, numbers in its path that change (as in the id of a post), or only one page, make it a text slot. Tasks infer expressions of the pages they hold; equal ones are one, and those of a host are
merged in two steps, first within 32 salted groups, so a host with a third of all pages is spread out.

Labels, per slot. Boilerplate: an element of its path says so (nav, footer, aside, form ..., or a class, id or role with such a
word); texts of such slots differ from page to page, so the texts alone can't tell. Inner: below an article or main element.
Outer: any other.

Extraction. A page's stream is folded and aligned with its host's expression, and each of its blocks gets the label of the
slot that it fell on. On a page with inner blocks these are the main text. On any other page the outer blocks in text slots
are, or all outer ones if the expression has no outer text slot. A block that no slot took counts as one of a text slot.
Expressions keep every slot, however many there are. Character references are decoded, white space in a block is made one space, trimmed; empty blocks are left out,
the others joined in page order by a line feed.

Cases: null html counts as empty and gives an empty text; a page without markup is one block; unclosed elements close
where HTML closes them, at the end of the page at the latest. Pages without a host in the url are one host. Rows may
repeat. An empty table gives an empty result. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SALTS = 32
#: Shapes of pages whose alignment is remembered.
MOST_SHAPES = 5_000
#: Characters of all wrappers up to which they are sent to every task; larger ones go with the rows, once per group of a host's pages.
MOST_BROADCAST = 4_000_000

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Numbers in a path, but for those of h1 to h6.
_DIGITS = re.compile(r"(?<!/h)(?<!^h)\d+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening element closes an open one of these kinds, up to the nearest of the borders.
CLOSES = {
    "p": (("p",), ()), "li": (("li", "p"), ("ul", "ol")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)), "td": (("td", "th", "p"), ("tr", "table")), "th": (("td", "th", "p"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: Block elements end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOILER_TAGS = frozenset("nav footer aside form button menu dialog fieldset head".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices "
    "popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus pagination pager toolbar masthead skip widget".split()
)
MAIN_TAGS = frozenset(("article", "main"))


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def _element(name: str, attrs: str) -> tuple[str, str]:
    """Name and signature (name, then class, id and role words) of an element."""
    if "=" not in attrs:
        return name, name
    found = [f"{k.lower()}={a or b or c}" for k, a, b, c in _ATTR.findall(attrs)]
    return name, " ".join([name, *found]) if found else name


def slots(page: str) -> list[tuple[str, str]]:
    """(path, text) of each block in page order; text with references decoded and white space made one space."""
    out: list[tuple[str, str]] = []
    open_: list[tuple[str, str]] = []
    held: list[str] = []
    at = 0

    def end_block() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(("/".join(s for _, s in open_), text))

    def close(names: tuple[str, ...], borders: tuple[str, ...]) -> None:
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in borders:
                return
            if open_[k][0] in names:
                del open_[k:]
                return

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            held.append(html_lib.unescape(page[at : m.start()]))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append("\n")
            continue
        if name in INLINE:
            continue
        end_block()
        if m["close"]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
            continue
        if name in ENDS_P:
            close(("p",), ("article", "div", "section", "td", "li", "blockquote", "main", "body"))
        if name in CLOSES and name != "p":
            close(*CLOSES[name])
        if name not in VOID and not m["attrs"].endswith("/"):
            open_.append(_element(name, m["attrs"]))
    if at < len(page):
        held.append(html_lib.unescape(page[at:]))
    end_block()
    return out


# ---- expressions ----
#
# An item is a slot (path, mark, pages) or a group (items), with flags optional and repeated. Of a stream, a slot's mark is the
# list of its blocks (numbers); of an expression it is the one text that the slot has (None: several).


class Item:
    __slots__ = ("items", "key", "mark", "optional", "pages", "repeated")

    def __init__(self, key: str, items: list[Item] | None = None, mark: object = None, pages: int = 1, optional: bool = False, repeated: bool = False):
        self.key, self.items, self.mark, self.pages, self.optional, self.repeated = key, items, mark, pages, optional, repeated

    def slots(self) -> Iterator[Item]:
        if self.items is None:
            yield self
        else:
            for item in self.items:
                yield from item.slots()

    def dump(self) -> list:
        flags = int(self.optional) + 2 * int(self.repeated)
        return [self.key, flags, self.mark, self.pages] if self.items is None else [[x.dump() for x in self.items], flags]

    @classmethod
    def load(cls, held: list) -> Item:
        flags = {"optional": bool(held[1] & 1), "repeated": bool(held[1] & 2)}
        if isinstance(held[0], str):
            return cls(held[0], None, held[2], held[3], **flags)
        return group([cls.load(x) for x in held[0]], **flags)

    def take(self, other: Item) -> None:
        """Make this the item of both; keys are equal."""
        self.optional |= other.optional
        self.repeated |= other.repeated
        if self.items is None:
            self.mark, self.pages = (self.mark if self.mark == other.mark else None), min(self.pages + other.pages, 2)
        else:
            for one, two in zip(self.items, other.items, strict=True):
                one.take(two)


def group(items: list[Item], optional: bool = False, repeated: bool = False) -> Item:
    return Item("(" + "\x01".join(x.key for x in items) + ")", items, optional=optional, repeated=repeated)


def _gathered(one: Item, other: Item) -> None:
    """Add a further repetition to an item of a stream."""
    one.optional |= other.optional
    one.repeated |= other.repeated
    if one.items is None:
        one.mark += other.mark
    else:
        for a, b in zip(one.items, other.items, strict=True):
            _gathered(a, b)


def folded(paths: list[str]) -> list[Item]:
    """A stream as items: runs of one path, then tandem repeats of any period, become repeated items."""
    items: list[Item] = []
    for k, path in enumerate(paths):
        if items and items[-1].key == path:
            items[-1].mark.append(k)
            items[-1].repeated = True
        else:
            items.append(Item(path, mark=[k]))
    tried = 1
    while True:
        # a period is a distance at which an item comes again
        last: dict[str, int] = {}
        gaps = set()
        for k, item in enumerate(items):
            if item.key in last:
                gaps.add(k - last[item.key])
            last[item.key] = k
        periods = sorted(p for p in gaps if p > tried)
        if not periods:
            return items
        tried = periods[0]
        keys = [x.key for x in items]
        out: list[Item] = []
        at = 0
        while at < len(items):
            n = 1
            if keys[at] == (keys[at + tried] if at + tried < len(keys) else None):
                while at + (n + 1) * tried <= len(items) and keys[at : at + tried] == keys[at + n * tried : at + (n + 1) * tried]:
                    n += 1
            if n > 1:
                first = items[at : at + tried]
                for k in range(1, n):
                    for a, b in zip(first, items[at + k * tried : at + (k + 1) * tried], strict=True):
                        _gathered(a, b)
                out.append(group(first, repeated=True))
                at += n * tried
            else:
                out.append(items[at])
                at += 1
        items = out


def partners(a: list[str], b: list[str], at: dict[str, list[int]] | None = None) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, in about as many steps as there are pairs of equal keys.

    at: the places of each key of a, if they are known; a long a is then read only where b has its keys.
    """
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[str, list[int]] = {}
    for j in range(lead, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end of a common subsequence of each length
    links: list[tuple | None] = []
    met = range(lead, len(a) - tail) if at is None else sorted(i for key in places for i in at.get(key, ()) if lead <= i < len(a) - tail)
    for i in met:
        for j in reversed(places.get(a[i], ())):
            n = bisect_left(ends, j)
            link = (i, j, links[n - 1] if n else None)
            if n == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[n], links[n] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append((link[0], link[1]))
        link = link[2]
    return [*((k, k) for k in range(lead)), *reversed(middle), *((len(a) - k, len(b) - k) for k in range(tail, 0, -1))]


def aligned(a: list[Item], b: list[Item]) -> list[Item]:
    """The expression of two: partners joined (into the items of a), the rest optional."""
    out: list[Item] = []
    i = j = 0
    for x, y in [*partners([t.key for t in a], [t.key for t in b]), (len(a), len(b))]:
        for item in (*a[i:x], *b[j:y]):
            item.optional = True
            out.append(item)
        if x < len(a):
            a[x].take(b[y])
            out.append(a[x])
        i, j = x + 1, y + 1
    merged: list[Item] = []  # a slot that is optional twice in a row is one that may repeat
    for item in out:
        if merged and merged[-1].optional and item.optional and merged[-1].key == item.key:
            merged[-1].take(item)
            merged[-1].repeated = True
        else:
            merged.append(item)
    return merged


def _mark(blocks: list[tuple[str, str]]) -> str:
    """What stands for the text of a slot on a page: its blocks in order, with the numbers of their paths."""
    text = "\n".join(f"{' '.join(_DIGITS.findall(path))}={text}" for path, text in blocks)
    return text if len(text) <= 80 else f"#{hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()}"


class Wrapper:
    """Expression of a host."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.seen = bool(items)
        self.shapes: dict[str, list[Item]] = {}  # slots of the expression on which those of a shape fall
        self.known: dict[str, list[int]] = {}

    def add(self, page: list[tuple[str, str]]) -> None:
        items = folded([_DIGITS.sub("#", p) for p, _ in page])
        own = [s for x in items for s in x.slots()]
        for slot in own:
            slot.mark = _mark([page[k] for k in slot.mark])
        shape = _shape(items)
        if shape in self.shapes:
            for slot, new in zip(self.shapes[shape], own, strict=True):
                slot.take(new)
            return
        pairs = partners([x.key for x in self.items], [x.key for x in items])
        if self.seen and len(pairs) == len(items):  # the page has no new slot, so those that were remembered stay the same
            held = [s for x, _ in pairs for s in self.items[x].slots()]
            for k in set(range(len(self.items))).difference(x for x, _ in pairs):
                self.items[k].optional = True
            for slot, new in zip(held, own, strict=True):
                slot.take(new)
            for x, y in pairs:
                self.items[x].repeated |= items[y].repeated
            if len(self.shapes) >= MOST_SHAPES:
                self.shapes.clear()
            self.shapes[shape] = held
        else:
            self.items = aligned(self.items, items) if self.seen else items
            self.shapes.clear()
        self.seen = True

    def join(self, other: Wrapper) -> None:
        self.items = aligned(self.items, other.items) if self.seen else other.items
        self.seen = True
        self.shapes.clear()

    def dump(self) -> str:
        return json.dumps([x.dump() for x in self.items])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls([Item.load(x) for x in json.loads(text)])

    def main(self, page: list[tuple[str, str]]) -> list[int]:
        """The blocks of a page that are its main text."""
        items = folded([_DIGITS.sub("#", p) for p, _ in page])
        own = [s for x in items for s in x.slots()]
        shape = _shape(items)
        if shape not in self.known:
            if not hasattr(self, "varied"):
                slots = [s for x in self.items for s in x.slots()]
                self.varied = any(label(s.key) == OUTER and (s.mark is None or s.pages < 2) for s in slots)
                self.keys = [x.key for x in self.items]
                self.at: dict[str, list[int]] = {}
                for k, key in enumerate(self.keys):
                    self.at.setdefault(key, []).append(k)
            taken: list[Item | None] = [None] * len(items)
            for x, y in partners(self.keys, [t.key for t in items], self.at):
                taken[y] = self.items[x]
            slots = [s for item, x in zip(items, taken, strict=True) for s in (x.slots() if x else [None] * sum(1 for _ in item.slots()))]
            labels = []
            for slot, new in zip(slots, own, strict=True):
                kind = label(new.key)
                template = slot is not None and slot.mark is not None and slot.pages > 1 and self.varied
                labels.append(DROPPED if kind == OUTER and template else kind)
            if len(self.known) >= MOST_SHAPES:
                self.known.clear()
            self.known[shape] = labels
        labels = self.known[shape]
        wanted = INNER if INNER in labels else OUTER
        return sorted(k for kind, slot in zip(labels, own, strict=True) if kind == wanted for k in slot.mark)


def _shape(items: list[Item]) -> str:
    return "\x02".join(x.key for x in items)


DROPPED, OUTER, INNER = 0, 1, 2


@lru_cache(maxsize=50_000)
def label(path: str) -> int:
    """What the elements of a path say of its slot."""
    if is_boilerplate(path):
        return DROPPED
    return INNER if any(e.split(" ")[0] in MAIN_TAGS or "role=main" in e for e in path.split("/")) else OUTER


def is_boilerplate(path: str) -> bool:
    inside = False
    for element in path.split("/"):
        name, *marks = element.split(" ")
        if name in BOILER_TAGS or (name == "header" and not inside):
            return True
        inside |= name in MAIN_TAGS
        if marks and name not in ("html", "body") and BOILER_WORDS.intersection(_words(" ".join(m.partition("=")[2] for m in " ".join(marks).split(" ") if m))):
            return True
        if marks and any(w in element.lower() for w in ("role=navigation", "role=banner", "role=contentinfo", "role=complementary")):
            return True
    return False


# ---- steps ----


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hosts: dict[str, Wrapper] = {}
    for b in batches:
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            if host not in hosts:
                hosts[host] = Wrapper([])
            hosts[host].add(slots(page))
        if len(hosts) > 20_000:  # a task may meet any number of hosts
            yield _dumped(hosts)
            hosts = {}
    yield _dumped(hosts)


def _dumped(hosts: dict[str, Wrapper]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(hosts), pa.string()), pa.array([w.dump() for w in hosts.values()], pa.string())], names=["host", "wrapper"])


def _merge(t: pa.Table) -> pa.Table:
    out = Wrapper([])
    for text in sorted(text for text, n in zip(t.column("wrapper").to_pylist(), t.column("n").to_pylist(), strict=True) for _ in range(min(n, 2))):
        out.join(Wrapper.load(text))
    return pa.table({"host": pa.array([t.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([out.dump()], pa.string())})


def _main_text(wrapper: Wrapper, page: str) -> str:
    found = slots(page)
    return "\n".join(found[k][1] for k in wrapper.main(found))


def _extract(shared):  # noqa: ANN001, ANN202
    """shared: broadcast wrapper of each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Wrapper] = {}
        for b in batches:
            out = []
            for page, key in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True):
                if key not in made:
                    if len(made) > 10_000:
                        made.clear()
                    made[key] = Wrapper.load(shared.value[key])
                out.append(_main_text(made[key], page))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def _extract_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a group come together, and the first of them is the wrapper of its host."""
    made = Wrapper([])
    for b in batches:
        out, of = [], []
        for k, (wrapper, page) in enumerate(zip(b.column("wrapper").to_pylist(), b.column("html").to_pylist(), strict=True)):
            if wrapper is not None:
                made = Wrapper.load(wrapper)
            else:
                of.append(k)
                out.append(_main_text(made, page))
        rows = b.take(pa.array(of, pa.int64()))
        yield pa.record_batch([rows.column("page_id"), rows.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _in_groups(read: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, html, wrapper: pages of a host in up to SALTS groups, each after a row with the host's wrapper; no row has both."""
    pages = read.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
    groups = pages.select("host", "salt").distinct().join(wrappers, "host")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in read.dtypes if name in ("page_id", "url", "html")]
    rows = groups.select("host", "salt", *none, "wrapper").unionByName(pages.select("host", "salt", "page_id", "url", "html", F.lit(None).cast("string").alias("wrapper")))
    parts = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", F.col("wrapper").isNull()).select("page_id", "url", "html", "wrapper")


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper of all hosts; pages: with_host()."""
    common.ship(pages.sparkSession)
    made = pages.select("host", "html").mapInArrow(_infer, "host string, wrapper string").groupBy("host", "wrapper").agg(F.count(F.lit(1)).alias("n"))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    halfway = salted.groupBy("host", "salt").applyInArrow(_merge, "host string, wrapper string").withColumn("n", F.lit(1))
    return halfway.groupBy("host").applyInArrow(_merge, "host string, wrapper string")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    read = with_host(pages)
    wrappers = common.cut(infer_wrappers(read))
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    if (wrappers.agg(F.sum(F.length("wrapper") + F.length("host") + 100)).first()[0] or 0) <= MOST_BROADCAST:
        # of a checked size; rows carry the name of their host only
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
        out = read.mapInArrow(_extract(shared), schema)
    else:
        out = _in_groups(read, wrappers).mapInArrow(_extract_groups, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.table(spark, sf_dir, "pages"))
