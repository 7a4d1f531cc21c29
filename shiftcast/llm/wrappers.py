"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tags and texts.  Runs of equal units are folded into
repeated groups, so a page is a short expression.  The expressions of a host are
aligned one after another: where both have the same token it stays; texts that
differ become a slot; a part that one side lacks becomes optional, or joins a
repeated group whose unit it equals.  The result, without alternation, is the
host's wrapper.

Its tokens get roles once: text below menus, headers, footers, asides, forms,
notices, adverts, comments and the like is boilerplate (by element name and the
words of class, id and role); on a page that marks the article (by the first of
``article``, ``main`` and containers named like one that holds text outside such
parts; where all of an ``article`` or ``main`` lies in parts that are only named like such,
these names don't count) the rest of what is marked is content; elsewhere slots and repeated groups
are content and a text that every page of the host has, the same, is template;
pages that differ in no text outside such parts (copies) cannot tell template from
content and keep both.  A page is read by aligning it with its host's wrapper and
emitting the texts at content tokens.

Data flow: pages are folded in parallel; equal expressions of a host are one row
after a grouped aggregate with map-side combining (a slot is constant if the
smallest and largest hash agree; so are the pages of a host copies), so a host with a third of all pages costs what
its distinct expressions cost.  These are aligned ``GROUP`` at a time, longest first,
and the groups' wrappers again in the same way until a host has one, so no task holds
more than that many.  Pages meet wrappers by a join on the
host (broadcast below a checked size).  No page is sampled.

Defined results: null or empty html and pages without content give an empty
text; null urls share the host ""; repeated rows are read each for itself.
Extra columns pass.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftcast.llm.common import running_sum, ship_package, store

#: Expressions of a host that one task aligns.
GROUP = 16
#: Longest repeated unit, in tokens.
UNIT = 16
#: Wrappers that may be broadcast together, in characters.
BROADCAST_CHARS = 8_000_000

# Elements and name words of parts that are not the article.
OUT_TAGS = frozenset("nav footer aside form script style noscript template head title button select textarea svg iframe "
                     "object canvas dialog menu option label fieldset".split())
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertisements adslot adsense banner sponsor sponsored promo promos "
                      "promotion promoted nav navbar navigation menu menubar sidebar aside footer masthead cookie cookies "
                      "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall "
                      "comment comments commentlist disqus replies reply respond discussion related recommended recommendations "
                      "share sharing social breadcrumb breadcrumbs pagination pager toolbar widget widgets search skip "
                      "complementary contentinfo announcement disclaimer teaser trending".split())
IN_WORDS = frozenset("article main content post entry story".split())
# Elements that hold no article, whatever their names.
NOT_CONTAINERS = frozenset("html body h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span "
                   "strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "xmp", "noembed")

# possessive: a tag that never closes is given up after one look at the rest of the page
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile("[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WORD = re.compile(r"[a-z]+")
TEXT = "#"


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of >, " and ' in the page, and for each where a tag ends that meets it outside of quotes (-1: nowhere).

    One pass from the back, so the tags of a page together cost its length, whatever is left open."""
    marks = [m.start() for m in _MARK.finditer(page)]
    ends = [-1] * (len(marks) + 1)
    later = {'"': -1, "'": -1}
    for i in range(len(marks) - 1, -1, -1):
        c = page[marks[i]]
        if c == ">":
            ends[i] = marks[i]
        else:
            ends[i] = ends[later[c] + 1] if later[c] >= 0 else -1
            later[c] = i
    return marks, ends


def _kind(attributes: str) -> list[str]:
    """Words of class, id and role that tell what a part is."""
    return sorted({w for x in _NAMES.findall(attributes) for w in _WORD.findall("".join(x).lower()) if w in OUT_WORDS or w in IN_WORDS})


def tokens(page: str) -> list[tuple[str, str]]:
    """(key, text): key is "#" for text, "name" or "name.word..." for a start tag, "/name" for an end tag."""
    out: list[tuple[str, str]] = []
    pieces: list[str] = []
    at, n = 0, len(page)
    ends: tuple[list[int], list[int]] | None = None  # once a tag is left open

    def flush() -> None:
        text = "".join(pieces)
        pieces.clear()
        # a blank between inline elements parts words
        if text and (not text.isspace() or (out and out[-1][0].lstrip("/").split(".")[0] in INLINE)):
            out.append((TEXT, text))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            pieces.append(page[at:])
            break
        pieces.append(page[at:lt])
        m = _TAG.match(page, lt) if ends is None else None
        if m:
            close, name, attributes, at = m[1], m[2].lower(), m[3], m.end()
        elif page.startswith(("<!", "<?"), lt):
            stop = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = page.find(stop, lt + {"-->": 4, "]]>": 9, ">": 2}[stop])
            at = end + len(stop) if end >= 0 else n
            continue
        else:
            m = _OPEN.match(page, lt)
            end = -1
            if m:
                ends = ends or _tag_ends(page)
                end = ends[1][bisect_left(ends[0], m.end())]
            if end < 0:  # a lone bracket
                pieces.append("<")
                at = lt + 1
                continue
            close, name, attributes, at = m[1], m[2].lower(), page[m.end():end], end + 1
        flush()
        if close:
            out.append(("/" + name, ""))
            continue
        words = _kind(attributes) if "=" in attributes else []
        out.append((".".join([name, *words]), ""))
        if name in _RAW_END and not attributes.endswith("/"):
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else n  # what stands in it is not markup
            out.append(("/" + name, ""))
    flush()
    return out


# An expression is a list of nodes [key, inner, const, optional]: key of a token or "+" for a
# repeated group with nodes ``inner``; const is a text's hash, or None for a slot.

def _shape(nodes: list) -> tuple:
    return tuple(n[0] if n[1] is None else ("+", _shape(n[1])) for n in nodes)


def fold(stream: list[tuple[str, str]]) -> tuple[list[tuple], list]:
    """The page's expression as (shape keys, for each leaf in order the indexes of its tokens)."""
    keys: list = []        # shapes
    leaves: list = []      # per shape: list of leaves, each a list of token indexes
    for i, (key, _) in enumerate(stream):
        keys.append(key)
        leaves.append([[i]])
        again = True
        while again:
            again = False
            n = len(keys)
            for size in range(1, min(UNIT, n) + 1):
                # the unit follows a group of itself
                if n > size and isinstance(keys[n - size - 1], tuple) and keys[n - size - 1][1] == tuple(keys[n - size:]) \
                        and keys[n - size - 1][0] == "+":
                    group = leaves[n - size - 1]
                    unit = [leaf for x in leaves[n - size:] for leaf in x]
                    for a, b in zip(group, unit):
                        a.extend(b)
                    del keys[n - size:], leaves[n - size:]
                    again = True
                    break
                # the unit follows itself, holds a text and begins with a start tag
                if n >= 2 * size and keys[n - size] != TEXT and keys[n - size][0] != "/" and keys[n - size:] == keys[n - 2 * size:n - size] \
                        and size > 1 and TEXT in _flat(keys[n - size:]):
                    first = [leaf for x in leaves[n - 2 * size:n - size] for leaf in x]
                    for a, b in zip(first, [leaf for x in leaves[n - size:] for leaf in x]):
                        a.extend(b)
                    unit = tuple(keys[n - size:])
                    del keys[n - 2 * size:], leaves[n - 2 * size:]
                    keys.append(("+", unit))
                    leaves.append(first)
                    again = True
                    break
    return keys, [leaf for x in leaves for leaf in x]


def _flat(keys) -> Iterator[str]:
    for k in keys:
        if isinstance(k, tuple):
            yield from _flat(k[1])
        else:
            yield k


def _to_nodes(keys, consts: Iterator) -> list:
    out = []
    for k in keys:
        if isinstance(k, (tuple, list)):
            out.append(["+", _to_nodes(k[1], consts), None, False])
        else:
            c = next(consts)
            out.append([k, None, c if k == TEXT else None, False])
    return out


def _merge(a: list, b: list) -> list:
    """One node from two of the same shape."""
    inner = None if a[1] is None else [_merge(x, y) for x, y in zip(a[1], b[1])]
    return [a[0], inner, a[2] if a[2] == b[2] else None, a[3] or b[3]]


def _slots(node: list) -> list:
    """The node with every text a slot: repeated units differ from each other."""
    return [node[0], None if node[1] is None else [_slots(x) for x in node[1]], None, node[3]]


def _absorb(nodes: list, other: list) -> list:
    """``nodes`` with each run that equals the unit of a repeated group of ``other`` made such a group."""
    units = {_shape(n[1]): len(n[1]) for n in other if n[1] is not None}
    out: list = []
    i = 0
    while i < len(nodes):
        hit = next((u for u, size in units.items() if _shape(nodes[i:i + size]) == u), None)
        if hit is None:
            out.append(nodes[i])
            i += 1
            continue
        unit = [_slots(x) for x in nodes[i:i + units[hit]]]
        i += units[hit]
        if out and out[-1][1] is not None and _shape(out[-1][1]) == hit:
            out[-1] = ["+", [_merge(x, y) for x, y in zip(out[-1][1], unit)], None, out[-1][3]]
        else:
            out.append(["+", unit, None, all(x[3] for x in unit)])
    return out


def align(a: list, b: list) -> list:
    """The expression that covers both."""
    a, b = _absorb(a, b), _absorb(b, a)
    x, y = list(_shape(a)), list(_shape(b))
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out += [_merge(p, q) for p, q in zip(a[i:j], b[k:m])]
        else:
            out += [[n[0], n[1], n[2], True] for n in (*a[i:j], *b[k:m])]
    return out


def infer(expressions: list[list]) -> list:
    """The wrapper of some expressions, longest first."""
    expressions = sorted(expressions, key=lambda e: (-len(e), json.dumps(_shape(e))))
    wrapper = expressions[0]
    for e in expressions[1:]:
        wrapper = align(wrapper, e)
    return wrapper


# ---------------------------------------------------------------- roles

def _leaves(nodes: list, repeated: bool = False) -> Iterator[tuple[str, object, bool]]:
    """(key, const, whether some page lacks the leaf or repeats it) of each leaf."""
    for key, inner, const, optional in nodes:
        if inner is None:
            yield key, const, repeated or optional
        else:
            yield from _leaves(inner, True)


class _Roles:
    """Follows open elements over a stream of tag keys and says what a text there is.

    ``marked``: how the article is marked, "article", "main", "word" or not at all (None);
    with a "~" the names of parts inside the marked one are not heeded, only their elements."""

    def __init__(self, marked: str | None):
        self.stack: list[tuple[str, bool, bool]] = []
        self.loose = 0  # open paragraphs and inline elements that are followed
        self.heedless = bool(marked) and marked.endswith("~")
        self.marked = marked.rstrip("~") if marked else None

    def _drop(self, i: int) -> None:
        self.loose -= sum(x[0] == "p" or x[0] in INLINE for x in self.stack[i:])
        del self.stack[i:]

    def feed(self, key: str) -> None:
        if key[0] == "/":
            if self.stack:
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == key[1:]:
                        self._drop(i)
                        break
            return
        name, *words = key.split(".")
        if name in VOID:
            return
        loose = name == "p" or name in INLINE
        if loose and not words and not self.loose:
            return
        if self.loose and name not in INLINE:  # a block closes an open paragraph
            i = len(self.stack)
            while i and (self.stack[i - 1][0] == "p" or self.stack[i - 1][0] in INLINE):
                i -= 1
            first = next((k for k in range(i, len(self.stack)) if self.stack[k][0] == "p"), None)
            if first is not None:
                self._drop(first)
        kinds = set(words)
        # an article that is called a post is one, whatever else it is called
        named = bool(kinds & OUT_WORDS) and not (name in ("article", "main") and kinds & IN_WORDS)
        if self.heedless and any(x[2] for x in self.stack):
            named = False
        if loose:
            if named or self.loose:
                self.stack.append((name, named, False))
                self.loose += 1
            return
        out = name in OUT_TAGS or named
        if name == "header":
            out = out or not any(x[2] for x in self.stack)
        self.stack.append((name, out, self._marks(name, kinds) and not out))

    def _marks(self, name: str, words: set[str]) -> bool:
        return (name == self.marked or name not in NOT_CONTAINERS
                and (self.marked == "main" and "main" in words or self.marked == "word" and bool(words & IN_WORDS)))

    def role(self) -> str:
        if any(x[1] for x in self.stack):
            return "out"
        if self.marked:
            return "in" if any(x[2] for x in self.stack) else "out"
        return "free"


def how_marked(keys: list[str], blank: Callable[[int], bool]) -> str | None:
    """How a stream of keys marks its article: by the first marker that holds a text that is neither boilerplate nor blank.

    ``blank`` tells it of the text at a place of ``keys``."""
    for marker in ("article", "main", "article~", "main~", "word"):
        follow = _Roles(marker)
        for place, key in enumerate(keys):
            if key != TEXT:
                follow.feed(key)
            elif follow.role() == "in" and not blank(place):
                return marker
    return None


def roles(keys: list[str], constant: list, marked: str | None) -> list[tuple[bool, int | None]]:
    """For each token whether a text there is content, and the hash of the template text it must differ from."""
    follow = _Roles(marked)
    out: list[tuple[bool, int | None]] = []
    for key, same in zip(keys, constant):
        if key == TEXT:
            r = follow.role()
            out.append((r != "out", same if r == "free" else None))
        else:
            follow.feed(key)
            out.append((False, None))
    return out


class Wrapper:
    def __init__(self, nodes: list, varied: bool):
        self.nodes, self.varied = nodes, varied
        self._plans: dict[tuple, list[tuple[bool, int | None]]] = {}

    def plan(self, keys: list, marked: str | None) -> list[tuple[bool, int | None]]:
        """``roles`` for each leaf of a page's expression."""
        name = json.dumps(keys), marked
        if name not in self._plans:
            page = _to_nodes(keys, iter([0] * sum(1 for _ in _flat(keys))))
            number = [0]
            for nodes in (page,):
                _number(nodes, number)
            # const of page leaves holds their number; aligning tells which wrapper leaf each one meets
            constant: list = [None] * number[0]
            a, b = _absorb(page, self.nodes), self.nodes
            for op, i, j, k, m in SequenceMatcher(None, list(_shape(a)), list(_shape(b)), autojunk=False).get_opcodes():
                if op == "equal" and self.varied:
                    for p, q in zip(a[i:j], b[k:m]):
                        for (_, place, _), (_, const, loose) in zip(_leaves([p]), _leaves([q])):
                            if place is not None and not loose:
                                constant[place] = const
            self._plans[name] = roles(list(_flat(keys)), constant, marked)
        return self._plans[name]


def _number(nodes: list, number: list[int]) -> None:
    for n in nodes:
        if n[1] is None:
            n[2] = number[0]
            number[0] += 1
        else:
            _number(n[1], number)


def blocks(stream: list[tuple[str, str]], content: list[bool]) -> str:
    """Content texts of a page, joined to blocks at block-level tags."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    for (key, text), good in zip(stream, content):
        if key == TEXT:
            if good:
                now.append(text)
        elif key.split(".")[0] == "br":
            now.append(" ")
        elif key.lstrip("/").split(".")[0] not in INLINE:
            close()
    close()
    return "\n\n".join(out)


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    stream = tokens(page or "")
    if not stream:
        return ""
    keys, leaves = fold(stream)
    flat = list(_flat(keys))
    marked = how_marked(flat, lambda leaf: all(not html.unescape(stream[i][1]).strip() for i in leaves[leaf]))
    plan = wrapper.plan(keys, marked) if wrapper else roles(flat, [None] * len(leaves), marked)
    content = [False] * len(stream)
    for (good, template), places in zip(plan, leaves):
        if good:
            for i in places:
                text = stream[i][1]
                content[i] = template is None or text.isspace() or _digest(" ".join(text.split())) != template
    return blocks(stream, content)


# ---------------------------------------------------------------- Spark side

def _host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, shapes, consts, bodies = [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            stream = tokens(page.as_py() or "")
            if not stream:
                continue
            keys, leaves = fold(stream)
            row = []
            for places in leaves:
                texts = {stream[i][1] for i in places}
                one = texts.pop() if len(texts) == 1 else None
                row.append(_digest(" ".join(one.split())) if one is not None and stream[places[0]][0] == TEXT else None)
            hosts.append(host)
            shapes.append(json.dumps(keys))
            consts.append(row)
            follow, body = _Roles(None), []
            for key, places in zip(_flat(keys), leaves):
                if key != TEXT:
                    follow.feed(key)
                elif follow.role() != "out":
                    body += [" ".join(stream[i][1].split()) for i in places]
            bodies.append(_digest("\0".join(body)))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array(consts, pa.list_(pa.int64())),
                                          pa.array(bodies, pa.int64())], ["host", "shape", "consts", "body"])


def _infer_group(t: pa.Table) -> pa.Table:
    host = t["host"][0].as_py()
    got = [(json.loads(s), c) for s, c in zip(t["shape"].to_pylist(), t["consts"].to_pylist())]
    nodes = [_to_nodes(s, iter(c)) if c is not None else s for s, c in got]
    return pa.table({"host": pa.array([host], pa.string()), "wrapper": pa.array([json.dumps(infer(nodes))]),
                     "lo": pa.array([min(t["lo"].to_pylist())], pa.int64()), "hi": pa.array([max(t["hi"].to_pylist())], pa.int64())})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, varied): the wrapper of every host of ``pages(url, html)``, as JSON, and whether its pages differ."""
    ship_package(pages.sparkSession)
    folded = store(pages.select(_host().alias("host"), "html").mapInArrow(_fold_rows, "host string, shape string, consts array<long>, body long"), "folded")
    key = ["host", F.xxhash64("shape").alias("s")]
    # a text is constant within a shape if its smallest and largest hash agree and no page lacks it
    flat = folded.select(*key, F.posexplode("consts").alias("slot", "c"))
    slots = (flat.groupBy("host", "s", "slot").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("c").alias("n"), F.count("*").alias("all"))
             .select("host", "s", F.struct("slot", F.when((F.col("lo") == F.col("hi")) & (F.col("n") == F.col("all")), F.col("lo")).alias("c")).alias("x"))
             .groupBy("host", "s").agg(F.array_sort(F.collect_list("x")).alias("x")))
    shapes = folded.groupBy(*key).agg(F.min("shape").alias("shape"), F.min("body").alias("lo"), F.max("body").alias("hi"))
    one = shapes.join(slots, ["host", "s"]).select("host", "shape", F.col("x.c").alias("consts"), "lo", "hi")
    kind = "host string, wrapper string, lo long, hi long"
    while True:  # each round leaves a wrapper for every GROUP expressions of a host, until there is one
        one = store(one.withColumn("length", F.length("shape")).withColumn("code", F.xxhash64("shape", "consts")), "expressions")
        placed = running_sum(one, ["host"], [F.col("length").desc(), "code", "shape"], F.lit(1), "place")
        groups = placed.groupBy("host", F.expr(f"place div {GROUP}").alias("g"))
        whole = store(groups.applyInArrow(lambda t: _infer_group(t), kind), "wrappers")
        if whole.count() == whole.select("host").distinct().count():
            break
        one = whole.select("host", F.col("wrapper").alias("shape"), F.lit(None).cast("array<long>").alias("consts"), "lo", "hi")
    return whole.select("host", "wrapper", (F.col("lo") != F.col("hi")).alias("varied"))


def _extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Wrapper] = {}
    for batch in batches:
        names = batch.schema.names
        hosts = batch.column(names.index("_host")).to_pylist()
        kept = [c for c in names if c not in ("_host", "_wrapper", "_varied")]
        out = []
        for i, page in enumerate(batch.column(names.index("html"))):
            w = batch.column(names.index("_wrapper"))[i]
            if hosts[i] not in known and w.is_valid:
                if len(known) > 1000:
                    known.clear()
                known[hosts[i]] = Wrapper(json.loads(w.as_py()), batch.column(names.index("_varied"))[i].as_py())
            out.append(extract(page.as_py(), known.get(hosts[i])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], [*kept, "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """``pages(url, html, ...)`` with ``text``, the article's blocks parted by empty lines."""
    wrappers = store(infer_wrappers(pages), "wrappers").select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"),
                                                              F.col("varied").alias("_varied"))
    size = wrappers.agg(F.sum(F.length("_wrapper"))).first()[0] or 0
    kept = [f for f in pages.schema.fields if f.name != "text"]
    rows = pages.select(*[f.name for f in kept]).withColumn("_host", _host())
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_CHARS else wrappers, "_host", "left")
    return joined.mapInArrow(_extract_rows, T.StructType([*kept, T.StructField("text", T.StringType())]))
