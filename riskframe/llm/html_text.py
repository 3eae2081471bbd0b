"""HTML main text by wrapper inference: a union-free regular expression per template of a host, matched to every page.

A page is a stream of tokens (container and block tags; texts). The pages of a host with the same outer containers
are one template. All whole streams of every template make its wrapper: the GROUP most frequent are aligned one after the other, and those
that the result does not fit, in groups whose results are aligned again, until one is left. Equal tokens stay, differing texts
are one text slot, a run of equal neighbours becomes a repeated group (X)+, and a part that only some pages have becomes an
optional group (X)?. Every page is then parsed by its template's wrapper, groups
repeated and left out as the page has it, so that each of its texts lies in a slot: a path of containers and a block tag, and where the
wrapper has those at several places, the place. A page that the wrapper does not fit takes the places in order.

All pages of the host are counted by slot (different pages, different texts, letters, letters in links), and these counts
decide. An article or main element is the content, whole between its first and its last varying slot and with all headings;
before and after those, a text that is the same on CONSTANT_CORE pages is template. Without such an element a slot whose text never varies, or that
is mostly links, is template, and the container with most varying text among the slots that the page has is the
content, so every template has its own. Names are a prior: menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are known by element, role or class name and are never content, unless a form or
the like holds nearly all varying text.

Defined results: a null, empty or tagless html gives its text (empty if none); a null url belongs to the host
of the empty name; very long pages are read whole; broken markup is read as far as it goes; repeated
rows give equal results and count once; an article of which nothing would be left is kept; an empty table gives an empty
result; extra columns are dropped.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, materialize, partitions, small_batches
from .url_filter import split_url

GROUP = 8              # different streams that are aligned in one go; all streams of a template meet in its wrapper
ALIGN = 4000 * 4000    # pairs of tokens that are compared at once; longer streams are aligned in pieces
CONSTANT, CONSTANT_CORE = 3, 8  # different pages on which a text must be the same to be template, outside and inside article elements
MOST = 0.8             # share of the varying text that makes a container the content
PERIOD = 16            # longest repeated group that folding looks for
WRAPPER_BYTES = 32 << 20  # wrappers of so many measured bytes are broadcast once; more meet their pages by (host, salt)
SALTS = 32

#: Element and class names. Fixed values.
RAW = "script|style|noscript|template|textarea|svg|iframe|object|select|button|title"
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr figure details dialog center menu fieldset".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote address figcaption caption hr summary legend label option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav header footer aside form head menu dialog fieldset".split())
BOILER_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb
breadcrumbs masthead header footer sidebar aside widget widgets related recommended recommendations share sharing social cookie cookies consent notice notices
alert popup modal overlay newsletter subscribe signup login form search comment comments disqus replies respond discussion pagination pager toolbar
copyright disclaimer""".split())
#: Words that make a name a state; first words of headers that hold a title; words for containers.
MODIFIERS = frozenset("has have no not with without hide hidden show is".split())
TITLED = frozenset("article entry post story content title".split())
BOXES = frozenset("container wrapper wrap box block area bar list inner outer section row col column top bottom left right unit slot panel items item links link buttons icons nav menu form 0".split())
#: Boilerplate that may also be the frame of a whole page.
SOFT = frozenset("form fieldset dialog search widget widgets header banner promo promotion modal overlay popup notice notices alert toolbar login signup @search @form @dialog @alert @alertdialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _symbol(tag: str, attributes: str) -> str:
    """Tag with its class, id and role names, numbers as 0: div.post-0"""
    if not attributes or "=" not in attributes:
        return tag
    names = []
    for kind, *value in NAMES.findall(attributes):
        names += [("@" if kind.lower() == "role" else "") + w for w in re.sub(r"[0-9]+", "0", re.sub(r"[./#]", "-", "".join(value).lower())).split()]
    return ".".join([tag, *names])


def _word(name: str) -> str | None:
    """The boilerplate word that a class or id name stands for: the whole name, its end (site-header) or its beginning before
    words for a container (ad-box). 'has-sidebar' and 'no-comments' are states, 'post-header' holds the title."""
    if name[0] == "@":
        return name if name[1:] in ROLES else None
    words = [w for w in re.split(r"[_-]+", name) if w]
    if not words or MODIFIERS.intersection(words):
        return None
    if words[-1] in BOILER_NAMES:
        return None if words[-1] == "header" and words[0] in TITLED else words[-1]
    return words[0] if words[0] in BOILER_NAMES and BOXES.issuperset(words[1:]) else None


@lru_cache(maxsize=65536)
def _kind(symbol: str, inside: bool = False) -> int:
    """2: boilerplate by its element, role or name; 1: boilerplate unless it holds nearly all varying text; 0: none. Names say nothing on
    html, body, article and main; ``inside`` an article or main, a header is the article's own."""
    tag, *names = symbol.split(".")
    if tag in ("html", "body", "article", "main"):
        return 0
    found = [tag] * (tag in BOILER_TAGS) + [w for w in map(_word, names) if w]
    if inside:
        found = [w for w in found if w != "header"]
    return 0 if not found else 1 if SOFT.issuperset(found) else 2


def hidden(path: tuple[str, ...], wide: set[tuple] | frozenset = frozenset(), soft: bool = True) -> bool:
    """Inside boilerplate; containers in ``wide`` are none, and without ``soft`` only the certain kinds count."""
    inside = False
    for i, symbol in enumerate(path):
        kind = _kind(symbol, inside)
        if kind == 2 or kind == 1 and soft and path[:i + 1] not in wide:
            return True
        inside = inside or core((symbol,))
    return False


def blocks(html: str) -> Iterator[tuple[tuple[str, ...], str, str, int]]:
    """(container path, block tag, text, characters inside links) of every block, in page order."""
    path: list[str] = []
    tag, parts, linked, in_link = "", [], 0, 0

    def close() -> Iterator[tuple[tuple[str, ...], str, str, int]]:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        parts, got, linked = [], linked, 0
        if text:
            yield tuple(path), tag, text, got

    for m in TOKEN.finditer(html):
        if m[3]:
            name = m[3].lower()
            if name in CONTAINERS or name in BLOCKS:
                yield from close()
                tag, in_link = "", 0  # a link that is not closed ends with its block
                if name in BLOCKS:
                    tag = "" if m[2] else name
                elif not m[2]:
                    if m[4][-1:] != "/":
                        path.append(_symbol(name, m[4]))
                else:
                    for i in range(len(path) - 1, -1, -1):
                        if path[i].split(".", 1)[0] == name:
                            del path[i:]
                            break
            elif name == "a":  # a name to jump to is no link
                in_link = int(not m[2] and HREF.search(m[4]) is not None)
            elif name in ("br", "img", "wbr", "input"):
                parts.append(" ")
        elif m[0][0] != "<" or m[0] == "<":
            text = unescape(m[0])
            parts.append(text)
            if in_link:
                linked += len(text.strip())
    yield from close()


# ---------------------------------------------------------------- wrapper inference

def stream(page: list[tuple[tuple[str, ...], str, str, int]]) -> list:
    """Token stream of a page's blocks: '<x' opens a container, '>x' closes it, 'x#' is a block's text slot."""
    out, open_ = [], ()
    for path, tag, _, _ in page:
        same = 0
        while same < min(len(path), len(open_)) and path[same] == open_[same]:
            same += 1
        out += [">" + s for s in reversed(open_[same:])] + ["<" + s for s in path[same:]] + [tag + "#"]
        open_ = path
    return out + [">" + s for s in reversed(open_)]


def fold(seq: list) -> list:
    """Neighbouring equal runs become ('+', run), short runs first."""
    for p in range(1, PERIOD + 1):
        out, i = [], 0
        while i < len(seq):
            run = seq[i:i + p]
            j = i + p
            while len(run) == p and seq[j:j + p] == run:
                j += p
            if j > i + p and not (p == 1 and isinstance(run[0], tuple)):
                out.append(("+", tuple(run)))
                i = j
            elif j > i + p:
                out.append(run[0])
                i = j
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


def unfold(seq: list) -> list:
    """A stream that folds to ``seq``, never longer than the folded one was: a run twice."""
    return [y for x in seq for y in (2 * unfold(x[1]) if isinstance(x, tuple) else [x])]


def _absorb(seq: list, bodies: set[tuple]) -> list:
    """Single occurrences of a group that repeats elsewhere count as that group."""
    for body in sorted(bodies, key=len):
        out, i, n = [], 0, len(body)
        while i < len(seq):
            if tuple(seq[i:i + n]) == body or seq[i] == ("+", body):
                step = 1 if seq[i] == ("+", body) else n
                if not (out and out[-1] == ("+", body)):
                    out.append(("+", body))
                i += step
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


def _bodies(seq: list) -> set[tuple]:
    return {x[1] for x in seq if isinstance(x, tuple) and x[0] == "+"}


def _opcodes(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """Opcodes of an alignment of all of both. Beyond ALIGN pairs it is made of pieces between tokens that both have once, or else of halves."""
    if len(a) * len(b) <= ALIGN:
        return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    in_a, in_b = Counter(a), Counter(b)
    at = {x: k for k, x in enumerate(b) if in_b[x] == 1}
    ends, chain = [], []  # longest ascending chain of such tokens: the smallest end of each length, and every token with its forerunner
    last: list[int] = []
    for i, x in enumerate(a):
        if in_a[x] == 1 and x in at:
            n = bisect_left(ends, at[x])
            ends[n:n + 1], last[n:n + 1] = [at[x]], [len(chain)]
            chain.append((i, at[x], last[n - 1] if n else None))
    cuts, now = [], last[-1] if last else None
    while now is not None:
        i, k, now = chain[now]
        cuts.append((i, k, 1))
    out, i, k = [], 0, 0
    for j, m, n in [*(reversed(cuts) if cuts else [(len(a) // 2, len(b) // 2, 0)]), (len(a), len(b), 0)]:
        out += [(op, i + w, i + x, k + y, k + z) for op, w, x, y, z in _opcodes(a[i:j], b[k:m])]
        if n:
            out.append(("equal", j, j + 1, m, m + 1))
        i, k = j + n, m + n
    return out


def _optional(x: tuple | str) -> bool:
    return isinstance(x, tuple) and x[0] == "?"


def merge(wrapper: list, page: list) -> list:
    """The wrapper that fits both, a wrapper and a page or another wrapper: mismatches become optional or repeated groups."""
    plain = [x for x in wrapper]
    both = _bodies(plain) | _bodies(page)
    a, b = _absorb(plain, both), _absorb(page, both)
    bare = lambda seq: [x[1][0] if _optional(x) and len(x[1]) == 1 else x for x in seq]
    out = []
    for op, i, j, k, m in _opcodes(bare(a), bare(b)):
        if op == "equal":
            out += [y if _optional(y) else x for x, y in zip(a[i:j], b[k:m])]
            continue
        out += [x if _optional(x) else ("?", (x,)) for x in [*a[i:j], *b[k:m]]]
    return out


def infer(pages: list[list]) -> list:
    """Wrapper of the pages' streams, iterated until it is stable."""
    return unite([fold(p) for p in pages])


def unite(folded: list[list]) -> list:
    """Wrapper of folded streams or of wrappers, iterated until it is stable."""
    streams = sorted(folded, key=len)
    wrapper = streams[0] if streams else []
    for _ in range(3):
        before = wrapper
        for s in streams:
            wrapper = merge(wrapper, s)
        if wrapper == before:
            break
    return wrapper


def show(wrapper: list) -> str:
    """The wrapper as a regular expression."""
    return " ".join(f"({show(list(x[1]))}){x[0]}" if isinstance(x, tuple) else x for x in wrapper)


def slots(wrapper: list) -> list[str]:
    """The wrapper's text slots in order, as path#tag. Optional and repeated groups are walked like their content."""
    stack, out = [], []
    todo = list(reversed(wrapper))
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += reversed(x[1])
        elif x[0] == "<":
            stack.append(x[1:])
        elif x[0] == ">":
            if x[1:] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(x[1:]):]
        else:
            key = "/".join(stack) + "#" + x[:-1]
            if not out or out[-1] != key:
                out.append(key)
    return out


class Template:
    """A wrapper made ready for parsing: its elements with the slot names of their texts."""

    def __init__(self, wrapper: list, name: str) -> None:
        self.order = slots(wrapper)
        self.places: dict[str, list[int]] = {}
        for i, key in enumerate(self.order):
            self.places.setdefault(key, []).append(i)
        self.name, self.stack, self.at = name, [], -1
        self.program = self._ready(wrapper)

    def slot(self, key: str, place: int) -> str:
        """The slot of the order's ``place``: its key, and the place among its like if there are several."""
        p = self.places[key]
        return key if len(p) == 1 else f"{key}@{self.name}:{p.index(place)}"

    def _ready(self, wrapper: list) -> list:
        out = []
        for x in wrapper:
            if isinstance(x, (tuple, list)):
                out.append((x[0], self._ready(x[1])))
                continue
            slot = None
            if x[0] == "<":
                self.stack.append(x[1:])
            elif x[0] == ">":
                if x[1:] in self.stack:
                    del self.stack[len(self.stack) - 1 - self.stack[::-1].index(x[1:]):]
            else:
                key = "/".join(self.stack) + "#" + x[:-1]
                if self.at < 0 or self.order[self.at] != key:  # as in slots(): neighbours of one key are one place
                    self.at += 1
                slot = self.slot(key, self.at)
            out.append(("", x, slot))
        return out

    def parse(self, tokens: list) -> list[str] | None:
        """The slots of the page's texts, if the wrapper as a regular expression fits the page; groups take all they can."""
        found: list[str] = []
        end = self._walk(self.program, tokens, 0, found)
        return found if end == len(tokens) else None

    def _walk(self, program: list, tokens: list, i: int, found: list[str]) -> int | None:
        for x in program:
            if not x[0]:
                if i >= len(tokens) or tokens[i] != x[1]:
                    return None
                i += 1
                if x[2] is not None:
                    found.append(x[2])
                continue
            again = x[0] == "+"
            n, have = 0, len(found)
            while (j := self._walk(x[1], tokens, i, found)) is not None and j > i:
                i, n, have = j, n + 1, len(found)
                if not again:
                    break
            del found[have:]
            if again and not n:
                return None
        return i

    def match(self, page: list[tuple[tuple[str, ...], str, str, int]]) -> list[str]:
        """The slot of every block: by parsing, else in order, where a block that has no place ahead starts a repeated group anew;
        what the wrapper lacks is its path and tag."""
        got = self.parse(stream(page))
        if got is not None:
            return got
        at, out = 0, []
        for path, tag, _, _ in page:
            key = "/".join(path) + "#" + tag
            p = self.places.get(key)
            if p:
                at = p[min(bisect_left(p, at), len(p) - 1)]
                key = self.slot(key, at)
            out.append(key)
        return out


def core(path: tuple[str, ...]) -> bool:
    """Inside an article or main element."""
    return any(s.split(".", 1)[0] in ("article", "main") or "@main" in s.split(".") for s in path)


def template_of(page: list[tuple[tuple[str, ...], str, str, int]]) -> str:
    """Name of the page's template: its outer containers, down to article, main, lists and tables."""
    outer = set()
    for path, _, _, _ in page:
        if hidden(path):
            continue
        n = 0
        while n < len(path) and path[n].split(".", 1)[0] in ("html", "body", "div", "section", "center"):
            n += 1
        outer.add("/".join(path[:n + core(path[n:n + 1])]))
    return _digest("\n".join(sorted(outer))).hex()


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _number(text: str) -> int:
    return int.from_bytes(_digest(text), "big", signed=True)


def place(page: list[tuple[tuple[str, ...], str, str, int]], orders: dict) -> list[int]:
    """The number of every block's slot in the wrapper of the page's template."""
    template = orders.get(template_of(page)) if orders else None
    keys = template.match(page) if template else ["/".join(path) + "#" + tag for path, tag, _, _ in page]
    number = {k: _number(k) for k in set(keys)}
    return [number[k] for k in keys]


def evidence(page: list[tuple[tuple[str, ...], str, str, int]], orders: dict) -> tuple[int, dict[int, tuple[int, int, int]]]:
    """Number of the page's text, and per slot that names do not rule out (number of its texts, letters, letters in links)."""
    texts: dict[int, list[str]] = {}
    links, whole = Counter(), []
    for (path, _, text, linked), slot in zip(page, place(page, orders)):
        if not hidden(path, soft=False):
            texts.setdefault(slot, []).append(text)
            links[slot] += linked
            whole.append(text)
    return _number("\n".join(whole)), {s: (_number("\n".join(sorted(t))), sum(map(len, t)), links[s]) for s, t in texts.items()}


def choose(page: list[tuple[tuple[str, ...], str, str, int]], wrapper: dict | None) -> list[bool]:
    """Whether each block is content. wrapper: the host's templates, and [different pages, whether the text never
    varies, letters, letters in links] of every slot that several pages have; a slot of this page alone counts by itself."""
    orders, known = (wrapper["orders"], wrapper["slots"]) if wrapper else ({}, {})
    at = place(page, orders)
    size, links = Counter(), Counter()
    for (_, _, text, linked), s in zip(page, at):
        size[s] += len(text)
        links[s] += linked
    counts = {s: known.get(str(s)) or [1, False, size[s], links[s]] for s in size}

    def varies(slot: int, least: int) -> bool:
        n, same, letters, linked = counts[slot]
        return not (same and n >= least) and linked <= 0.5 * letters

    wide: set[tuple] = set()
    is_core = [core(p) and not hidden(p) for p, _, _, _ in page]
    if not any(is_core):  # a form, or an element named like one, that holds nearly all varying text is no boilerplate
        mass = Counter()
        for path, s in {(p, s) for (p, _, _, _), s in zip(page, at)}:
            if not hidden(path, soft=False) and varies(s, CONSTANT):
                for depth in range(len(path) + 1):
                    mass[path[:depth]] += counts[s][2] / counts[s][0]
        wide = {p for p, v in mass.items() if p and _kind(p[-1]) == 1 and v > MOST * mass[()]}
        is_core = [core(p) and not hidden(p, wide) for p, _, _, _ in page]
    if any(is_core):
        constant = lambda s: counts[s][1] and counts[s][0] >= CONSTANT_CORE
        run = [i for i, (c, s) in enumerate(zip(is_core, at)) if c and not constant(s)]
        if not run:
            return is_core
        return [c and (run[0] < i < run[-1] or tag in HEADINGS or not constant(s)) for i, (c, s, (_, tag, _, _)) in enumerate(zip(is_core, at, page))]
    open_ = {(p, s) for (p, _, _, _), s in zip(page, at) if not hidden(p, wide) and varies(s, CONSTANT)}
    if not open_:
        return [False] * len(page)
    mass = Counter()  # no article element: the container with most varying text, with all that lies in it
    for path, s in open_:
        for depth in range(len(path) + 1):
            mass[path[:depth]] += counts[s][2] / counts[s][0]
    least = MOST * mass[()] * (1 - 1e-9)
    top = max(mass, key=lambda p: (mass[p] >= least, len(p) if mass[p] >= least else 0, mass[p], p))
    return [(p, s) in open_ and p[:len(top)] == top for (p, _, _, _), s in zip(page, at)]


def main_text(html: str, wrapper: dict | None) -> str:
    """The content blocks joined by line ends."""
    page = list(blocks(html))
    return "\n".join(text for (_, _, text, _), ok in zip(page, choose(page, wrapper)) if ok)


# ---------------------------------------------------------------- Spark

def _thaw(x: list | str) -> tuple | str:
    return (x[0], tuple(map(_thaw, x[1]))) if isinstance(x, list) else x


def wrappers(pages: DataFrame) -> DataFrame:
    """host, orders (JSON): each template's wrapper, where a path and tag occur at several places."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: Counter = Counter()
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = list(blocks(html or ""))
                if page:
                    got[host, template_of(page), json.dumps(fold(stream(page)))] += 1
            if got:
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in got], pa.string()) for i in range(3)), pa.array(list(got.values()), pa.int64())],
                                                 ["host", "template", "stream", "n"])

    seen = pages.select("host", "html").mapInArrow(read, "host string, template string, stream string, n long") \
        .groupBy("host", "template", "stream").agg(F.sum("n").alias("n"))
    keys = ["host", "template"]
    seen = materialize(seen.withColumn("h", F.xxhash64("stream")), "html-streams")
    first = seen.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "h"))).where(F.col("rank") <= GROUP)
    made = materialize(_united(first, keys, infer), "html-first")
    # of templates with more streams, those that the first wrapper does not fit are aligned group by group, in rounds
    many = seen.groupBy(*keys).agg(F.count("*").alias("streams")).where(F.col("streams") > GROUP)
    rest = materialize(seen.select(*keys, "stream", "h").join(many.select(*keys), keys, "left_semi").join(made.withColumnRenamed("stream", "wrapper"), keys)
                       .select(*keys, "stream", "h", "wrapper").mapInArrow(_unfit, "host string, template string, stream string, h long"), "html-unfit")
    size = rest.groupBy(*keys).agg(F.count("*").alias("size"))
    most = size.agg(F.max("size")).first()[0]
    while most and most > 1:
        dealt = rest.join(size, keys).withColumn("part", F.pmod("h", F.ceil(F.col("size") / GROUP)))
        rest = materialize(_united(dealt, [*keys, "part"], unite).select(*keys, "stream", F.xxhash64("stream").alias("h")), "html-united")
        size = rest.groupBy(*keys).agg(F.count("*").alias("size"))
        most = size.agg(F.max("size")).first()[0]
    if most:
        both = made.join(rest.select(*keys), keys, "left_semi").select(*keys, "stream", F.lit(0).cast("long").alias("h")).unionByName(rest.withColumn("h", F.lit(1).cast("long")))
        made = made.join(rest.select(*keys), keys, "left_anti").unionByName(_united(both, keys, unite))
    cell = F.concat(F.lit('"'), "template", F.lit('": '), "stream")
    return made.mapInArrow(_several, "host string, template string, stream string") \
        .groupBy("host").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(cell)), ", "), F.lit("}")).alias("orders"))


def _united(streams: DataFrame, keys: list[str], work: Callable[[list], list]) -> DataFrame:
    """host, template, stream (JSON): for every group of ``keys`` (host, template, ...) what ``work`` makes of its streams in order of h."""
    n, ddl = len(keys), "host string, template string, stream string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (*now[:2], json.dumps(work([_thawed(raw) for raw in group])))], ["host", "template", "stream"])
        for b in batches:
            for *key, raw in zip(*(c.to_pylist() for c in b.columns[:n + 1])):
                if key != now:
                    if group:
                        yield row()
                    now, group = key, []
                group.append(raw)
        if group:
            yield row()

    return streams.select(*keys, "stream", "h").repartition(partitions(streams.sparkSession), *keys).sortWithinPartitions(*keys, "h").mapInArrow(run, ddl)


def _thawed(raw: str) -> list:
    return [_thaw(x) for x in json.loads(raw)]


def _unfit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose stream the wrapper (fifth column) does not parse."""
    templates: dict[str, Template] = {}
    for b in batches:
        lost = []
        for i, (name, raw, wrapper) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist())):
            if wrapper not in templates:
                if len(templates) > 500:
                    templates.clear()
                templates[wrapper] = Template(_thawed(wrapper), name)
            if templates[wrapper].parse(unfold(_thawed(raw))) is None:
                lost.append(i)
        if lost:
            yield b.select([0, 1, 2, 3]).take(pa.array(lost))


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers with a path and tag at several places."""
    for b in batches:
        orders = [slots(_thawed(raw)) for raw in b.column(2).to_pylist()]
        kept = [i for i, order in enumerate(orders) if len(set(order)) < len(order)]
        if kept:
            yield b.take(pa.array(kept))


class _Parsed(dict):
    """A host's JSON -> templates (and counts); read once a task."""

    def __missing__(self, raw: str) -> dict:
        if len(self) > 500:
            self.clear()
        value = json.loads(raw)
        made = value.get("orders", {}) if "slots" in value else value
        ready = {name: Template([_thaw(x) for x in wrapper], name) for name, wrapper in made.items()}
        self[raw] = {"orders": ready, "slots": value["slots"]} if "slots" in value else ready
        return self[raw]


def _over_pages(rows: DataFrame, made: DataFrame, cell: str, work: Callable[[list, list, list, list], pa.RecordBatch | None], ddl: str) -> DataFrame:
    """``work(page_ids, urls, htmls, (host, the host's parsed cell or None))`` over all pages. The hosts' cells are measured: up to WRAPPER_BYTES they
    are one broadcast; beyond, pages are dealt by (host, salt) and each such group's cell comes once, in front of its pages."""
    spark = rows.sparkSession
    small_batches(spark)
    size = made.agg(F.sum(F.octet_length("host") + F.octet_length(cell)).alias("bytes")).first()["bytes"] or 0
    if size <= WRAPPER_BYTES:
        send = spark.sparkContext.broadcast({r["host"]: r[cell] for r in made.select("host", cell).collect()})  # at most WRAPPER_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Parsed()
            for b in batches:
                ids, urls, hosts, htmls = (c.to_pylist() for c in b.columns)
                out = work(ids, urls, htmls, [(h, known[send.value[h]] if h in send.value else None) for h in hosts])
                if out is not None:
                    yield out

        return rows.select("page_id", "url", "host", "html").mapInArrow(run, ddl)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of, now = _Parsed(), None, None
        for b in batches:
            ids, urls, htmls, hosts = [], [], [], []
            for i, u, host, html, salt, raw in zip(*(c.to_pylist() for c in b.columns)):
                if raw is not None:
                    of, now = (host, salt), known[raw]
                    continue
                ids.append(i), urls.append(u), htmls.append(html), hosts.append((host, now if of == (host, salt) else None))
            out = work(ids, urls, htmls, hosts) if ids else None
            if out is not None:
                yield out

    pages = rows.select("page_id", "url", "host", "html", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("string").alias("cell"))
    cells = made.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "host", F.lit(None).cast("string").alias("html"),
                        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col(cell).alias("cell"))
    return cells.unionByName(pages).repartition(partitions(spark), "host", "salt").sortWithinPartitions("host", "salt", F.col("cell").asc_nulls_last()).mapInArrow(meet, ddl)


def counts(rows: DataFrame, made: DataFrame) -> DataFrame:
    """host, slots (JSON): what choose() wants to know of every slot that several different pages of the host have."""
    def work(ids: list, urls: list, htmls: list, hosts: list) -> pa.RecordBatch | None:
        out: list[tuple] = []
        for html, (host, templates) in zip(htmls, hosts):
            number, found = evidence(list(blocks(html or "")), templates or {})
            out += [(host, slot, number, *v) for slot, v in found.items()]
        if not out:
            return None
        cells = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.string()), *(pa.array(c, pa.int64()) for c in cells[1:])], ["host", "slot", "page", "text", "letters", "linked"])

    found = _over_pages(rows, made, "orders", work, "host string, slot long, page long, text long, letters long, linked long")
    # copies of a page count once; both sums are partial before they are shuffled
    each = found.groupBy("host", "slot", "page").agg(F.min("text").alias("a"), F.max("text").alias("z"), F.max("letters").alias("letters"), F.max("linked").alias("linked"))
    slot = each.groupBy("host", "slot").agg(F.count("*").alias("n"), (F.min("a") == F.max("z")).alias("same"), F.sum("letters").alias("letters"), F.sum("linked").alias("linked"))
    cell = F.format_string('"%d":[%d,%s,%d,%d]', "slot", "n", F.col("same").cast("string"), "letters", "linked")
    return slot.where("n > 1").groupBy("host").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(cell)), ","), F.lit("}")).alias("slots"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row a page."""
    rows = columns_of(pages, page_id="long", url="string", html="string")
    rows = rows.withColumn("host", split_url(F.col("url"))[0])
    orders = materialize(wrappers(rows), "html-wrappers")
    per_slot = counts(rows, orders)
    cell = F.concat(F.lit('{"orders":'), F.coalesce("orders", F.lit("{}")), F.lit(',"slots":'), F.coalesce("slots", F.lit("{}")), F.lit("}"))
    made = materialize(orders.join(per_slot, "host", "full").select("host", cell.alias("wrapper")), "html-slots")

    def work(ids: list, urls: list, htmls: list, hosts: list) -> pa.RecordBatch:
        text = [main_text(html, wrapper) if html else "" for html, (_, wrapper) in zip(htmls, hosts)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                          ["page_id", "url", "text", "n_chars"])

    return _over_pages(rows, made, "wrapper", work, "page_id long, url string, text string, n_chars long")
