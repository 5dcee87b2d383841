"""Main text of web pages by wrappers inferred per host.

A page is read as a stream of structural tags, constant texts and slots.  Tandem
repeats in the stream fold into repeated groups, so pages of one template that
differ in the number of their paragraphs share one skeleton.  The skeletons of a
host are aligned one after another: what only one side has becomes optional, and
a group that repeats in one and stands once in the other becomes repeated.  The
result is a union-free regular expression, the host's wrapper, which says where
its pages hold the article.  Every skeleton takes part: those of a host are
aligned in groups, and the groups' wrappers with each other, round by round.

Texts outside the article that all pages with something in their place share are
template: they stand in the stream by their hash and say nothing about where the
article is.  Text that differs is a slot.  Inside the article no text is dropped
for being the same elsewhere; only what its own markup names as menu, notice,
advert and the like goes, on every host alike.

A wrapper is matched with sets of states, in time linear in the page.  A page it
does not match is read by its own structure, so every page is extracted whole.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerframe.llm.common import store, utf8

#: Skeletons, or wrappers of them, that one task aligns.
GROUP = 32
#: Items a wrapper may have; a longer one becomes any sequence of its tokens.
ITEMS = 2000
#: Articles that must differ before a text outside them that they share counts as template.
LEAST = 2
#: Longest body of a repeated group, in tokens; pages with longer ones have a skeleton each.
BODY = 24
#: Sets of states a matcher remembers.
STATES = 20_000

VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "xmp", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
#: Elements, roles, and words of a class or id that never hold the article.
NOT_ARTICLE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "object", "canvas", "svg", "math", "audio", "video", *RAW}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
WORDS = {
    "ad", "ads", "adsense", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "consent", "gdpr", "notice", "notices", "alert",
    "popup", "modal", "overlay", "subscribe", "subscription", "signup", "login", "social", "share", "sharing", "related", "recommended",
    "rail", "aside", "widget", "pagination", "pager", "respond", "disqus", "replies", "footer", "copyright", "toolbar", "nav", "navbar",
    "navigation", "menu", "search", "masthead", "topbar",
}
PREFIXES = ("advert", "comment", "cookie", "newsletter", "sidebar", "breadcrumb")
#: What ends an open paragraph, and elements that end their own kind.
ENDS_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
ARTICLE_WORDS = {"articlebody", "article-body", "entry-content", "post-content", "article-content", "story-body", "post-body"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DIGITS = re.compile(r"[0-9]+")
MAIN = ("article", "marked", "main")


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(utf8(text), digest_size=8).digest(), "little", signed=True)


def class_of(attributes: str) -> str:
    """The class, with 0 for all digits: numbers in it belong to the page."""
    found = CLASS.search(attributes) if attributes else None
    return DIGITS.sub("0", found[1] or found[2] or found[3] or "") if found else ""


def kind_of(name: str, attributes: str) -> str:
    """"!" for what never holds the article, one of ``MAIN`` for what does, else ""."""
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    named = f"{values.get('class', '')} {values.get('id', '')}"
    words = re.split(r"[^a-z0-9]+", named)
    if name in ("html", "body"):
        return ""
    if name == "article":
        return "!" if any(w.startswith("comment") for w in words) else "article"
    if name in NOT_ARTICLE or values.get("role") in ROLES:
        return "!"
    if values.get("itemprop") == "articlebody" or ARTICLE_WORDS & set(named.split()):
        return "marked"
    if name == "main" or values.get("role") == "main":
        return "main"
    if any(w in WORDS or w.startswith(PREFIXES) for w in words):
        return "!"
    return "header" if name == "header" or "header" in words else ""


def outside(kinds: frozenset[str]) -> bool:
    """Neither within an article nor within what never holds one."""
    return "!" not in kinds and not kinds.intersection(MAIN)


class Page:
    """The structural stream of a page and its blocks of text.

    A block outside article elements whose key is in ``template`` is constant.
    """

    def __init__(self, source: str, template: frozenset[int] = frozenset()):
        self.stream: list[str] = []
        #: (text, kinds of the open elements, their path, class of the last) of each block
        self.blocks: list[tuple[str, frozenset[str], str, str]] = []
        #: whether each block's text is template
        self.constant: list[bool] = []
        self._template = template
        self._open: list[tuple[str, str, str]] = []
        self._text: list[str] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            hit = TOKEN.search(source, at)
            if hit is None:
                self._text.append(source[at:])
                break
            if hit.start() > at:
                self._text.append(source[at : hit.start()])
            at = hit.end()
            if hit[0].startswith("<![CDATA["):
                self._text.append(html.escape(hit[0][9:].removesuffix("]]>")))
            name = (hit[2] or hit[5] or "").lower()
            if not name:
                continue
            if hit[1] or hit[4]:
                self._close(name)
                continue
            attributes = hit[3] or hit[6] or ""
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else size
                continue
            self._start(name, attributes)
        self._end_block()
        while self._open:
            self.stream.append(f"/{self._open.pop()[0]}")

    def _start(self, name: str, attributes: str) -> None:
        kind = kind_of(name, attributes)
        if name in INLINE and kind != "!":
            if name in ("br", "img", "wbr"):
                self._text.append(" " if name == "br" else "")
            return
        self._end_block()
        if name in VOID:
            return
        if name == "body":
            self._close("head")
        if self._open and (self._open[-1][0].rstrip("!") == "p" or name in ENDS_ITSELF and self._open[-1][0] == name):
            self.stream.append(f"/{self._open.pop()[0]}")
        symbol = name + ("!" if kind == "!" else "*" if kind in MAIN else "")
        self.stream.append(symbol)
        self._open.append((symbol, kind, class_of(attributes)))

    def _close(self, name: str) -> None:
        depth = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i][0].rstrip("!*") == name), None)
        if depth is None:
            if name not in INLINE:
                self._end_block()
            return
        self._end_block()
        while len(self._open) > depth:
            self.stream.append(f"/{self._open.pop()[0]}")

    def _end_block(self) -> None:
        text = " ".join(html.unescape("".join(self._text)).split()) if self._text else ""
        self._text.clear()
        if text:
            kinds = frozenset(kind for _, kind, _ in self._open)
            block = (text, kinds, " ".join(symbol for symbol, _, _ in self._open), self._open[-1][2] if self._open else "")
            key = self.key(block)[1] if self._template and outside(kinds) else None
            self.constant.append(key in self._template)
            self.stream.append(f"#{key}" if self.constant[-1] else "#")
            self.blocks.append(block)

    @staticmethod
    def key(block: tuple[str, frozenset[str], str, str]) -> tuple[int, int]:
        """Hashes of a block's place, and of the place with the text."""
        place = f"{block[2]}|{block[3]}"
        return hashed(place), hashed(f"{place}|{block[0]}")

    def keys(self) -> list[tuple[int, int]]:
        return sorted({self.key(b) for b in self.blocks if outside(b[1])})

    def container(self) -> tuple[str, int]:
        """What holds the article by this page alone, and how much text it holds."""
        free = [b for b, constant in zip(self.blocks, self.constant, strict=True) if "!" not in b[1] and not constant]
        free = free or [b for b in self.blocks if "!" not in b[1]]
        for kind in MAIN:
            size = sum(len(b[0]) for b in free if kind in b[1])
            if size:
                return kind, size
        held: Counter[str] = Counter()
        for text, kinds, path, _ in free:
            if "header" not in kinds:
                held[path.rpartition(" ")[0]] += len(text)
        return max(held.items(), key=lambda x: (x[1], x[0])) if held else ("", 0)

    def text(self, container: str) -> str:
        inside = (lambda b: container in b[1]) if container in MAIN else (lambda b: "header" not in b[1] and f"{b[2]} ".startswith(f"{container} "))
        return "\n".join(b[0] for b in self.blocks if "!" not in b[1] and (not container or inside(b)))


def fold(stream: list[str], longest: int = BODY) -> list:
    """The stream with tandem repeats as tuples, shortest bodies first."""
    items: list = list(stream)
    for size in range(1, longest + 1):
        out, i = [], 0
        while i < len(items):
            body = items[i : i + size]
            n = 1
            while len(body) == size and items[i + n * size : i + (n + 1) * size] == body:
                n += 1
            if n > 1:
                out.append(tuple(body))
                i += n * size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def written(items: list | tuple) -> str:
    return " ".join(f"( {written(x)} )+" if isinstance(x, tuple) else x for x in items)


def parsed(skeleton: str) -> list:
    stack: list[list] = [[]]
    for part in skeleton.split():
        if part == "(":
            stack.append([])
        elif part == ")+":
            body = tuple(stack.pop())
            stack[-1].append(body)
        else:
            stack[-1].append(part)
    return stack[0]


def _repeat_alike(items: list, other: list) -> list:
    """``items`` with single occurrences of the other's repeated bodies made repeated."""
    for body in [x for x in other if isinstance(x, tuple)]:
        out, i = [], 0
        while i < len(items):
            if tuple(items[i : i + len(body)]) == body:
                out.append(body)
                i += len(body)
            else:
                out.append(items[i])
                i += 1
        items = [x for i, x in enumerate(out) if not (i and isinstance(x, tuple) and x == out[i - 1])]
    return items


def align(wrapper: list[tuple], other: list[tuple]) -> list[tuple]:
    """(item, optional) pairs that generate whatever either of two wrappers did."""

    def grown(one: list[tuple], by: list[tuple]) -> list[tuple]:
        items = [x for x, _ in one]
        alike = _repeat_alike(items, [x for x, _ in by])
        if alike == items:
            return one
        optional = {x for x, o in one if o}
        return [(x, x in optional) for x in alike]

    other = grown(other, wrapper)
    wrapper = grown(wrapper, other)
    out: list[tuple] = []
    pairs = difflib.SequenceMatcher(None, [x for x, _ in wrapper], [x for x, _ in other], autojunk=False).get_opcodes()
    for what, a, b, c, d in pairs:
        if what == "equal":
            out += [(x, o or p) for (x, o), (_, p) in zip(wrapper[a:b], other[c:d], strict=True)]
        else:
            out += [(x, True) for x, _ in wrapper[a:b]] + [(x, True) for x, _ in other[c:d]]
    return out if len(out) <= ITEMS else loosened(out)


def loosened(wrapper: list[tuple]) -> list[tuple]:
    """Any sequence of a wrapper's tokens."""

    def tokens(items) -> Iterator[str]:
        for x in items:
            if isinstance(x, tuple):
                yield from tokens(x)
            else:
                yield x

    return [(ANY + tuple(sorted(set(tokens([x for x, _ in wrapper])) - set(ANY))), True)]


#: Marks a repeated group whose tokens may stand in any order.
ANY = ("*",)


def plain(skeleton: str) -> list[tuple]:
    """A skeleton as a wrapper in which nothing is optional."""
    return [(x, False) for x in parsed(skeleton)]


def to_text(wrapper: list[tuple]) -> str:
    return json.dumps(wrapper)


def from_text(text: str) -> list[tuple]:
    def item(x):
        return tuple(item(y) for y in x) if isinstance(x, list) else x

    return [(item(x), optional) for x, optional in json.loads(text)]


class Matcher:
    """A wrapper as a machine over sets of states; slots may be empty.

    Sets met before are remembered with where each token leads, so a token costs
    one look-up; the table starts anew at ``STATES`` sets.
    """

    def __init__(self, wrapper: list[tuple]):
        #: per state, where it leads without a token, and with one
        self.free: list[list[int]] = [[]]
        self.by: list[dict[str, int]] = [{}]
        end = 0
        for item, optional in wrapper:
            end = self._add(item, optional, end)
        self.end = end
        self._forget()

    def _state(self) -> int:
        self.free.append([])
        self.by.append({})
        return len(self.free) - 1

    def _add(self, item, optional: bool, at: int) -> int:
        start = self._state()
        self.free[at].append(start)
        if isinstance(item, tuple) and item[:1] == ANY:
            last = start
            self.by[start] = dict.fromkeys(item[1:], start)
        elif isinstance(item, tuple):
            last = start
            for part in item:
                last = self._add(part, False, last)
            self.free[last].append(start)
        else:
            last = self._state()
            self.by[start][item] = last
        # a way out of its own: whoever skips a group must not land where it repeats
        end = self._state()
        self.free[last].append(end)
        if optional or item == "#":
            self.free[start].append(end)
        return end

    def _reached(self, states: set[int]) -> int:
        """Number of the set with all that its states lead to without a token."""
        found, rest = set(states), list(states)
        while rest:
            for to in self.free[rest.pop()]:
                if to not in found:
                    found.add(to)
                    rest.append(to)
        key = frozenset(found)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.numbers[key]

    def _forget(self) -> None:
        self.numbers: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._reached({0})

    def fits(self, stream: list[str]) -> bool:
        if len(self.sets) > STATES:
            self._forget()
        now = self.start
        for token in stream:
            to = self.steps[now].get(token)
            if to is None:
                to = self._reached({self.by[s][token] for s in self.sets[now] if token in self.by[s]})
                self.steps[now][token] = to
            if not self.sets[to]:
                return False
            now = to
        return self.end in self.sets[now]


def merged(parts: list[tuple[str, dict[str, int]]]) -> tuple[str, dict[str, int]]:
    """One wrapper of several, and the characters that each container holds."""
    wrapper: list[tuple] = []
    held: Counter[str] = Counter()
    for i, (text, sizes) in enumerate(parts):
        wrapper = align(wrapper, from_text(text)) if i else from_text(text)
        held.update(sizes)
    return to_text(wrapper), dict(held)


def container_of(held: dict[str, int]) -> str:
    best = [k for k in MAIN if held.get(k)] or [max(held.items(), key=lambda x: (x[1], x[0]))[0]]
    return best[0]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page without a template: its skeleton and container, the hash of its text, the keys of its blocks."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("place", pa.int64()), ("key", pa.int64())])))
    names = ["host", "skeleton", "container", "size", "article", "blocks"]
    for batch in batches:
        rows = []
        for host, source in zip(batch[0].to_pylist(), batch[1], strict=True):
            page = Page(source.as_py())
            container, size = page.container()
            blocks = [{"place": place, "key": key} for place, key in page.keys()]
            whole = hashed("\n".join(b[0] for b in page.blocks if "!" not in b[1]))
            rows.append((host, written(fold(page.stream)), container, size, whole, blocks))
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def host_templates(read: DataFrame) -> DataFrame:
    """(host, template): keys of the texts that are constant over a host, or over a skeleton of it.

    Pages of the same text count once, so copies of a page make nothing constant.
    """
    once = store(
        read.groupBy("host", "article").agg(F.min(F.struct(F.xxhash64("skeleton").alias("skeleton"), "blocks")).alias("page")), "page-articles"
    )
    levels = F.array(F.lit(0).cast("long"), F.col("page.skeleton"))
    pages = once.select("host", F.posexplode(levels).alias("level", "of"), F.col("page.blocks").alias("blocks"))
    at = ["host", "level", "of", "place"]
    texts = pages.select("host", "level", "of", F.inline("blocks")).groupBy(*at, "key").agg(F.count("*").alias("n"))
    places = pages.select("host", "level", "of", F.explode(F.array_distinct("blocks.place")).alias("place")).groupBy(*at).agg(F.count("*").alias("pages"))
    constant = texts.filter(F.col("n") >= LEAST).join(places.filter(F.col("pages") >= LEAST), at).filter("n = pages")
    return constant.groupBy("host").agg(F.array_sort(F.collect_set("key")).alias("template"))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, str, str], list[int]] = {}
        for host, source, template in zip(batch[0].to_pylist(), batch[1], batch[2], strict=True):
            page = Page(source.as_py(), frozenset(template.as_py()))
            container, size = page.container()
            row = seen.setdefault((host, written(fold(page.stream)), container), [0, 0])
            row[0] += 1
            row[1] += size
        keys = list(seen)
        columns = [[k[i] for k in keys] for i in range(3)] + [[seen[k][i] for k in keys] for i in range(2)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "skeleton", "container", "pages", "size"])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, expression, container, template) from pages (host, html)."""
    read = store(
        pages.select("host", "html").mapInArrow(
            _read, "host string, skeleton string, container string, size long, article long, blocks array<struct<place:long,key:long>>"
        ),
        "pages-read",
    )
    templates = store(host_templates(read), "host-templates")
    # only hosts that have a template are read a second time, with it
    untouched = read.join(templates, "host", "left_anti").select("host", "skeleton", "container", F.lit(1).cast("long").alias("pages"), "size")
    counted = (
        pages.join(templates, "host")
        .select("host", "html", "template")
        .mapInArrow(_skeletons, "host string, skeleton string, container string, pages long, size long")
        .unionByName(untouched)
        .groupBy("host", "skeleton", "container")
        .agg(F.sum("size").alias("size"))
    )
    return joined_wrappers(counted).join(templates, "host", "left")


PARTS = "host string, at long, expression string, held map<string,long>"


def joined_wrappers(counted: DataFrame) -> DataFrame:
    """(host, expression, container) from every skeleton (host, skeleton, container, size).

    A round aligns ``GROUP`` wrappers of a host in each task and leaves one; it
    is stored, and rounds go on until every host has one.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[(c, z)] for c, z in zip(batch["container"].to_pylist(), batch["size"].to_pylist(), strict=True)]
            texts = [to_text(plain(x)) for x in batch["skeleton"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["host"], pa.array([hashed(t) for t in texts], pa.int64()), pa.array(texts, pa.string()), pa.array(held, pa.map_(pa.string(), pa.int64()))],
                names=["host", "at", "expression", "held"],
            )

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["expression"].to_pylist(), map(dict, table["held"].to_pylist()), strict=True), key=lambda r: (len(r[0]), r[0]))
        text, held = merged(rows)
        return pa.table({
            "host": pa.array([key[0].as_py()], pa.string()), "at": pa.array([key[1].as_py()], pa.int64()),
            "expression": pa.array([text], pa.string()), "held": pa.array([list(held.items())], pa.map_(pa.string(), pa.int64())),
        })

    parts = store(counted.mapInArrow(first, PARTS), "wrapper-parts")
    while True:
        held = parts.groupBy("host").agg(F.count("*").alias("parts"))
        most = held.agg(F.max("parts").alias("n")).first()["n"] or 0
        if most <= 1:
            break
        # as many groups as the host needs: one for most hosts
        dealt = parts.join(held, "host").withColumn("at", F.pmod(F.xxhash64("at", "expression"), F.ceil(F.col("parts") / GROUP)))
        parts = store(dealt.groupBy("host", "at").applyInArrow(run, PARTS), "wrapper-parts")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [container_of(dict(h)) for h in batch["held"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["host"], batch["expression"], pa.array(chosen, pa.string())], names=["host", "expression", "container"])

    return parts.mapInArrow(choose, "host string, expression string, container string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Matcher | None] = {}
    for batch in batches:
        texts, matched = [], []
        if len(known) > 1000:
            known.clear()
        for source, found, container, template in zip(*(batch.column(c) for c in ("html", "expression", "container", "template")), strict=True):
            page, found = Page(source.as_py(), frozenset(template.as_py() or ())), found.as_py()
            if found not in known:
                known[found] = Matcher(from_text(found)) if found is not None else None
            fits = known[found] is not None and known[found].fits(page.stream)
            own = page.container()[0]
            chosen = container.as_py() if fits else own
            text = page.text(chosen)
            if not text and own != chosen:
                text = page.text(own)
            texts.append(text)
            matched.append(fits)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(matched, pa.bool_())],
            names=["page_id", "url", "text", "n_chars", "by_wrapper"],
        )


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, by_wrapper for every page.

    Text of a block is its decoded characters with white space as single blanks;
    blocks are joined by one line break.  Line-break elements count as white
    space.  Null or empty html, or a page without an article, gives the empty
    text; a null or odd URL belongs to the empty host; repeated rows give
    repeated results.  Other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = df.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    wrappers = store(host_wrappers(pages), "wrappers")
    return pages.join(wrappers, "host", "left").select("page_id", "url", "html", "expression", "container", "template").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long, by_wrapper boolean"
    )
