"""Main text of pages by equivalence-class template deduction.

Tokens are tags and pairs of words in their place (path of tags with class and id). Per host, tokens with equal
occurrence vectors over the host's pages form an equivalence class; a class that is large and frequent enough is valid,
and valid classes nest by their paths into a template. Between template tokens lie slots. The slot with most text outside
links and chrome is the host's main slot, and its blocks without the template's words are a page's main text. Names such
as article or sidebar only decide between slots, and for hosts with too few pages; inside the main slot a name takes away
what most pages of the host call so and what no heading is in.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from gridwell.plans.runtime import materialize, small, tidy

#: Pages that a class needs in a host, and tokens that it needs.
MIN_PAGES, MIN_TOKENS = 3, 2
#: Buckets of a host's word tokens in the first count of its pages, and entries of it that a task holds at once.
BUCKETS, SKETCH_ENTRIES = 1 << 16, 4_000_000
#: Pages that are looked at together, and hashes of copied pages that may be broadcast.
SLICE_PAGES, COPIED_ROWS = 250, 1_000_000
#: Successive pairs of template words that make a template run inside a block that has other words too.
RUN_PAIRS = 4

_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# HTML's own groups of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea template iframe svg math object select title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li legend main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav header footer aside form menu dialog button label fieldset head".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert comment comments disqus respond reply replies discussion sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended newsletter subscribe subscription signup login search popup modal overlay toolbar pagination pager skip copyright".split())
_MAIN_WORDS = frozenset("article content main post entry story articlebody".split())
_PLACE_WORDS = frozenset("post entry article site page box area list section block container wrapper inner outer left right top bottom bar buttons".split())


def _labels(attrs: str) -> tuple[str, set[str], bool, bool]:
    """As `_read_labels`, which pages of a site ask the same things of; long attributes are not kept."""
    return _short_labels(attrs) if len(attrs) < 200 else _read_labels(attrs)


def _read_labels(attrs: str) -> tuple[str, set[str], bool, bool]:
    """What names the element in its path, the words of its class, id, role and itemprop, whether it is hidden, and
    whether one of its names says chrome and nothing else (comments, post-comments, but not related-work)."""
    name, words, hidden, plain = "", set(), False, False
    if attrs and ("=" in attrs or "hidden" in attrs):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("hidden", "aria-hidden"):
                hidden |= key == "hidden" or value == "true"
                continue
            for own in value.split():
                parts = {x for x in re.split(r"[^a-z]+", own) if x}
                words |= parts
                plain |= bool(parts & _CHROME_WORDS) and parts <= _CHROME_WORDS | _PLACE_WORDS
            if key in ("class", "id"):
                name += ("." if key == "class" else "#") + re.sub(r"\d+", "0", value)
    return name, words, hidden, plain


_short_labels = lru_cache(1 << 14)(_read_labels)


TAG, NAME, PART = range(3)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags of a page that are looked for with their quotes; after as many that do not close, a tag ends at its first >.
QUOTED_TRIES = 50
_START = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""<[a-zA-Z/](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")


class Node:
    """An element: the hash of its path of block tags, its parent's number, and how it looks.

    mark: TAG, NAME or PART if it looks like chrome by its tag, a name or a part of a name. tagged, named: whether it or
    an element around it does so by its tag, or by a name that no <article> or <main> between them puts right.
    """

    __slots__ = ("path", "parent", "mark", "tagged", "named", "article", "body", "called", "text", "plain", "heading")

    def __init__(self, path: int, parent: int):
        self.path, self.parent, self.mark, self.tagged, self.named, self.article = path, parent, None, False, False, False
        self.body = self.called = self.heading = False
        self.text = self.plain = 0


class Page:
    """What parse() finds: tag tokens with their counts, elements (parents first), blocks as (element, text, linked characters)."""

    def __init__(self):
        root = Node(0, -1)
        root.body = True
        self.tokens, self.nodes, self.blocks = Counter(), [root], []

    def weigh(self) -> None:
        """text: what each element holds outside links; plain: the part that is not in chrome."""
        for at, text, linked in self.blocks:
            value = len(text) - min(linked, len(text)) * 2
            node = self.nodes[at]
            node.text += value
            node.plain += 0 if node.tagged or node.named else value
        for node in reversed(self.nodes[1:]):
            up = self.nodes[node.parent]
            up.text += node.text
            up.plain += node.plain
            up.heading |= node.heading


def _tags(page: str):
    """(text before, tag, closes, attributes, end) of each tag in turn; the last has no tag."""
    at, size, tries, last = 0, len(page), QUOTED_TRIES, page.rfind(">")
    begin = 0
    while at <= last:
        m = _START.search(page, at)
        if not m or m.start() > last:
            break
        k = m.start()
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            end = size if end < 0 else end + 3
            at = yield page[begin:k], "", False, "", end
            begin = at
            continue
        end = page.find(">", k) + 1
        if page[k + 1] not in "!?" and tries and (page.count('"', k, end) % 2 or page.count("'", k, end) % 2):
            if whole := _QUOTED.match(page, k):
                end = whole.end()
            else:
                tries -= 1
        if page[k + 1] in "!?":
            at = yield page[begin:k], "", False, "", end
        elif named := _NAME.match(page, k, end):
            at = yield page[begin:k], named[1].lower(), page[k + 1] == "/", page[named.end() : end - 1], end
        else:  # </ and no name
            at = yield page[begin:k], "", False, "", end
        begin = at
    rest = page.find("<!--", begin) if begin <= size else -1  # a comment that nothing closes
    yield page[begin : rest if rest >= 0 else size], None, False, "", size


@lru_cache(1 << 14)
def _path(parent: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}>{text}") >> 1


def parse(page: str) -> Page:
    """Elements, tag tokens and text blocks in page order, in time and memory that grow with the page.

    A token is the path of a block element, or that with its lowest bit turned for the end tag.
    """
    out = Page()
    tokens, nodes, blocks = out.tokens, out.nodes, out.blocks
    stack: list[tuple[str, int, int]] = []  # tag, element, the block element around it
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked = link_depth = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append((stack[-1][2] if stack else 0, text, linked))
        parts, linked = [], 0

    def pop() -> None:
        nonlocal link_depth
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        link_depth -= tag == "a"

    found, at = _tags(page), None
    while True:
        text, tag, close, attrs, end = found.send(at)
        at = end
        if text:
            parts.append(text)
            if link_depth:
                linked += len(text)
        if tag is None:
            break
        if not tag:
            continue
        if close:
            if tag in BLOCK:
                flush()
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                if tag in BLOCK:
                    tokens[nodes[stack[-1][1]].path ^ 1] += 1
                pop()
            continue
        if tag in BLOCK or tag in RAW:
            if tag in BLOCK:
                flush()
            while stack and (stack[-1][0] in CLOSES.get(tag, ()) or (tag in BLOCK and open_tags["p"] and any(s[0] == "p" for s in stack[-4:]))):
                if stack[-1][0] in BLOCK and stack[-1][0] not in ("p", *CLOSES.get(tag, ())):
                    break
                pop()
        up, around = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
        name, words, hidden, plain = _labels(attrs)
        path = _path(nodes[up].path, tag + name) & ~1 if tag in BLOCK else nodes[up].path
        if tag in BLOCK:
            tokens[path] += 1
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                at = _raw_end(page, tag, end)
            continue
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCK:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        node, parent, whole = Node(path, up), nodes[up], tag in ("article", "main")
        main = whole or bool(words & {"main", "articlebody"}) or tag in ("div", "section") and bool(words & _MAIN_WORDS) and not words & _CHROME_WORDS
        if tag in CHROME or hidden:
            node.mark = TAG
        elif tag not in ("html", "body") and tag not in HEADINGS and not whole and words & _CHROME_WORDS and not main:
            node.mark = NAME if plain else PART
        node.tagged = parent.tagged or node.mark == TAG
        node.named = (parent.named and not whole) or node.mark in (NAME, PART)
        node.article, node.body, node.called, node.heading = parent.article or main, tag in ("html", "body"), whole, tag in HEADINGS
        nodes.append(node)
        stack.append((tag, len(nodes) - 1, len(nodes) - 1 if tag in BLOCK else around))
        open_tags[tag] += 1
        link_depth += tag == "a"
    flush()
    return out


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where a raw element ends: after its end tag, or with the page."""
    m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
    return m.end() if m else len(page)


#: Bits of a page's hash in an occurrence vector, and of their halves, which are summed apart.
_VECTOR, _HALF = (1 << 48) - 1, (1 << 24) - 1


class _Sketch:
    """How many of each host's pages have a word token in each bucket, summed until it is handed on."""

    def __init__(self):
        self.hosts, self.keys, self.size = {}, [], 0

    def add(self, hosts: list[str], pages: list[Page]) -> None:
        tokens, ends = page_tokens(pages)
        page = np.repeat(np.arange(len(pages)), np.diff(ends))
        own = np.unique(page * BUCKETS + (tokens & (BUCKETS - 1)))  # a page counts once in a bucket
        names = np.array([self.hosts.setdefault(h, len(self.hosts)) for h in hosts], np.int64)
        self.keys.append(names[own // BUCKETS] * BUCKETS + own % BUCKETS)
        self.size += len(own)

    def flush(self):
        """(hosts, sketches) of a few hosts at a time."""
        keys, n = np.unique(np.concatenate(self.keys), return_counts=True) if self.keys else (np.zeros(0, np.int64),) * 2
        names, comp = list(self.hosts), zstandard.ZstdCompressor(level=1)
        cuts = np.searchsorted(keys, np.arange(len(names) + 1) * BUCKETS)
        for lo in range(0, len(names), 256):
            out = []
            for k in range(lo, min(lo + 256, len(names))):
                dense = np.zeros(BUCKETS, "<u4")
                dense[keys[cuts[k] : cuts[k + 1]] % BUCKETS] = n[cuts[k] : cuts[k + 1]]
                out.append(comp.compress(dense.tobytes()))
            yield names[lo : lo + 256], out
        self.__init__()


def _host_tokens(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per host and token: pages, occurrences, occurrence-vector signature, text below the token outside chrome (`mass`)
    and with it (`whole`), depth, whether it is html or body, and whether it is an article; and (host, sketch) of its word
    tokens, from each task."""
    kinds = {"host": pa.string(), "token": pa.int64(), "pages": pa.int64(), "n": pa.int64(), "vector": pa.int64(), "mass": pa.int64(), "whole": pa.int64(), "depth": pa.int32(), "body": pa.bool_(), "called": pa.bool_(), "sketch": pa.binary()}

    def sketched(hosts, sketches):
        own = {"host": hosts, "sketch": sketches}
        return pa.RecordBatch.from_arrays([pa.array(own[k], t) if k in own else pa.nulls(len(hosts), t) for k, t in kinds.items()], names=list(kinds))

    @tidy
    def run(batches):
        sketch = _Sketch()
        for batch in batches:
            sums, pages, hosts = {}, [], batch.column(0).to_pylist()
            for host, text in zip(hosts, batch.column(1).to_pylist()):
                page = parse(text)
                page.weigh()
                pages.append(page)
                raw = text.encode("utf-8", "replace")
                own = f"{xxhash.xxh64_intdigest(raw)}.{len(raw)}"
                held, depth = {}, [0] * len(page.nodes)
                for k, node in enumerate(page.nodes):
                    depth[k] = depth[node.parent] + 1 if k else 0
                    old = held.get(node.path)
                    if old is None or page.nodes[node.parent].path != node.path:  # inline elements share the path around them
                        old = old or [0, 0, depth[k], node.body, node.called]
                        held[node.path] = [old[0] + node.plain, old[1] + node.text, *old[2:]]
                for token, n in page.tokens.items():
                    row = sums.setdefault((host, token), [0, 0, 0, 0, 0, 0, False, False])
                    row[0] += 1
                    row[1] += n
                    row[2] = (row[2] + xxhash.xxh64_intdigest(f"{own}.{n}")) & _VECTOR
                    if about := held.get(token):
                        row[3:] = row[3] + about[0], row[4] + about[1], *about[2:]
                if len(pages) == SLICE_PAGES:
                    sketch.add(hosts[: len(pages)], pages)
                    hosts, pages = hosts[len(pages) :], []
            if pages:
                sketch.add(hosts, pages)
            if sketch.size >= SKETCH_ENTRIES:
                yield from (sketched(*x) for x in sketch.flush())
            if sums:
                keys, values = zip(*sums.items())
                of = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([v[c] for v in values], t) for c, t in enumerate(list(kinds.values())[2:-1]))]
                yield pa.RecordBatch.from_arrays([*of, pa.nulls(len(keys), pa.binary())], names=list(kinds))
        yield from (sketched(*x) for x in sketch.flush())

    seen = rows.mapInArrow(run, "host string, token long, pages long, n long, vector long, mass long, whole long, depth int, body boolean, called boolean, sketch binary")
    seen = materialize(seen, "html-seen", "zstd")
    halves = [F.sum(F.shiftright("vector", 24)).alias("high"), F.sum(F.col("vector").bitwiseAND(F.lit(_HALF))).alias("low")]  # sums of halves stay in the range of a long
    held = seen.filter("sketch is null").groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), *halves, F.sum("mass").alias("mass"), F.sum("whole").alias("whole"), F.max("depth").alias("depth"), F.bool_or("body").alias("body"), F.bool_or("called").alias("called"))
    vector = F.pmod(F.pmod("high", F.lit(1 << 24)) * F.lit(1 << 24) + F.col("low"), F.lit(1 << 48))
    return held.withColumn("vector", vector).drop("high", "low"), seen.filter("sketch is not null").select("host", "sketch")


_POWER = 0x9E3779B97F4A7C15
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([k])) for k in range(256)], np.uint64)
_powers: list = []


def _hash_words(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes' numbers, modulo 2^64."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    if not _powers or len(_powers[0]) <= len(raw):
        size = max(1 << 20, len(raw) + 1)
        _powers[:] = [np.append(np.uint64(1), np.cumprod(np.full(size, k, np.uint64))) for k in (_POWER, pow(_POWER, -1, 1 << 64))]
    upto = np.append(np.uint64(0), np.cumsum(_BYTES[raw] * _powers[0][: len(raw)]))
    x = (upto[ends[1:]] - upto[ends[:-1]]) * _powers[1][ends[:-1]] + np.diff(ends).astype(np.uint64)
    x ^= x >> np.uint64(32)
    return x * _LAST


_EDGE, _A, _B, _PATH, _LAST = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))


def pair_tokens(paths: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each block's pairs of successive words, its edges counting as words, block after block, and where each
    block's begin and end. A block's words are parted by one space, as `parse` leaves them."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    split = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = split.flatten().dictionary_encode()
    own = _hash_words(coded.dictionary)
    n = np.diff(split.offsets.to_numpy()).astype(np.int64)
    words = np.full(int(n.sum()) + len(n) + 1, _EDGE)
    words[np.arange(n.sum()) + np.repeat(np.arange(len(n)) + 1, n)] = own[coded.indices.to_numpy()]
    a, b = words[:-1], words[1:]
    x = a * _A ^ (b << np.uint64(23) | b >> np.uint64(41)) * _B
    x += np.repeat(np.array(paths, np.uint64) * _PATH, n + 1)
    x ^= x >> np.uint64(31)
    x *= _LAST
    x ^= x >> np.uint64(29)
    return x.view(np.int64), np.append(0, np.cumsum(n + 1))


def page_tokens(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """The word tokens of each page, and where each page's begin and end."""
    tokens, ends = pair_tokens([p.nodes[b[0]].path for p in pages for b in p.blocks], [b[1] for p in pages for b in p.blocks])
    return tokens, ends[np.append(0, np.cumsum([len(p.blocks) for p in pages])).astype(np.int64)]


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones."""
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values if len(held) else np.zeros(len(values), bool)


#: A prime: a page of c copies counts as the inverse of c in each, so that they add up to one page.
_PRIME = (1 << 48) - 59
_WORD, _NAME_OF = 1, 2


def _wanted(hashed: DataFrame, sketches: DataFrame) -> DataFrame:
    """(host, need, buckets) of hosts with MIN_PAGES different pages: the pages that a word token needs, and the buckets that
    as many have. All tokens in other buckets are in fewer pages."""
    pages = hashed.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    need = pages.select("host", F.greatest(F.lit(MIN_PAGES), F.floor((F.col("pages") + 1) / 2)).cast("long").alias("need"))

    def run(group: pa.Table) -> pa.Table:
        undo, total = zstandard.ZstdDecompressor(), np.zeros(BUCKETS, np.int64)
        for raw in group.column("sketch"):
            total += np.frombuffer(undo.decompress(raw.as_py()), "<u4")
        often = np.flatnonzero(total >= group.column("need")[0].as_py()).astype("<u2").tobytes()
        return pa.table({"host": group.column("host").slice(0, 1), "need": group.column("need").slice(0, 1), "buckets": pa.array([often], pa.binary())})

    return sketches.join(need, "host").groupBy("host").applyInArrow(run, "host string, need long, buckets binary")


def _host_words(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(host, words, names) from all different pages of each host; copies of a page count once.

    A word token is in the template if its class has MIN_TOKENS tokens, tags included, and half of the host's pages,
    MIN_PAGES at least. The names are paths of elements with text on as many pages that are called chrome, and have no
    heading in them. `sketches` bound each token's pages from above, so that only tokens that may be in so many are counted.
    """
    keyed = rows.withColumn("h", F.xxhash64("html"))
    hashed = materialize(keyed.groupBy("host", "h").agg(F.count("*").alias("copies")), "html-hashes")
    wanted = materialize(_wanted(hashed, sketches), "html-wanted")
    copied = small(hashed.filter("copies > 1"), COPIED_ROWS)
    own = keyed.join(small(wanted.select("host", "buckets")), "host").join(copied, ["host", "h"], "left")
    own = own.select("host", "html", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "buckets")

    @tidy
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_PAGES):
                batch = whole.slice(lo, SLICE_PAGES)
                htmls = batch.column(1).to_pylist()
                pages = [parse(t) for t in htmls]
                tokens, ends = page_tokens(pages)
                at, kind, token, weight, vector = [], [], [], [], []
                for k, (page, text, copies, buckets) in enumerate(zip(pages, htmls, batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    page.weigh()
                    raw, share = text.encode("utf-8", "replace"), pow(copies, -1, _PRIME)
                    name = f"{xxhash.xxh64_intdigest(raw)}.{len(raw)}"
                    words = tokens[ends[k] : ends[k + 1]]
                    words = words[_among((words & (BUCKETS - 1)).astype(np.uint16), np.frombuffer(buckets, "<u2"))]
                    words, times = np.unique(words, return_counts=True)
                    called = {x.path for x in page.nodes if x.mark == NAME and x.text and not x.heading}
                    n = np.concatenate([np.fromiter(page.tokens.values(), np.int64, len(page.tokens)), times, np.zeros(len(called), np.int64)])
                    counts, place = np.unique(n, return_inverse=True)
                    value = np.array([xxhash.xxh64_intdigest(f"{name}.{c}") * share % _PRIME for c in counts.tolist()], np.int64)
                    token += [np.fromiter(page.tokens, np.int64, len(page.tokens)), words, np.fromiter(called, np.int64, len(called))]
                    kind.append(np.repeat([0, _WORD, _NAME_OF], [len(page.tokens), len(words), len(called)]))
                    vector.append(value[place])
                    weight.append(np.full(len(n), share))
                    at.append(np.full(len(n), k))
                columns = {"at": at, "kind": kind, "token": token, "weight": weight, "vector": vector}
                hosts = batch.column(0).dictionary_encode()
                table = pa.table({k: np.concatenate(v).astype(np.int64) for k, v in columns.items()})
                table = table.append_column("host", hosts.indices.take(table.column("at").combine_chunks()))
                table = table.group_by(["host", "kind", "token"]).aggregate([("weight", "sum"), ("vector", "sum")]).combine_chunks()
                named = hosts.dictionary.take(table.column("host").combine_chunks())
                yield from pa.table({"host": named, **{c: table.column(c) for c in ("kind", "token", "weight_sum", "vector_sum")}}).to_batches()

    seen = own.mapInArrow(run, "host string, kind long, token long, weight_sum long, vector_sum long")
    cut = [f(c).alias(f"{c}_{n}") for c in ("weight_sum", "vector_sum") for n, f in (("high", lambda c: F.sum(F.shiftright(c, 24))), ("low", lambda c: F.sum(F.col(c).bitwiseAND(F.lit(_HALF)))))]
    shift, prime = F.lit(1 << 12), F.lit(_PRIME)
    whole = lambda c: F.pmod(F.pmod(F.pmod(F.pmod(f"{c}_high", prime) * shift, prime) * shift, prime) + F.pmod(f"{c}_low", prime), prime)
    held = seen.groupBy("host", "kind", "token").agg(*cut).select("host", "kind", "token", whole("weight_sum").alias("pages"), whole("vector_sum").alias("vector"))
    held = materialize(held.join(small(wanted.select("host", "need")), "host").filter("pages >= need").drop("need"), "html-words")
    same = ["host", "vector", "pages"]
    tokens = held.filter(F.col("kind") < _NAME_OF)
    valid = tokens.groupBy(*same).agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_TOKENS).drop("n")
    words = tokens.filter(F.col("kind") == _WORD).join(valid, same, "left_semi").groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("words"))
    names = held.filter(F.col("kind") == _NAME_OF).groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("names"))
    return words.join(names, "host", "full")


def deduce(rows: DataFrame) -> DataFrame:
    """(host, main, words, names): the path of each host's main slot, null without one, its template's word tokens, and
    its elements that are called chrome.

    rows(host, html). A class is valid with MIN_PAGES pages and MIN_TOKENS tokens; classes nest as their paths do. The
    main slot opens at a template token that occurs once a page and holds nine tenths of the text that the best such
    token below the body holds: the deepest <article> or <main>, or else the deepest. Text in what looks like
    chrome counts on hosts where most text does. Classes and hosts are compared by aggregates alone, so that a host with
    very many tokens is no single task's work.
    """
    tokens, sketches = _host_tokens(rows)
    tokens = materialize(tokens, "html-tokens")
    same = ["host", "vector", "pages", "n"]
    large = tokens.groupBy(*same).agg(F.count("*").alias("members")).filter((F.col("pages") >= MIN_PAGES) & (F.col("members") >= MIN_TOKENS)).drop("members")
    once = tokens.filter((F.col("n") == F.col("pages")) & (F.col("token") % 2 == 0) & ~F.col("body")).join(large, same, "left_semi")
    best = once.groupBy("host").agg(F.max("mass").alias("best_mass"), F.max("whole").alias("best_whole"))
    plain = F.col("best_mass") * 2 >= F.col("best_whole")
    held, top = F.when(plain, F.col("mass")).otherwise(F.col("whole")), F.when(plain, F.col("best_mass")).otherwise(F.col("best_whole"))
    pick = once.join(best, "host").filter((held > 0) & (held * 10 >= top * 9))
    main = pick.groupBy("host").agg(F.max_by("token", F.struct(F.col("called").cast("int"), "depth", "token")).alias("main"))
    return main.join(_host_words(rows, sketches), "host", "full")


def _without(text: str, hits: list[bool]) -> tuple[str, int]:
    """A block's text without the template's runs of words, and how many went. hits: which of its pairs are the template's."""
    words, gone, k = text.split(" "), set(), 0
    while k < len(hits):
        end = k
        while end < len(hits) and hits[end]:
            end += 1
        if end - k >= RUN_PAIRS:
            gone.update(range(max(k - 1, 0), min(end, len(words))))
        k = end + 1
    return (" ".join(w for i, w in enumerate(words) if i not in gone) if gone else text), len(gone)


def _slot(page: Page, main: int, names: frozenset[int]) -> list[tuple[int, str, int]]:
    """The page's blocks in the main slot, without elements in it that their tag calls chrome, or their name if it is one
    of `names`; an <article> or <main> in between puts a name right."""
    inside, out = [False] * len(page.nodes), [False] * len(page.nodes)
    named = [False] * len(page.nodes)
    for k, node in enumerate(page.nodes[1:], 1):
        up = node.parent
        if inside[up]:
            inside[k] = True
            named[k] = (named[up] and not node.called) or node.mark in (NAME, PART) and node.path in names
            out[k] = out[up] or node.mark == TAG
        else:
            inside[k] = node.path == main
    return [b for b in page.blocks if inside[b[0]] and not out[b[0]] and not named[b[0]]]


def _own_blocks(html: str, main: int | None, names: frozenset[int]) -> list[tuple[int, str]]:
    """(path, text) of the blocks in the host's main slot, or else of the article, or else of all that is not chrome."""
    page = parse(html)
    own = _slot(page, main, names) if main is not None else []
    if not own:
        keep = [b for b in page.blocks if not (page.nodes[b[0]].tagged or page.nodes[b[0]].named)]
        own = [b for b in keep if page.nodes[b[0]].article] or [b for b in keep if b[2] * 2 < len(b[1])]
    return [(page.nodes[at].path, text) for at, text, _ in own]


def _main_texts(pages: list[tuple[list[tuple[int, str]], np.ndarray]]) -> list[str]:
    """The text of each page's blocks without its host's template words, which are sorted.

    Where template words are most of the words they are taken for copies of one text, and stay.
    """
    blocks = [b for own, words in pages if len(words) for b in own]
    tokens, ends = pair_tokens([b[0] for b in blocks], [b[1] for b in blocks])
    out, at = [], 0
    for own, words in pages:
        texts = [t for _, t in own]
        if len(words) and own:
            edges = ends[at : at + len(own) + 1]
            at += len(own)
            hits = _among(tokens[edges[0] : edges[-1]], words)
            edges = edges - edges[0]
            if hits.any():
                left, lost, found = [], 0, np.add.reduceat(hits, edges[:-1], dtype=np.int64).tolist()
                for text, n, a, b in zip(texts, found, edges[:-1].tolist(), edges[1:].tolist()):
                    if n == b - a:
                        text, gone = "", n - 1
                    else:
                        text, gone = _without(text, hits[a:b].tolist()) if n >= RUN_PAIRS else (text, 0)
                    left.append(text)
                    lost += gone
                if lost * 2 <= edges[-1] - len(own):
                    texts = [t for t in left if t]
        out.append("\n".join(texts))
    return out


def main_text(html: str, main: int | None, words: frozenset[int] = frozenset(), names: frozenset[int] = frozenset()) -> str:
    """The main text of one page by its host's main slot, template words and chrome names."""
    return _main_texts([(_own_blocks(html, main, names), np.array(sorted(words), np.int64))])[0]


def extract(pages: DataFrame, url: str = "url", column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`, from its whole html.

    Null and empty html give an empty text. Repeated rows and null ids stay; a null url shares the empty host; other
    columns go. Malformed markup never fails: unclosed tags end with their parents, stray ends are skipped; deep markup
    and long pages cost in proportion. Ties between slots go to the larger path hash. An empty table gives an empty one.
    Occurrence vectors of tags are summed per host with partial aggregation; templates are joined by broadcast only if counted
    and small, else by a shuffle on the host in which Spark splits hot hosts.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select("page_id", F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(column), F.lit("")).alias("html"))
    found = materialize(deduce(rows.select("host", "html")), "html-templates")
    joined = rows.join(small(found.select("host", "main", "words", "names")), "host", "left").select("page_id", "url", "html", "main", "words", "names")
    kind = dict(rows.dtypes)["page_id"]

    @tidy
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_PAGES):
                part = batch.slice(lo, SLICE_PAGES)
                words = [np.zeros(0, np.int64) if x.values is None else x.values.to_numpy() for x in part.column(4)]  # sorted by `deduce`
                names = [frozenset(x or ()) for x in part.column(5).to_pylist()]
                own = [_own_blocks(*x) for x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), names)]
                texts = _main_texts(list(zip(own, words)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
