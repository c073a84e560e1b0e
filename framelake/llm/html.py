"""Main text of web pages: markup structure, and a suffix array for each host.

A page is read as a stream of tags and text into blocks. Elements that by name, role, class or id are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments are left out; blocks in
an ``article`` or ``main`` element are marked as the article. A token of a class or id counts as a whole.
Unless hidden, elements that hold a page's main element, its only articles or (by class, id, role, form) most of
the text of a page without articles stay.

Blocks of left-out elements are read as well, as hinted ones. Pages are read in groups of ``PAGES`` as they lie.
A group's pages are concatenated as one stream of ranks of words (salted by host), with a separator of its own
after each page. Prefix doubling sorts all suffixes by their first ``DEPTH`` words; neighbours with ``RUN`` or
more common words form classes, each with its distinct pages. Classes of all groups are added up by the key of
host and run, and so are whole blocks and the host's pages: evidence is that of the whole host, however its pages lie.

A run or block is repeated if it stands on ``LEAST_PAGES`` distinct pages and ``LEAST_SHARE`` of the host's.
Repeated runs and blocks are boilerplate, outside an article; what is left of a block, the unique runs, is kept.
A page without an article that is covered throughout is a copy: it is kept, without the runs that stand on more than twice
as many pages as its own words do. In an article, which quotes and copies may share, only whole blocks go that
stand on ``ARTICLE_PAGES`` distinct pages and more than half of the host's, unless they are ``COPY_SHARE`` of it.
Hinted blocks go in any case: where they aren't repeated, the markup is the evidence.

Keys are dealt to buckets by hash, so neither a host with a third of all pages nor a run on all of them is one
task. A host of fewer than ``LEAST_PAGES`` pages has no evidence, and its pages keep all blocks that aren't hinted.

Defined cases: null html is empty, with the empty text; pages of any length are read whole; a null url or one
without a host is the host ''; rows that repeat a page count as one page for repetition, and are each kept;
unclosed elements end with their parents; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, stored, text_of
from .hashing import BASES, powers, mix, word_hashes

#: Pages of a group; words that a repeated run has at least; words that suffixes are sorted by.
PAGES, RUN, DEPTH = 128, 12, 16
#: A run is repeated on so many distinct pages of a host, and at least this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.01
#: Pages from which a block of an article may be boilerplate; share of an article's words from which it is a copy.
ARTICLE_PAGES, COPY_SHARE = 10, 0.8
#: Characters of pages for a bucket of keys, and bits that name buckets at most.
BUCKET_CHARS, BUCKET_BITS = 1 << 20, 23
#: Buckets that a task adds up, one after another; keys that a task holds before it deals them.
TOGETHER, HELD = 8, 400_000
#: Repeated runs that are broadcast; more are joined by a shuffle, dealt by so many salts.
BROADCAST_RUNS, SALTS = 4_000_000, 16

# Names in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp nobr".split())
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "head", "fieldset"}
#: Of these, elements whose content isn't shown as text.
UNREAD = {"select", "object", "canvas", "audio", "video", "head"}
ARTICLE = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMED = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert sidebar sidebars "
    "aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist respond reply replies disqus share sharing social related recommended "
    "newsletter subscribe subscription signup login popup modal overlay pagination pager widget widgets form search skip hidden".split()
)
#: Parts that may stand beside a name in a token of a class or id ("ad-top", "widget-area"); others make it another
#: word ("has-sidebar", "no-header", "overflow-hidden").
BESIDE = set(
    "top bottom left right middle center upper lower main primary secondary global site page web blog post entry article content body inner outer first last "
    "bar box block area list item items link links button buttons btn container wrapper wrap holder group panel section region row col column unit slot zone space "
    "text title label info message msg policy law icon icons image img logo desktop mobile sticky fixed small large big new the and a to us me my your is by for "
    "visually email mail letter input field google dfp media article articles posts stories".split()
)
#: Parts of an article's own frame that aren't left out within it.
WITHIN = {"header"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_of(value: str) -> set[str]:
    """The names in tokens of a class or id that consist of such names, and of words that may stand beside one."""
    out: set[str] = set()
    for token in value.split():
        parts = [w for w in _WORD.findall(_CAMEL.sub(" ", token).lower()) if not w.isdigit()]
        names = NAMED.intersection(parts)
        if names and all(w in names or w in BESIDE for w in parts):
            out |= names
    return out


def left_out(tag: str, attributes: str, inside: bool) -> str:
    """Why an element is no part of an article: "tag", "hidden" or "name", or ""; ``inside`` if one is open."""
    if tag in LEFT_OUT and not (inside and tag in WITHIN):
        return "name" if tag in ("form", "fieldset") else "tag"
    if not attributes.strip():
        return ""
    why = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "hidden"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "hidden"
        if name == "role" and value.lower() in ROLES:
            why = "name"
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            words = names_of(value)
            if tag == "article":
                words &= {"comment", "comments", "reply", "ad", "advert", "sponsored", "related", "promo"}
            elif inside:
                words -= WITHIN
            if words:
                why = "name"
    return why


@dataclass
class Block:
    text: str
    article: bool
    hinted: bool


@dataclass
class Span:
    """An element that is left out by its tag or name: where it begins and ends, and its characters of text."""

    begin: int
    end: int
    why: str
    chars: int


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order; those that a left-out element holds are hinted.

    An element left out by tag or name stays if it holds a main element or, where no article is left, articles.
    One left out by name stays if no article is left anywhere and it holds over half of the page's text.
    """
    out, spans, mains, articles, seen = read(page, set())
    bare = not any(b.article and not b.hinted for b in out)
    marks = np.array(sorted(mains + articles if bare else mains), np.int64)
    keep = set()
    for span in spans:
        if np.searchsorted(marks, span.begin, "right") < np.searchsorted(marks, span.end) or bare and not len(marks) and span.why == "name" and 2 * span.chars > seen:
            keep.add(span.begin)
    return read(page, keep)[0] if keep else out


def read(page: str, keep: set[int]) -> tuple[list[Block], list[Span], list[int], list[int], int]:
    """Blocks; elements left out, but those that begin at ``keep``; begins of main elements and of articles; seen
    characters of text."""
    out: list[Block] = []
    held: list[str] = []
    aside: list[str] = []  # of inline elements and others that are left out
    stack: list[tuple[str, bool, bool, bool, bool, Span | None]] = []  # name, left out, in an article, unseen, hidden, span
    spans: list[Span] = []
    mains: list[int] = []
    articles: list[int] = []
    out_now = article_now = unseen_now = hidden_now = False
    seen = 0

    def end_block() -> None:
        for parts, hinted in ((held, False), (aside, True)):
            if parts:
                text = "".join(parts)
                parts.clear()
                if text := " ".join(text.split()):
                    out.append(Block(text, article_now and not hinted, hinted))

    def close(i: int) -> tuple[bool, bool, bool, bool]:
        for *_, span in stack[i:]:
            if span:
                span.end, span.chars = at, seen - span.chars
        del stack[i:]
        return stack[-1][1:5] if stack else (False, False, False, False)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not hidden_now:
            text = page[at:stop]
            seen += 0 if unseen_now else len(text.strip())
            (aside if out_now else held).append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA[") and not hidden_now:
                (aside if out_now else held).append(m[0][9:].removesuffix("]]>"))
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        if not closing:
            if name in RAW:
                if not attributes.endswith("/"):
                    ending = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    at = ending.end() if ending else n
                continue
            if name in VOID:
                if name in ("br", "wbr"):
                    (aside if out_now else held).append(" " if name == "br" else "")
                elif name == "hr":
                    end_block()
                continue
            if name not in INLINE:
                end_block()
                if name == "p":  # a paragraph ends where the next begins
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            out_now, article_now, unseen_now, hidden_now = close(i)
                            break
                        if stack[i][0] not in INLINE:
                            break
            if attributes.endswith("/") and name in INLINE:
                continue
            why = "" if m.start() in keep else left_out(name, attributes, article_now)
            span = None
            if why in ("tag", "name"):
                span = Span(m.start(), n, why, seen)
                spans.append(span)
            elif name in ARTICLE and not why and not unseen_now:
                (mains if name == "main" else articles).append(m.start())
            gone = out_now or bool(why)
            stack.append((name, gone, article_now or name in ARTICLE and not gone, unseen_now or why in ("tag", "hidden"), hidden_now or why == "hidden" or name in UNREAD, span))
            out_now, article_now, unseen_now, hidden_now = stack[-1][1:5]
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in INLINE:
                        end_block()
                    out_now, article_now, unseen_now, hidden_now = close(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            else:
                if name not in INLINE:
                    end_block()
    end_block()
    close(0)
    return out, spans, mains, articles, seen


def suffix_ranks(ranks: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... ``depth`` words; 0 is the end."""
    levels, step = [ranks], 1
    while step < depth:
        last = levels[-1]
        further = np.zeros(len(last), np.int64)
        further[: max(0, len(last) - step)] = last[step:]
        _, made = np.unique(last * (int(last.max(initial=0)) + 1) + further, return_inverse=True)
        levels.append(made.astype(np.int64) + 1)
        step *= 2
    return levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix of ``order`` shares with the one before it, up to twice the depth less one."""
    n = len(order)
    a, b = order[1:].copy(), order[:-1].copy()
    out = np.zeros(n, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        padded = np.concatenate([levels[j], np.zeros(1, np.int64)])
        ia, ib = np.minimum(a, n), np.minimum(b, n)
        same = (padded[ia] == padded[ib]) & (ia < n) & (ib < n)
        out[1:] += same << j
        a += same << j
        b += same << j
    return out


def run_counts(words: np.ndarray, pages: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The class of the suffix at each word, by its first ``run`` words, and the distinct pages of each class.

    ``words`` are hashes and ``pages`` the ascending page number of each; pages are separated.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(np.diff(pages)) + 1
    _, ranks = np.unique(words, return_inverse=True)
    top = int(ranks.max()) + 1
    at = np.insert(np.arange(n), breaks, -1)
    stream = np.where(at >= 0, ranks[np.maximum(at, 0)] + 1, 0).astype(np.int64)
    stream[at < 0] = top + 1 + np.arange(len(breaks))  # a separator like no other
    levels = suffix_ranks(stream)
    order = np.argsort(levels[-1], kind="stable")
    group = np.cumsum(common_prefixes(order, levels) < run)
    place = at[order]
    real = place >= 0
    group, place = group[real], place[real]
    each = np.unique(group * (int(pages[-1]) + 1) + pages[place]) // (int(pages[-1]) + 1)
    classes = np.zeros(n, np.int64)
    classes[place] = group
    return classes, np.bincount(each, minlength=int(group.max()) + 1)


def spread(counts: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each word the most pages of a run that holds it, from those of the run that begins at each word."""
    out = counts.copy()
    for k in range(1, min(run, len(counts))):
        np.maximum(out[k:], counts[:-k], out=out[k:])
    return out


def covered(words: np.ndarray, pages: np.ndarray, least: int, run: int = RUN) -> np.ndarray:
    """Flags of the words in runs of ``run`` or more that stand on ``least`` or more distinct pages."""
    classes, counts = run_counts(words, pages, run)
    return spread(counts[classes], run) >= least


def whole_runs(flags: np.ndarray, run: int = RUN) -> np.ndarray:
    """Covered words of a block, without the ends of runs that mostly lie in a block next to it."""
    if flags.all() or not flags.any():
        return flags
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    out = flags.copy()
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a < run:
            out[a:b] = False
    return out


@dataclass
class Parsed:
    """Pages as blocks, and the words of all blocks: hash, page and block of each; words of each block."""

    pages: list[list[Block]]
    words: np.ndarray
    page: np.ndarray
    block: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def parsed(htmls: list[str]) -> Parsed:
    every = [blocks(h) for h in htmls]
    data = [b.text.encode("utf-8", "surrogatepass") for page in every for b in page]
    begin, words = word_hashes(np.frombuffer(b"\n".join([*data, b""]) or b"\n", np.uint8))
    counts = np.diff(np.searchsorted(begin, np.cumsum([0, *(len(d) + 1 for d in data)])))
    block = np.repeat(np.arange(len(data)), counts)
    page = np.repeat(np.arange(len(every)), [len(p) for p in every])[block] if len(data) else np.zeros(0, np.int64)
    return Parsed(every, words, page, block, counts)


def texts(made: Parsed, run_pages: np.ndarray, block_pages: np.ndarray, host_pages: np.ndarray) -> list[tuple[str, int, int]]:
    """Text, blocks and words removed as repeated of each page: from the pages of the runs that hold each word,
    of each block and of each page's host."""
    first, out, k = made.first, [], 0
    for page, n in zip(made.pages, host_pages.tolist(), strict=True):
        own = range(k, k := k + len(page))
        met = [np.maximum(run_pages[first[i] : first[i + 1]], block_pages[i]) for i in own]
        least = max(LEAST_PAGES, LEAST_SHARE * n)
        gone = [whole_runs(m >= least) for m in met]
        kept = [i for i, b in enumerate(page) if not b.hinted]
        article = [i for i in kept if page[i].article]
        for i in article:
            gone[i] = np.full(len(met[i]), len(met[i]) > 0 and met[i].min() >= ARTICLE_PAGES and 2 * met[i].min() > n)
        if article and sum(int(gone[i].sum()) for i in article) >= COPY_SHARE * sum(len(gone[i]) for i in article):
            for i in article:
                gone[i][:] = False
        elif kept and not article and all(gone[i].all() for i in kept):
            usual = np.median(np.concatenate([met[i] for i in kept]))
            for i in kept:
                gone[i] = met[i] > 2 * usual
        lines = []
        for i in kept:
            if not gone[i].any():
                lines.append(page[i].text)
            elif rest := [w for w, f in zip(re.findall(r"[^\x20\x09-\x0D]+", page[i].text), gone[i].tolist(), strict=True) if not f]:
                lines.append(" ".join(rest))
        out.append(("\n".join(lines), len(lines), sum(int(g.sum()) for g in gone)))
    return out


def extract_group(ids: list, htmls: list[str]) -> list[tuple[str, int, int]]:
    """Text, blocks and words removed as repeated for each page of a host, from all its pages."""
    hosts = np.zeros(len(ids), np.uint64)
    keys, counts = group_keys(ids, hosts, htmls, 0)
    order = np.argsort(keys)
    return looked_up(htmls, hosts, keys[order], counts[order], 0)


def low_bits(bits: int) -> int:
    """Bits of a key in its bucket, in whole bytes."""
    return min(48, (63 - bits) // 8 * 8)


def placed(key: np.ndarray, bits: int) -> np.ndarray:
    """The hash with its bucket (its top ``bits``) above its low bits."""
    low = low_bits(bits)
    top = key >> np.uint64(64 - bits) << np.uint64(low) if bits else np.uint64(0)
    return top | key & np.uint64((1 << low) - 1)


#: Added to a host's salt for the keys of its blocks and its pages.
BLOCK_MARK, HOST_MARK = np.uint64(BASES[0]), np.uint64(BASES[1])


def keys_of(made: Parsed, hosts: np.ndarray, bits: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words salted by host; key of the run that begins at each word; whether it ends within its page; key of
    each block; key of each page's host."""
    n = len(made.words)
    salted = mix(made.words + hosts[made.page]) if n else made.words
    keys, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= run:
        m = n - run + 1
        key = np.zeros(m, np.uint64)
        for k in range(run):
            key = mix(key * np.uint64(BASES[1]) + salted[k : k + m])
        keys[:m] = placed(key, bits)
        whole[:m] = made.page[:m] == made.page[run - 1 :]
    up, down = powers(BASES[0], n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted * up[:n])])
    first = made.first
    block = mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + BLOCK_MARK * (made.counts.astype(np.uint64) + np.uint64(1)))
    return salted, keys, whole, placed(block, bits), placed(mix(hosts + HOST_MARK), bits)


def group_keys(ids: list, hosts: np.ndarray, htmls: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs, blocks and hosts of a group of pages, and the distinct pages of the group with each."""
    numbers: dict = {}
    number = np.array([numbers.setdefault(k, len(numbers)) for k in zip(ids, hosts.tolist(), strict=True)], np.int64)
    order = np.argsort(number, kind="stable")
    made, number = parsed([htmls[i] for i in order]), number[order]
    salted, keys, whole, block, host = keys_of(made, hosts[order], bits)
    classes, met = run_counts(salted, number[made.page])
    held, at = np.unique(classes[whole], return_index=True)
    found, counts = [keys[whole][at]], [met[held]]
    full = made.counts > 0
    owner = np.repeat(np.arange(len(made.pages)), [len(p) for p in made.pages])[full] if len(full) else np.zeros(0, np.int64)
    for key, page in ((block[full], number[owner]), (host, number)):
        each, n = np.unique(np.unique(np.stack([key, page.astype(np.uint64)]), axis=1)[0], return_counts=True)
        found.append(each)
        counts.append(n)
    return np.concatenate(found), np.concatenate(counts)


def looked_up(htmls: list[str], hosts: np.ndarray, known: np.ndarray, n: np.ndarray, bits: int) -> list[tuple[str, int, int]]:
    """What ``texts`` gives, from the ascending keys that are known and the distinct pages of each."""
    made = parsed(htmls)
    _, keys, whole, block, host = keys_of(made, hosts, bits)

    def pages(key: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return np.where(known[at] == key, n[at], 0)

    return texts(made, spread(np.where(whole, pages(keys), 0)), np.where(made.counts > 0, pages(block), 0), pages(host))


TEXT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_boilerplate", T.LongType())])


BUCKET = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
RUNS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _uint64(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _dealt(keys: np.ndarray, counts: np.ndarray, bits: int):
    """A row for each bucket: sorted low bytes of its keys, as planes (which compress), and counts, of one byte each
    where all fit."""
    import pyarrow as pa

    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)
    bucket = (keys >> np.uint64(low_bits(bits))).astype(np.int32)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    low = keys.view(np.uint8).reshape(-1, 8)[:, : low_bits(bits) // 8]
    spans = [*zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return pa.table({"bucket": pa.array(bucket[edges[:-1]], pa.int32()), "keys": pa.array([np.ascontiguousarray(low[a:b].T).tobytes() for a, b in spans], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())})


def by_parts(fn):
    """An Arrow function that gives ``fn`` the rows in parts of ``PAGES``."""

    def task(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                yield from fn(batch.slice(at, PAGES))

    return task


def page_keys(part, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key of each row, and the row's number."""
    made = parsed(part["html"].to_pylist())
    _, keys, whole, block, host = keys_of(made, _uint64(part["salt"]), bits)
    owner = np.repeat(np.arange(len(made.pages)), [len(p) for p in made.pages])
    return np.concatenate([keys[whole], block, host]), np.concatenate([made.page[whole], owner, np.arange(part.num_rows)]).astype(np.int64)


def repeated_runs(rows: DataFrame, bits: int) -> DataFrame:
    """Keys of runs, blocks and hosts with ``LEAST_PAGES`` or more distinct pages, and those pages' number."""
    pages, size = rows.select("salt", "page_id", "html"), low_bits(bits) // 8
    twice = stored(pages.groupBy("salt", "page_id").count().filter("count > 1").select("salt", "page_id", F.lit(True).alias("twice")), "repeated")

    def task(batches: Iterator) -> Iterator:
        for batch in batches:
            found, held = [], 0
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                found.append(group_keys(part["page_id"].to_pylist(), _uint64(part["salt"]), part["html"].to_pylist(), bits))
                held += len(found[-1][0])
                if held >= HELD or at + PAGES >= batch.num_rows:
                    yield from _dealt(*map(np.concatenate, zip(*found, strict=True)), bits).to_batches()
                    found, held = [], 0

    def each(part) -> Iterator:
        import pyarrow as pa

        key, row = page_keys(part, bits)
        yield pa.RecordBatch.from_pydict({"salt": part["salt"].take(pa.array(row)), "page_id": part["page_id"].take(pa.array(row)), "key": pa.array(key.view(np.int64), pa.int64())})

    def pack(batches: Iterator) -> Iterator:
        for batch in batches:
            yield from _dealt(batch["key"].to_numpy().view(np.uint64), batch["n"].to_numpy(), bits).to_batches()

    def add(table):
        import pyarrow as pa

        keys = [np.frombuffer(k, np.uint8).reshape(size, -1).T for k in table["keys"].to_pylist()]
        wide = np.zeros((sum(map(len, keys)), 8), np.uint8)
        wide[:, :size] = np.concatenate(keys)
        low = wide.view(np.uint64)[:, 0]
        widths = [np.uint8 if len(c) * size == len(k) else np.uint32 for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)]
        counts = np.concatenate([np.frombuffer(c, w).astype(np.int64) for c, w in zip(table["counts"].to_pylist(), widths, strict=True)])
        order = np.argsort(low)
        low, counts = low[order], counts[order]
        at = np.concatenate([[0], np.flatnonzero(np.diff(low)) + 1])
        total = np.add.reduceat(counts, at)
        often = total >= LEAST_PAGES
        key = low[at][often] | np.uint64(table["bucket"][0].as_py() << (8 * size))
        return pa.table({"key": pa.array(key.view(np.int64), pa.int64()), "n": pa.array(total[often], pa.int64())})

    if twice.limit(1).count():  # rows of a page count once for each key
        same = [pages["salt"].eqNullSafe(twice["salt"]), pages["page_id"].eqNullSafe(twice["page_id"])]
        more = pages.join(twice, same, "left_semi").mapInArrow(by_parts(each), "salt long, page_id long, key long").distinct()
        more = more.groupBy("key").agg(F.count(F.lit(1)).alias("n")).mapInArrow(pack, BUCKET)
        dealt = pages.join(twice, same, "left_anti").mapInArrow(task, BUCKET).unionByName(more)
    else:
        dealt = pages.mapInArrow(task, BUCKET)
    found = stored(dealt.repartition((1 << bits) // TOGETHER, "bucket").groupBy("bucket").applyInArrow(add, RUNS), "repeated-runs")
    forget(twice)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_boilerplate (words removed as repeated) for every row."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").alias("html"), F.xxhash64(host_of(F.col("url"))).alias("salt"))
    chars = rows.agg(F.sum(F.length("html"))).first()[0] or 0
    bits = min(BUCKET_BITS, max(4 * TOGETHER, -(-chars // BUCKET_CHARS)).bit_length())
    runs = repeated_runs(rows, bits)

    def made(part, met: list[tuple[str, int, int]]):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"page_id": part["page_id"], "url": part["url"], "text": pa.array([t for t, _, _ in met], pa.string()), "n_chars": pa.array([len(t) for t, _, _ in met], pa.int64()), "n_blocks": pa.array([b for _, b, _ in met], pa.int64()), "n_boilerplate": pa.array([r for _, _, r in met], pa.int64())})

    if runs.count() <= BROADCAST_RUNS:
        table = runs.toArrow()
        order = np.argsort(table["key"].to_numpy())
        held = spark.sparkContext.broadcast((table["key"].to_numpy()[order].view(np.uint64), table["n"].to_numpy()[order]))

        def with_all(part) -> Iterator:
            yield made(part, looked_up(part["html"].to_pylist(), _uint64(part["salt"]), *held.value, bits))

        return rows.mapInArrow(by_parts(with_all), TEXT)

    # Too many to broadcast: each row gets those it holds. Hot runs are dealt by a part of the row's key.
    keyed = rows.withColumn("row", F.xxhash64("salt", "page_id", "html"))

    def own(part) -> Iterator:
        import pyarrow as pa

        key, row = page_keys(part, bits)
        yield pa.RecordBatch.from_pydict({"row": part["row"].take(pa.array(row)), "key": pa.array(key.view(np.int64), pa.int64())})

    deal = F.pmod("row", F.lit(SALTS)).cast("int")
    each = keyed.mapInArrow(by_parts(own), "row long, key long").distinct().withColumn("salt", deal)
    shared = runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lists = each.join(shared, ["key", "salt"]).groupBy("row").agg(F.collect_list(F.struct("key", "n")).alias("runs"))

    def with_own(part) -> Iterator:
        met = []
        for text, salt, found in zip(part["html"].to_pylist(), _uint64(part["salt"]), part["runs"].to_pylist(), strict=True):
            known = np.array([r["key"] for r in found or ()], np.int64).view(np.uint64)
            order = np.argsort(known)
            met += looked_up([text], np.array([salt]), known[order], np.array([r["n"] for r in found or ()], np.int64)[order], bits)
        yield made(part, met)

    return keyed.join(lists, "row", "left").select("page_id", "url", "html", "salt", "runs").mapInArrow(by_parts(with_own), TEXT)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
