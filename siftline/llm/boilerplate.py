"""Problem 3: the main body of web pages, by wrappers inferred for each host.

A page is a stream of tokens: its lines, digits made a slot, known by a 64-bit hash whatever their length. The lines from
the first to the last long one are the main slot of the page; what stands ahead and behind are its head and its tail. A
host's wrapper is a union-free regular expression HEAD (TEXT (token)?)* TAIL TEXT*. It is inferred by aligning the heads (and
tails) of its pages one after another: where streams agree a node is shared, a mismatch becomes an optional node, tokens
that come back in a stream or in another order become a repeated group of optional nodes, and all else is a text slot.
Streams are first reduced to the host's frequent tokens (counted exactly), so equal streams count as one, and they are
aligned from the most frequent on, in parts by their hash and then together: the result does not depend on partitions
or on the order of rows, and no task holds a host's pages. The wrappers of all hosts are aligned in the same way into a
general one, which counts as PRIOR pages of every host: a host with few pages is read mostly by it.

A page is read by aligning its lines with the wrapper: the chain of nodes of greatest weight in the wrapper's order, in
which only repeated groups and the main slot may hold several lines. A line is furniture if its node is required there,
or is an optional node of the head that stands nowhere else; behind a required node of the tail all short lines are. A line that the
alignment leaves in a slot is body, unless it is a breadcrumb or an inserted line (adverts, links, counters: a template
with slots for names that comes back over all pages) that is not the page's title.

Null and empty texts have no lines; blank lines are never returned. Repeated deliveries give repeated rows; extra columns
are left out.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import map_rows
from siftline.session import checkpoint

#: Pages that the general wrapper counts for.
PRIOR = 4
#: Share of a host's pages from which a token is required, and from which the order of its part is inferred for it.
REQUIRED, ORDERED = 0.4, 0.1
#: Share of a host's pages (and least number) from which a token is a node of the wrapper; it bounds the nodes.
NODE, LEAST_PAGES = 0.02, 2
#: Pages that must share a long line for it to be no text (with REQUIRED of the pages).
LEAST_SHARED = 3
#: Share of all pages (and least number) from which a template with slots is an insertion; it bounds their number.
INSERTED, LEAST_TIMES = 0.003, 3
#: Share of all hosts (and least number) from which a token belongs to the general wrapper; it bounds its nodes.
USUAL, LEAST_HOSTS = 0.002, 3
#: An optional token belongs to the head if this share of its places is there.
SIDE = 0.9
#: Characters of a line that is text for certain.
LONG = 100
#: Weight of a long line in the main slot; that of a node is its share of the pages.
CERTAIN = 100.0
#: Parts in which the streams of one host are aligned first.
SALTS = 16
HEAD, MAIN, TAIL, OPEN = 0, 1, 2, 3
IS_LONG, CRUMB, CLOSED, NUMBERED, TITLED = 1, 2, 4, 8, 16
DIGITS = re.compile(r"\d+")
NAMES = re.compile(r"(?<=[^.!?\s] )([«\"(]?)[A-ZА-ЯЁЇІЄҐÁČĎÉĚÍŇÓŘŠŤÚŮÝŽÄÖÜ][\w-]*")
MENU = re.compile(r"\s(?:[|·»>/→]|::)\s")
SPACES = re.compile("[   -  　\\t]+")
HIDDEN = re.compile("[­​-‏⁠﻿]")
WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
#: A numbered line whose digits stand behind a colon or a date's point is no title.
COUNTER = re.compile(r"[:.] ?#|#[.,] |\(#\)")


COMPACT = (
    ("block_id", ("bigint", pa.int64())), ("host", ("string", pa.string())), ("lines", ("array<int>", pa.list_(pa.int32()))), ("keys", ("array<bigint>", pa.list_(pa.int64()))), ("kinds", ("array<bigint>", pa.list_(pa.int64()))),
    ("flags", ("array<int>", pa.list_(pa.int32()))), ("parts", ("array<int>", pa.list_(pa.int32()))),
)


def host_column(path):  # noqa: ANN001, ANN201
    """The host of a page: the folder named site_… in its path, else its folder."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/(site_[^/]+)/", 1), F.lit("")), F.regexp_replace(path, r"/[^/]*$", ""), F.lit(""))


def token(line: str) -> str:
    """A line in plain characters with its digits made a slot."""
    return DIGITS.sub("#", SPACES.sub(" ", HIDDEN.sub("", line).translate(WIDE)).strip())


def template(tok: str) -> str:
    """A token with its names made slots too."""
    return NAMES.sub(r"\1@", tok)


def key_of(tok: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(xxhash.xxh64_digest(tok.encode("utf-8", "surrogatepass")), "big", signed=True)


def line_rows(text: str) -> list[tuple[int, int, int, int]]:
    """(line_no, token key, template key or 0 without slots, flags) of every line that is not blank."""
    tokens = [token(x) for x in text.split("\n")]
    out = []
    for k, tok in enumerate(tokens):
        if not tok:
            continue
        flags = IS_LONG * (len(tok) >= LONG)
        if MENU.search(tok) and any(len(n) > 5 and tok.endswith(n) for n in tokens[k + 1 : k + 5]):
            flags |= CRUMB
        kind = template(tok)
        slots = "@" in kind or "#" in kind
        if slots:
            flags |= CLOSED * (kind[-1] in ".!?") | NUMBERED * ("#" in tok) | TITLED * (COUNTER.search(tok) is None)
        out.append((k, key_of(tok), key_of(kind) if slots else 0, flags))
    return out


def part_of(flags: list[int]) -> list[int]:
    """The part of the page that each line stands in; OPEN for all lines of a page without a long one."""
    long = [k for k, f in enumerate(flags) if f & IS_LONG]
    if not long:
        return [OPEN] * len(flags)
    return [HEAD if k < long[0] else TAIL if k > long[-1] else MAIN for k in range(len(flags))]


def compact(pages: DataFrame) -> DataFrame:
    """Pages (block_id, host, text) without their texts: arrays of line numbers, token keys, template keys, flags and parts."""

    def make():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for block_id, host, text in rows:
                found = line_rows(text)
                if found:
                    at, keys, kinds, flags = (list(c) for c in zip(*found, strict=True))
                    yield block_id, host, at, keys, kinds, flags, part_of(flags)

        return step

    return map_rows(pages.select("block_id", "host", "text"), make, ", ".join(f"{n} {ddl}" for n, (ddl, _) in COMPACT), [(n, kind) for n, (_, kind) in COMPACT])


def without_long_furniture(small: DataFrame) -> DataFrame:
    """Long lines that a host's pages share (a menu or a notice in one line) are no text: their flag is cleared and the parts are set anew."""
    pages = small.groupBy("host").agg(F.count("*").alias("pages"))
    long = small.select("host", F.explode(F.array_distinct(F.filter(F.arrays_zip("keys", "flags"), lambda x: x["flags"].bitwiseAND(IS_LONG) > 0))).alias("x")).groupBy("host", F.col("x.keys").alias("key")).agg(F.count("*").alias("n"))
    shared = long.where(F.col("n") >= LEAST_SHARED).join(pages.hint("shuffle_merge"), "host").where(F.col("n") >= REQUIRED * F.col("pages"))
    fixed = shared.groupBy("host").agg(F.collect_list("key").alias("fixed"))  # at most 1 / REQUIRED as many as a page has lines
    names = small.columns

    def make():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for *own, keys, flags, parts, fixed in rows:
                if fixed:
                    gone = set(fixed)
                    flags = [f & ~IS_LONG if k in gone else f for k, f in zip(keys, flags, strict=True)]
                    parts = part_of(flags)
                yield *own, keys, flags, parts

        return step

    order = ["block_id", "host", "lines", "kinds", "keys", "flags", "parts"]
    joined = small.join(fixed.hint("shuffle_merge"), "host", "left").select(*order, "fixed")
    return map_rows(joined, make, ", ".join(f"{n} {dict(COMPACT)[n][0]}" for n in order), [(n, dict(COMPACT)[n][1]) for n in order]).select(*names)


def token_shares(small: DataFrame) -> DataFrame:
    """(host, pages, all_open, nodes: array of (key, part, n)): the pages of a host that hold a token in a part, exact, for tokens frequent enough to be nodes."""
    # A page without a long line would be a head from end to end: only hosts that have no others are ordered by such.
    pages = small.groupBy("host").agg(F.count("*").alias("pages"), F.min(F.array_contains("parts", OPEN)).alias("all_open"))
    each = small.select("host", F.explode(F.array_distinct(F.arrays_zip("keys", "parts"))).alias("x")).select("host", F.col("x.keys").alias("key"), F.col("x.parts").alias("part"))
    counted = each.groupBy("host", "key", "part").agg(F.count("*").alias("n"))
    by = counted.groupBy("host", "key").agg(F.sum("n").alias("held"), F.collect_list(F.struct("part", "n")).alias("own"))
    kept = by.where(F.col("held") >= LEAST_PAGES).join(pages.hint("shuffle_merge"), "host").where(F.col("held") >= NODE * F.col("pages"))
    return kept.groupBy("host").agg(F.first("pages").alias("pages"), F.first("all_open").alias("all_open"), F.collect_list(F.struct("key", "own")).alias("nodes"))


class Shares:
    """Of each token the number of pages that hold it in the head, the main slot and the tail."""

    def __init__(self, pages: float, nodes: Iterable[tuple[int, Iterable[tuple[int, float]]]]) -> None:
        self.pages = pages
        self.parts: dict[int, list[float]] = {}
        for key, own in nodes:
            n = [0.0] * 4
            for part, count in own:
                n[part] += count
            # Pages without long lines say nothing of the part; they are divided as the others.
            known = sum(n[:OPEN])
            self.parts[key] = [c + n[OPEN] * c / known for c in n[:OPEN]] if known else [n[OPEN], 0.0, 0.0]

    def ordered(self, part: int) -> set[int]:
        """Tokens that the order of a part is inferred for: often there, or there only."""
        return {k for k, n in self.parts.items() if n[part] >= LEAST_PAGES and (n[part] >= ORDERED * self.pages or n[part] >= SIDE * sum(n))}


def unite(mine: list[list], theirs: list[list]) -> list[list]:
    """Align two streams of nodes [key, weight] and unite them: the longest chain of equal nodes is shared, all else is kept as optional nodes in its gap."""
    at: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(mine):
        at[n[0]].append(i)
    ends: list[int] = []
    top: list[int] = []
    links: list[tuple[int, int, int]] = []
    for k, n in enumerate(theirs):
        for i in reversed(at.get(n[0], ())):
            j = bisect_left(ends, i)
            links.append((i, k, top[j - 1] if j else -1))
            if j == len(ends):
                ends.append(i)
                top.append(len(links) - 1)
            else:
                ends[j], top[j] = i, len(links) - 1
    chain, j = [], top[-1] if top else -1
    while j >= 0:
        i, k, j = links[j]
        chain.append((i, k))
    out, i, k = [], 0, 0
    for a, b in [*reversed(chain), (len(mine), len(theirs))]:
        out += mine[i:a]
        out += theirs[k:b]
        if a < len(mine):
            out.append([mine[a][0], mine[a][1] + theirs[b][1]])
        i, k = a + 1, b + 1
    return out


def align_all(streams: list[tuple[float, list[list]]]) -> tuple[float, list[list]]:
    """Unite streams of (weight, nodes), the heaviest first; nodes of little weight beside another one of their token are left to it."""
    weight, nodes = 0.0, []
    for w, own in sorted(streams, key=lambda s: (-s[0], s[1])):
        weight += w
        nodes = unite(nodes, own)
        if len(nodes) > 4 * len({n[0] for n in nodes}):
            nodes = without_strays(weight, nodes)
    return weight, without_strays(weight, nodes)


def without_strays(weight: float, nodes: list[list]) -> list[list]:
    most: dict[int, float] = {}
    for key, n in nodes:
        most[key] = max(most.get(key, 0.0), n)
    return [n for n in nodes if n[1] >= most[n[0]] or n[1] >= NODE * weight]


def grouped(nodes: list[list]) -> list[tuple[bool, list[int]]]:
    """The expression: (repeated, keys) of each group. What stands between two nodes of one token is a repeated group."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, (key, _) in enumerate(nodes):
        first.setdefault(key, i)
        last[key] = i
    out: list[tuple[bool, list[int]]] = []
    i = 0
    while i < len(nodes):
        end, k = i, i
        while k <= end:
            end = max(end, last[nodes[k][0]])
            k += 1
        out.append((end > i, list(dict.fromkeys(n[0] for n in nodes[i : end + 1]))))
        i = end + 1
    return out


def streams_of(small: DataFrame, shares: DataFrame) -> DataFrame:
    """(host, part, weight, stream): the distinct heads and tails of each host's pages, reduced to the tokens that are ordered."""

    def make():  # noqa: ANN202
        held: dict[str, tuple[set[int], set[int]]] = {}

        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for host, keys, parts, pages, nodes in rows:
                if host not in held:
                    if len(held) > 2000:
                        held.clear()
                    own = Shares(pages, _own(nodes))
                    held[host] = own.ordered(HEAD), own.ordered(TAIL)
                head, tail = held[host]
                yield host, HEAD, [k for k, p in zip(keys, parts, strict=True) if p in (HEAD, OPEN) and k in head]
                yield host, TAIL, [k for k, p in zip(keys, parts, strict=True) if p == TAIL and k in tail]

        return step

    chosen = small.join(shares.hint("shuffle_merge"), "host").where(~F.array_contains("parts", OPEN) | F.col("all_open"))
    made = map_rows(chosen.select("host", "keys", "parts", "pages", "nodes"), make, "host string, part int, stream array<bigint>", [("host", pa.string()), ("part", pa.int32()), ("stream", pa.list_(pa.int64()))])
    return made.where(F.size("stream") > 0).groupBy("host", "part", "stream").agg(F.count("*").cast("double").alias("weight"))


def _own(nodes: list[dict]) -> list[tuple[int, list[tuple[int, float]]]]:
    return [(n["key"], [(x["part"], x["n"]) for x in n["own"]]) for n in nodes]


def aligned(streams: DataFrame) -> DataFrame:
    """(host, head, tail: nodes as JSON): the streams (host, part, weight, stream) of each host aligned, in parts by their hash and then together."""

    def frame_of(frame: pd.DataFrame, weight: float, nodes: list[list]) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "part": [frame["part"].iloc[0]], "weight": [weight], "nodes": [json.dumps(nodes)]})

    def some(frame: pd.DataFrame) -> pd.DataFrame:
        return frame_of(frame, *align_all([(w, [[int(k), w] for k in s]) for w, s in zip(frame["weight"], frame["stream"], strict=True)]))

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        return frame_of(frame, *align_all([(w, json.loads(s)) for w, s in zip(frame["weight"], frame["nodes"], strict=True)]))

    ddl = "host string, part int, weight double, nodes string"
    first = streams.groupBy("host", "part", F.pmod(F.xxhash64("stream"), F.lit(SALTS)).alias("salt")).applyInPandas(some, ddl)
    parts = first.groupBy("host", "part").applyInPandas(whole, ddl)
    return parts.groupBy("host").agg(*(F.max(F.when(F.col("part") == part, F.col("nodes"))).alias(name) for part, name in ((HEAD, "head"), (TAIL, "tail"))))


def expressions(small: DataFrame) -> DataFrame:
    """(host, pages, nodes, head, tail) of every host: the shares of its tokens and the order of its head and tail."""
    shares = checkpoint(token_shares(small))
    return checkpoint(shares.join(aligned(streams_of(small, shares)).hint("shuffle_merge"), "host", "left").drop("all_open"))


def general(exps: DataFrame) -> tuple[list[tuple[int, list[tuple[int, float]]]], list[list], list[list]]:
    """(shares of one page, head, tail) of the general wrapper: tokens that many hosts have, in the order in which their wrappers agree.

    A share of all hosts bounds the number of tokens, which is all that reaches the driver.
    """

    def make():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for pages, nodes in rows:
                for key, n in Shares(pages, _own(nodes)).parts.items():
                    if sum(n) >= ORDERED * pages:
                        yield key, *(x / pages for x in n)

        return step

    hosts = exps.count()
    each = map_rows(exps.select("pages", "nodes"), make, "key bigint, a double, m double, t double", [("key", pa.int64()), ("a", pa.float64()), ("m", pa.float64()), ("t", pa.float64())])
    usual = each.groupBy("key").agg(F.count("*").alias("hosts"), *(F.avg(c).alias(c) for c in "amt")).where(F.col("hosts") >= max(LEAST_HOSTS, USUAL * hosts)).collect()
    nodes = sorted((r["key"], [(HEAD, r["a"]), (MAIN, r["m"]), (TAIL, r["t"])]) for r in usual)
    wanted = exps.sparkSession.sparkContext.broadcast({k for k, _ in nodes})

    def make_streams():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for both in rows:
                for part, own in zip((HEAD, TAIL), both, strict=True):
                    yield "", part, [k for k, _ in json.loads(own or "[]") if k in wanted.value]

        return step

    streams = map_rows(exps.select("head", "tail"), make_streams, "host string, part int, stream array<bigint>", [("host", pa.string()), ("part", pa.int32()), ("stream", pa.list_(pa.int64()))])
    order = aligned(streams.where(F.size("stream") > 0).groupBy("host", "part", "stream").agg(F.count("*").cast("double").alias("weight"))).first()
    scale = PRIOR / max(hosts, 1)
    head, tail = ([[k, n * scale] for k, n in json.loads(own or "[]")] for own in ((order.head, order.tail) if order else (None, None)))
    return nodes, head, tail


def insertions(small: DataFrame) -> set[int]:
    """Keys of the templates with slots that come back over all pages; no more than (lines a page) / INSERTED of them."""
    pages = small.count()
    each = small.select(F.explode(F.array_distinct(F.filter("kinds", lambda x: x != 0))).alias("kind"))
    return {r.kind for r in each.groupBy("kind").agg(F.count("*").alias("n")).where(F.col("n") >= max(LEAST_TIMES, INSERTED * pages)).collect()}


class Wrapper:
    """The expression of a host, and the reading of pages by it."""

    def __init__(self, pages: int, nodes: list, head: list[list], tail: list[list], usual: tuple, inserted: set[int]) -> None:
        self.inserted = inserted
        own = Shares(pages, nodes)
        prior = Shares(1, usual[0])
        self.ahead = {k for s, least in ((own, max(LEAST_PAGES, NODE * pages)), (prior, 0.0)) for k, n in s.parts.items() if n[HEAD] >= max(least, SIDE * sum(n)) and n[HEAD]}
        self.pages = pages + PRIOR
        self.parts = {k: [x + PRIOR * y for x, y in zip(own.parts.get(k, (0.0,) * 3), prior.parts.get(k, (0.0,) * 3), strict=True)] for k in {**own.parts, **prior.parts}}
        self.head, self.tail = (grouped(align_all([(pages, mine), (PRIOR, general_)])[1]) for mine, general_ in ((head, usual[1]), (tail, usual[2])))
        #: The ranks of the groups in order, the main slot between head and tail and a slot for more text behind it; whether a rank may hold several lines.
        groups = [*self.head, (True, ()), *self.tail, (True, ())]
        self.again = [again for again, _ in groups]
        self.main = len(self.head)
        self.places: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for key, n in self.parts.items():
            if n[MAIN]:
                self.places[key].append((self.main, MAIN, n[MAIN] / self.pages))
        for rank, (_, keys) in enumerate(groups):
            part = HEAD if rank < self.main else TAIL
            for key in keys:
                if key in self.parts:
                    self.places[key].append((rank, part, max(self.parts[key][part] / self.pages, 1e-3)))

    def required(self, key: int, part: int) -> bool:
        n = self.parts[key]
        return sum(n) >= REQUIRED * self.pages and n[part] >= NODE * self.pages

    def align(self, keys: list[int], flags: list[int]) -> list[int | None]:
        """The part in which the alignment matches each line with a node; None for lines that it leaves in a slot.

        The chain of greatest weight among those whose ranks do not fall, and rise but within repeated groups; found with
        a tree of prefix maxima over the ranks.
        """
        size = len(self.again)
        tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)
        links: list[tuple[int, int, int]] = []
        for k, (key, flag) in enumerate(zip(keys, flags, strict=True)):
            options = self.places.get(key, ())
            if flag & IS_LONG:
                options = [(self.main, MAIN, CERTAIN), (size - 1, OPEN, CERTAIN), *(o for o in options if o[1] != MAIN)]
            found = []
            for rank, part, weight in options:
                i = rank + 1 if self.again[rank] else rank
                best = (0.0, -1)
                while i > 0:
                    best = max(best, tree[i])
                    i &= i - 1
                found.append((rank, part, best[0] + weight, best[1]))
            for rank, part, value, back in found:
                links.append((k, part, back))
                i = rank + 1
                while i <= size:
                    tree[i] = max(tree[i], (value, len(links) - 1))
                    i += i & -i
        best, i = (0.0, -1), size
        while i > 0:
            best = max(best, tree[i])
            i &= i - 1
        out: list[int | None] = [None] * len(keys)
        at = best[1]
        while at >= 0:
            k, out[k], at = links[at][0], links[at][1], links[at][2]
        return out

    def furniture(self, lines: list[int], keys: list[int], kinds: list[int], flags: list[int]) -> list[int]:
        """Numbers of the lines that are not part of the body."""
        out, begun, ended = [], False, False
        last_long = max((k for k, f in enumerate(flags) if f & IS_LONG), default=-1)
        for k, part in enumerate(self.align(keys, flags)):
            key, flag = keys[k], flags[k]
            slots = kinds[k] in self.inserted and not flag & IS_LONG  # a long line is text
            drop = part in (HEAD, MAIN, TAIL) and key in self.parts and self.required(key, part)
            ended = (ended or (drop and part == TAIL)) and not flag & IS_LONG
            if not drop and not begun:
                drop = bool(flag & CRUMB) or (part == HEAD and key in self.ahead) or (slots and bool(flag & CLOSED)) or (k < last_long and slots and flag & NUMBERED and not flag & TITLED)
            elif not drop:
                drop = slots
            if drop or ended:
                out.append(lines[k])
            else:  # furniture in an unusual place does not open the body
                begun = begun or not (key in self.parts and sum(self.parts[key]) >= REQUIRED * self.pages)
        return out


def host_pages(blocks: DataFrame) -> DataFrame:
    """block_id, host, text of the pages with text."""
    return blocks.select("block_id", host_column(F.col("file_path")).alias("host"), "text").where("text is not null and trim(text) <> ''")


def furniture_lines(blocks: DataFrame) -> DataFrame:
    """(block_id, line_no) of every non-blank line outside the body; ``blocks`` has block_id, file_path and text."""
    small = checkpoint(without_long_furniture(checkpoint(compact(host_pages(blocks)))))
    exps = expressions(small)
    sent = blocks.sparkSession.sparkContext.broadcast((insertions(small), general(exps)))

    def make():  # noqa: ANN202
        inserted, usual = sent.value
        held: dict[str, Wrapper] = {}

        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for block_id, host, lines, keys, kinds, flags, pages, nodes, head, tail in rows:
                wrapper = held.get(host)
                if wrapper is None:
                    if len(held) > 500:
                        held.clear()
                    wrapper = held[host] = Wrapper(pages or 0, _own(nodes or []), json.loads(head or "[]"), json.loads(tail or "[]"), usual, inserted)
                for line in wrapper.furniture(lines, keys, kinds, flags):
                    yield block_id, line

        return step

    # One expression a host, never broadcast: a hot host's pages are split by the adaptive skew join, its expression copied to each split.
    read = small.join(exps.hint("shuffle_merge"), "host", "left").select("block_id", "host", "lines", "keys", "kinds", "flags", "pages", "nodes", "head", "tail")
    return map_rows(read, make, "block_id bigint, line_no bigint", [("block_id", pa.int64()), ("line_no", pa.int64())])


def bodies(blocks: DataFrame) -> DataFrame:
    """(block_id, body): the lines of the body of each page with text; empty where there is none."""
    lines = furniture_lines(blocks).groupBy("block_id").agg(F.collect_set("line_no").alias("out"))
    texts = blocks.select("block_id", "text").where("text is not null").dropDuplicates(["block_id"])
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, k: F.struct(x.alias("x"), k.cast("bigint").alias("k"))), lambda p: ~F.array_contains(F.coalesce("out", F.array().cast("array<bigint>")), p["k"]) & (F.trim(p["x"]) != ""))
    return texts.join(lines, "block_id", "left").select("block_id", F.array_join(F.transform(kept, lambda p: p["x"]), "\n").alias("body"))


def expression_text(pages: int, nodes: list, head: list[list], tail: list[list], words: dict[int, str]) -> str:
    """An expression to be read by people: required tokens bare, optional ones as (…)?, repeated groups as (…)+, the main slot as (TEXT …)*."""
    own = Shares(pages, nodes)
    one = lambda k: words.get(k, "") if sum(own.parts.get(k, [0.0])) >= REQUIRED * pages else f"({words.get(k, '')})?"
    show = lambda groups: [one(keys[0]) if not again else "(" + " ".join(map(one, keys)) + ")+" for again, keys in groups]
    main = sorted(one(k) for k, n in own.parts.items() if n[MAIN] >= ORDERED * pages)
    return "\n".join([*show(grouped(head)), "(" + " ".join(["TEXT", *main]) + ")*" if main else "TEXT*", *show(grouped(tail)), "TEXT*"])


def expression_texts(blocks: DataFrame) -> DataFrame:
    """(host, pages, expression): the inferred wrapper of each host."""
    pages = host_pages(blocks)
    small = checkpoint(without_long_furniture(checkpoint(compact(pages))))
    exps = expressions(small)

    def make_words():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            found = {(host, tok) for host, text in rows for tok in map(token, text.split("\n")) if tok}
            return ((host, key_of(tok), tok) for host, tok in found)

        return step

    # Texts of the nodes only; equal tokens meet in the tasks first.
    wanted = exps.select("host", F.explode("nodes").alias("x")).select("host", F.col("x.key").alias("key"))
    words = map_rows(pages.select("host", "text"), make_words, "host string, key bigint, word string", [("host", pa.string()), ("key", pa.int64()), ("word", pa.string())])
    named = words.join(wanted.hint("shuffle_merge"), ["host", "key"], "left_semi").groupBy("host", "key").agg(F.min("word").alias("word"))
    by = named.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("key", "word"))).alias("words"))

    def make():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for host, n, nodes, head, tail, known in rows:
                yield host, n, expression_text(n, _own(nodes), json.loads(head or "[]"), json.loads(tail or "[]"), dict(known or ()))

        return step

    ready = exps.join(by.hint("shuffle_merge"), "host", "left").select("host", "pages", "nodes", "head", "tail", "words")
    return map_rows(ready, make, "host string, pages bigint, expression string", [("host", pa.string()), ("pages", pa.int64()), ("expression", pa.string())])
