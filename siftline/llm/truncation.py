"""Problem 10: texts that were cut off.

A stack automaton reads each whole text: brackets, quotes and markup push and pop, escapes, entities, tags and multibyte
characters begin and end. Its last state is the evidence: inside a broken character, escape, entity or tag; behind a mark
of omission; with a pair of the last line left open; or without a terminator. What the state means depends on baselines
over all texts of the source: how often its paragraphs end with a terminator, how often they leave a pair open, and
whether the last line is one that texts end with (signatures, notes: such lines recur whole more often than as the
beginning of longer lines). Where a source's paragraphs have no terminators, lengths at which its unfinished texts pile up
(field limits) are evidence; elsewhere such a length is reported only, as a complete text may be as long as a limit.
Copies of a text say nothing about how texts end: for last lines and lengths, texts that are equal count once.

Null and empty texts are not cut; a null source is a source of its own. Repeated rows give repeated results; extra
columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import map_rows
from siftline.session import checkpoint

#: A source whose paragraphs end with a terminator less often than this gives no evidence by lacking one.
LEAST_TERMINATED = 0.6
#: So often must a last line recur, as a share of the source-independent number of texts and at least, to be an ending.
LEAST_SHARE, LEAST_TIMES = 1e-5, 3
#: Words of a line's beginning that are compared with other lines' beginnings.
HEAD_WORDS = 3
PAIRS = {"»": "«", ")": "(", "]": "[", "}": "{", "”": "“"}
OPENING = set(PAIRS.values())
#: Pairs, straight double quotes, tags and line ends.
TOKENS = re.compile(r"[«»()\[\]{}“”\"]|</?[A-Za-z][^<>\n]*>|\n")
#: Elements that have no end tag.
VOID = re.compile(r"<(?:br|hr|img|input|meta|link|wbr)\b", re.I)
#: What is left open: nothing, what may be meant so (a straight quote, an element), or one of a pair.
SHUT, LOOSE, PAIR = 0, 1, 2
#: A source whose paragraphs leave a pair open more often than this gives no evidence by doing so behind a terminator.
MOST_OPEN = 0.01
#: Unfinished texts of one length, and their share of all texts of that length, from which it is a field limit of the source.
LEAST_AT_LIMIT, LIMIT_SHARE = 5, 0.5
TERMINATED = re.compile(r"[.!?。؟][»”\"')\]]*$|[:;][)\]]?$")
OMITTED = re.compile(r"(?:…|\.{3,}|\[(?:\.{3}|…)\])[»”\"')\]]*$")
#: What a transfer leaves of a character, an escape, an entity or a tag.
BROKEN = re.compile(r"(?:�+|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|(?:%[0-9A-F]{2})+%[0-9A-F]?|%[DC][01]|&(?:#\w{0,6}|[a-z]{0,6})|</?(?:[A-Za-z][^<>\n]{0,80})?|[\ud800-\udfff])$")
#: Whole lines that end texts without a terminator: list items, table rows, references, dates, file names, closed notes.
ITEM = re.compile(r"^(?:[-–—•*·]|\d{1,3}[.)])\s+\S")
CLOSED = re.compile(r"^(?:[(\[].*[)\]]|.*\|.*|№\s*\S+|\d{1,2}[./]\d{1,2}[./]\d{2,4}(?:,\s*\S+)?|\S+\.[A-Za-z]{2,5}|[^.!?]*:\s*[\d\s|.,/-]+)$")
NUMBERS = re.compile(r"\d+")


def left_open(text: str) -> int:
    """What the last line that is not blank leaves open of what it opens."""
    stack: list[tuple[str, int]] = []
    line = 0
    for m in TOKENS.finditer(text):
        token = m[0]
        if token == "\n":
            line += 1
            stack = [x for x in stack if x[0] != '"']  # a straight quote ends with its line
        elif token in OPENING:
            stack.append((token, line))
        elif token in PAIRS:
            if stack and stack[-1][0] == PAIRS[token]:
                stack.pop()
        elif token == '"':
            if stack and stack[-1][0] == token:
                stack.pop()
            else:
                stack.append((token, line))
        elif token[1] == "/":
            if stack and stack[-1][0] == "<":
                stack.pop()
        elif not token.endswith("/>") and not VOID.match(token):
            stack.append(("<", line))
    last = text.rstrip().count("\n")
    return max((LOOSE if kind in '<"' else PAIR for kind, at in stack if at == last), default=SHUT)


def automaton(text: str) -> tuple[str, int]:
    """(class of the end, what is left open in the last line)."""
    body = text.rstrip()
    open_end = left_open(body)
    last = body[body.rfind("\n") + 1 :].strip()
    if BROKEN.search(body):
        return "broken", open_end
    if OMITTED.search(last):
        return "omitted", open_end
    if TERMINATED.search(last):
        return "terminated", open_end
    if ITEM.search(last):
        return "item", open_end
    if CLOSED.search(last) and not open_end:
        return "closed", open_end
    return "bare", open_end


def _head(line: str) -> str:
    return " ".join(NUMBERS.sub("#", line).split()[:HEAD_WORDS])


def line_ends(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A small row for each text: its hash, source, length, class of the end, hash of the template and head of a bare last line."""

    def make():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for key, text_key, source, text in rows:
                kind, opened = automaton(text)
                last = text.rstrip().rpartition("\n")[2].strip()
                bare = kind in ("bare", "item")
                whole = hashlib.blake2b(NUMBERS.sub("#", last).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if bare else None
                yield key, text_key, source, len(text), kind, opened, whole, _head(last) if bare else None

        return step

    chosen = docs.select(id_col, F.xxhash64("text").alias("text_key"), F.coalesce("source", F.lit("")).alias("source"), "text").where("text is not null and trim(text) <> ''")
    text, large = pa.string(), pa.int64()
    return map_rows(
        chosen, make, f"{id_col} bigint, text_key bigint, source string, chars bigint, kind string, left_open int, last_line string, head string",
        [(id_col, large), ("text_key", large), ("source", text), ("chars", large), ("kind", text), ("left_open", pa.int32()), ("last_line", text), ("head", text)],
    )


def line_counts(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """Counts over all lines: paragraphs of each source, those with a terminator and those that leave a pair open; over the lines of distinct texts: those longer than a head, of the wanted heads."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def make():  # noqa: ANN202
        chosen_heads = sent.value

        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            counts: Counter = Counter()
            for text_key, source, text in rows:
                heads: Counter = Counter()
                lines = text.split("\n")
                for k, line in enumerate(lines):
                    words = line.split()
                    if len(words) > HEAD_WORDS:
                        heads[NUMBERS.sub("#", " ".join(words[:HEAD_WORDS]))] += 1
                        if len(words) > 8 and k < len(lines) - 1:
                            counts["paragraph", source] += 1
                            counts["terminated", source] += TERMINATED.search(line.rstrip()) is not None
                            counts["open", source] += any(c in line for c in OPENING) and left_open(line) == PAIR
                    # A line that breaks off within its first words is the beginning of these.
                    for n in range(1, min(HEAD_WORDS, len(words))):
                        heads[NUMBERS.sub("#", " ".join(words[:n]))] += 1
                for head in heads.keys() & chosen_heads:
                    yield "head", head, text_key, heads[head]
            for (what, source), n in counts.items():
                yield what, source, None, n

        return step

    chosen = docs.select(F.xxhash64("text").alias("text_key"), F.coalesce("source", F.lit("")).alias("source"), "text").where("text is not null and trim(text) <> ''")
    text, large = pa.string(), pa.int64()
    made = map_rows(chosen, make, "what string, value string, text_key bigint, n bigint", [("what", text), ("value", text), ("text_key", large), ("n", large)])
    # Copies of a text give the same count of a head; it counts once.
    once = made.groupBy("what", "value", "text_key").agg(F.when(F.col("what") == "head", F.max("n")).otherwise(F.sum("n")).alias("n"))
    return once.groupBy("what", "value").agg(F.sum("n").alias("n"))


def mark_cut(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each text with ``cut``, ``evidence`` (broken, omitted, open, unterminated, limit, or null) and ``at_limit``."""
    ends = checkpoint(line_ends(docs, id_col))
    # Bare last lines that recur are few; they are compared with the heads of lines that go on.
    total = ends.agg(F.count_distinct("text_key").alias("texts"))
    times = ends.where("kind = 'bare'").groupBy("last_line", "head").agg(F.count_distinct("text_key").alias("times"))
    whole = checkpoint(times.join(F.broadcast(total)).where(F.col("times") >= F.greatest(F.lit(LEAST_TIMES), F.col("texts") * LEAST_SHARE)))
    counts = checkpoint(line_counts(docs, {r["head"] for r in whole.select("head").distinct().collect()}))
    heads = counts.where("what = 'head'").select(F.col("value").alias("head"), F.col("n").alias("heads"))
    by = lambda what: F.sum(F.when(F.col("what") == what, F.col("n")))
    base = (
        counts.where("what <> 'head'").groupBy("value").agg(by("terminated").alias("t"), by("open").alias("o"), by("paragraph").alias("p"))
        .select(F.col("value").alias("source"), (F.col("t") / F.col("p")).alias("terminated_share"), (F.col("o") / F.col("p")).alias("open_share"))
    )
    once = ends.select("source", "chars", "text_key", F.col("kind").isin("bare", "broken", "omitted").alias("unfinished")).distinct()
    lengths = once.groupBy("source", "chars").agg(F.count_if("unfinished").alias("n"), F.count("*").alias("texts"))
    limits = lengths.where((F.col("n") >= LEAST_AT_LIMIT) & (F.col("n") >= LIMIT_SHARE * F.col("texts"))).select("source", "chars", F.lit(True).alias("at_limit"))
    usual = (
        whole.join(heads, "head", "left")
        .where(F.col("times") * 2 > F.coalesce("heads", F.lit(0)) - F.when(F.size(F.split("head", " ")) < HEAD_WORDS, F.col("times")).otherwise(F.lit(0)))
        .select("last_line", F.lit(True).alias("usual_end"))
    )
    judged = ends.join(base, "source", "left").join(usual, "last_line", "left").join(limits, ["source", "chars"], "left").fillna({"at_limit": False})
    bare = (F.col("kind") == "bare") & F.col("usual_end").isNull()
    has_ends = F.coalesce("terminated_share", F.lit(1.0)) >= LEAST_TERMINATED
    opened = ((F.col("kind") == "bare") & (F.col("left_open") > SHUT)) | ((F.col("kind") == "terminated") & (F.col("left_open") == PAIR) & (F.coalesce("open_share", F.lit(0.0)) <= MOST_OPEN))
    evidence = F.when(F.col("kind").isin("broken", "omitted"), F.col("kind")).when(opened, "open").when(bare & has_ends, "unterminated").when(bare & F.col("at_limit"), "limit")
    return judged.select(id_col, "source", "chars", "at_limit", evidence.alias("evidence"), evidence.isNotNull().alias("cut"))


def cut_rates(marked: DataFrame) -> DataFrame:
    """How often each source cuts, and how many of its texts end at a field limit."""
    return marked.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("bigint")).alias("cut_texts"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_rate"), F.count_if("at_limit").alias("at_limit"))
