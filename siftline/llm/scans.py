"""Problem 1: noise of scanned pages, by a noisy channel decoded with Viterbi.

The language model is word unigrams and bigrams (numbers as one word) over all texts that were not scanned, with letter
bigrams for other words. The channel's confusions of characters are learned: pairs of one or two characters that turn
many different unknown words of the scanned texts into words of the vocabulary, much more often than words of the
vocabulary are turned into one another; a few that hold for every typeface are always in. Their probabilities are
estimated by expectation-maximisation over the rare words of the scanned texts. Each word of a line gets the candidates that reversing
one or two confusions gives; a Viterbi pass over the line picks the likeliest sequence. Words split at a line end are
joined where the joined word is likelier than the compound with a hyphen. A line at the top or bottom of a page that
comes back on other pages of its file is a running header; keys are compared with confusable characters folded, and
counted by file and key with partial aggregates, so a file of any size is never gathered. Page numbers are recognised by
shape at those places.

Null and empty texts have no noise. Repeated deliveries of a block count once. Extra columns are left out.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Memo, count_keys, map_rows
from siftline.session import checkpoint

METHODS = ("ocr_extractor", "pdf_text_extractor")
#: Misreadings of every typeface, digits for letters and letters run together: what is read and what it was; fixed values.
ALWAYS = (
    ("0", "о"), ("0", "o"), ("1", "l"), ("1", "i"), ("!", "l"), ("!", "i"), ("|", "l"), ("3", "з"), ("4", "ч"), ("5", "s"), ("6", "б"), ("8", "в"), ("9", "g"),
    ("rn", "m"), ("rn", "м"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ii", "u"), ("ьl", "ы"), (">к", "ж"), ("lo", "ю"),
)
#: A confusion is learned if it explains so many words and so many different ones, no one of them more than half, and so many times more unknown words (as a share of them) than words of the vocabulary.
LEAST_SEEN, LEAST_DIFFERENT, TIMES = 8, 5, 10
#: Letters of words from which confusions are learned, at least, and the share of a confusion's places that are not at a word's end, as endings are.
WHOLE, INSIDE = 4, 0.3
#: Words and word pairs from this share on make the model, which bounds it.
SHARE = 1e-6
#: Log probability that a word is none of the vocabulary.
OTHER = math.log(0.02)
HYPHENS = "-‐¬­"
SPLIT = re.compile(rf"([^\W_]+(?:-[^\W_]+)*)([{HYPHENS}])[ \t]*$")
NEXT = re.compile(r"^[ \t]*([^\W_]+)")
TOKEN = re.compile(r"[^\s.,;:«»()\"?/|—–\[\]{}=<>]+(?:>к[^\s.,;:«»()\"?/|—–\[\]]*)*|>к[^\s.,;:«»()\"?/|—–\[\]]*")
#: Characters that no misread letter stands among.
MARKS = frozenset("-‐¬­'’\n")
#: Characters of a running header, at least.
LEAST_HEADER = 5
#: Addresses and codes are read as they are.
CODE = re.compile(r"\S*@\S*|\S+[\[(](?:at|dot)\S*|(?:[\w+-]+\.)+(?:[A-Za-z]{2,})\b|(?<!\w)[\w.+-]+\s*(?:@|\[at\]|\(собака\))\s*\n?\s*[\w-]+(?:\s*(?:\.|\[dot\])\s*[\w-]+)*", re.I)
CODE_SIGN = re.compile(r"@|[\[(<{]\s*(?:at|собака)|[A-Za-z0-9-]\.[A-Za-z]")
NUMBER = re.compile(r"\d\d")
#: Words for a page, before its number: fixed values.
PAGE_WORDS = ("лист", "стр", "страница", "page", "p", "sheet", "seite", "s", "strana", "str", "аркуш", "blatt", "list", "сторінка")
OF_WORDS = ("из", "of", "von", "z", "із")
TAIL = re.compile(r"(?:\s{2,}|\t|\s*[|·—–]\s*)[-—–\[(]*(\d{1,4})[-—–\])]*\s*$")
ONE_TAIL = re.compile(r"\s(\d{1,4})\s*$")


DIGIT = re.compile(r"\d")
#: What may stand around a page number, and the most characters between that its pattern has, without blanks.
AROUND_PAGE, MOST_PAGE = " \t-—–[(|])", 2 + 1 + 2 * 4 + max(map(len, PAGE_WORDS)) + max(map(len, OF_WORDS))


class Folding:
    """Lines with the characters that are confused as one, and what is a page number under it."""

    def __init__(self, confusions: Iterable[tuple[str, str]]) -> None:
        top: dict[str, str] = {}

        def find(c: str) -> str:
            while top.get(c, c) != c:
                c = top[c]
            return c

        for a, b in confusions:
            if len(a) == len(b) == 1:
                low, high = sorted((find(a), find(b)))
                top[high] = low
        self.table = {ord(c): find(c) for c in top if find(c) != c}
        self.wide = sorted(((a, b) for a, b in confusions if len(a) > len(b) == 1), key=lambda x: (-len(x[0]), x))
        digit = "[" + "".join(sorted({re.escape(self.fold(c)) for c in "0123456789"})) + "]{1,4}"
        either = lambda words: "|".join(sorted({re.escape(self.fold(w)) for w in words}, key=lambda w: (-len(w), w)))
        self.page = re.compile(rf"^[\s\-—–\[(|]*(?:(?:{either(PAGE_WORDS)})\.?\s*№?\s*)?{digit}(?:\s*(?:/|{either(OF_WORDS)})\s*{digit})?[\s\-—–\])|]*$")

    def fold(self, line: str) -> str:
        """A line in lower case with confusable characters as one."""
        out = re.sub(r"\s+", " ", line.lower()).strip()
        for a, b in self.wide:
            out = out.replace(a, b)
        return out.translate(self.table)

    def is_page(self, line: str) -> bool:
        """Whether a line is a page number, alone or with a word for it."""
        if not DIGIT.search(line) or (len(line) > MOST_PAGE and len("".join(line.strip(AROUND_PAGE).split())) > MOST_PAGE):
            return False
        return self.page.match(self.fold(line)) is not None


def words_of(text: str) -> list[str]:
    """Lower-case words; a hyphen inside belongs to the word and numbers are one word."""
    return ["#" if w.isdigit() else w for w in re.findall(r"[^\W_]+(?:[-’'][^\W_]+)*", text.lower())]


def word_counts(blocks: DataFrame) -> DataFrame:
    """(kind, a, b, n): words and neighbours of texts that were not scanned, and words of those that were."""

    def make():  # noqa: ANN202
        def add(rows: Iterator[tuple], counts: Counter) -> None:
            texts: dict[bool, list[str]] = {True: [], False: []}
            for scanned, text in rows:
                texts[scanned].append(text)
            single: Counter = Counter()
            pairs: Counter = Counter()
            for text in texts[False]:
                clean = words_of(text)
                single.update(clean)
                pairs.update(zip(clean, clean[1:]))
            for w, n in single.items():
                counts["word", w, ""] += n
            for (a, b), n in pairs.items():
                counts["pair", a, b] += n
            for w, n in Counter(TOKEN.findall("\n".join(texts[True]).lower())).items():
                counts["scan", w, ""] += n

        return add

    chosen = blocks.where("text is not null and text <> ''").select(F.coalesce(F.col("extraction_method").isin(*METHODS), F.lit(False)).alias("scanned"), "text")
    return count_keys(chosen, make, ["kind", "a", "b"])


class Channel:
    """The language model and the channel."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], scanned: dict[str, int]) -> None:
        self.total = sum(words.values()) or 1
        self.words, self.pairs = words, pairs
        letters, firsts = Counter(), Counter()
        for word, n in words.items():
            if word != "#":
                weight = math.ceil(math.sqrt(n))
                for x, y in zip(f"^{word}", f"{word}$"):
                    letters[x, y] += weight
                    firsts[x] += weight
        self.letters = {k: math.log(n / firsts[k[0]]) for k, n in letters.items()}
        self.longest = max(map(len, words), default=0)
        self.confusions = tuple(sorted({*ALWAYS, *self._confusions(scanned)}))
        self.folding = Folding(self.confusions)
        self.rates = dict.fromkeys(self.confusions, math.log(1e-3))
        for _ in range(3):
            self._learn(scanned)

    def _confusions(self, scanned: dict[str, int]) -> list[tuple[str, str]]:
        """Pairs of one or two characters by which unknown scanned words differ from words of the vocabulary."""
        holes: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for word, n in self.words.items():
            if len(word) >= WHOLE:
                for size in (1, 2):
                    for i in range(len(word) - size + 1):
                        holes.setdefault((word[:i], word[i + size :]), []).append((word[i : i + size], n))

        def neighbours(word: str) -> Iterator[tuple[str, str, int, bool]]:
            for size in (1, 2):
                for i in range(len(word) - size + 1):
                    a = word[i : i + size]
                    if MARKS.isdisjoint(a):
                        for b, n in holes.get((word[:i], word[i + size :]), ()):
                            if a != b and b.isalpha() and size + len(b) < 4:
                                yield a, b, n, i + size < len(word) - 1

        seen: Counter = Counter()
        unknown = 0
        inside: Counter = Counter()
        different: dict[tuple[str, str], Counter] = {}
        for word, n in scanned.items():
            if word not in self.words and WHOLE <= len(word) <= self.longest + 1 and not NUMBER.search(word):
                # What is misread now and then is read right much more often; names that differ in a letter are about as frequent.
                found = [x for x in neighbours(word) if x[2] >= TIMES * n]
                unknown += 1
                mass = sum(m for _, _, m, _ in found)
                for a, b, m, within in found:
                    seen[a, b] += n * m / mass
                    inside[a, b] += within * n * m / mass
                    different.setdefault((a, b), Counter())[word] += n * m / mass
        likely = {c for c, n in seen.items() if n >= LEAST_SEEN and len(different[c]) >= LEAST_DIFFERENT and max(different[c].values()) <= 0.5 * n and inside[c] >= INSIDE * n}
        usual: Counter = Counter()
        if likely:
            for word in self.words:
                if len(word) >= WHOLE:
                    usual.update((a, b) for a, b, *_ in neighbours(word) if (a, b) in likely)
        # Two letters that words often hold are themselves; their likeness to one letter is left to ALWAYS.
        own: Counter = Counter(w[i : i + 2] for w in self.words for i in range(len(w) - 1))
        # Different words are compared with different words, in shares of all: names made of syllables are neighbours of one another everywhere.
        often = lambda c: len(different[c]) * len(self.words) >= TIMES * usual[c] * unknown
        return [c for c in likely if often(c) and own[c[0]] * TIMES <= len(different[c])]

    def _learn(self, scanned: dict[str, int]) -> None:
        """One step of expectation-maximisation of the confusions' rates over the scanned words."""
        got: Counter = Counter()
        chances: Counter = Counter()
        for word, n in scanned.items():
            for c in {b for _, b in self.confusions if b in word}:
                chances[c] += n * word.count(c)
            base = self.alone(word)
            if base > OTHER - 3 or len(word) > self.longest + 3:
                continue
            found = [(used, self.alone(w) + cost) for w, cost, used in self._reversed(word) if w in self.words]
            found = [(used, s) for used, s in found if s > base]
            if found:
                top = max(s for _, s in found)
                mass = sum(math.exp(s - top) for _, s in found)
                for used, s in found:
                    for c in used:
                        got[c] += n * math.exp(s - top) / mass
        self.rates = {c: math.log((got[c] + 0.5) / (chances[c[1]] + got[c] + 5000)) for c in self.confusions}

    def alone(self, word: str) -> float:
        """Log probability of a word by itself."""
        n = self.words.get(word)
        if n:
            return math.log(n / self.total)
        return OTHER + sum(self.letters.get(k, -9.0) for k in zip(f"^{word}", f"{word}$"))

    def after(self, a: str, b: str, b_alone: float) -> float:
        """Log probability of ``b`` behind ``a``."""
        n, total = self.pairs.get((a, b)), self.words.get(a, 0)
        return max(b_alone - 0.7, math.log(0.5 * n / total) if n and total else -99.0)

    def _reversed(self, word: str) -> Iterator[tuple[str, float, tuple]]:
        """Words that one or two confusions may have turned into this one, with the log cost."""
        places = []
        for c in self.confusions:
            at = word.find(c[0])
            while at >= 0:
                places.append((at, c))
                at = word.find(c[0], at + 1)
        for at, c in places:
            yield word[:at] + c[1] + word[at + len(c[0]) :], self.rates[c], (c,)
        if any(word[:at] + c[1] + word[at + len(c[0]) :] in self.words for at, c in places):
            return  # two confusions in a word are looked for only where one does not explain it
        for (i, c), (k, d) in itertools.combinations(sorted(places, key=lambda x: x[0]), 2):
            if i + len(c[0]) <= k:
                yield word[:i] + c[1] + word[i + len(c[0]) : k] + d[1] + word[k + len(d[0]) :], self.rates[c] + self.rates[d], (c, d)
        # A sign that no letter looks like (a digit in a word) may stand three times.
        marks = [(at, c) for at, c in places if c[0] in "0134569!"]
        if len(marks) > 2:
            one = dict(reversed(marks))
            made = "".join(one[i][1] if i in one else x for i, x in enumerate(word))
            yield made, sum(self.rates[c] for c in one.values()), tuple(one.values())

    def candidates(self, word: str) -> list[tuple[str, float, float]]:
        """(reading, channel cost, log probability alone) of a lower-case word; the first is the word as it stands."""
        own = self.alone("#" if word.isdigit() else word)
        out = [(word, 0.0, own)]
        if self.words.get(word, 0) >= self.total * 2e-5 and len(word) > 2 or len(word) > self.longest + 3:
            return out  # confusions make no word so much shorter
        if word.isdigit() and len(word) > 1 or NUMBER.search(word):
            return out  # a number, alone or written together with words
        best: dict[str, float] = {}
        for made, cost, _ in self._reversed(word):
            if made.isdigit():
                continue
            # Letters next to digits are no word; a reading outside the vocabulary must at least be of letters.
            if made in self.words or (len(word) > 2 and made.isalpha() and not word.isalpha()):
                best[made] = max(best.get(made, -99.0), cost)
        for made, cost in best.items():
            alone = self.alone(made)
            if alone + cost > own - 8:
                out.append((made, cost, alone))
        return out

    def decode(self, words: list[str]) -> list[str]:
        """Viterbi over the words of a line; only words with more than one reading branch."""
        lists = [self.known[w] for w in words]
        if all(len(x) == 1 for x in lists):
            return words
        state: list[tuple[float, str, tuple]] = [(0.0, "", ())]
        for options in lists:
            state = [
                max(((s + cost + (self.after(a, key, alone) if a else alone), key, (w, path)) for s, a, path in state), key=lambda x: x[0])
                for w, cost, alone in options
                for key in ("#" if w.isdigit() else w,)
            ]
        best = max(state, key=lambda x: x[0])
        out, path = [], best[2]
        while path:
            out.append(path[0])
            path = path[1]
        return out[::-1]

    def start(self) -> None:
        self.known = Memo(self.candidates, 300_000)

    def is_split(self, a: str, mark: str, b: str) -> bool:
        """Whether a word was split at a line end between ``a`` and ``b`` by a mark that is not part of it."""
        if not a[-1].isalpha() or not b[0].isalpha():
            return False
        if mark in "¬­":
            return True
        if b[0].isupper() and not a.isupper():
            return False
        a, b = a.lower(), b.lower()
        joined, compound = self.words.get(a + b, 0), max(self.words.get(f"{a}-{b}", 0), self.words.get(f"{a.rpartition('-')[2]}-{b}", 0))
        if joined or compound:
            return joined >= compound
        if "-" in a and f"{a}-{b}".count("-") > 1 and self.words.get(a.rpartition("-")[2]) and self.words.get(b):
            return False
        fixed = max((w for w, *_ in self.known[a + b]), key=lambda w: self.words.get(w, 0))
        if self.words.get(fixed):
            return True
        fixed = [w for w, *_ in self.known[f"{a}-{b}"] if self.words.get(w)]
        return not fixed and not (self.words.get(a, 0) > 30 and self.words.get(b, 0) > 30)

    def read(self, text: str) -> tuple[list[str], set[str], list[bool]]:
        """(repaired lines, defects, whether each line is joined to the next without its mark)."""
        lines = text.split("\n")
        defects: set[str] = set()
        joins = [False] * len(lines)
        masked = CODE.sub(lambda m: re.sub(r"\S", " ", m[0]), text).split("\n") if CODE_SIGN.search(text) else lines
        heads: dict[int, str] = {}
        rests: dict[int, int] = {}  # where a split word goes on
        for k in range(len(lines) - 1):
            m = SPLIT.search(masked[k]) if masked[k].rstrip()[-1:] in HYPHENS and masked[k].strip() else None
            if not m:
                continue
            on = next((j for j in range(k + 1, len(lines)) if lines[j].strip() and not self.folding.is_page(lines[j])), None)
            n = NEXT.match(masked[on]) if on is not None else None
            if n and n[1][0].isupper() and not m[1].isupper():
                # The top of a new page stands between the parts.
                on = next((j for j in range(on + 1, len(lines)) if lines[j].strip() and not self.folding.is_page(lines[j])), None)
                n = NEXT.match(masked[on]) if on is not None else None
                n = n if n and n[1][0].islower() and not self.words.get(m[1].lower()) else None
            if n and on not in rests.values() and self.is_split(m[1], m[2], n[1]):
                defects.add("line_hyphen")
                joins[k], heads[k], rests[k] = True, n[1], on
        begun = {on: k for k, on in rests.items()}
        out = []
        for k, (line, mask) in enumerate(zip(lines, masked, strict=True)):
            mask = line if len(mask) != len(line) else mask
            if joins[k]:
                # The split word is read whole where it begins, and left out where it goes on.
                end = SPLIT.search(mask)
                mask = mask[: end.end(1)] + heads[k]
            skip = len(heads[begun[k]]) + NEXT.match(lines[k]).start(1) if k in begun else 0
            spans = [m.span() for m in TOKEN.finditer(mask, skip)]
            found = []
            for a, b in spans:
                while b > a and mask[b - 1] in "-‐¬­'’!":
                    b -= 1
                if a < b:
                    found.append((a, b))
            words = [mask[a:b].lower() for a, b in found]
            read = self.decode(words)
            base = line if not joins[k] else line[: SPLIT.search(masked[k]).end(1)] + heads[k]
            if read != words and len(base) == len(mask):
                parts, done = [], 0
                for (a, b), w, r in zip(found, words, read, strict=True):
                    if w != r:
                        defects.add("misread_char")
                        parts += [base[done:a], _cased(r, base[a:b])]
                        done = b
                base = "".join([*parts, base[done:]])
            out.append(base[skip:] if skip else base)
        return out, defects, joins


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() or (like[:1].isdigit() and letters[:1] and letters[0].isupper()) else word


def fit(blocks: DataFrame) -> Channel:
    """Exact counts over all blocks; those from SHARE on make the model (at most 1 / SHARE entries of each kind)."""
    counts = word_counts(blocks).persist()
    total = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    kept: dict[str, dict] = {"word": {}, "pair": {}, "scan": {}}
    for kind in kept:
        least = max(2, SHARE * total.get(kind, 0))
        for r in counts.where((F.col("kind") == kind) & (F.col("n") >= least)).collect():
            kept[kind][(r.a, r.b) if kind == "pair" else r.a] = r.n
    counts.unpersist()
    return Channel(kept["word"] or kept["scan"], kept["pair"], kept["scan"])


def edge_lines(text: str, folding: Folding) -> tuple[list[int], list[tuple[int, str]]]:
    """(lines that are page numbers, lines that may be running headers with a mark of their kind)."""
    lines = text.split("\n")
    filled = [k for k, x in enumerate(lines) if x.strip()]
    pages = [k for k in filled if folding.is_page(lines[k])]
    rest = [k for k in filled if k not in pages]
    edges = []
    if len(rest) > 1:
        edges.append((rest[0], ""))
        edges.append((rest[-1], ""))
    # Within a text of more than one page: a line that breaks into a sentence or stands next to a page number.
    for a, k, b in zip(rest, rest[1:], rest[2:]):
        line = lines[k].strip()
        if line[:1].isupper() or line[:1].isdigit():
            if b - k > 1 or k - a > 1 or (lines[b].strip()[:1].islower() and lines[a].rstrip()[-1:] not in ".!?:;»"):
                edges.append((k, ""))
    return pages, [(k, side) for k, side in edges if not re.search(r"[.!?;,]\s*$", lines[k]) and len(lines[k].strip()) >= LEAST_HEADER]


def _key(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def headers(scans: DataFrame, folding: Folding) -> DataFrame:
    """(block_id, line_no, defect) of running headers, and of page numbers in them; ``scans``: block_id, file_path, text."""

    def make():  # noqa: ANN202
        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for key, path, text in rows:
                lines = text.split("\n")
                place = _key(path)
                for k, side in edge_lines(text, folding)[1]:
                    line = lines[k]
                    tail = TAIL.search(line) or ONE_TAIL.search(line)
                    if folding.is_page(line):
                        continue
                    yield place, _key(side + folding.fold(line)), key, k, None
                    if tail and len(line[: tail.start()].strip()) >= LEAST_HEADER:
                        yield place, _key(side + folding.fold(line[: tail.start()])), key, k, tail[1]

        return step

    text, number = pa.string(), pa.int64()
    # Files and lines as hashes of 64 bits each; the rows are small, read twice and written once.
    made = map_rows(scans.select("block_id", F.coalesce("file_path", F.lit("")), "text"), make, "path bigint, key bigint, block_id bigint, line_no bigint, page string", [("path", number), ("key", number), ("block_id", number), ("line_no", number), ("page", text)])
    edges = checkpoint(made).distinct()
    # Plain and numbered lines of one key are counted apart: titles may end in a number that stays.
    counted = edges.groupBy("path", "key", F.col("page").isNotNull().alias("numbered")).agg(F.count_distinct("block_id").alias("blocks"), F.count_distinct("line_no").alias("lines"), F.count_distinct("page").alias("pages"))
    again = counted.where("(blocks > 1 or lines > 1) and (not numbered or pages > 1)")
    found = edges.withColumn("numbered", F.col("page").isNotNull()).join(again, ["path", "key", "numbered"])
    return found.select("block_id", "line_no", F.explode(F.when(F.col("numbered"), F.array(F.lit("running_header"), F.lit("page_number"))).otherwise(F.array(F.lit("running_header")))).alias("defect"))


def scans_of(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("extraction_method").isin(*METHODS) & F.col("text").isNotNull() & (F.col("text") != "")).select("block_id", "file_path", "text")


def defects(blocks: DataFrame) -> DataFrame:
    """(block_id, defect): one row for each sort of noise in a block."""
    scans = scans_of(blocks)
    model = fit(blocks)
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def make():  # noqa: ANN202
        channel = sent.value
        channel.start()

        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for key, text in rows:
                found = channel.read(text)[1]
                if edge_lines(text, channel.folding)[0]:
                    found.add("page_number")
                for defect in found:
                    yield key, defect

        return step

    read = map_rows(scans.select("block_id", "text"), make, "block_id bigint, defect string", [("block_id", pa.int64()), ("defect", pa.string())])
    return read.unionByName(headers(scans, model.folding).select("block_id", "defect")).distinct()


def repair(blocks: DataFrame) -> DataFrame:
    """(block_id, clean_text): continuous paragraphs without headers and page numbers, words whole and read right."""
    scans = scans_of(blocks)
    model = fit(blocks)
    sent = blocks.sparkSession.sparkContext.broadcast(model)
    drop = headers(scans, model.folding).groupBy("block_id").agg(F.collect_set("line_no").alias("out"))

    def make():  # noqa: ANN202
        channel = sent.value
        channel.start()

        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for key, text, out in rows:
                lines, _, joins = channel.read(text)
                gone = {*edge_lines(text, channel.folding)[0], *(out or ())}
                yield key, paragraphs([(x, j) for k, (x, j) in enumerate(zip(lines, joins, strict=True)) if k not in gone])

        return step

    return map_rows(scans.join(drop, "block_id", "left").select("block_id", "text", "out"), make, "block_id bigint, clean_text string", [("block_id", pa.int64()), ("clean_text", pa.string())])


def paragraphs(lines: list[tuple[str, bool]]) -> str:
    """Lines flow together; a paragraph ends at a blank line, or behind a full stop in a line shorter than the rest."""
    width = max((len(x) for x, _ in lines), default=0)
    out, now = [], ""
    for line, joined in lines:
        line = line.strip()
        if not line:
            out, now = [*out, now] if now else out, ""
            continue
        # The rest of a split word's line goes on behind the whole word.
        now = f"{now} {line}" if now else line
        if not joined and re.search(r"[.!?…][»”\")]?$", line) and len(line) < 0.8 * width:
            out, now = [*out, now], ""
    return "\n".join([*out, now] if now else out)
