"""Problem 8: documents that hold passages of evaluation items.

Each item is cut into all its windows of a third and of a sixth of its length, each document into all its windows of
those sizes. A window's SimHash has 64 bits in 9 blocks; two hashes within a Hamming distance of 7 agree in at least two
blocks, so probing the 36 tables on pairs of blocks finds every pair within that radius. The weights are whole numbers, so
equal windows have equal hashes wherever they stand. A candidate (document, item) is verified with the exact
weighted-shingle similarity (word pairs, weighed by rarity over all documents) of the passage and by the number of the
item's words that the passage holds in their order, by local alignment.

Every window within the radius is found, but for those of whose weight less than LEAST_KNOWN lies in item words, which are
left out before hashing; what such a window could find, windows of the passage around it find (tested against probing
them all). A passage of about half an item with a word changed in every eight or fewer can have no window within the
radius. Rarity is counted once for all items; then items are taken in blocks of ITEM_BLOCK, each against all documents, so
what is sent to the tasks is bounded however many items there are.

Null and empty documents and items match nothing; repeated rows give repeated results; extra columns are left out.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Memo, count_keys, map_rows

WORD = re.compile(r"\w+")
#: Characters that have another form of the same letter, and those that print nothing.
FORMS = re.compile("[\u0300-\u036f\uff01-\uffef\ufb00-\ufb06\u00ad\u200b-\u200f\u2060\ufeff]")
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: Sizes of windows in words; an item is cut by the largest ones up to these parts of its length, of LEAST_SIZE words at least.
SIZES = (4, 6, 8, 11, 16, 22, 32, 45, 64, 90, 128)
PARTS, LEAST_SIZE = (3, 6), 8
RADIUS = 7
#: Blocks of the hash as (shift, bits), and all pairs of them.
BLOCKS = (*((7 * k, 7) for k in range(8)), (56, 8))
PAIRS = tuple(itertools.combinations(range(len(BLOCKS)), 2))
#: Steps of a weight of 1, windows that are summed at once, and pairs of windows that are compared at once.
UNITS, RUN, AT_ONCE = 256, 20_000, 2_000_000
LEAST_KNOWN = 0.6
#: Share of the item's words that the passage must hold, and the least weighted similarity of the aligned passage.
LEAST_SHARE, LEAST_SIMILARITY = 0.5, 0.5
ITEM_BLOCK = 4000
#: Texts that are probed together.
TEXTS = 500
POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def words_of(text: str | None) -> list[str]:
    """Words in lower case without accents of form; marks and spacing do not matter."""
    if not text:
        return []
    if FORMS.search(text):
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.lower().replace("ё", "е"))


def signs(word: str) -> np.ndarray:
    """64 signs that stand for a word."""
    bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(word)], np.uint64).view(np.uint8))
    return bits.astype(np.int64) * 2 - 1


def simhash(vectors: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every window of ``size`` rows; vectors: signs times whole weights, a row a word."""
    total = np.vstack([np.zeros((1, 64), np.int64), np.cumsum(vectors, 0)])
    return np.packbits(total[size:] - total[:-size] > 0, axis=1).view(np.uint64).ravel()


def pair_keys(hashes: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    """The bits of two blocks as one number."""
    (s, n), (t, m) = BLOCKS[pair[0]], BLOCKS[pair[1]]
    return (((hashes >> np.uint64(s)) & np.uint64((1 << n) - 1)) | (((hashes >> np.uint64(t)) & np.uint64((1 << m) - 1)) << np.uint64(n))).astype(np.uint16)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(POP[((x >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int16) for s in (0, 16, 32, 48))


_UNIT = 1 << 20


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score and matches in one number, item end, passage end) of the best local alignment; a match gains 1, an edit costs 1."""
    slope = np.arange(len(passage) + 1, dtype=np.int64) * _UNIT
    above = np.zeros(len(passage) + 1, np.int64)
    top = (0, 0, 0)
    for i, word in enumerate(item, 1):
        row = np.maximum(above - _UNIT, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, _UNIT + 1, -_UNIT))
        row = np.maximum.accumulate(row + slope) - slope  # an added word costs as much at any distance
        row[row < _UNIT] = 0
        k = int(row.argmax())
        if row[k] > top[0]:
            top = (int(row[k]), i, k)
        above = row
    return top


def align(item: np.ndarray, passage: np.ndarray, least: float = 0.0) -> tuple[int, int, int]:
    """(item words held in order, start and end in the passage) of the best local alignment; no places if it holds fewer than ``least``."""
    value, i, k = _best(item, passage)
    if not value or value % _UNIT < least:
        return value % _UNIT, 0, 0
    _, _, back = _best(item[:i][::-1], passage[:k][::-1])
    return value % _UNIT, k - back, k


class ItemIndex:
    """Tables on pairs of blocks over the windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rarity: dict[str, float]) -> None:
        self.rarity = rarity
        self.words = {key: words_of(text) for key, text in items}
        self.words = {key: own for key, own in self.words.items() if own}
        self.own = {w: self.units(w) for own in self.words.values() for w in own}
        self.vectors = {w: signs(w) * n for w, n in self.own.items()}
        self.foreign = round(self.rarity[""] * UNITS)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        by_size = defaultdict(list)
        for key, own in self.words.items():
            for size in {max([s for s in SIZES if s <= len(own) / part and (s >= LEAST_SIZE or part == PARTS[0])], default=min(len(own), SIZES[0]) if part == PARTS[0] else 0) for part in PARTS} - {0}:
                by_size[size].append(key)
        for size, keys in by_size.items():
            hashes = [simhash(np.stack([self.vectors[w] for w in self.words[k]]), size) for k in keys]
            owner = np.repeat(np.array(keys, np.int64), [len(h) for h in hashes])
            flat = np.concatenate(hashes)
            tables = []
            for pair in PAIRS:
                own = pair_keys(flat, pair)
                order = np.argsort(own, kind="stable").astype(np.int32)
                tables.append((own[order], order))
            self.sizes[size] = (flat, owner, tables)
        self.keys = np.array(sorted(self.words), np.int64)

    def weight(self, word: str) -> float:
        return self.rarity.get(word, self.rarity[""])

    def units(self, word: str) -> int:
        return max(1, round(self.weight(word) * UNITS))

    def vector(self, word: str) -> np.ndarray:
        found = self.vectors.get(word)
        return self.other[word] if found is None else found

    def windows(self, texts: list[list[str]], least: float = LEAST_KNOWN) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, texts, positions, hashes) of all windows of which the share ``least`` of the weight lies in item words."""
        words = list(itertools.chain.from_iterable(texts))
        lengths = np.array([len(t) for t in texts])
        begins = np.concatenate([[0], np.cumsum(lengths)])
        owner = np.repeat(np.arange(len(texts)), lengths)
        known = np.fromiter(map(self.own.get, words, itertools.repeat(0)), np.int64, len(words))
        run = np.concatenate([[0], np.cumsum(known)])
        other = np.concatenate([[0], np.cumsum((known == 0) * self.foreign)])
        for size in self.sizes:
            if len(words) < size:
                continue
            held, rest = run[size:] - run[:-size], other[size:] - other[:-size]
            inside = owner[: len(words) - size + 1] == owner[size - 1 :]
            dense = np.flatnonzero(inside & (held * (1 - least) >= rest * least))
            if not len(dense):
                continue
            # Windows near one another are summed together, RUN of them at most.
            cuts = np.flatnonzero(np.diff(dense) > size) + 1
            made = []
            for part in (p[k : k + RUN] for p in np.split(dense, cuts) for k in range(0, len(p), RUN)):
                a, b = int(part[0]), int(part[-1])
                made.append(simhash(np.stack([self.vector(w) for w in words[a : b + size]]), size)[part - a])
            yield size, owner[dense], dense - begins[owner[dense]], np.concatenate(made)

    def near(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes``, items): all pairs of a hash and an item with a window of this size within the radius."""
        flat, owner, tables = self.sizes[size]
        got: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, AT_ONCE * (1 << 14) // (len(flat) + (1 << 14)))
        for at in range(0, len(hashes), step):
            own = hashes[at : at + step]
            for pair, (keys, order) in zip(PAIRS, tables, strict=True):
                wanted = pair_keys(own, pair)
                low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                n = high - low
                if not n.any():
                    continue
                place = np.repeat(np.arange(len(own)), n)
                first = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                window = order[first + np.arange(len(place))]
                close = distance(own[place], flat[window]) <= RADIUS
                got.append((place[close] + at, owner[window[close]]))
        places, items = (np.concatenate(x) for x in zip(*got, strict=True))
        both = np.unique(places * len(self.keys) + np.searchsorted(self.keys, items))
        return both // len(self.keys), self.keys[both % len(self.keys)]

    def candidates(self, texts: list[list[str]]) -> list[dict[int, list[int]]]:
        """For each text the items of which a window is within the radius of one of its own, with the positions; all texts are probed at once."""
        out: list[dict[int, list[int]]] = [defaultdict(list) for _ in texts]
        for size, text, at, hashes in self.windows(texts):
            for i, key in zip(*(x.tolist() for x in self.near(size, hashes)), strict=True):
                out[int(text[i])][key].append(int(at[i]))
        return out

    def verified(self, words: list[str], found: dict[int, list[int]]) -> Iterator[tuple[int, int, int, float]]:
        """(item, its words, those held in order, weighted similarity) of the candidates that the text holds at least half of."""
        for key, places in found.items():
            item = self.words[key]
            number = {w: i for i, w in enumerate(dict.fromkeys(item))}
            codes = np.array([number[w] for w in item])
            best, done = (0, 0.0), -1
            # Candidate windows are taken from left to right; each look covers all those within the item's length.
            for p in sorted(places):
                if p <= done:
                    continue
                done = p + len(item)
                part = words[max(0, p - len(item)) : p + 3 * len(item)]
                own = np.array([number.get(w, -1) for w in part])
                if np.count_nonzero(own >= 0) < LEAST_SHARE * len(item):
                    continue  # no passage of it can hold half of the item
                held, start, end = align(codes, own, LEAST_SHARE * len(item))
                best = max(best, (held, self.similarity(item, part[start:end])))
            held, similar = best
            if held >= LEAST_SHARE * len(item) and similar >= LEAST_SIMILARITY:
                yield key, len(item), held, round(similar, 6)

    def similarity(self, item: list[str], passage: list[str]) -> float:
        """Weight of the passage's word pairs that the item has, as a share of the passage's: 1 for a verbatim piece."""
        own, other = Counter(zip(item, item[1:])), Counter(zip(passage, passage[1:]))
        weigh = lambda pairs: sum(n * (self.weight(a) + self.weight(b)) for (a, b), n in pairs.items())
        total = weigh(other)
        return weigh(own & other) / total if total else 0.0


def rarity_of(docs: DataFrame, words: set[str]) -> dict[str, float]:
    """log(texts / texts with the word) over all documents, for the items' words; "" stands for any other word."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def make():  # noqa: ANN202
        wanted = sent.value

        def add(rows: Iterator[tuple], counts: Counter) -> None:
            for (text,) in rows:
                counts.update((w,) for w in wanted.intersection(words_of(text)))
                counts[("",)] += 1

        return add

    counts = {r.word: r.n for r in count_keys(docs.select("text").where("text is not null"), make, ["word"]).collect()}  # no more than the items' words
    texts = counts.pop("", 0) + 1
    return {"": math.log(texts + 1.0)} | {w: math.log(1 + texts / (1 + counts.get(w, 0))) for w in words}


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, item_words, held_words, similarity) of every document that holds at least half of an item."""
    spark = docs.sparkSession
    listed = items.select("item_id", "text").where("text is not null and trim(text) <> ''").dropDuplicates(["item_id"])
    parts: list[DataFrame] = []
    last, text = None, docs.select("doc_id", "text").where("text is not null")
    number = pa.int64()
    every = {w for r in listed.select("text").toLocalIterator() for w in words_of(r.text)}  # the words of the stated query set
    rarity = rarity_of(text, every) if every else {}
    while True:  # a block of items at a time, by id
        block = listed if last is None else listed.where(F.col("item_id") > last)
        rows = block.orderBy("item_id").limit(ITEM_BLOCK).collect()
        if not rows:
            break
        last = rows[-1].item_id
        own = [(r.item_id, r.text) for r in rows]
        words = {w for _, t in own for w in words_of(t)}
        sent = spark.sparkContext.broadcast(ItemIndex(own, {w: v for w, v in rarity.items() if w in words or not w}))

        def make(sent=sent):  # noqa: ANN001, ANN202
            index = sent.value
            index.other = Memo(lambda w: signs(w) * index.foreign, 50_000)

            def step(rows: Iterator[tuple]) -> Iterable[tuple]:
                keys, bodies = zip(*rows, strict=True)
                for k in range(0, len(keys), TEXTS):
                    texts = [words_of(body) for body in bodies[k : k + TEXTS]]
                    for doc_id, own, found in zip(keys[k : k + TEXTS], texts, index.candidates(texts), strict=True):
                        for key, size, held, similar in index.verified(own, found):
                            yield key, doc_id, size, held, similar

            return step

        parts.append(map_rows(text, make, "item_id bigint, doc_id bigint, item_words bigint, held_words bigint, similarity double", [("item_id", number), ("doc_id", number), ("item_words", number), ("held_words", number), ("similarity", pa.float64())]))
        if len(rows) < ITEM_BLOCK:
            break
    if not parts:
        return spark.createDataFrame([], "item_id bigint, doc_id bigint, item_words bigint, held_words bigint, similarity double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
