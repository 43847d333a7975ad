"""Problem 5: language of each text and of each segment of a mixed one.

Script ranges narrow the candidates of a word (Cyrillic: ru, uk; Latin: en, de, cs). Word scores come from counts over
all labelled texts, with a character model for words too rare to be counted. A Viterbi pass with a penalty for each
switch labels every word; runs of one label are segments. Texts of about one length advance in step, so the pass costs a
few array operations per word position instead of a loop per text; a very long text is read alone.

Null, empty and wordless texts get no segments and a null language. Texts of which few words are known (garbled ones)
get a language with a low confidence. Repeated rows give repeated results; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import count_keys, map_rows
from siftline.session import checkpoint

LANGS = ("ru", "en", "uk", "de", "cs")
#: Scripts and the languages written in them: fixed values.
CYRILLIC, LATIN = ("ru", "uk"), ("en", "de", "cs")
#: Three-letter codes of the languages (ISO 639-2): fixed values.
CODES = {"rus": "ru", "eng": "en", "ukr": "uk", "deu": "de", "ger": "de", "ces": "cs", "cze": "cs"}
NO_LABEL = ("", "und", "unknown")
WORD = re.compile(r"[^\W\d_]+")
#: Characters that print nothing, which may stand within words, and wide letters with their plain ones.
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
HIDDEN_WORD = re.compile("[^\\W\\d_](?:[\u00ad\u200b-\u200f\u2060\ufeff]*[^\\W\\d_])*")
ODD, WIDE = re.compile("[\uff01-\uff5e]"), {c: chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}
#: Addresses, and what a text with one holds.
SIGN = re.compile(r"@|\[(?:at|dot)|\((?:at|собака)|[a-z0-9]\.[a-z]")
ADDRESS = re.compile(r"[\w.+=:<-]*\s?@\s?[\w.-]+|[\w.+-]+\s*[\[(](?:at|собака)[\])]\s*[\w-]+(?:\s*(?:\.|[\[(](?:dot|точка)[\])])\s*[\w-]+)*|(?<![^\s(\[<,;])(?:[a-z0-9_+-]+\.)+[a-z]{2,}\b")
#: Nats that a switch of language costs, and the most that one word may say.
SWITCH, MOST = 14.0, 5.0
#: Words times texts that advance in step, and texts from which on that is worth it.
CELLS, FEW = 1_000_000, 8
#: Words that a language's longest segment must have to count as part of a mixed text, and the share of known ones.
LEAST_SEGMENT, LEAST_KNOWN = 9, 0.5
#: A word belongs to the model if it makes up at least this share of a language's words, so a language has at most 1e5.
LEAST_SHARE = 1e-5


def label(column):  # noqa: ANN001, ANN201
    """The language that a label names, whatever its spelling; null if it names none of the five or is missing."""
    base = F.lower(F.regexp_extract(F.trim(column), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    names = F.create_map(*(F.lit(x) for pair in [*CODES.items(), *((x, x) for x in LANGS)] for x in pair))
    return F.try_element_at(names, base)


def label_missing(column):  # noqa: ANN001, ANN201
    """Null, empty or a word for not known."""
    return F.coalesce(F.lower(F.trim(column)).isin(*NO_LABEL), F.lit(True))


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all labelled texts; ``labelled`` has lang (one of LANGS) and text."""

    def make():  # noqa: ANN202
        def add(rows: Iterator[tuple], counts: Counter) -> None:
            texts = defaultdict(list)
            for lang, text in rows:
                texts[lang].append(text)
            for lang, own in texts.items():
                for word, n in Counter(WORD.findall("\n".join(own).lower())).items():
                    counts[lang, word] += n

        return add

    return count_keys(labelled.where("lang is not null and text is not null").select("lang", "text"), make, ["lang", "word"])


class LanguageModel:
    """Word and letter scores; small enough to be sent to every task (see LEAST_SHARE)."""

    def __init__(self, words: dict[str, dict[str, int]], totals: dict[str, int]) -> None:
        self.words, self.totals = words, totals
        self.pieces = {lang: self._letters(words.get(lang, {})) for lang in LANGS}

    @staticmethod
    def _letters(words: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
        triples, pairs = Counter(), Counter()
        for word, n in words.items():
            n, padded = math.ceil(math.sqrt(n)), f"^{word}$"
            for i in range(len(padded) - 2):
                triples[padded[i : i + 3]] += n
                pairs[padded[i : i + 2]] += n
        return dict(triples), dict(pairs)

    def score(self, word: str) -> tuple[np.ndarray, bool]:
        """(log likelihood of the word in each language, less the best one's and bounded, whether it is known)."""
        cyrillic, latin = any("Ѐ" <= c <= "ӿ" for c in word), any(c.isascii() or "À" <= c <= "ɏ" for c in word)
        fit = CYRILLIC if cyrillic and not latin else LATIN if latin and not cyrillic else ()
        out = np.full(len(LANGS), -MOST if fit else 0.0)
        if not fit:
            return out, False
        known = any(word in self.words.get(lang, ()) for lang in fit)
        own = []
        for lang in fit:
            total = self.totals.get(lang, 0) + 1
            if known:
                own.append(math.log((self.words.get(lang, {}).get(word, 0) + 0.02 * total * LEAST_SHARE) / total))
            else:
                triples, pairs = self.pieces[lang]
                padded = f"^{word}$"
                own.append(0.4 * sum(math.log((triples.get(padded[i : i + 3], 0) + 0.3) / (pairs.get(padded[i : i + 2], 0) + 12)) for i in range(len(padded) - 2)))
        best = max(own)
        for lang, value in zip(fit, own, strict=True):
            out[LANGS.index(lang)] = max(value - best, -MOST if known else -1.5)
        return out, known


def fit(labelled: DataFrame) -> LanguageModel:
    """Counts over all labelled texts; words under LEAST_SHARE are left to the letters."""
    counts = word_counts(labelled).persist()
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.lit(1.0)
    for lang, n in totals.items():
        least = F.when(F.col("lang") == lang, max(3.0, n * LEAST_SHARE)).otherwise(least)
    words: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counts.where(F.col("n") >= least).collect():  # at most 1 / LEAST_SHARE words a language
        words[r.lang][r.word] = r.n
    counts.unpersist()
    return LanguageModel(dict(words), totals)


def viterbi(ids: list[list[int]], table: np.ndarray) -> list[np.ndarray]:
    """The best label of each word of each text; ids: rows of ``table`` (scores by language), a list a text."""
    order = sorted(range(len(ids)), key=lambda k: -len(ids[k]))
    sizes = np.array([len(ids[k]) for k in order])
    steps = int(sizes[0]) if len(sizes) else 0
    alive = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps)]  # texts longer than t
    columns = np.zeros((steps, len(order)), np.int32)
    for c, k in enumerate(order):
        columns[: len(ids[k]), c] = ids[k]
    states = len(LANGS)
    best = np.zeros((len(order), states))
    back = np.zeros((steps, len(order)), np.int8)  # where a switch would come from
    stayed = np.zeros((steps, len(order)), np.uint8)  # a bit a state: it came from itself
    bits = 1 << np.arange(states, dtype=np.uint8)
    for t in range(steps):
        n = alive[t]
        now = best[:n]
        if t:
            top = now.argmax(1)
            jump = now[np.arange(n), top] - SWITCH
            stay = now >= jump[:, None]
            back[t, :n], stayed[t, :n] = top, (stay * bits).sum(1)
            now = np.where(stay, now, jump[:, None])
        best[:n] = now + table[columns[t, :n]]
    path = np.zeros((steps, len(order)), np.int8)
    state = best.argmax(1).astype(np.int8) if len(order) else np.zeros(0, np.int8)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        path[t, :n] = state[:n]
        keep = (stayed[t, :n] >> state[:n].astype(np.uint8)) & 1
        if t:
            state[:n] = np.where(keep, state[:n], back[t, :n])
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(ids)
    for c, k in enumerate(order):
        out[k] = path[: sizes[c], c]
    return out


def viterbi_one(ids: list[int], table: dict[int, list[float]]) -> np.ndarray:
    """The best labels of one long text: the same pass word by word."""
    states = range(len(LANGS))
    best, back = [0.0] * len(LANGS), []
    for t, word in enumerate(ids):
        if t:
            top = max(states, key=best.__getitem__)
            jump = best[top] - SWITCH
            back.append([s if best[s] >= jump else top for s in states])
            best = [b if b >= jump else jump for b in best]
        best = [b + x for b, x in zip(best, table[word], strict=True)]
    out = np.zeros(len(ids), np.int8)
    if ids:
        state = max(states, key=best.__getitem__)
        for t in range(len(ids) - 1, -1, -1):
            out[t] = state
            if t:
                state = back[t - 1][state]
    return out


def in_groups(sizes: list[int]) -> Iterator[list[int]]:
    """Texts of about one length together, so that the longest one of a group times its texts stays within CELLS."""
    group: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if group and sizes[group[0]] * (len(group) + 1) > CELLS:
            yield group
            group = []
        group.append(k)
    if group:
        yield group


def labels(ids: list[list[int]], table: np.ndarray) -> list[np.ndarray]:
    """The best label of each word of each text, in memory bounded by CELLS or by one text."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(ids)
    for group in in_groups([len(x) for x in ids]):
        own = [ids[k] for k in group]
        if len(own) < FEW:
            scores = {w: table[w].tolist() for x in own for w in set(x)}
            paths = [viterbi_one(x, scores) for x in own]
        else:
            paths = viterbi(own, table)
        for k, path in zip(group, paths, strict=True):
            out[k] = path
    return out


def _unaddressed(text: str) -> str:
    """The text in lower case, with addresses (of no language) blanked out; of the same length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if ODD.search(low):
        low = low.translate(WIDE)
    return ADDRESS.sub(lambda m: " " * len(m[0]), low) if SIGN.search(low) else low


class Vocabulary:
    """Numbers of the words that a task has met, and their scores; starts anew beyond a size."""

    def __init__(self, model: LanguageModel, most: int = 300_000) -> None:
        self.model, self.most = model, most
        self.numbers: dict[str, int] = {}
        self.scores: list[np.ndarray] = []
        self.known: list[bool] = []

    def ids(self, words: list[str]) -> list[int]:
        found = list(map(self.numbers.get, words))
        if None in found:
            for k, word in enumerate(words):
                if found[k] is None:
                    number = self.numbers.get(word)
                    if number is None:
                        number = self.numbers[word] = len(self.scores)
                        score, known = self.model.score(word)
                        self.scores.append(score)
                        self.known.append(known)
                    found[k] = number
        return found

    def fresh(self) -> None:
        if len(self.scores) > self.most:
            self.__init__(self.model, self.most)


def segments_of(vocabulary: Vocabulary, texts: list[str]) -> Iterator[list[tuple[int, int, str, float, int, float]]]:
    """For each text its segments: (from_char, to_char, lang, confidence, words, share of known words)."""
    vocabulary.fresh()
    plain = [_unaddressed(t) for t in texts]
    shapes = [HIDDEN_WORD if HIDDEN.search(t) else WORD for t in plain]
    ids = [vocabulary.ids(WORD.findall(t) if w is WORD else [HIDDEN.sub("", x) for x in w.findall(t)]) for t, w in zip(plain, shapes, strict=True)]
    table, known = np.array(vocabulary.scores or [np.zeros(len(LANGS))]), np.array(vocabulary.known or [False])
    for text, word, own, path in zip(plain, shapes, ids, labels(ids, table), strict=True):
        if not own:
            yield []
            continue
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(own)]
        if len(cuts) == 2:
            last = len(text) - WORD.search(text[::-1]).start()
            spans = {0: (WORD.search(text).start(), 0), len(own) - 1: (0, last)}
        else:
            spans = dict(enumerate(m.span() for m in word.finditer(text)))
        scores, seen, out = table[own], known[own], []
        for a, b in zip(cuts, cuts[1:]):
            total = scores[a:b].sum(0)
            odds = np.exp(np.clip(total - total.max(), -50, 0))
            share = float(seen[a:b].mean())
            # Certainty among the languages, weighed by how much of the segment is known at all.
            out.append((spans[a][0], spans[b - 1][1], LANGS[path[a]], round(float(odds[path[a]] / odds.sum()) * (0.5 + 0.5 * share), 4), b - a, share))
        yield out


def label_texts(df: DataFrame, model: LanguageModel, keys: list[str], text_col: str = "text") -> DataFrame:
    """Segments of each text: the keys (strings or numbers as strings), segment, from_char, to_char, lang, confidence, words, known."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    size = len(keys)

    def make():  # noqa: ANN202
        held = Vocabulary(sent.value)

        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            batch = list(rows)
            for k in range(0, len(batch), 2000):
                part = batch[k : k + 2000]
                for row, found in zip(part, segments_of(held, [r[size] for r in part]), strict=True):
                    for i, s in enumerate(found):
                        yield (*row[:size], i, *s)

        return step

    text, number = pa.string(), pa.int64()
    ddl = ", ".join(f"{k} string" for k in keys) + ", segment bigint, from_char bigint, to_char bigint, lang string, confidence double, words bigint, known double"
    chosen = df.where(F.col(text_col).isNotNull()).select(*(F.col(k).cast("string").alias(k) for k in keys), F.col(text_col).alias("text"))
    return map_rows(chosen, make, ddl, [*((k, text) for k in keys), ("segment", number), ("from_char", number), ("to_char", number), ("lang", text), ("confidence", pa.float64()), ("words", number), ("known", pa.float64())])


def languages(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The languages of each text: lang, words, confidence, main (the one with most words). Short segments are furniture."""
    held = (F.col("words") >= LEAST_SEGMENT) & (F.col("known") >= LEAST_KNOWN)
    by = segments.groupBy(*keys, "lang").agg(
        F.sum("words").alias("words"), F.max("confidence").alias("confidence"), F.max(held).alias("held"),
        (F.sum(F.col("known") * F.col("words")) / F.sum("words")).alias("known"),
    )
    top = by.groupBy(*keys).agg(F.max(F.struct("words", "lang")).alias("top"))
    return by.join(top, keys).where("held or lang = top.lang").select(*keys, "lang", "words", "confidence", "known", (F.col("lang") == F.col("top.lang")).alias("main"), "held")


def records(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """The records with a language label: rec_table, rec_id, label, text; repeated deliveries are dropped after labelling, as rows of segments."""
    docs = documents.select(F.lit("documents").alias("rec_table"), F.col("doc_id").alias("rec_id"), F.col("lang").alias("label"), "text")
    own = blocks.where(F.array_contains(F.map_keys("extra"), "lang")).select(F.lit("text_blocks").alias("rec_table"), F.col("block_id").alias("rec_id"), F.element_at("extra", "lang").alias("label"), "text")
    return docs.unionByName(own)


def wrong_labels(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rec_table, rec_id, lang, confidence): one row for each language of a record whose label is missing or wrong, or whose text is mixed."""
    found = records(documents, blocks)
    model = fit(found.select(label(F.col("label")).alias("lang"), "text"))
    tagged = found.withColumn("named", F.coalesce(label(F.col("label")), F.when(label_missing(F.col("label")), "").otherwise("?")))
    keys = ["rec_table", "rec_id", "named"]
    # The segments are read by two aggregates; they are small and written once, so texts are labelled once.
    langs = languages(checkpoint(label_texts(tagged, model, keys).dropDuplicates([*keys, "segment"])), keys)
    # One row per record decides; it is joined back through a window-free aggregate on the same keys.
    case = langs.groupBy(*keys).agg(F.collect_list(F.struct("lang", "confidence", "main", "known", "held")).alias("all"))
    main = F.filter("all", lambda x: x["main"])[0]
    sure = main["known"] >= LEAST_KNOWN
    is_case = (F.col("named") == "") | (F.size("all") > 1) | ((main["lang"] != F.col("named")) & (sure | (F.col("named") == "?")))
    return case.where(is_case).select("rec_table", F.col("rec_id").cast("bigint").alias("rec_id"), F.explode("all").alias("x")).select("rec_table", "rec_id", "x.lang", "x.confidence")
