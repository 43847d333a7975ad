"""Problem 7: text that was decoded with the wrong code page.

A swap of code pages is a substitution cipher: each symbol of the garbled text stands for a letter (or, from UTF-8, a
group of symbols does). Known pairs of code pages are ciphers whose tables are given; for each source,
expectation-maximisation against letter bigrams learns how often each of them occurs there. Words of a source that no
known cipher explains are taken for an unknown one: its byte-to-letter table is learned from these words by
expectation-maximisation against the bigrams (see ``ciphers``), started from the nearest known table and from letter
frequencies, again and again until what is left makes no words. The bigrams come from the words of all texts, without
those that some cipher, known or learned, turns into much more frequent ones. A word is garbled if its translation is
likelier than itself by a margin; a record is garbled if its words are in sum, or if characters were lost (replacement
characters, question marks in place of letters). Restoring applies the cipher's table with str.translate, line by line;
lost characters are set where the bigrams leave no doubt.

Null and empty texts are not garbled. Repeated rows give repeated results; extra columns are left out.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.ciphers import Learner, Letters, completed
from siftline.llm.common import Memo, count_keys, map_rows

#: Code pages that texts were written in, and those they were read as.
WRITTEN = ("utf-8", "cp1251", "cp866", "koi8-r", "mac-cyrillic", "iso8859-5", "cp1250", "cp1252", "cp850", "cp852", "iso8859-2")
READ = ("cp1251", "cp866", "koi8-r", "mac-cyrillic", "iso8859-5", "cp1252", "latin-1", "cp1250", "cp437", "cp850", "cp852", "iso8859-2", "mac-roman")
LOST = "�"
TOKEN = re.compile(r"[^ \n\t\r]+")
ODD = re.compile(r"[^\x00-\x7f]")
NONE = re.compile(r"(?<![\w?])\?{2,}[,.;:)»]*(?![\w?])")
EDGE = ".,;:!?()\"'«»/|[]-_0123456789 ·•№©—–…=<>"
LETTERS = re.compile(rf"(?:[^\W\d_]|[-'’{LOST}])+")
MIXED = re.compile("[Ѐ-ӿ][A-Za-z]|[A-Za-z][Ѐ-ӿ]")
MISREAD = re.compile(r"[^\W\d_]\d|\d[^\W\d_]")
SOFT, BLANK = re.compile("[\u00a0\u00ad\u2000-\u200f\u202f\u2060\u3000\ufeff]"), re.compile("[\u00a0\u2000-\u200a\u202f\u3000]")
#: A word belongs to the vocabulary from this share of all words on, which bounds it; a garbled word's translation is that much more frequent.
SHARE, TIMES = 5e-7, 4
#: A word of the vocabulary that is counted more often is sound.
SOUND = 4
#: Least probability of a bigram in a word that is beyond suspicion.
COMMON = math.log(4e-4)
#: Nats by which translations must be likelier: one word, the words of one cipher in a text together, and in a name of a few words.
WORD, RECORD, NAME = 4.0, 13.0, 4.5
#: The source of file names, and the characters of a text that is judged as a name.
NAMES, SHORT = "file names", 200
#: Letters of two alphabets with one look (problem 2, not garbled): fixed values.
_C, _L = "аеорсухіјѕАВЕКМНОРСТХІЈЅУ", "aeopcyxijsABEKMHOPCTXIJSY"
LOOKS = (str.maketrans(_L + "οΟαΑΒΕΗΚΜΡΤΧ", _C + "оОаАВЕНКМРТХ"), str.maketrans(_C + "οΟαΑΒΕΗΚΜΡΤΧ", _L + "oOaABEHKMPTX"))
#: The most frequent words that together make up this share of all words are sound enough to learn from.
SAFE = 0.8
#: Standard deviations by which the mean bigram of a word falls short of sound words' for an unknown cipher to be looked for.
STRANGE = 2.0
#: Words of an unknown cipher are learned from if they make up this share of the source's words.
LEARN_SHARE = 2e-6
#: Nats by which a word must be likelier in translation to be one of a learned cipher's.
OWN = 2.0
#: Question marks in place of whole words from which letters were lost.
MARKS = 3


def _one_byte(page: str, byte: int) -> str:
    try:
        return bytes([byte]).decode(page)
    except UnicodeDecodeError:
        return chr(byte) if page in ("cp1252", "cp1250") else LOST


class Cipher:
    """What a text written in ``a`` and read as ``b`` looks like, undone."""

    def __init__(self, a: str, b: str) -> None:
        self.name, self.wide = f"{a} read as {b}", a == "utf-8"
        self.bytes = {}
        for k in range(255, 127, -1):
            symbol = _one_byte(b, k)
            if symbol != LOST:
                self.bytes[symbol] = k
        if b in ("cp1252", "latin-1"):  # the two differ in the C1 controls only
            self.bytes |= {chr(k): k for k in range(0x80, 0xA0)}
        self.symbols = frozenset(self.bytes) | {LOST}
        self.table = {} if self.wide else {ord(s): _one_byte(a, k) for s, k in self.bytes.items()}

    def undo(self, text: str) -> str | None:
        """The text as written; None where this cipher cannot have made it."""
        if not self.wide:
            out = text.translate(self.table)
            return out if out != text and all(c.isascii() or c == LOST or ord(c) in self.table for c in text) else None
        raw, odd = bytearray(), 0
        for c in text:
            k = self.bytes.get(c)
            if k is not None:
                raw.append(k)
            elif c.isascii():
                raw.append(ord(c))
            elif c == LOST:
                raw.append(0xFF)
                odd += 1
            else:
                return None
        out = raw.decode("utf-8", "replace")
        return out if out != text and out.count(LOST) <= odd + (odd > 0) and out != LOST * len(out) else None


class Learned:
    """A cipher whose table was learned."""

    wide = False

    def __init__(self, name: str, letters: dict[str, str]) -> None:
        self.name, self.table, self.symbols = name, {ord(s): c for s, c in letters.items()}, frozenset(letters) | {LOST}

    def undo(self, text: str) -> str | None:
        out = text.translate(self.table)
        return out if out != text else None


CIPHERS = [Cipher(a, b) for a in WRITTEN for b in READ if a != b]


def core(word: str) -> str:
    return word.strip(EDGE)


class Bigrams:
    """Letter bigrams of words, with their ends."""

    def __init__(self, words: Iterable[tuple[str, int]]) -> None:
        pairs, firsts = Counter(), Counter()
        for word, n in words:
            padded = f"^{word}$"
            for x, y in zip(padded, padded[1:]):
                pairs[x, y] += n
                firsts[x] += n
        size = len(firsts) + 1
        self.table = {k: math.log((n + 0.01) / (firsts[k[0]] + 0.01 * size)) for k, n in pairs.items()}
        self.floor = {x: math.log(0.01 / (n + 0.01 * size)) for x, n in firsts.items()}
        self.least = -math.log(size) - 4

    def steps(self, word: str) -> list[float]:
        padded = f"^{word}$"
        return [self.table.get(k) or max(self.floor.get(k[0], self.least), -13.0) for k in zip(padded, padded[1:])]

    def score(self, word: str) -> float:
        """Log probability; a lost letter costs as a letter at random."""
        padded = f"^{word}$"
        return sum(-4.0 if LOST in k else self.table.get(k) or max(self.floor.get(k[0], self.least), -13.0) for k in zip(padded, padded[1:]))


#: From the words of each source and the sound words to the ciphers learned by source.
Learn = Callable[[dict[str, dict[str, int]], list[tuple[str, int]]], dict[str, list["Learned"]]]


def learned_here(counts: dict[str, dict[str, int]], clean: list[tuple[str, int]]) -> dict[str, list[Learned]]:
    return {source: found for source, own in counts.items() if (found := Restorer.learned(own, clean))}


def learned_in_tasks(spark: SparkSession) -> Learn:
    """Each source's ciphers are learned in a task of its own."""

    def learn(counts: dict[str, dict[str, int]], clean: list[tuple[str, int]]) -> dict[str, list[Learned]]:
        if not counts:
            return {}
        sent = spark.sparkContext.broadcast((counts, clean))

        def make():  # noqa: ANN202
            def step(rows: Iterator[tuple]) -> Iterable[tuple]:
                own, sound = sent.value
                for (source,) in rows:
                    for cipher in Restorer.learned(own[source], sound):
                        yield source, cipher.name, json.dumps({chr(s): c for s, c in cipher.table.items()})

            return step

        sources = spark.createDataFrame([(s,) for s in sorted(counts)], "source string").repartition(len(counts), "source")
        text = pa.string()
        out: dict[str, list[Learned]] = defaultdict(list)
        for r in sorted(map_rows(sources, make, "source string, name string, letters string", [("source", text), ("name", text), ("letters", text)]).collect()):
            out[r.source].append(Learned(r.name, json.loads(r.letters)))
        return dict(out)

    return learn


class Restorer:
    """Language bigrams and, for each source, the learned probabilities of the ciphers."""

    def __init__(self, counts: dict[str, dict[str, int]], learn: Learn | None = None) -> None:
        total: Counter = Counter()
        for own in counts.values():
            total.update(own)
        clean = self._clean(total, CIPHERS)
        #: The ciphers of each source: the known ones and those learned from its words.
        self.letters: dict[str, list[Learned]] = (learn or learned_here)(counts, clean)
        if self.letters:
            clean = self._clean(total, [*CIPHERS, *(c for own in self.letters.values() for c in own)])
        self.bigrams, self.sound = Bigrams(clean), {w for w, n in clean if n > SOUND}
        # A floor for every cipher: the first garbled record of a kind must be found too.
        self.prior = {source: self._em(own, self.ciphers(source)) for source, own in counts.items()}

    def ciphers(self, source: str) -> list[Cipher | Learned]:
        return [*CIPHERS, *self.letters.get(source, ())]

    @staticmethod
    def _clean(total: Counter, ciphers: list[Cipher | Learned]) -> list[tuple[str, int]]:
        """Words that no cipher turns into more frequent ones: much more for a known one, which fits many a word by chance."""
        out = []
        for word, n in total.items():
            if LOST in word:
                continue
            odd = frozenset(ODD.findall(word))
            if odd and any(odd <= c.symbols and (t := c.undo(word)) is not None and LOST not in t and total.get(core(t), 0) >= (TIMES if isinstance(c, Cipher) else 1) * n for c in ciphers):
                continue
            out.append((word, n))
        return out

    @staticmethod
    def learned(own: dict[str, int], clean: list[tuple[str, int]]) -> list[Learned]:
        """Tables of unknown ciphers of a source, learned from the words that look like no language and that no known cipher explains."""
        size, run, safe = sum(own.values()), 0, []
        for word, n in sorted(clean, key=lambda x: (-own.get(x[0], 0), x[0])):
            # Words of other sources are sound, and the most frequent ones of its own.
            if (n - own.get(word, 0) > 0) or run <= SAFE * size:
                safe.append((word, n))
            run += own.get(word, 0)
        model, known = Bigrams(safe), {w: n for w, n in safe if w[0].isalpha()}
        mean = lambda w: model.score(w) / (len(w) + 1)
        usual = [(mean(w), n) for w, n in known.items() if len(w) > 2 and not w.isascii()]
        if not usual:
            return []
        weight = sum(n for _, n in usual)
        middle = sum(m * n for m, n in usual) / weight
        least = middle - STRANGE * math.sqrt(sum(n * (m - middle) ** 2 for m, n in usual) / weight)

        def odd(word: str) -> bool:
            if len(word) < 3 or word.isascii() or LOST in word or word in known or MISREAD.search(word) or SOFT.search(word) or mean(word) >= least:
                return False
            if any((plain := word.translate(table)) != word and mean(plain) >= least for table in LOOKS):
                return False  # look-alike letters
            base, signs = model.score(word), frozenset(ODD.findall(word))
            return not any(signs <= c.symbols and (t := c.undo(word)) is not None and len(core(t)) > 2 and mean(core(t)) >= least and model.score(core(t)) > base + WORD for c in CIPHERS)

        left, out = {w: n for w, n in own.items() if n >= LEARN_SHARE * size and odd(w)}, []
        letters = Letters(safe) if left else None
        while left:
            table = Learner(letters, left).learn([{chr(s): c for s, c in k.table.items()} for k in CIPHERS if not k.wide], known, lambda w, made: model.score(made) - model.score(w) > OWN)
            if table is None:
                break
            table, pair = completed(table, {w: n for w, n in left.items() if (t := w.translate(str.maketrans(table))) != w and model.score(t) > model.score(w) + OWN})
            out.append(Learned(f"learned: {pair or len(out) + 1}", table))
            rest = {w: n for w, n in left.items() if (t := out[-1].undo(w)) is None or model.score(t) <= model.score(w) + OWN}
            if len(rest) == len(left):
                break
            left = rest
        return out

    def _em(self, own: dict[str, int], ciphers: list[Cipher | Learned]) -> dict[int, float]:
        """Shares of the ciphers among the source's suspicious words."""
        bad = []
        for word, n in own.items():
            odd = frozenset(ODD.findall(word))
            if odd and word not in self.sound and min(self.bigrams.steps(word)) < COMMON:
                base = self.bigrams.score(word)
                found = [(k, t, s - base) for k, c in enumerate(ciphers) if odd <= c.symbols and (t := c.undo(word)) is not None and (s := self.bigrams.score(core(t))) > base + WORD]
                if found:
                    bad.append((n, found))
        prior = dict.fromkeys(range(len(ciphers)), 1 / len(ciphers))
        for _ in range(15):
            got: Counter = Counter()
            for n, found in bad:
                top = max(s for *_, s in found)
                weights = [(k, prior[k] * math.exp(max(s - top, -40))) for k, _, s in found]
                mass = sum(w for _, w in weights) or 1.0
                for k, w in weights:
                    got[k] += n * w / mass
            size = sum(got.values())
            prior = {k: (got[k] + 0.01 * max(size, 1)) / (size + 0.01 * max(size, 1) * len(ciphers)) for k in prior}
        return prior

    def open_letters(self, cipher: int, text: str) -> str:
        """A translated word with its lost letters set where the bigrams leave no doubt."""
        out = list(text)
        for i, c in enumerate(out):
            if c == LOST and 0 < i < len(out) - 1 and LOST not in (out[i - 1], out[i + 1]):
                score = {y: v + self.bigrams.table.get((y, out[i + 1]), -20.0) for (x, y), v in self.bigrams.table.items() if x == out[i - 1] and y != "$"}
                if score:
                    ranked = sorted(score, key=score.get, reverse=True)
                    if len(ranked) == 1 or score[ranked[0]] - score[ranked[1]] > 4:
                        out[i] = ranked[0]
        return "".join(out)

    def is_sound(self, word: str) -> bool:
        return word in self.sound or word.lower() in self.sound or word.capitalize() in self.sound

    def judge(self, source: str, word: str) -> tuple[int, float, bool]:
        """(cipher, nats by which its translation is likelier, whether that is a sound word) of a word; (-1, 0) if it is not suspicious."""
        inner = core(word)
        odd = frozenset(ODD.findall(inner))
        if len(inner) < 3 or not odd or inner in self.sound:
            return -1, 0.0, False
        steps = self.bigrams.steps(inner)
        if min(steps) >= COMMON or sum(c.isalpha() or ord(c) > 0x7F for c in inner) < 3:
            return -1, 0.0, False
        if MISREAD.search(inner) or (inner.isupper() and min(self.bigrams.steps(inner.lower())) >= COMMON):
            return -1, 0.0, False
        if SOFT.search(inner) and all(len(x) < 2 or min(self.bigrams.steps(x)) >= COMMON for part in BLANK.split(inner) if (x := core(SOFT.sub("", part)))):
            return -1, 0.0, False  # invisible characters and wide blanks between sound words
        for table in LOOKS:
            plain = core(SOFT.sub("", unicodedata.normalize("NFKC", inner).translate(table)))
            if plain != inner and (plain in self.sound or min(self.bigrams.steps(plain)) >= COMMON):
                return -1, 0.0, False
            if MIXED.search(inner) and not MIXED.search(plain):
                return -1, 0.0, False  # letters of two alphabets that look alike, in a word of one
        base, prior = sum(steps), self.prior.get(source) or self.prior.get("", {})
        best = (-1, 0.0, False)
        for k, cipher in self.order[source]:
            translated = cipher.undo(inner) if odd <= cipher.symbols else None
            if translated is None:
                continue
            made = core(translated)
            if LETTERS.fullmatch(inner) and not LETTERS.fullmatch(translated):
                continue  # letters do not come from signs
            score, sound = self.bigrams.score(made) - base, self.is_sound(made)
            if cipher.wide and (again := cipher.undo(translated)) is not None:
                score, sound = max(score, self.bigrams.score(core(again)) - base), sound or self.is_sound(core(again))
            # Signs at the ends of a word may be letters of it.
            sound = sound or (word != inner and (whole := cipher.undo(word)) is not None and self.is_sound(core(whole)))
            score += max(math.log(prior.get(k, 1e-3)), -5.0)
            if score > best[1]:
                best = (k, score, sound)
        return best if best[1] >= WORD else (-1, 0.0, False)

    def start(self) -> None:
        """Caches of a task."""
        self.order = Memo(lambda source: sorted(enumerate(self.ciphers(source)), key=lambda c: -(self.prior.get(source) or {}).get(c[0], 0.0)))
        self.known = Memo(lambda key: self.judge(*key), 400_000)

    def record(self, source: str, text: str) -> tuple[bool, int, float]:
        """(garbled, cipher or -1, nats) of a text."""
        marks = NONE.findall(text) if "??" in text else ()
        lost = LOST in text or len(marks) >= MARKS or (len(marks) > 1 and sum(map(len, marks)) > 3 * MARKS)
        if text.isascii():
            return lost, -1, 0.0
        sums: dict[int, float] = {}
        sure: set[int] = set()
        known = self.known
        for word in TOKEN.findall(text.replace("_", " ")):
            k, score, sound = known[source, word]
            if k >= 0:
                sums[k] = sums.get(k, 0.0) + score
                if sound:
                    sure.add(k)
        if not sums:
            return lost, -1, 0.0
        k = max(sums, key=sums.get)
        # Of a text one word at least must become a sound one: names and codes in it translate into letters as likely as their own.
        found = sums[k] >= NAME if len(text) < SHORT and source == NAMES else k in sure and sums[k] >= RECORD
        return lost or found, k if found else -1, sums[k]

    def restore(self, source: str, text: str) -> str:
        """The text with its garbled lines translated: whole lines if most words are, else the garbled words."""
        _, k, _ = self.record(source, text)
        if k < 0:
            return text
        cipher, lines = self.ciphers(source)[k], []
        for line in text.split("\n"):
            words = [w for w in TOKEN.findall(line) if ODD.search(w)]
            bad = [w for w in words if self.known[source, w][0] >= 0]
            if bad and 2 * len(bad) >= len(words) and (made := cipher.undo(line)) is not None:
                if cipher.wide and (again := cipher.undo(made)) is not None and self.bigrams.score(core(again)) > self.bigrams.score(core(made)):
                    made = again
                line = self.open_letters(k, made)
            elif bad:
                line = TOKEN.sub(lambda m: cipher.undo(m[0]) or m[0] if self.known[source, m[0]][0] == k else m[0], line)
            lines.append(line)
        return "\n".join(lines)


def texts(blocks: DataFrame, inventory: DataFrame) -> DataFrame:
    """(rec_table, rec_id, source, text) of both tables; a source is where texts of one kind come from."""
    own = blocks.where("text is not null and text <> ''").select(F.lit("text_blocks").alias("rec_table"), F.col("block_id").alias("rec_id"), F.coalesce("extraction_method", F.lit("")).alias("source"), "text")
    names = inventory.where("decoded_name is not null and decoded_name <> ''").select(F.lit("file_inventory").alias("rec_table"), F.col("scan_id").alias("rec_id"), F.lit(NAMES).alias("source"), F.col("decoded_name").alias("text"))
    return own.unionByName(names)


def fit(found: DataFrame) -> Restorer:
    """Words of all texts by source, counted in full; those over SHARE (at most 1 / SHARE of them) make the model."""

    def make():  # noqa: ANN202
        def add(rows: Iterator[tuple], counts: Counter) -> None:
            by: dict[str, list[str]] = defaultdict(list)
            for source, text in rows:
                by[source].append(text)
            for source, own in by.items():
                inner: Counter = Counter()
                for word, n in Counter(TOKEN.findall("\n".join(own).replace("_", " "))).items():
                    w = core(word)
                    if w:
                        inner[w] += n
                for w, n in inner.items():
                    counts[source, w] += n

        return add

    counts = count_keys(found.select("source", "text"), make, ["source", "word"]).persist()
    total = counts.agg(F.sum("n")).first()[0] or 0
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counts.where(F.col("n") >= max(2, SHARE * total)).collect():
        out[r.source][r.word] = r.n
    counts.unpersist()
    return Restorer(dict(out), learned_in_tasks(found.sparkSession))


def garbled(found: DataFrame, model: Restorer, restore: bool = False) -> DataFrame:
    """The garbled records: rec_table, rec_id, cipher (null if letters were only lost), nats, and with ``restore`` the restored text."""
    sent = found.sparkSession.sparkContext.broadcast(model)

    def make():  # noqa: ANN202
        held = sent.value
        held.start()

        def step(rows: Iterator[tuple]) -> Iterable[tuple]:
            for table, key, source, text in rows:
                bad, k, nats = held.record(source, text)
                if bad:
                    yield table, key, held.ciphers(source)[k].name if k >= 0 else None, round(nats, 3), held.restore(source, text) if restore else None

        return step

    text, number = pa.string(), pa.int64()
    return map_rows(found.select("rec_table", "rec_id", "source", "text"), make, "rec_table string, rec_id bigint, cipher string, nats double, restored string", [("rec_table", text), ("rec_id", number), ("cipher", text), ("nats", pa.float64()), ("restored", text)])
