"""Substitution ciphers learned from their own words: which letter each symbol stands for, when no code page tells.

A text swapped through an unknown code page is a substitution cipher. Hidden letters follow the bigrams of sound words; each
symbol outside ASCII is emitted by one letter, with unknown probabilities. Expectation-maximisation (forward-backward over
all words, transitions fixed) learns them from a start: the table of a known pair of code pages, or frequencies alone.
The table is then made one-to-one, and checked against the vocabulary: words that one letter keeps from being known vote
on that letter. A table is accepted only if most of the words become words of the vocabulary.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable
from encodings.aliases import aliases
from functools import cache

import numpy as np

#: Iterations of expectation-maximisation, starts from frequencies, and the iterations that each of these gets first.
ROUNDS, STARTS, FIRST = 30, 4, 10
#: Known tables that learning starts from besides.
NEAREST = 2
#: A table is accepted if so much of its words' weight, and so many different words of WHOLE letters or more, become known.
LEAST_KNOWN, LEAST_WORDS, WHOLE = 0.5, 15, 4
#: Times that a symbol counts as standing for itself.
ITSELF = 4.0
#: Share of a table's symbols in words (and least number of them) with which a pair of code pages must agree to complete it.
AGREES, LEAST_SYMBOLS = 0.9, 12
#: Bytes that a one-byte code page may leave undefined.
UNDEFINED = 40
#: Letters that make up a smaller share of all letters are no states.
LEAST_LETTER = 2e-5


@cache
def page_symbols() -> dict[str, tuple[str, ...]]:
    """The upper 128 symbols of every one-byte code page that the runtime knows; undefined bytes are the control of their number."""
    out = {}
    for page in sorted(set(aliases.values()) - {"ascii"}):
        try:
            if bytes(range(32, 127)).decode(page) == "".join(map(chr, range(32, 127))):
                own = tuple(bytes([k]).decode(page, "replace") for k in range(128, 256))
                if all(len(c) == 1 for c in own) and own.count("\ufffd") <= UNDEFINED:
                    out[page] = tuple(chr(k + 128) if c == "\ufffd" else c for k, c in enumerate(own))
        except (LookupError, UnicodeDecodeError):
            continue
    return out


def completed(table: dict[str, str], words: dict[str, int]) -> tuple[dict[str, str], str | None]:
    """The whole table of the pair of code pages that agrees with a learned one, and the pair's name; else the learned table.

    Symbols count by their number in the words, as the letters of rare ones may be wrong.
    """
    count: Counter = Counter()
    for word, n in words.items():
        for c in word:
            count[c] += n
    weight = {s: count[s] for s in table}
    size, best, pages = sum(weight.values()), (0, "", ""), page_symbols()
    for b, symbols in pages.items():
        code = {c: k for k, c in enumerate(symbols)}
        at = [(code[s], letter, weight[s]) for s, letter in table.items() if s in code]
        if len(at) < LEAST_SYMBOLS or sum(n for *_, n in at) < AGREES * size:
            continue
        for a, own in pages.items():
            agree = sum(n for k, letter, n in at if own[k] == letter)
            if agree > best[0]:
                best = (agree, a, b)
    agree, a, b = best
    if not size or agree < AGREES * size or a == b:
        return table, None
    return {s: c for s, c in zip(pages[b], pages[a], strict=True) if s != c}, f"{a} read as {b}"


def changed(word: str, made: str) -> bool:
    """Whether most symbols outside ASCII stand for another letter: a cipher changes nearly all of them, a misreading one."""
    odd = [(a, b) for a, b in zip(word, made, strict=True) if not a.isascii()]
    return sum(a != b for a, b in odd) > 0.5 * len(odd)


class Letters:
    """Bigrams of sound words as a matrix over the letters, with the ends of words."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        single: Counter = Counter()
        for word, n in words:
            for c in word:
                single[c] += n
        size = sum(single.values()) or 1
        self.states = sorted(c for c, n in single.items() if c.isalpha() and n >= LEAST_LETTER * size)
        self.number = {c: i for i, c in enumerate(self.states)}
        self.share = np.array([single[c] / size for c in self.states])
        k = len(self.states)
        move, first, last = np.full((k, k), 0.05), np.full(k, 0.05), np.full(k, 0.05)
        for word, n in words:
            at = [self.number.get(c, -1) for c in word]
            if at and at[0] >= 0:
                first[at[0]] += n
            if at and at[-1] >= 0:
                last[at[-1]] += n
            for a, b in zip(at, at[1:]):
                if a >= 0 and b >= 0:
                    move[a, b] += n
        out = move.sum(1) + last
        self.move, self.last, self.first = move / out[:, None], last / out, first / first.sum()


class Learner:
    """The words of one source that may be garbled, and the expectation-maximisation over them."""

    def __init__(self, letters: Letters, words: dict[str, int]) -> None:
        self.letters = letters
        self.words = {w: n for w, n in words.items() if len(w) > 2 and all(not c.isascii() or c in letters.number for c in w) and not w.isascii()}
        count: Counter = Counter()
        for w, n in self.words.items():
            for c in w:
                if not c.isascii():
                    count[c] += n
        self.symbols = [c for c, _ in count.most_common()]
        self.number = {c: i for i, c in enumerate(self.symbols)}
        self.count = np.array([count[c] for c in self.symbols], float)
        self.free = np.array([not c.isascii() for c in letters.states])
        by: dict[int, list[str]] = defaultdict(list)
        for w in sorted(self.words):
            by[len(w)].append(w)
        size = len(self.symbols)
        ascii_at = {c: size + i for i, c in enumerate(x for x in letters.states if x.isascii())}
        self.batches = [(np.array([[self.number.get(c, ascii_at.get(c, 0)) for c in w] for w in own]), np.array([self.words[w] for w in own], float)) for own in by.values()]
        # Which word holds which symbol at each place, to sum over equal symbols by a product.
        self.places = [[np.eye(size + len(ascii_at), dtype=np.float32)[seen[:, t]] for t in range(seen.shape[1])] for seen, _ in self.batches]
        # An ASCII letter stands for itself.
        self.fixed = np.zeros((len(letters.states), len(ascii_at)))
        for c, i in ascii_at.items():
            self.fixed[letters.number[c], i - size] = 1.0

    def step(self, emit: np.ndarray) -> tuple[np.ndarray, float]:
        """(expected number of times that each letter stood for each symbol, log likelihood) under the emissions."""
        own = self.letters
        full = np.hstack([emit, self.fixed])
        got = np.zeros_like(full)
        total = 0.0
        for (seen, n), places in zip(self.batches, self.places, strict=True):
            length = seen.shape[1]
            forward, scale = [], []
            now = own.first * full[:, seen[:, 0]].T
            for t in range(length):
                if t:
                    now = (forward[-1] @ own.move) * full[:, seen[:, t]].T
                norm = np.maximum(now.sum(1, keepdims=True), 1e-300)
                forward.append(now / norm)
                scale.append(norm)
            back = np.broadcast_to(own.last, forward[-1].shape)
            ends = np.maximum((forward[-1] * back).sum(1), 1e-300)
            total += float(n @ (np.log(ends) + sum(np.log(s[:, 0]) for s in scale)))
            for t in range(length - 1, -1, -1):
                held = forward[t] * back
                held *= (n / np.maximum(held.sum(1), 1e-300))[:, None]
                got += held.T @ places[t]
                if t:
                    back = ((full[:, seen[:, t]].T * back) @ own.move.T) / scale[t]
        return got[:, : len(self.symbols)], total

    def run(self, emit: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
        got, value = emit, -math.inf
        for _ in range(rounds):
            got, now = self.step(emit)
            emit = self._normal(got + 1e-3)
            if now - value < 1e-4 * abs(now) and value > -math.inf:
                value = now
                break
            value = now
        return emit, got, value

    def _normal(self, weights: np.ndarray) -> np.ndarray:
        weights = weights * self.free[:, None]
        return weights / np.maximum(weights.sum(1, keepdims=True), 1e-300)

    def from_table(self, table: dict[str, str]) -> np.ndarray:
        """Emissions that follow a table, open for what it leaves out."""
        emit = np.full((len(self.letters.states), len(self.symbols)), 1e-3)
        for symbol, letter in table.items():
            if symbol in self.number and letter in self.letters.number:
                emit[self.letters.number[letter], self.number[symbol]] += 1.0
        return self._normal(emit)

    def from_frequencies(self, seed: int) -> np.ndarray:
        """Emissions between letters and symbols that are about as frequent."""
        share = np.log(self.letters.share + 1e-9)[:, None] - np.log(self.count / self.count.sum() + 1e-9)[None, :]
        noise = np.random.default_rng(seed).gamma(2.0, 1.0, share.shape)
        return self._normal(np.exp(-np.abs(share)) * noise * self.letters.share[:, None])

    def table(self, got: np.ndarray) -> dict[str, str]:
        """One letter a symbol and one symbol a letter, the surest first; a symbol that is rare had better stand for itself."""
        got = got.copy()
        for symbol, b in self.number.items():
            if symbol in self.letters.number:
                got[self.letters.number[symbol], b] += ITSELF
        rank = np.argsort(-got, axis=None)
        out: dict[str, str] = {}
        used: set[int] = set()
        for at in rank[: 8 * got.shape[1]].tolist():
            a, b = divmod(at, got.shape[1])
            if got[a, b] < 0.5 or a in used or self.symbols[b] in out:
                continue
            out[self.symbols[b]] = self.letters.states[a]
            used.add(a)
        return out

    def vote(self, table: dict[str, str], known: dict[str, int]) -> dict[str, str]:
        """The table with letters that the vocabulary corrects: words of it that differ from a translation in one letter vote."""
        blanks: dict[str, set[str]] = defaultdict(set)
        for word in known:
            if len(word) >= WHOLE:
                for i, c in enumerate(word):
                    blanks[f"{word[:i]}\0{word[i + 1 :]}"].add(c)
        for _ in range(6):
            votes: dict[str, Counter] = defaultdict(Counter)
            for word, n in self.words.items():
                made = "".join(table.get(c, c) for c in word)
                if len(word) < WHOLE:
                    continue
                weight = math.sqrt(n)
                if made in known:
                    for c in set(word) & self.number.keys():
                        votes[c][table.get(c, c)] += 2 * weight
                    continue
                for i, c in enumerate(word):
                    if c in self.number:
                        for letter in blanks.get(f"{made[:i]}\0{made[i + 1 :]}", ()):
                            if not letter.isascii():
                                votes[c][letter] += weight
            new = dict(table)
            for symbol, own in votes.items():
                best, n = max(own.items(), key=lambda x: (x[1], x[0]))
                if n > own.get(table.get(symbol, ""), 0.0) and n >= 2:
                    new[symbol] = best
            if new == table:
                break
            table = new
        return table

    def quality(self, table: dict[str, str], known: dict[str, int]) -> tuple[float, int]:
        """(share of the words' weight that becomes known, different words of WHOLE letters that do)."""
        total, hit, words = 0, 0, 0
        for word, n in self.words.items():
            made = "".join(table.get(c, "\0") if not c.isascii() else c for c in word)
            good = made in known and changed(word, made)
            total, hit, words = total + n, hit + n * good, words + (good and len(word) >= WHOLE)
        return hit / total if total else 0.0, words

    def nearest(self, starts: list[dict[str, str]]) -> list[dict[str, str]]:
        """The start tables that know most of the symbols' weight."""
        known = [float(sum(self.count[i] for c, i in self.number.items() if c in table)) for table in starts]
        return [starts[k] for k in sorted(range(len(starts)), key=lambda k: -known[k])[:NEAREST] if known[k] > 0]

    def learn(self, starts: list[dict[str, str]], known: dict[str, int], is_own: Callable[[str, str], bool]) -> dict[str, str] | None:
        """The table learned, from the nearest of the start tables and from frequencies alone; None if it makes no words.

        ``is_own(word, translation)`` says which words the cipher explains; it is learned once more from these alone.
        """
        if len(self.words) < LEAST_WORDS or not self.symbols or not self.letters.states:
            return None
        tries = [self.from_table(t) for t in self.nearest(starts)] + [self.from_frequencies(seed) for seed in range(STARTS)]
        emit = max((self.run(t, FIRST) for t in tries), key=lambda x: x[2])[0]
        _, got, _ = self.run(emit, ROUNDS)
        table = self.vote(self.table(got), known)
        own = {w: n for w, n in self.words.items() if changed(w, made := "".join(table.get(c, c) for c in w)) and is_own(w, made)}
        if LEAST_WORDS <= len(own):
            again = Learner(self.letters, own)
            _, got, _ = again.run(again.from_table(table), ROUNDS)
            table = again.vote(again.table(got), known)
            share, words = again.quality(table, known)
        elif own:
            share, words = self.quality(table, known)
        else:
            return None
        return table if share >= LEAST_KNOWN and words >= LEAST_WORDS else None
