"""Noisy-channel restoration of disguised words: lattices of what a writer may have meant, decoded by Viterbi under a
character language model.

The channel: digits and symbols stand for letters (leetspeak), symbols and separators are strewn between letters, letters
are repeated, and words are spaced out into single characters. Each run of equal characters becomes a step of the lattice
with its readings (letters to emit, a word's end, or nothing) and their costs; the language model adds the cost of every
emitted character after the four before it. The cheapest path is the restored text.

The model holds counts of 1- to 5-grams of characters within words, of all words of all documents, in BUCKETS hashed
cells, so its size does not depend on the corpus. Probabilities are smoothed towards shorter contexts."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column
from quire.session import bound_batches

ORDER, BUCKETS = 5, 1 << 20
#: Letters that a digit or symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "%": "o", "&": "a"}
_MASK, _BASE, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_START, _END = "^", "$"
#: Nats: a letter written as another sign, a sign between letters left out, a digit left out, repeated letters written once or twice, smoothing.
_SWAP, _DROP, _DROP_DIGIT, _HALVE, _SHORTEN, _WEIGHT = 1.5, 1.0, 6.0, 2.5, 0.3, 4.0
_SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){2,}(?!\S)")
_EDGE = re.compile(r"^[^\w@$!|+(<€£*#%&]+|[^\w@$|+<€£*#%&]+$")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
_RUNS = re.compile(r"(.)\1*", re.S)


def _cell(gram: str) -> int:
    """The cell of an n-gram; grams() computes the same for whole batches."""
    h = len(gram)
    for ch in gram:
        h = (h * _BASE + ord(ch)) & _MASK
    return ((((h ^ (h >> 30)) * _MIX) & _MASK) >> 40) % BUCKETS


def gram_counts(words: list[str], counts: np.ndarray) -> np.ndarray:
    """Counts by cell of all 1- to ORDER-grams of words, each with a start and an end, counted counts times."""
    marked = [f"{_START}{w}{_END}" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in marked])
    left = np.repeat(length.cumsum(), length) - np.arange(len(code))  # characters to the end of the word
    weight, out = np.repeat(counts, length), np.zeros(BUCKETS, dtype=np.int64)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(_BASE) + code[at + j]
            h = ((h ^ (h >> np.uint64(30))) * np.uint64(_MIX)) >> np.uint64(40)
            np.add.at(out, (h % np.uint64(BUCKETS)).astype(np.int64), weight[at])
    return out


def character_counts(docs: DataFrame) -> np.ndarray:
    """The model's counts over every word of every text (null: none): words are counted by Spark first, BUCKETS rows at most reach the driver."""
    bound_batches(docs.sparkSession)
    # whatever an accent or sign is stuck to, only letters make words here; what they look like in disguise teaches nothing
    words = docs.select(F.explode(F.split(F.lower("text"), r"[\s\p{Punct}]+")).alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += gram_counts(column(batch, "word").to_pylist(), column(batch, "n").to_numpy())
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"cell": part, "n": total[part]})

    out = np.zeros(BUCKETS, dtype=np.int64)
    found = counted.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


class Restorer:
    """Restored words of texts under the model of counts."""

    def __init__(self, counts: np.ndarray, remembered: int = 600_000, told: Callable[[tuple[str, ...]], tuple] | None = None) -> None:
        """told: what to keep of a token's words (the words themselves if none); it is worked out once for a token that is remembered."""
        self.counts, self.remembered, self.told = counts, remembered, told or (lambda words: words)
        self.total = max(1, int(counts.sum()) // ORDER)
        self._costs: dict[str, float] = {}
        self._words: dict[str, tuple] = {}
        self._older: dict[str, tuple] = {}  # what was remembered before that, half of all

    def cost(self, context: str, ch: str) -> float:
        """-log P(ch | context), context of at most ORDER - 1 characters."""
        key = context + ch
        found = self._costs.get(key)
        if found is None:
            both = int(self.counts[_cell(key)])
            if context:
                seen = int(self.counts[_cell(context)])
                p = (min(both, seen) + _WEIGHT * math.exp(-self.cost(context[1:], ch))) / (seen + _WEIGHT)
            else:
                p = (both + 1 / 256) / (self.total + 1)
            if len(self._costs) >= 2 * self.remembered:
                self._costs.clear()
            found = self._costs[key] = -math.log(p)
        return found

    def spelt(self, word: str) -> tuple[str, ...]:
        """decode() of a word of letters alone: its few readings, with repeated letters or without, are weighed one by one."""
        readings = [("", 0.0)]
        for m in _RUNS.finditer(word):
            options = _readings(m[1], len(m[0]))
            readings = [(text + emitted, price + more) for text, price in readings for emitted, more in options]
            if len(readings) > 8:
                return self.decode(word)
        best, chosen, costs = math.inf, word, self._costs
        for text, total in readings:
            marked = f"{_START}{text}{_END}"
            for i in range(1, len(marked)):
                key = marked[max(0, i + 1 - ORDER) : i + 1]
                total += costs[key] if key in costs else self.cost(key[:-1], key[-1])
            if total < best:
                best, chosen = total, text
        return (chosen,)

    def decode(self, written: str) -> tuple[str, ...]:
        """The words of the cheapest path through the lattice of a disguised token or spaced-out group."""
        # states by the last characters: cost, and the path as a linked list, so that long tokens copy nothing
        states: dict[str, tuple[float, tuple | None]] = {_START: (0.0, None)}
        for match in _RUNS.finditer(written):
            ch, n = match[1], len(match[0])
            after: dict[str, tuple[float, tuple | None]] = {}
            if n == 1 and ch not in LEET and ch.isalpha():  # one reading, the letter itself
                for context, (total, path) in states.items():
                    key = context + ch
                    total += self._costs[key] if key in self._costs else self.cost(context, ch)
                    now = key[1 - ORDER :]
                    if now not in after or total < after[now][0]:
                        after[now] = (total, (ch, path))
                states = after
                continue
            for emitted, price in _readings(ch, n):
                for context, (so_far, path) in states.items():
                    total, now, way = so_far + price, context, path
                    for c in emitted:
                        if c == _END and now[-1] == _START:
                            continue  # no empty words
                        total += self.cost(now, c)
                        now = _START if c == _END else (now + c)[1 - ORDER :]
                        way = (c, way)
                    kept = after.get(now)
                    if kept is None or total < kept[0]:
                        after[now] = (total, way)
            states = after
        best, way = min(((total + (0.0 if context == _START else self.cost(context, _END)), i, path) for i, (context, (total, path)) in enumerate(states.items())), key=lambda s: s[:2])[::2]
        letters = []
        while way is not None:
            letters.append(way[0])
            way = way[1]
        return tuple(w for w in "".join(reversed(letters)).split(_END) if w)

    def _token(self, token: str) -> tuple[str, ...]:
        token = _EDGE.sub("", token)
        if _PLAIN.match(token):
            return self.spelt(token) if _DOUBLE.search(token) else (token,)
        return self.decode(token) if _LETTER.search(token) else ()

    def words(self, text: str) -> set:
        """The distinct restored words of a text, lower case (or what told makes of them). Spaced-out groups are restored as one; their single characters are no words of their own."""
        text = text.lower()
        out: set = set()
        for group in set(_SPACED.findall(text)):
            if _LETTER.search(group):
                group = " ".join(group.split())
                out.update(self._words[group] if group in self._words else self._new(group, self.decode))
        known = self._words.get
        for token in set(text.split()):
            found = known(token)
            if found is None:
                found = self._new(token, self._token)
                known = self._words.get  # a new generation may have begun
            if found:
                out.update(found)
        return out

    def _new(self, token: str, work: Callable[[str], tuple[str, ...]]) -> tuple:
        found = self._older[token] if token in self._older else self.told(work(token))
        if len(token) <= 40:  # longer ones don't come again
            if len(self._words) >= self.remembered // 2:
                self._older, self._words = self._words, {}
            self._words[token] = found
        return found


def _readings(ch: str, n: int) -> list[tuple[str, float]]:
    """What n times ch may have meant: what to emit ("$" ends a word) and the channel's cost."""
    if ch in LEET:
        out = [(letter * k, _SWAP + (_SHORTEN if k < n else 0.0)) for letter in LEET[ch] for k in (1, 2)[: min(n, 2)]]
        return [*out, ("", _DROP_DIGIT if ch.isdigit() else _DROP), (_END, _DROP_DIGIT if ch.isdigit() else 0.0)]
    if _LETTER.match(ch):
        return [(ch, 0.0)] if n == 1 else [(ch * 2, 0.0), (ch, _HALVE)] if n == 2 else [(ch, _SHORTEN), (ch * 2, _SHORTEN)]
    return [("", _DROP), (_END, 0.0)]
