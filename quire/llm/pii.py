"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans follow fixed patterns and always stay. Beside them, generators of high recall propose overlapping
spans of the same kinds, such as every run of digit groups that could be a card or phone number, also within
longer digit runs where the base pattern matches too much and is dropped. Boosted trees score each candidate by
its format and its context; a threshold of each kind, calibrated on held-out examples, selects. Of overlapping
selected candidates the most probable stays, and none that overlaps a base span is added.

The trees are trained in a few seconds on EXAMPLES generated snippets with known spans and with decoys (order
numbers, versions, dates, amounts, hexadecimal keys), a fixed number from a fixed seed; no rows are read for it.

Results: null text is empty and has no spans. Offsets are code points, ends exclusive. Repeated rows give
repeated results; other columns are kept by redact() whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.batches import column, map_batches
from quire.session import bound_batches
from quire.llm.boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, SEED, PRECISION = 6000, 97, 0.995

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behinds only skip starts inside a digit run, which can't match where the run's start doesn't
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")

_GROUP = re.compile(r"[0-9]++")
_WORDED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]{1,63})+", re.I)

#: Candidates scored at once, so that a text full of numbers needs no great matrix.
_SLAB = 10_000

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k & 1:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and then by start."""
    found: list[Span] = []
    if not _HINT.search(text):
        return found
    end, at = 0, text.find("@")
    while at >= 0:  # the leftmost match starts where the run of local characters before an @ does
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of every kind. A run of digit groups gives those windows whose digit count fits, so their number is linear in the text."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            lead = start
            while lead < at and text[lead] in "._%+-":
                lead += 1
            tail = m.end()
            while text[tail - 1] == "-":
                tail -= 1
            out += [("email", start, m.end()), ("email", lead, tail)]
        at = text.find("@", at + 1)
    if "at" in text.lower() and ("(" in text or "[" in text):
        out += [("email", m.start(), m.end()) for m in _WORDED.finditer(text)]
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text)]

    def apart(k: int) -> bool:
        """Whether group k stands too far from the one before it to belong to one number."""
        gap = text[groups[k - 1][1] : groups[k][0]] if 0 < k < len(groups) else "...."
        return len(gap) > 3 or bool(gap.strip(" ().-"))

    for i, (a, first) in enumerate(groups):
        if i + 3 < len(groups) and all(text[groups[k][1] : groups[k + 1][0]] == "." for k in range(i, i + 3)):
            out.append(("ip", a, groups[i + 3][1]))
        n, longest = 0, 0
        for j in range(i, min(i + 19, len(groups))):  # a group has a digit at least
            s, e = groups[j]
            if j > i and apart(j):
                break
            n, longest = n + e - s, max(longest, e - s)
            if n > 19:
                break
            if longest == 1 and j > i and not (apart(i) and apart(j + 1)):
                continue  # of lone digits only a whole run can be one number
            inner = text[a:e]
            if n >= 13 and "(" not in inner:
                out.append(("card", a, e))
            if 7 <= n <= 15 and ("." not in inner or j - i >= 2):
                lead = a - 1 if a and text[a - 1] in "+(" else a
                if text[lead] == "(" and lead and text[lead - 1] == "+":
                    lead -= 1
                out.append(("phone", lead, e))
    return [s for s in dict.fromkeys(out) if s[1] < s[2]]


_FOR, _AGAINST = ("phone tel call mobile fax cell contact ring dial", "card visa mastercard amex credit debit pay", "ip address host server addr from", "email mail contact write reach"), ("order invoice version ver id no ref isbn sku serial part build release ticket number code tracking section page figure key token password hash total price",)
_CONTEXT = [frozenset(x.split()) for x in (*_FOR, *_AGAINST)]
_WORDS = re.compile(r"[a-z]+")


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, a, b = span
    inner = text[a:b]
    digits = _digits(inner)
    groups = _GROUP.findall(inner)
    before, after = text[max(0, a - 2) : a], text[b : b + 2]
    words = _WORDS.findall(text[max(0, a - 40) : a].lower())[-4:]
    octets = kind == "ip" and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    padded = any(len(g) > 1 and g[0] == "0" for g in groups)
    seps = set(re.findall(r"[^0-9A-Za-z+]", inner)) if kind != "email" else set()
    tail = inner.rsplit(".", 1)[-1] if kind == "email" else ""
    prev, following = before[-1:], after[:1]
    return [
        *(float(kind == k) for k in KINDS), len(digits), len(inner), len(groups), float(luhn(digits)) if digits and kind == "card" else -1.0,
        float(octets), float(padded), float(inner[:1] == "+"), float("(" in inner), float(inner.count("(") != inner.count(")")), len(seps),
        float(prev.isalnum()), float(following.isalnum()), float(prev in "+-./=_#$€£" if prev else False), float(following in "-/=_%" if following else False),
        float(following == "." and after[1:2].isdigit()), float(prev == " " and before[:1].isdigit()), float(following == " " and after[1:2].isdigit()),
        float(digits[:1] in "3456" if digits else False), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[-1]) if groups else 0,
        len(groups[0]) if groups else 0, float(tail.isalpha()), len(tail), float(inner[:1].isalnum()), float("@" in inner),
        *(float(any(w in c for w in words)) for c in _CONTEXT), len(set(digits)),
    ]


def _example(rng: random.Random) -> tuple[str, list[Span]]:
    """A snippet and its true spans."""
    def filler(n: int) -> list[tuple[str, str]]:
        return [("", "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "é", "ung", "ción")) for _ in range(rng.randint(1, 4))) + rng.choice(("", "", "", ".", ","))) for _ in range(n)]

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        lead = rng.choice("3456") + number(rng.choice((11, 13, 14, 14, 14, 14, 17)))
        digits = lead + next(c for c in "0123456789" if luhn(lead + c))
        if rng.random() < 0.4:
            sep = rng.choice(" -.")
            digits = sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        return digits

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+{rng.randint(20, 99)} {rng.randint(10, 999)} {number(3)} {number(4)}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)}{number(9)}", f"1-800-{b}-{c}", f"0{a} {number(7)}", "0" + " ".join([number(1), *(number(2) for _ in range(4))]), f"+{rng.randint(20, 99)} {number(1)} " + " ".join(number(2) for _ in range(4)), f"{a}.{b}.{c}"))

    def ip() -> str:
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))

    def email() -> str:
        name = "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
        at, dot = rng.choice((("@", "."),) * 5 + ((" (at) ", "."), (" [at] ", " [dot] ")))
        return f"{name}.{number(2)}{at}mail{number(1)}{dot}example{dot}{rng.choice(('com', 'org', 'net', 'de'))}"

    def decoy() -> list[tuple[str, str]]:
        bad = number(rng.choice((13, 16, 16)))
        bad = bad[:-1] + next(c for c in "0123456789" if not luhn(bad[:-1] + c))
        version = f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}"
        key = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((18, 40))))
        return rng.choice((
            [("", "order"), ("", bad)], [("", "version"), ("", version)], [("", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}")],
            [("", f"${number(3)},{number(3)}.{number(2)}")], [("", f"password={key}")], [("", f'token = "{key}"')], [("", f"AKIA{number(6)}XKD{number(7)}")],
            [("", "isbn"), ("", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}")], [("", "invoice"), ("", number(rng.choice((8, 10, 12))))], [("", f"{number(2)}.{number(3)}")],
            [("", " ".join(str(k) for k in range(1, rng.randint(6, 18))))],
            [("", f"{rng.randint(256, 999)}.{number(2)}.{number(2)}.{number(2)}")], [("", "tracking"), ("", number(22))], [("", number(rng.choice((4, 7, 9, 11, 13, 16))))], [("", f"{number(4)} {number(4)}")],
        ))

    parts = filler(rng.randint(1, 4))
    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    hint = {"email": ("email", "contact"), "ip": ("server", "ip"), "card": ("card", "visa"), "phone": ("call", "phone")}
    for _ in range(rng.randint(1, 4)):
        if rng.random() < 0.55:
            kind = rng.choice(KINDS)
            if rng.random() < 0.3:
                parts.append(("", rng.choice(hint[kind])))
            parts.append((kind, makers[kind]()))
        else:
            parts += decoy()
        if rng.random() < 0.6:  # else the next follows at once
            parts += filler(rng.randint(1, 3))
    text, spans = "", []
    for kind, part in parts:
        text += " " if text else ""
        if kind:
            spans.append((kind, len(text), len(text) + len(part)))
        text += part
    return text, spans


class Detector:
    """The trained trees and the threshold of each kind."""

    def __init__(self, examples: int = EXAMPLES, seed: int = SEED) -> None:
        rng = random.Random(seed)
        rows, marks, kinds, fold = [], [], [], []
        for i in range(examples):
            text, truth = _example(rng)
            for span in candidates(text):
                rows.append(features(text, span))
                marks.append(span in truth)
                kinds.append(KINDS.index(span[0]))
                fold.append(i % 3 == 0)
        x, y, k, held = np.array(rows), np.array(marks, dtype=float), np.array(kinds), np.array(fold)
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        p = self.trees.probability(x)
        self.thresholds = [self._threshold(p[held & (k == i)], y[held & (k == i)] > 0) for i in range(len(KINDS))]

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray) -> float:
        """The least cut whose precision on held-out candidates is PRECISION, and at least one half."""
        order = np.argsort(-p, kind="stable")
        precision = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        return max(0.5, float(p[order][good[-1]])) if len(good) else 1.1

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that overlap no base span, the most probable first where they overlap."""
        proposals = [s for s in candidates(text) if not any(s[1] < b and a < s[2] for _, a, b in base)] if len(base) <= 64 else self._free(text, base)
        if not proposals:
            return []
        p = np.concatenate([self.trees.probability(np.array([features(text, s) for s in proposals[i : i + _SLAB]])) for i in range(0, len(proposals), _SLAB)])
        chosen: list[Span] = []
        taken = set()
        for q, s in sorted(zip(p.tolist(), proposals), key=lambda t: (-t[0], t[1][1] - t[1][2], t[1])):
            if q >= self.thresholds[KINDS.index(s[0])] and not taken.intersection(range(s[1], s[2])):
                chosen.append(s)
                taken.update(range(s[1], s[2]))
        return chosen

    @staticmethod
    def _free(text: str, base: list[Span]) -> list[Span]:
        taken = set()
        for _, a, b in base:
            taken.update(range(a, b))
        return [s for s in candidates(text) if not taken.intersection(range(s[1], s[2]))]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The base spans, and all spans by kind and start."""
        base = base_spans(text)
        if not _HINT.search(text) and "[" not in text and "(" not in text:
            return base, base
        rank = {k: i for i, k in enumerate(KINDS)}
        return base, sorted(base + self.added(text, base), key=lambda s: (rank[s[0]], s[1], s[2]))


@functools.lru_cache(maxsize=2)
def detector(examples: int = EXAMPLES, seed: int = SEED) -> Detector:
    return Detector(examples, seed)


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans (all), n_added."""
    sent = docs.sparkSession.sparkContext.broadcast(detector())

    def work(batch: pa.RecordBatch) -> dict:
        found = [sent.value.spans(t or "") for t in column(batch, "text").to_pylist()]
        counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
        return counts | {"doc_id": column(batch, "doc_id"), "base_sha256": [hashlib.sha256(write_spans(base).encode()).hexdigest() for base, _ in found], "spans": [write_spans(every) for _, every in found], "n_added": [len(every) - len(base) for base, every in found]}

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of text replaced by [KIND]; null texts stay null."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(detector())
    where = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t if t is None else masked(t, sent.value.spans(t)[1]) for t in batch.column(where).to_pylist()]
            columns = list(batch.columns)
            columns[where] = pa.array(texts, type=batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
