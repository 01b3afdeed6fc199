"""Personal data: patterns, and a character-level BiLSTM-CRF that adds what they miss (operator 10).

The base finds e-mail addresses, IPv4 addresses, payment cards and phone numbers by linear-time
patterns and checks (parts up to 255, Luhn, numbers of digits).  Its spans in a bounded sample of
windows (TRAIN_WINDOWS of the corpus, in the order of a hash; a documented parameter), some of them
rewritten in forms that the patterns don't cover, and drawn examples from grammars of each kind
(DRAWN of them) train a bidirectional LSTM with CRF transitions, in numpy.  Besides the four kinds
the tagger learns secrets (keys, tokens, passwords), which are told apart from personal data.

The tagger reads texts in overlapping windows.  Spans of all windows of a text are reconciled
together: those of one kind that touch or overlap become one, base spans come first, then longer
ones, and what overlaps an accepted span goes.  An added span must pass the check of its kind, which
looks at what the span says (digits and Luhn, four parts up to 255, a name, an at sign or word and a
domain) and not at how it is written.

An added span must hold a digit, an at sign, a bracketed "at" or the word "dot" of its text (a trigger).
Windows with a trigger are read first, then those that a found span meets or touches, until there is
no such window left; windows that are never read can't be part of an accepted span, so the result is
that of reading all windows (tested, also on long entities; ``every=True`` reads all).  A span that ends
inside a word takes on the rest of it.

Defined results: a null text is the empty text and has no spans; texts of any length are read whole;
rows that repeat or have null ids give a row each; an empty table gives an empty result; without any
text to learn from the tagger is trained on the drawn examples alone.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store, words
from riskframe.llm.tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
#: what the tagger tells apart: the kinds, and secrets
TAGS = (*KINDS, "secret")
#: characters of a window and of what two windows share, and of a window that trains; windows of the corpus and drawn ones that train
WINDOW, SHARED, LEARNT, TRAIN_WINDOWS, DRAWN = 96, 48, 72, 800, 7000
#: parts of the training windows that train side by side, and how often
SHARDS, EPOCHS = 4, 14
#: the tags of drawn examples, in turn: more of those with many forms
TURNS = (0, 3, 1, 0, 3, 2, 0, 3, 1, 4)
Span = tuple[int, int, int]  # start, end, kind

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BASIC = re.compile(r"[0-9@]")
#: What every accepted span holds.
_TRIGGER = re.compile(r"(?i)[0-9@]|[\[({<]\s?at\b|\bdot\b")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid(kind: int, text: str) -> bool:
    if kind == 1:
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))
    digits = _digits(text)
    return kind == 0 or (kind == 2 and 12 <= len(digits) <= 19 and luhn(digits)) or (kind == 3 and 9 <= len(digits) <= 15)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its check, ordered by start and kind."""
    if not _BASIC.search(text):
        return []
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        # the local part is the run of its characters that ends at the sign, after the last match
        start = at
        while start > done and _LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), 0))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


# Character classes: letters without case, digits as one, the rest of ASCII alone, other letters, others.
_CLASS = np.full(128, 1, np.int16)
for _c in range(128):
    _x = chr(_c)
    _CLASS[_c] = ord(_x.lower()) - 93 if _x.isalpha() else 2 if _x.isdigit() else 3 if _x in "\t\n\r" else 30 + " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".find(_x) if _c >= 32 and _c < 127 else 1
CLASSES, LABELS = 30 + 34, 1 + 2 * len(TAGS)


def _classes(text: str) -> np.ndarray:
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(chars < 128, _CLASS[np.minimum(chars, 127)], 0)


def _labels(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int8)
    for start, end, kind in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


class Grammar:
    """Draws entities of each kind in many forms. ``held_out`` draws only forms that training never sees."""

    def __init__(self, rng: random.Random, held_out: bool = False):
        self.rng, self.held_out = rng, held_out

    def _pick(self, seen: list, unseen: list):
        return self.rng.choice(unseen if self.held_out else seen)

    def _number(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def _word(self, a: int, b: int, letters: str = "abcdefghijklmnoprstuvwyz") -> str:
        return "".join(self.rng.choice(letters) for _ in range(self.rng.randint(a, b)))

    def _cut(self, digits: str, sizes: list[int], between: str) -> str:
        ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
        return between.join(digits[e - n : e] for e, n in zip(ends, sizes, strict=True) if digits[e - n : e])

    def email(self, name: str = "", host: str = "") -> str:
        rng = self.rng
        name = name or self._word(1, 9) + rng.choice(["", ".", "_", "-"]) + rng.choice(["", self._word(1, 7), self._number(2)])
        name = name.rstrip("._-")
        host = host or rng.choice(["mail.", "", "", f"mail{self._number(1)}."]) + self._word(3, 9) + "." + rng.choice(["com", "org", "net", "co.uk", "de", "example.com", "fr", "info"])
        at = self._pick([" @ ", "@ ", " @", "[at]", "(at)", " (at) ", " [at] ", *[" at ", " AT "] * 3], ["{at}", " {at} ", "<at>", " [ at ] "])
        dot = rng.choice([" dot ", " DOT "]) if at.strip().lower() == "at" else rng.choice([".", ".", "[dot]", "(dot)", " dot ", " . "] if "@" not in at else [".", ".", " . ", ". "])
        return name.replace(".", dot if rng.random() < 0.3 else ".") + at + host.replace(".", dot)

    def ip(self, text: str = "") -> str:
        if not text and self.rng.random() < 0.15 and not self.held_out:
            return ":".join(f"{self.rng.randrange(1 << 16):x}" for _ in range(8))
        text = text or ".".join(str(self.rng.randint(0, 255)) for _ in range(4))
        return text.replace(".", self._pick([" . ", ". ", " .", "[.]", "(.)", ",", ":"], [" [.] ", "{.}", " dot ", "_"]))

    def card(self, digits: str = "") -> str:
        n = self.rng.choice([12, 15, 16, 16, 16, 16, 18, 19])
        stem = self._number(n - 1)
        digits = digits or next(stem + str(k) for k in range(10) if luhn(stem + str(k)))
        sizes = [4, 6, 5] if len(digits) == 15 and self.rng.random() < 0.5 else [4] * 5
        return self._cut(digits, sizes, self._pick([".", "  ", "_", "/", " - ", ". ", ", "], ["--", " . ", ":", " / "]))

    def phone(self, digits: str = "") -> str:
        rng = self.rng
        d = digits or self._number(rng.choice([10, 10, 10, 11, 11, 9]))
        if len(d) == 10 and rng.random() < 0.7:
            a, b, c = d[:3], d[3:6], d[6:]
            seen = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", *[f"{a}.{b}.{c}"] * 5, f"({a}) {b} {c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"{a} {b}-{c}", f"1 ({a}) {b}-{c}", f"001 {a} {b} {c}"]
            return self._pick(seen, [f"{a}/{b}/{c}", f"({a}) {b}.{c}", f"{a} - {b} - {c}", f"1.{a}.{b}.{c}", f"[{a}] {b}-{c}"])
        sizes = rng.choice([[2, 2, 7], [2, 2, 7], [2, 3, 6], [2, 3, 3, 4], [3, 4, 4], [4, 6], [3, 2, 2, 2, 2], [5, 5, 2], [2, 2, 2, 2, 2, 2]])
        return self._pick(["00", "00", "0", ""], ["00 ", "0-"]) + self._cut(d, sizes, rng.choice([" ", "-", ".", "/", " "]))

    def secret(self) -> str:
        kinds = ["0123456789abcdef"] * 3 + ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789_-"]
        n = self.rng.choice([20, 24, 32, 40, 40])
        return self._pick(["", "", "", "sk-", "ghp_", "AKIA", "AKIA", "xoxb-"], ["pk_", "glpat-"]) + self._word(n, n, self.rng.choice(kinds))

    def plain(self, kind: int) -> str:
        """An entity as the base patterns write it."""
        rng = self.rng
        if kind == 0:
            return f"{self._word(1, 9)}.{self._number(2)}@mail{self._number(1)}.example.com" if rng.random() < 0.3 else f"{self._word(2, 9)}{rng.choice(['', '.', '_', '+'])}{self._word(1, 6)}@{self._word(3, 9)}.{rng.choice(['com', 'org', 'net', 'co.uk', 'de'])}"
        if kind == 1:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            stem = self._number(rng.choice([12, 15, 15, 15, 18]))
            digits = next(stem + str(k) for k in range(10) if luhn(stem + str(k)))
            return rng.choice(["", " ", "-"]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
        return f"+{rng.randint(1, 99)}{rng.choice([' ', ' (', '-'])}{self._number(3)}{rng.choice([' ', ') ', '-'])}{self._number(3)}{rng.choice([' ', '-', '.'])}{self._number(4)}"

    def other(self, kind: int, text: str = "") -> str:
        """An entity (the one of ``text``, if given) in a form that the base patterns don't cover."""
        digits = _digits(text)
        if kind == 0:
            return self.email(*text.split("@", 1)) if "@" in text else self.email()
        return self.ip(text) if kind == 1 else self.card(digits) if kind == 2 else self.phone(digits[-10:]) if kind == 3 else self.secret()

    def lead(self, kind: int) -> str:
        """Words before an entity."""
        if kind == 4:
            return self.rng.choice(["token", "key", "secret", "api_key", "password", "auth", "TOKEN", "access token"]) + self.rng.choice([" = ", "=", ": ", " "]) + self.rng.choice(['"', '"', "'", ""])
        words = [["mail ", "write to ", "contact: "], ["ip ", "from ", "host "], ["card ", "paid with "], ["tel ", "call ", "phone: "]][kind]
        return self.rng.choice(words) if self.rng.random() < 0.3 else self.rng.choice(["", "", "", "(", '"', "- "])

    def nothing(self) -> str:
        """Numbers and signs that are no entity."""
        rng = self.rng
        return rng.choice([
            str(rng.randint(0, 99999)), f"{rng.randint(1, 99)}.{rng.randint(0, 99)}", f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2030)}",
            f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"Version {rng.randint(1, 9)}.0.", f"CC BY {rng.randint(1, 4)}.0", f"@{self._word(3, 8)}", f"{rng.randint(1, 12)}:{rng.randint(0, 59):02}", f"${rng.randint(1, 999)},{rng.randint(0, 999):03}.{rng.randint(0, 99):02}",
            self._number(rng.choice([5, 6, 7, 8, 16, 16, 17, 20])), f"{rng.randint(1, 99)} {rng.randint(1, 99)} {rng.randint(1, 999)}", f"dot {self._word(2, 6)} at {self._word(2, 8)}", f"{rng.randint(1, 9)}, {rng.randint(1, 9)}, {rng.randint(1, 9)} and {rng.randint(10, 99)}", f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}",
            f"{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)} {self._word(3, 8)}", f"<{self._word(1, 4)}>", f"no. {rng.randint(1, 9999)}/{rng.randint(1, 99)}",
        ])


def _example(before: str, entity: str, kind: int, after: str, rng: random.Random) -> tuple[str, np.ndarray]:
    room = max(0, LEARNT - len(entity))
    left = rng.randint(min(0, room), room)
    before = before[len(before) - left :] if left <= len(before) else before
    # some spans are cut by a window's edge
    whole = LEARNT + 8 * (len(before) % 3)
    cut = max(0, min(len(before + entity + after), whole) - LEARNT)
    start, end = max(0, len(before) - cut), min(max(0, len(before) + len(entity) - cut), LEARNT)
    spans = [(start, end, kind)] if kind >= 0 and end > start else []
    return (before + entity + after)[:whole][-LEARNT:].ljust(LEARNT), _labels(LEARNT, spans)


def _sample(docs: DataFrame, text: str, windows: int) -> list:
    """Windows of the corpus in the order of a hash, at most ``windows`` around a base span and as many without one."""
    order = lambda r: (r[0], r[1], r[3], r[2], r[4])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[set, set] = (set(), set())
        words.kept("pii")
        for batch in words.slices(batches, "text"):
            for k, x in zip(batch["mark"].to_pylist(), batch["text"].to_pylist(), strict=True):
                x = x or ""
                spans = base_spans(x)
                for n, (a, b, kind) in enumerate(spans):
                    clear = max([0, *(e for _, e, _ in spans[max(0, n - 9) : n])]), min([len(x), *(s for s, _, _ in spans[n + 1 : n + 2])])
                    held[1].add((k, kind, x[max(clear[0], a - WINDOW) : a], x[a:b][:WINDOW], x[b : max(b, min(clear[1], b + WINDOW))]))
                if not spans and x:
                    at = k % max(1, len(x) - WINDOW)
                    held[0].add((k, -1, "", x[at : at + WINDOW], ""))
            # a task keeps no more than the whole sample needs
            for own in held:
                if len(own) > windows:
                    least = sorted(own, key=order)[:windows]
                    own.clear()
                    own.update(least)
        out = sorted(held[0]) + sorted(held[1])
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.string()] * 3), strict=True)], ["mark", "kind", "before", "entity", "after"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    found = store.keep(rows.mapInArrow(cut, "mark long, kind int, before string, entity string, after string"))
    named = ["mark", "kind", "entity", "before", "after"]
    some = [r for clean in ("kind < 0", "kind >= 0") for r in found.where(clean).distinct().orderBy(*named).limit(windows).collect()]
    store.discard(found)
    return some


def train(docs: DataFrame, text: str = "text", windows: int = TRAIN_WINDOWS, drawn: int = DRAWN, epochs: int = EPOCHS, hidden: int = 24) -> Tagger:
    """Labelled windows of the corpus, at most ``windows`` with a span and as many without, and ``drawn`` ones.

    The SHARDS parts of these train in tasks side by side.
    """
    return train_on(_sample(docs, text, windows), drawn, epochs, hidden, docs.sparkSession)


def train_on(some: list, drawn: int = DRAWN, epochs: int = EPOCHS, hidden: int = 24, spark: SparkSession | None = None, batch: int = 64, rate: float = 0.025, shards: int = SHARDS) -> Tagger:
    """some: rows (mark, kind or -1, text before, entity, text after); without ``spark`` the shards train one after the other."""
    rng, examples = random.Random(5), []
    grammar = Grammar(rng)
    plain = [r[3] for r in some if r[1] < 0 and not _TRIGGER.search(r[3])] or ["some words of no interest, a few of them. " * 3]
    for _, kind, before, entity, after in some:
        if kind >= 0 and rng.random() < 0.5:
            entity = grammar.other(kind, entity)
        examples.append(_example(before, entity, kind, after, rng))
    for k in range(drawn):
        kind = TURNS[k % len(TURNS)]
        entity = grammar.plain(kind) if kind < 4 and rng.random() < 0.25 else grammar.other(kind)
        lead = grammar.lead(kind)
        ends = {"(": ")"}.get(lead, lead[-1]) if lead and lead[-1] in "\"'(" else ""
        before, after = rng.choice(plain) + " " + lead, ends + rng.choice([" ", " ", " ", ". ", ", ", "! ", "*** ", ";", "\n"]) + rng.choice(plain)
        examples.append(_example(before, entity, kind, after, rng))
        if k % 2 == 0:
            examples.append(_example(rng.choice(plain) + " ", grammar.nothing(), -1, rng.choice([" ", ". ", ", "]) + rng.choice(plain), rng))
    tagger = Tagger(CLASSES, LABELS, hidden)
    tagger.fit_together(np.stack([_classes(t) for t, _ in examples]), np.stack([y for _, y in examples]), shards, epochs, batch, rate, spark)
    return tagger


def _triggers(text: str) -> list[tuple[int, int]]:
    """Where a text holds what an accepted span needs, in order."""
    return [m.span() for m in _TRIGGER.finditer(text)]


def _pieces(tagger: Tagger, texts: list[str], cut: list[tuple[int, int]], size: int) -> list[tuple[int, Span]]:
    """(text, span) of every span of the windows ``cut``, each a text and a window's number."""
    step, out = WINDOW - SHARED, []
    for first in range(0, len(cut), size):
        own = cut[first : first + size]
        labels = tagger.decode(np.stack([_classes(texts[k][n * step : n * step + WINDOW].ljust(WINDOW)) for k, n in own]))
        for (k, n), row in zip(own, labels, strict=True):
            if not row.any():
                continue
            kinds = np.where(row > 0, (row - 1) >> 1, -1)
            starts = np.flatnonzero((kinds >= 0) & ((np.diff(kinds, prepend=-1) != 0) | (row % 2 == 1)))
            for s in starts:
                e = s + 1
                while e < WINDOW and kinds[e] == kinds[s] and row[e] % 2 == 0:
                    e += 1
                at = n * step
                if at + s < len(texts[k]):
                    out.append((k, (at + int(s), min(at + int(e), len(texts[k])), int(kinds[s]))))
    return out


def _joined(spans: set[Span]) -> list[Span]:
    """Spans of one kind that touch or overlap are one."""
    out: list[list[int]] = []
    for s, e, kind in sorted(spans, key=lambda v: (v[2], v[0])):
        if out and out[-1][2] == kind and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, kind])
    return [tuple(v) for v in out]


def _read(tagger: Tagger, texts: list[str], triggers: list[list[tuple[int, int]]], size: int = 1024, every: bool = False) -> list[list[Span]]:
    """Spans of the tagger in each text, windows joined.

    First the windows that hold a trigger are read; then, again and again, those that a span which was
    found meets or touches and which weren't read.  A joined span that holds a trigger is made of
    pieces that touch, one of them with the trigger, so all of its windows are read in the end.
    """
    step = WINDOW - SHARED
    last = [max(0, (len(t) - SHARED - 1) // step) for t in texts]  # windows that hold more than the one before
    within = lambda k, a, b: range(max(0, (a - WINDOW) // step + 1), min(last[k], b // step) + 1)
    if every:
        due = {(k, n) for k in range(len(texts)) for n in range(last[k] + 1)}
    else:
        due = {(k, n) for k, own in enumerate(triggers) for a, _ in own for n in within(k, a, a)}
    seen: set[tuple[int, int]] = set()
    found: list[set[Span]] = [set() for _ in texts]
    while due:
        seen |= due
        told = _pieces(tagger, texts, sorted(due), size)
        for k, span in told:
            found[k].add(span)
        due = {(k, n) for k, (s, e, _) in told for n in within(k, s - 1, e)} - seen
    return [_joined(spans) for spans in found]


_AT = re.compile(r"(?i)\s*(?:@|[\[({<]\s?at\s?[\])}>])\s*|\s+at\s+")
_DOT = re.compile(r"(?i)\s*[\[({<]\s?(?:dot|\.)\s?[\])}>]\s*|\s+dot\s+|\s*\.\s*")


def _acceptable(kind: int, text: str) -> bool:
    """The check of an added span: what it says, however it is written."""
    if kind == 0:
        parts = _AT.split(text)
        if len(parts) != 2:
            return False
        name, host = (_DOT.sub(".", p).strip() for p in parts)
        return bool(_LOCAL.fullmatch(name)) and bool(_DOMAIN.fullmatch(host)) and host.rpartition(".")[2].isalpha()
    if kind == 1:
        if text.count(":") > 3:
            try:
                return bool(_digits(text)) and ipaddress.ip_address(text).version == 6
            except ValueError:
                return False
        return bool(re.fullmatch(r"(?i)[0-9]+(?:(?:[^0-9a-z]{1,5}|\s+dot\s+)[0-9]+){3}", text)) and _valid(1, ".".join(re.findall(r"[0-9]+", text)))
    if kind == 4:
        return len(text) >= 16 and not re.search(r"\s", text) and bool(re.search(r"[0-9]", text)) and bool(re.search(r"[A-Za-z]", text))
    return not re.search(r"[^\W\d_]", text) and bool(re.search(r"[0-9]", text)) and _valid(kind, text)


#: Characters that a span of each kind takes on where it would end inside a run of them; at most REACH of them.
_INSIDE, REACH = tuple(re.compile(x) for x in (r"[A-Za-z0-9_%+-]", r"[0-9A-Fa-f]", r"[0-9]", r"[0-9]", r"[A-Za-z0-9_-]")), 320
_AT_BEFORE = re.compile(r"(?i)(?:\s*(?:@|[\[({<]\s?at\s?[\])}>])|\s+at(?=\s))\s*\Z")
_AT_FIRST = re.compile(r"(?i)(?:@|[\[({<]\s?at\s?[\])}>]|at\s)")
_DOTTED = r"(?:\s*[\[({<]\s?(?:dot|\.)\s?[\])}>]\s*|\s+dot\s+|\s*\.\s*)"
_NAME_LAST = re.compile(rf"(?i)[A-Za-z0-9._%+-]+(?:(?!\s*\.\s){_DOTTED}[A-Za-z0-9_%+-]+)*\Z")
_HOST_FIRST = re.compile(rf"(?i)[A-Za-z0-9-]+(?:{_DOTTED}[A-Za-z0-9-]+)+")


def _snapped(text: str, start: int, end: int, kind: int) -> tuple[int, int]:
    """The span without blanks and stops at its ends, and with the rest of the words that it cuts.

    An e-mail address also takes on what a dot joins to its ends and, where the sign comes first or stands
    before it, the name; a phone number the bracket or plus before it.
    """
    while start < end and text[start] in " \n\t.,;:\"'":
        start += 1
    while end > start and text[end - 1] in " \n\t.,;:\"'":
        end -= 1
    if start >= end:
        return start, start
    inside, low, high = _INSIDE[kind], max(0, start - REACH), min(len(text), end + REACH)
    joins = lambda at: kind == 0 and 0 < at < len(text) - 1 and text[at] == "." and inside.match(text[at - 1]) and inside.match(text[at + 1])

    def leftwards(at: int) -> int:
        while at > low and (inside.match(text[at - 1]) or joins(at - 1)):
            at -= 1
        return at

    if inside.match(text[start]) and not (kind == 0 and _AT_FIRST.match(text, start) and start and text[start - 1].isspace()):
        start = leftwards(start)
    if kind == 0:
        if m := _AT_BEFORE.search(text, low, start):
            start = leftwards(m.start())
        elif _AT_FIRST.match(text, start):
            k = start
            while k > low and text[k - 1].isspace():
                k -= 1
            start = leftwards(k)
    if inside.match(text[end - 1]):
        while end < high and (inside.match(text[end]) or joins(end)):
            end += 1
    if kind == 3 and start > 0 and text[start - 1] in "(+" and (text[start - 1] == "+" or ")" in text[start:end]) and "(" not in text[start:end]:
        start -= 1
    return start, end


def _settled(text: str, span: Span) -> Span | None:
    """The span that an added one stands for, if it passes a check.

    Of an address only name, sign and domain stay; a number that is none of its kind may be one of another.
    """
    start, end = _snapped(text, *span)
    own, kind = text[start:end], span[2]
    if kind == 0:
        for m in _AT.finditer(own):
            name, host = _NAME_LAST.search(own, 0, m.start()), _HOST_FIRST.match(own, m.end())
            if name and host and _acceptable(0, own[name.start() : host.end()]):
                return start + name.start(), start + host.end(), 0
        return None
    for k in (kind, *({2: (3,), 3: (2,)}.get(kind, ()))):
        if own and _acceptable(k, own):
            return start, end, k
    return None


def reconcile(text: str, base: list[Span], added: list[Span], triggers: list[tuple[int, int]]) -> list[Span]:
    """Base spans, then added ones that hold a trigger, pass their check and overlap nothing accepted; longer ones first."""
    taken = list(base)
    starts, ends = [], []  # what is covered, as intervals apart from each other
    for s, e, _ in sorted(base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    settled = {v for span in added if (v := _settled(text, span))}
    for s, e, kind in sorted(settled, key=lambda v: (v[0] - v[1], v)):
        k, t = bisect.bisect_right(ends, s), bisect.bisect_left(triggers, (s, 0))
        if (k == len(starts) or starts[k] >= e) and t < len(triggers) and triggers[t][1] <= e:
            taken.append((s, e, kind))
            starts.insert(k, s)
            ends.insert(k, e)
    return sorted(taken, key=lambda v: (v[0], v[2]))


def find_spans(tagger: Tagger, texts: list[str | None], every: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; secrets are among all spans."""
    whole = [t or "" for t in texts]
    base, triggers = [base_spans(t) for t in whole], [_triggers(t) for t in whole]
    hot = [k for k in range(len(whole)) if every or triggers[k]]
    read = dict(zip(hot, _read(tagger, [whole[k] for k in hot], [triggers[k] for k in hot], every=every), strict=True))
    return [(b, reconcile(whole[k], b, read[k], triggers[k]) if k in read else b) for k, b in enumerate(base)]


def _told(spans: list[Span]) -> str:
    return ",".join(f"{TAGS[kind]}:{s}:{e}" for s, e, kind in spans)


def detect(docs: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans, n_added of them by the
    tagger, the secrets, and n_found, the number of spans and secrets, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "secrets", "n_found"]
    kinds = [*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.kept("pii")
        for batch in words.slices(batches, "text"):
            out = []
            for base, every in find_spans(sent.value, batch["text"].to_pylist()):
                personal, secrets = [s for s in every if s[2] < len(KINDS)], [s for s in every if s[2] == len(KINDS)]
                counts = [sum(s[2] == k for s in base) for k in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(_told(base).encode()).hexdigest(), _told(personal), len(personal) - len(base), _told(secrets), len(every)))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch["key"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, *names])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    told = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, kinds, strict=True))
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, {told}")


def redact(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """The same rows with every span and secret of ``text`` replaced by its kind in angle brackets. A null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.kept("pii")
        for batch in words.slices(batches, text):
            out = []
            for x, (_, spans) in zip(batch[text].to_pylist(), find_spans(sent.value, batch[text].to_pylist()), strict=True):
                parts, at = [], 0
                for s, e, kind in spans:
                    if s >= at:
                        parts += [x[at:s], f"<{TAGS[kind]}>"]
                    at = max(at, e)
                out.append("".join([*parts, x[at:]]) if spans else x)
            k = batch.schema.names.index(text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: the base patterns and what the tagger adds."""
    docs = store.table(spark, sf_dir, "documents")
    return detect(docs, train(docs))
