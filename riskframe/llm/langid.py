"""Language identification of mixed-language text (operator 3).

Words are runs of letters.  A word's script (by code-point ranges) narrows its candidate languages to
those that were seen in that script; each candidate scores the word by its character trigrams.  A
Viterbi pass over the words of a text, with a penalty for each switch, labels spans; the language
with most letters is the text's, and its share of letters the score.

Trigram counts come from all training texts: each task counts hashed trigrams by language, Spark sums
them, and the driver gets at most BUCKETS numbers a language.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text where
nothing could be learned; ties go to the smaller language code; texts of any length are labelled
whole; a null lang is not learned from; rows that repeat or have null ids give a row each; an empty
table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store, words
from riskframe.llm.token_files import mixed

BUCKETS = 1 << 16
#: nats that a switch of language costs; texts with more words are walked one by one; letters share that ties a language to a script
SWITCH, LONG, SCRIPT_SHARE = 6.0, 1500, 0.01
# Fixed values of the Unicode standard: where the blocks of scripts begin.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0x20000, "han"), (0x32400, "other"),
]
_FROM = np.array([start for start, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])
_tables: list[np.ndarray] = []


def _characters() -> list[np.ndarray]:
    """Whether a code point is a letter, and its lower case; no letter stands above the last one of the table."""
    if not _tables:
        every = [chr(c) for c in range(0x32401)]
        _tables.append(np.array([c.isalpha() for c in every]))
        _tables.append(np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], np.uint32))
    return _tables


class Words:
    """The words of some texts: trigram buckets of their letters, scripts, places."""

    def __init__(self, texts: list[str | None]):
        alpha, lower = _characters()
        lengths = np.array([len(t or "") + 1 for t in texts], np.int64)
        chars = np.frombuffer("".join((t or "") + "\n" for t in texts).encode("utf-32-le", "replace"), "<u4")
        chars = np.minimum(chars, len(alpha) - 1)
        letter = alpha[chars]
        low = np.where(letter, lower[chars], 0).astype(np.uint64)
        around = np.concatenate((np.zeros(1, np.uint64), low, np.zeros(1, np.uint64)))
        at = np.flatnonzero(letter)
        key = (around[at] << np.uint64(42)) | (around[at + 1] << np.uint64(21)) | around[at + 2]
        self.bucket = (mixed(key, 1) >> np.uint64(48)).astype(np.int64)
        self.first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        self.letters = np.diff(np.append(self.first, len(at)))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths)))
        self.starts = at[self.first]
        self.script = _SCRIPT[np.searchsorted(_FROM, chars[self.starts], side="right") - 1]
        #: which words are a text's
        self.bounds = np.searchsorted(self.starts, self.text_starts)


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: (BUCKETS, languages); scripts: letters by (script, language)."""
        self.languages = languages
        totals = counts.sum(0)
        self.log = np.log((counts + 0.1) / (totals + 0.1 * BUCKETS)).astype(np.float32)
        near = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0))
        near[~near.any(1)] = True
        self.banned = np.where(near, 0, -1e6).astype(np.float32)

    def word_scores(self, w: Words) -> np.ndarray:
        if not len(w.first):
            return np.zeros((0, len(self.languages)), np.float32)
        return np.add.reduceat(self.log[w.bucket], w.first, axis=0) + self.banned[w.script]

    def label(self, w: Words) -> np.ndarray:
        """The language of each word, on the best path of its text."""
        scores, labels = self.word_scores(w), np.zeros(len(w.first), np.int64)
        sizes = np.diff(w.bounds)
        for k in np.flatnonzero(sizes > LONG):
            labels[w.bounds[k] : w.bounds[k + 1]] = _path(scores[w.bounds[k] : w.bounds[k + 1]])
        order = np.argsort(-sizes, kind="stable")
        order = order[(sizes[order] > 0) & (sizes[order] <= LONG)]
        if len(order):
            self._side_by_side(scores, labels, w.bounds[:-1][order], sizes[order])
        return labels

    def _side_by_side(self, scores: np.ndarray, labels: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        """Viterbi over many texts at once, longest first, one word of each a step."""
        stays, source = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int64)
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        best = scores[first].copy()
        for t in range(1, sizes[0]):
            n = active[t]
            now = first[:n] + t
            d = best[:n]
            top = d.argmax(1)
            moved = d[np.arange(n), top][:, None] - SWITCH
            stays[now], source[now] = d >= moved, top
            best[:n] = np.maximum(d, moved) + scores[now]
        last = best.argmax(1)
        for t in range(sizes[0] - 1, -1, -1):
            n = active[t]
            now = first[:n] + t
            labels[now] = last[:n]
            last[:n] = np.where(stays[now, last[:n]], last[:n], source[now])


def _path(scores: np.ndarray) -> np.ndarray:
    """Viterbi over one long text."""
    d, back, languages = scores[0].tolist(), [], range(scores.shape[1])
    for s in scores[1:].tolist():
        top = max(d)
        moved, k = top - SWITCH, d.index(top)
        back.append([x if d[x] >= moved else k for x in languages])
        d = [(a if a >= moved else moved) + b for a, b in zip(d, s, strict=True)]
    out = [d.index(max(d))]
    for row in reversed(back):
        out.append(row[out[-1]])
    return np.array(out[::-1])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts over all given rows whose language isn't null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.kept("langid")
        held: dict[str, np.ndarray] = {}
        for batch in words.slices(batches, "text", 2 << 20):
            labels, texts = np.array(batch["lang"].to_pylist(), object), np.array(batch["text"].to_pylist(), object)
            for name in set(labels):
                w = Words(texts[labels == name].tolist())
                own = held.setdefault(name, np.zeros(BUCKETS + len(_NAMES), np.int64))
                own[:BUCKETS] += np.bincount(w.bucket, minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(w.script, w.letters, len(_NAMES)).astype(np.int64)
        for name, own in held.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(own[used])], ["lang", "bucket", "n"])

    rows = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    found = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    counts[np.asarray(found["bucket"]), [languages.index(x) for x in found["lang"].to_pylist()]] = np.asarray(found["n"])
    return LanguageModel(languages, counts[:BUCKETS], counts[BUCKETS:])


def _labelled(model: LanguageModel, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    words.kept("langid")
    for batch in words.slices(batches, "text", max(1 << 16, (6 << 20) // (1 + len(model.languages)))):
        w = Words(batch["text"].to_pylist())
        yield batch, w, model.label(w) if model.languages else np.zeros(len(w.first), np.int64)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, lang_pred and score of every row; carried ones of these names get ``_in`` behind them."""
    names_out = [c + "_in" if c in ("lang_pred", "score") else c for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(1, len(model.languages))
        for batch, w, labels in _labelled(model, batches):
            rows = batch.num_rows
            of = np.repeat(np.arange(rows), np.diff(w.bounds))
            letters = np.bincount(of * n + labels, w.letters, rows * n).reshape(rows, n)
            top, whole = letters.argmax(1), letters.sum(1)
            some = (whole > 0) & bool(model.languages)
            names = [model.languages[k] if s else "und" for k, s in zip(top, some, strict=True)]
            share = np.where(some, letters[np.arange(rows), top] / np.maximum(1, whole), 0.0)
            kept = [batch[c] for c in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(share)], [*names_out, "lang_pred", "score"])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)), F.col(f"`{text}`").alias("text"))
    fields = [f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names_out, carry, strict=True)]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double"]))


def language_spans(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, end (code points, from a span's first word to the next span's), lang: the spans of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w, labels in _labelled(model, batches):
            of = np.repeat(np.arange(batch.num_rows), np.diff(w.bounds))
            new = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0)) if model.languages else np.empty(0, np.int64)
            starts = w.starts[new] - w.text_starts[of[new]]
            same = np.append(of[new][1:], -1) == of[new]
            ends = np.where(same, np.append(starts[1:], 0), np.diff(w.text_starts)[of[new]] - 1)
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(of[new])), pa.array(starts), pa.array(ends), pa.array([model.languages[k] for k in labels[new]], pa.string())], [key, "start", "end", "lang"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, end long, lang string")


def held_out_quarter(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts labelled by a model of the documents whose crc32 of the id leaves no 2 by 4."""
    docs = store.table(spark, sf_dir, "documents")
    held = held_out_quarter(F.col("doc_id"))
    return predict(docs, train(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
