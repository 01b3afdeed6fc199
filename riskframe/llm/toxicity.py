"""Toxic passages by maximum-scoring segments of token log-odds (operator 13).

Tokens are runs of letters in lower case.  A token is judged by the longest of its features that the
lexicon holds: prefixes of PREFIXES letters, and the whole word.

Learning.  Toxic documents tell in how many different surroundings a word stands: different words
before it and different words after it, the smaller number, so that copies and passages that repeat
say what one of them says.  The others tell how often it stands there.  From the root down, a feature
enters the lexicon if its share of toxic uses differs from that of its nearest ancestor there by more
than chance among all features (likelihood ratio); below the root it may be more or less toxic, at the
root only more.  Its share has a Dirichlet prior centred on the ancestor's, and its score is the log of
the odds over those of any token.  All other tokens score slightly below zero: what they are less
frequent in toxic text.

Search.  Every maximal scoring segment of a text is found in one scan (Ruzzo and Tompa).  The number of
segments that reach a score S by chance in n tokens is about K n exp(-lambda S): lambda from the
distribution of scores in clean text, K from the segments that clean training documents have.  A
segment is significant where at most SIGNIFICANT are expected.  The logs of how much rarer than one a
text's significant segments are, summed, become a probability by the rising curve that fits the labels of all training
documents best (counts by label in a fixed number of bins, adjacent violators pooled).

Scale: texts to score are read where they lie; those to learn from meet their labels by one shuffle and are
kept while they are read three times; word counts are summed in tasks before they are shuffled; hot words
spread over their surroundings; the driver gets the lexicon, whose features each differ from chance, and
the bins.

Defined results: a null or empty text, or one without letters, has no passage and the score of such
texts; without a toxic or without a clean training document nothing is learned, and every score is the
share of toxic training documents (0 without any); a null label or id is not learned from; a document with
several labels is toxic if one of them says 1; rows that repeat give a row each; an empty table gives an
empty result; other columns are not touched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store, words
from riskframe.llm.token_files import mixed

PREFIXES = (3, 4, 5, 6)
#: clean segments from which the tail is told
ENOUGH = 10
#: rows that a prior stands for; passages expected by chance at most; widest and number of bins of the statistic
PRIOR, SIGNIFICANT, WIDEST, BINS = 2.0, 0.05, 40.0, 320
#: what a token without a feature scores at most; how much likelier in toxic text a toxic feature is at least
DRIFT, EFFECT = -0.005, 3.0
#: what each repetition tells
REPEATED = 1 / 3
_RUNS = re.compile(r"[^\W\d_]+")


def runs(chunk: str) -> list[str]:
    """The letter runs of what stands between blanks, in lower case."""
    return [chunk.lower()] if chunk.isalpha() else [r.lower() for r in _RUNS.findall(chunk)]


def features_of(word: str) -> list[str]:
    """From the shortest to the whole word, which a blank ends."""
    return [word[:k] for k in PREFIXES if len(word) >= k] + [word + " "]


@dataclass(frozen=True)
class ToxicityModel:
    """scores: of features; drift: of all other tokens; tail: (lambda, log K); curve: (statistics, probabilities), both rising."""

    scores: dict[str, float]
    drift: float = DRIFT
    tail: tuple[float, float] = (1.0, 0.0)
    curve: tuple[tuple[float, ...], tuple[float, ...]] = ((0.0,), (0.0,))
    share: float = 0.0

    def token_score(self, chunk: str) -> float:
        """The highest score of a chunk's words; nan where none has a feature."""
        best = math.nan
        for word in runs(chunk):
            for f in reversed(features_of(word)):
                if (s := self.scores.get(f)) is not None:
                    best = s if math.isnan(best) else max(best, s)
                    break
        return best

    def surprise(self, score: float, n: int) -> float:
        """Minus the log of how many segments of that score n tokens have by chance."""
        return self.tail[0] * score - self.tail[1] - math.log(max(n, 1))

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        return np.interp(statistic, *self.curve) if self.scores else np.full(len(statistic), self.share)


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments: (first token, last token, score), in order.

    ``places`` (ascending) have ``scores``, all tokens between them ``drift``, which is negative.  A
    candidate is merged with the nearest earlier one that begins lower, if it ends higher; each keeps a
    link to that one, so candidates are looked at a bounded number of times.
    """
    found: list[list] = []  # first, last, sum before, sum after, link
    total, at = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total += drift * (place - at - 1)
        before, at = total, place
        total += score
        if score <= 0:
            continue
        first, low, high = place, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([first, place, low, high, j])
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _passages(model: ToxicityModel, known: words.Remembered, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(row, tokens, segments) of the texts that have a token with a feature.

    A token that a text has seen k times after the same token tells REPEATED^k of its score: repeated lines say little.
    """
    codes, bounds, distinct = words.ascii_words(texts, fold=False)
    per = np.array(known(distinct), np.float64)
    scores = per[codes] if len(codes) else np.empty(0)
    hits = np.flatnonzero(~np.isnan(scores))
    of = np.searchsorted(bounds, hits, side="right") - 1
    before = np.where(hits > bounds[of], codes[hits - 1], -1)
    order = np.lexsort((hits, codes[hits], before, of))
    sorted_keys = np.stack((of, before, codes[hits]))[:, order]
    new = np.flatnonzero((np.diff(sorted_keys, axis=1, prepend=-2) != 0).any(0))
    seen = np.empty(len(hits), np.int64)
    seen[order] = np.arange(len(hits)) - np.repeat(new, np.diff(np.append(new, len(hits))))
    told = scores[hits] * REPEATED ** np.minimum(seen, 64)
    cut = np.searchsorted(hits, bounds)
    for row in np.flatnonzero(np.diff(cut)).tolist():
        own = hits[cut[row] : cut[row + 1]]
        yield row, int(bounds[row + 1] - bounds[row]), segments((own - bounds[row]).tolist(), told[cut[row] : cut[row + 1]].tolist(), model.drift)


def _statistic(model: ToxicityModel, n: int, found: list[tuple[int, int, float]]) -> float:
    """The summed surprise of significant segments, or that of the best one, 0 at least."""
    told = [model.surprise(score, n) for _, _, score in found]
    return max(0.0, max(told, default=0.0), sum(s for s in told if s >= -math.log(SIGNIFICANT)))


def word_uses(docs: DataFrame) -> DataFrame:
    """word, toxic (surroundings), clean (uses). docs: text and toxic (0 or 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", 2 << 20):
            codes, bounds, distinct = words.ascii_words(batch["text"], fold=False)
            own = [runs(c) for c in distinct]
            bad = np.repeat(np.asarray(batch["toxic"]) == 1, np.diff(bounds))
            clean: dict[str, int] = {}
            for k, n in enumerate(np.bincount(codes[~bad], minlength=len(distinct)).tolist()):
                if n:
                    for word in own[k]:
                        clean[word] = clean.get(word, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(clean), pa.string()), pa.nulls(len(clean), pa.int64()), pa.array(list(clean.values()), pa.int64())], ["word", "beside", "n"])
            if not bad.any():
                continue
            marks = np.append(pd.util.hash_array(np.array(distinct, object)), 0).astype(np.uint64)
            beside = np.full(len(codes), len(distinct))
            inside = np.ones(len(codes) + 1, bool)
            inside[bounds] = False  # no text begins here
            at = np.flatnonzero(bad)
            for odd, step in ((0, -1), (1, 1)):
                there = inside[at] if step < 0 else inside[at + 1]
                beside[at] = np.where(there, codes[np.clip(at + step, 0, len(codes) - 1)], len(distinct))
                mark = (mixed(marks[beside[at]], 7) >> np.uint64(2) << np.uint64(1)) + np.uint64(odd)
                seen = np.unique(np.stack((codes[at].astype(np.uint64), mark), 1), axis=0)
                pairs = [(word, m) for c, m in zip(seen[:, 0].tolist(), seen[:, 1].tolist(), strict=True) for word in own[c]]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([m for _, m in pairs], pa.int64()), pa.array([0] * len(pairs), pa.int64())], ["word", "beside", "n"])

    once = docs.select("text", "toxic").mapInArrow(run, "word string, beside long, n long").groupBy("word", "beside").agg(F.sum("n").alias("n"))
    left, right = (F.count_if(F.col("beside") % 2 == odd) for odd in (0, 1))
    return once.groupBy("word").agg(F.least(left, right).alias("toxic"), F.sum("n").alias("clean"))


def _likelihood_ratio(y1: Column, y0: Column, share: Column) -> Column:
    """Twice the log of how much better their own share explains y1 and y0 than the given one."""
    n = y1 + y0
    term = lambda y, p: F.when(y > 0, y * F.ln(y / (n * p))).otherwise(0.0)
    return 2 * (term(y1, share) + term(y0, 1 - share))


def lexicon(uses: DataFrame) -> tuple[dict[str, tuple[float, float, float]], float, float]:
    """{feature: (share, toxic, clean)}, and all toxic and clean uses."""
    spark = uses.sparkSession
    word = F.col("word")
    parts = F.array_compact(F.array(*(F.when(F.length(word) >= k, F.substring(word, 1, k)) for k in PREFIXES), F.concat(word, F.lit(" "))))
    counted = store.keep(uses.select(F.explode(parts).alias("feature"), "toxic", "clean").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    n1, n0 = (float(x or 0) for x in uses.agg(F.sum("toxic"), F.sum("clean")).first())
    held: dict[str, tuple[float, float, float]] = {}
    n_features = counted.count()
    if not n1 or not n0:
        store.discard(counted)
        return held, n1, n0
    root, most = n1 / (n1 + n0), 2 * math.log(n_features) + 4
    whole = F.col("feature").endswith(" ")
    for level in (*PREFIXES, None):
        rows = counted.where(whole if level is None else ~whole & (F.length("feature") == level))
        # ancestors, the longest first: a whole word's are its own prefixes
        above, known = [k for k in reversed(PREFIXES) if level is None or k < level], rows.withColumn("share", F.lit(None).cast("double"))
        if held:
            shares = spark.createDataFrame([(f, s) for f, (s, _, _) in held.items()], "ancestor string, of double")
            for k in above:
                named = shares.select(F.col("ancestor"), F.col("of")).where(F.length("ancestor") == k)
                known = known.join(F.broadcast(named), (F.substring("feature", 1, k) == F.col("ancestor")) & (F.length(F.rtrim("feature")) >= k), "left").withColumn("share", F.coalesce("share", "of")).drop("ancestor", "of")
        prior = F.coalesce("share", F.lit(root))
        other = (_likelihood_ratio(F.col("toxic"), F.col("clean"), prior) > most) & (F.col("share").isNotNull() | (F.col("toxic") > root * (F.col("toxic") + F.col("clean"))))
        for r in known.where(other).select("feature", "toxic", "clean", prior.alias("prior")).collect():
            held[r.feature] = ((r.toxic + PRIOR * r.prior) / (r.toxic + r.clean + PRIOR), float(r.toxic), float(r.clean))
    store.discard(counted)
    return held, n1, n0


def _odds(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def _ancestor(feature: str, held: dict) -> str | None:
    word = feature.rstrip(" ")
    return next((p for k in reversed(PREFIXES) if len(word) >= k and (p := word[:k]) != feature and p in held), None)


def pruned(held: dict[str, tuple[float, float, float]], root: float) -> dict[str, tuple[float, float, float]]:
    """The features that tell something beside the longer ones: {feature: (share, toxic, clean)} of the uses left to each.

    From the longest on, a feature keeps the uses that no longer feature has.  It goes, and leaves its
    uses to its ancestor, where these are not EFFECT times likelier in toxic text; less toxic features stay
    if an ancestor does.
    """
    left = {f: [a, b] for f, (_, a, b) in held.items()}
    for f in held:
        if up := _ancestor(f, held):
            left[up] = [u - v for u, v in zip(left[up], held[f][1:], strict=True)]
    share = lambda a, b, prior: (max(0.0, a) + PRIOR * prior) / (max(0.0, a) + max(0.0, b) + PRIOR)
    toxic = {f for f, (a, b) in left.items() if _odds(share(a, b, root)) - _odds(root) >= math.log(EFFECT)}
    kept = {f: held[f] for f in held if f in toxic or _ancestor(f, dict.fromkeys(toxic))}
    uses = {f: left[f][:] for f in kept}
    for f in held:
        if f not in kept and (up := _ancestor(f, kept)):
            uses[up] = [u + v for u, v in zip(uses[up], left[f], strict=True)]
    return {f: (share(a, b, root), max(0.0, a), max(0.0, b)) for f, (a, b) in uses.items()}


def scored_lexicon(held: dict[str, tuple[float, float, float]], n1: float, n0: float) -> ToxicityModel:
    """Log-odds of the features that remain, the drift of other tokens, and lambda."""
    own = pruned(held, n1 / (n1 + n0)) if held else {}
    if not own:
        return ToxicityModel({})
    scores = {f: _odds(s) - _odds(n1 / (n1 + n0)) for f, (s, _, _) in own.items()}
    q1, q0 = (min(0.5, sum(x[k] for x in own.values()) / n) for k, n in ((1, n1), (2, n0)))
    drift = min(DRIFT, math.log((1 - q1) / (1 - q0)))
    weights = [(x[2] + PRIOR * n0 / (n1 + n0)) / (n0 + PRIOR) for x in own.values()]
    pairs = [*zip(scores.values(), weights, strict=True), (drift, max(1e-9, 1 - sum(weights)))]
    grown = lambda t: sum(w * math.exp(min(700.0, t * s)) for s, w in pairs) - 1
    low, high = 1e-3, 1.0
    while grown(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if grown(middle) > 0 else (middle, high)
    return ToxicityModel(scores, drift, (high, 0.0))


def _chance_segments(clean: DataFrame, model: ToxicityModel) -> float:
    """log K, the largest that the segments of clean texts ask for at a score which ENOUGH of them reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, tokens = words.Remembered(lambda keys: list(map(model.token_score, keys))), np.zeros(BINS + 1, np.int64), 0
        for batch in words.slices(batches, "text", 4 << 20):
            tokens += len(words.ascii_words(batch["text"], fold=False)[0])
            scores = [score for _, _, found in _passages(model, known, batch["text"]) for _, _, score in found]
            counts += np.bincount(np.minimum(np.array(scores) * (BINS / WIDEST), BINS).astype(int), minlength=BINS + 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([tokens, *counts[used].tolist()], pa.int64())], ["bin", "n"])

    told = {r.bin: r.n for r in clean.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    tokens, reached, most = max(1, told.pop(-1, 0)), 1, -math.inf
    for k in sorted(told, reverse=True):
        reached += told[k]
        if reached > ENOUGH or k == min(told):
            most = max(most, math.log(reached) + model.tail[0] * k * WIDEST / BINS)
    return (most if told else 0.0) - math.log(tokens)


def statistics(docs: DataFrame, model: ToxicityModel, text: str, carry: list[str]) -> DataFrame:
    """The ``carry`` columns as _c0, _c1 and so on, and the statistic and its probability of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.Remembered(lambda keys: list(map(model.token_score, keys)))
        for batch in words.slices(batches, "text", 4 << 20):
            out = np.zeros(batch.num_rows)
            for row, n, found in _passages(model, known, batch["text"]) if model.scores else ():
                out[row] = _statistic(model, n, found)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in range(len(carry))), pa.array(out), pa.array(model.probability(out))], [*(f"_c{k}" for k in range(len(carry))), "statistic", "probability"])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, ", ".join([*(f"_c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)), "statistic double, probability double"]))


def fitted_curve(bins: list[tuple[float, int, int]], share: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(statistics, probabilities) of the best rising curve; bins: (statistic, toxic, clean), ascending.

    Blocks of bins pooled until their shares rise, a prior of one document at ``share`` in each block.  The
    curve is flat within a block and linear from a block's last bin to the next one's first.
    """
    pooled: list[list[float]] = []  # documents, toxic, first and last statistic
    value = lambda g: (g[1] + share) / (g[0] + 1)
    for x, a, b in bins:
        pooled.append([a + b, a, x, x])
        while len(pooled) > 1 and value(pooled[-2]) >= value(pooled[-1]):
            n, ones, _, last = pooled.pop()
            pooled[-1] = [pooled[-1][0] + n, pooled[-1][1] + ones, pooled[-1][2], last]
    ends = [(x, value(g)) for g in pooled for x in sorted({g[2], g[3]})]
    return tuple(x for x, _ in ends), tuple(v for _, v in ends)


def train(docs: DataFrame, text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """A model of all given documents whose label isn't null."""
    rows = store.keep(docs.where(F.col(f"`{toxic}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), (F.col(f"`{toxic}`") == 1).cast("int").alias("toxic")), "zstd")
    model = _trained(rows)
    store.discard(rows)
    return model


def _trained(rows: DataFrame) -> ToxicityModel:
    n, ones = rows.agg(F.count("*"), F.sum("toxic")).first()
    share = (ones or 0) / n if n else 0.0
    if not ones or ones == n:
        return ToxicityModel({}, share=share)
    uses = store.keep(word_uses(rows))
    model = scored_lexicon(*lexicon(uses))
    store.discard(uses)
    if not any(s > 0 for s in model.scores.values()):
        return ToxicityModel({}, share=share)
    model = ToxicityModel(model.scores, model.drift, (model.tail[0], _chance_segments(rows.where("toxic = 0"), model)), share=share)
    place = F.least(F.floor(F.least("statistic", F.lit(WIDEST)) * (BINS / WIDEST)), F.lit(BINS)).cast("int")
    counts = statistics(rows, model, "text", ["toxic"]).groupBy(place.alias("bin")).agg(F.sum("_c0").alias("a"), F.sum(1 - F.col("_c0")).alias("b")).orderBy("bin").collect()
    curve = fitted_curve([(r.bin * WIDEST / BINS, r.a, r.b) for r in counts], share)
    return ToxicityModel(model.scores, model.drift, model.tail, curve, share)


def predict(docs: DataFrame, model: ToxicityModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, and score (0 to 1) of every text; a carried ``score`` gets ``_in`` behind it."""
    names = [F.col(f"_c{k}").alias(c + "_in" if c == "score" else c) for k, c in enumerate(carry)]
    return statistics(docs, model, text, list(carry)).select(*names, F.col("probability").alias("score"))


def toxic_passages(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, end (code points, end exclusive), score, expected: every significant passage of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.Remembered(lambda keys: list(map(model.token_score, keys)))
        for batch in words.slices(batches, "text", 4 << 20):
            out = []
            for row, n, found in _passages(model, known, batch["text"]) if model.scores else ():
                if good := [(a, b, s, e) for a, b, s in found if (e := math.exp(-model.surprise(s, n))) <= SIGNIFICANT]:
                    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", batch["text"][row].as_py())]
                    out += [(row, spans[a][0], spans[b][1], s, e) for a, b, s, e in good]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], [key, "start", "end", "score", "expected"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, end long, score double, expected double")


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the labelled documents whose crc32 of the id doesn't leave 1 by 3.

    Labels grow with the documents, so the two meet by shuffle at every size.
    """
    said = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    return docs.where(~held_out_third(F.col("doc_id"))).select("doc_id", "text").join(said.hint("merge"), "doc_id").select("text", F.col("_toxic").alias("toxic"))


def held_out_third(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts scored by a model of the labelled documents whose crc32 of the id doesn't leave 1 by 3."""
    docs, labels = (store.table(spark, sf_dir, name) for name in ("documents", "labels"))
    scored = predict(docs, train(with_labels(docs, labels)))
    return scored.select("doc_id", held_out_third(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
