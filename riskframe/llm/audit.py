"""How quality filters interact (operator 11): every order of the filters, and each filter's Shapley value.

A document's failures are a set of filters, so a part of the corpus is described by how many of its
documents have each of the 2^n sets.  From that table every coalition S of filters gets v(S), the
documents that S removes together.  Whatever the order, a filter f after the filters S removes
v(S and f) - v(S), so steps are differences of coalitions and no order is ever run over documents.

Shapley values are the exact solution of a constrained least squares problem: the additive game that
is nearest to v, coalitions weighted by the Shapley kernel, whose values sum to v(all).  Its normal
equations are solved once in rationals for all games at a time; what each coalition counts for in a
value becomes an integer after multiplication by n!, so values summed over all orders are integers.

Filter E, identical to an earlier document, needs no gathering of copies: the one document of each text
that has its smallest id is found by aggregation, and documents meet it by (digest of the text, id),
a key that is shared by repeated rows only; these are counted before they meet.

Defined results: a null text is the empty text; a null id is neither smaller nor larger than others, so
such a row fails no E and makes none fail; rows that repeat an id count each, and the first of them are
all of the smallest id; a null part is the empty string; a document with several labels has quality, or
is toxic, if one of them says 1; a null label says nothing; an empty table gives no rows; other columns
are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from hashlib import sha256
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store, words

LETTERS = "ABCDE"
#: of each byte: 1 for A to Z, 2 for a sign of markup
_KIND = np.array([1 if 65 <= b <= 90 else 2 if b in b"#$%&*|" else 0 for b in range(256)], np.uint8)


def shapley_weights(n: int) -> list[list[int]]:
    """What v(S) counts for in n! times the Shapley value of each of n players; [player][S], S as bits.

    The problem: least sum over S of w(S) (v(S) - sum of x in S)^2 subject to sum of x = v(all), with the
    kernel w(s) = (n - 1) / (C(n, s) s (n - s)) for 0 < s < n.  Stationarity and the constraint are one
    linear system in x and a multiplier; its right side is linear in v, so it is solved for each v(S) = 1.
    """
    sets = [[i for i in range(n) if s >> i & 1] for s in range(1 << n)]
    weight = [Fraction(n - 1, comb(n, len(s)) * len(s) * (n - len(s))) if 0 < len(s) < n else Fraction(0) for s in sets]
    left = [[sum(w for s, w in zip(sets, weight, strict=True) if i in s and j in s) for j in range(n)] + [Fraction(1)] for i in range(n)]
    left.append([Fraction(1)] * n + [Fraction(0)])
    right = [[w if i in s else Fraction(0) for s, w in zip(sets, weight, strict=True)] for i in range(n)]
    right.append([Fraction(int(len(s) == n)) for s in sets])
    solved = _solve(left, right)
    values = [[x * factorial(n) for x in row] for row in solved[:n]]
    if any(x.denominator != 1 for row in values for x in row):
        raise ArithmeticError("a weight is no whole number of orders")
    return [[int(x) for x in row] for row in values]


def _solve(left: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solutions of a regular system for several right sides, by elimination in rationals."""
    rows, n = [a + b for a, b in zip(left, right, strict=True)], len(left)
    for k in range(n):
        pivot = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and (times := rows[r][k]):
                rows[r] = [x - times * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [row[n:] for row in rows]


def coalition_table(rows: DataFrame, part: str, failures: str, n: int, sums: Sequence[str]) -> DataFrame:
    """part, then for each of ``sums`` an array v: v[S + 1] is its sum over rows that fail a filter of S, and a total.

    ``failures`` has a bit a filter.  Rows are first summed by set of failures, at most 2^n rows a part.
    """
    counted = rows.groupBy(part, failures).agg(*(F.sum(c).alias(c) for c in sums))
    hit = lambda s, c: F.sum(F.when(F.col(failures).bitwiseAND(s) != 0, F.col(c)).otherwise(0)).cast("long")
    return counted.groupBy(part).agg(
        *(F.array(*(hit(s, c) for s in range(1 << n))).alias(f"v_{c}") for c in sums), *(F.sum(c).cast("long").alias(f"all_{c}") for c in sums)
    )


def interactions(rows: DataFrame, letters: str = LETTERS, part: str = "part") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    rows: part, failures (bit k: fails the filter letters[k]), and the sums n, good and toxic of each row.
    """
    n = len(letters)
    table = coalition_table(rows, part, "failures", n, ("n", "good", "toxic"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters))))
    steps = table.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    mask = lambda text: sum((F.contains(text, F.lit(x)).cast("int") * (1 << k) for k, x in enumerate(letters)), F.lit(0))
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumn("before", mask(F.left("filter_order", F.col("step") - 1))).withColumn("own", mask(own))
    v = lambda c, s: F.element_at(f"v_{c}", s + 1)
    after = F.col("before").bitwiseOR(F.col("own"))
    gain = lambda c: v(c, after) - v(c, F.col("before"))
    weights = F.array(*(F.array(*map(F.lit, row)) for row in shapley_weights(n)))
    products = F.zip_with(F.element_at(weights, F.instr(F.lit(letters), own)), "v_n", lambda w, x: w * x)
    everything = (1 << n) - 1
    return steps.select(
        part, "filter_order", "step", (F.col("all_n") - v("n", after)).alias("kept"), gain("n").alias("removed"), (v("n", F.col("own")) - gain("n")).alias("redundant"),
        (v("n", F.lit(everything)) - v("n", F.lit(everything) - F.col("own"))).alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        F.aggregate(products, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def own_failures(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3, filters A to D, of texts: few words, few distinct words, many capitals, a sign of markup."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    codes, bounds, distinct = words.coded_words(whole, fold=False)
    n_words, n = np.diff(bounds), len(whole)
    pairs = np.sort(np.repeat(np.arange(n) * len(distinct), n_words) + codes)  # a text's words side by side
    n_distinct = np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] // max(1, len(distinct)), minlength=n)
    kinds = _KIND[np.frombuffer(b"".join(whole.cast(pa.large_binary()).to_pylist()) + b" ", np.uint8)]  # the blank ends the last text
    starts = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(whole), np.int64))))
    full = np.diff(starts) > 0
    capitals, signs = (np.where(full, np.add.reduceat(kinds == k, starts, dtype=np.int64)[:-1], 0) for k in (1, 2))
    failed = [n_words < 100, 100 * n_distinct < 80 * n_words, 100 * capitals > 10 * np.asarray(pc.utf8_length(whole), np.int64), signs > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def document_failures(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id, part, failures (bits A to E), n: how many rows there are of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", 2 << 20):
            digests = [sha256((t or "").encode()).digest() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["part"], pa.array(own_failures(batch["text"]), pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "bits", "digest"])

    named = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text"))
    thin = named.mapInArrow(run, f"id {docs.schema[id].dataType.simpleString()}, part string, bits int, digest binary")
    counted = store.keep(thin.groupBy("id", "part", "bits", "digest").agg(F.count("*").alias("n")))
    first = counted.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    told = counted.join(first, ["digest", "id"], "left")
    later = F.col("is_first").isNull() & F.col("id").isNotNull()
    return told.select("id", "part", (F.col("bits") + later.cast("int") * 16).alias("failures"), "n")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over all documents, by language, with what labels say of the removed ones."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    failures = document_failures(docs).groupBy("id", "part", "failures").agg(F.sum("n").alias("n"))
    marked = failures.join(marks, "id", "left")
    times = lambda c: F.when(F.col(c), F.col("n")).otherwise(0).alias(c)
    return interactions(marked.select("part", "failures", "n", times("good"), times("toxic")))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over all documents."""
    return audit_filters(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "labels"))


#: Walks every order step by step, and sums what each filter removes in all of them.
SQL_OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
first AS (SELECT text, min(doc_id) AS doc_id FROM t GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(words) < 100 WHEN 'B' THEN 100 * len(list_distinct(words)) < 80 * len(words)
    WHEN 'C' THEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text) WHEN 'D' THEN regexp_matches(t.text, '[#$%&*|]') ELSE coalesce(t.doc_id > first.doc_id, false) END) AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t JOIN first ON t.text = first.text LEFT JOIN l ON t.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM x a, x b, x d, x e, x h WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, CAST(k AS INTEGER), 1) AS own, string_split(substr(filter_order, 1, CAST(k AS INTEGER) - 1), '') AS before FROM o, range(1, 6) AS r(k)),
y AS (SELECT part, filter_order, step, own, n, good, toxic, fails, list_contains(fails, own) AS bad, list_has_any(fails, before) AS gone FROM g, s),
z AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS removed, coalesce(sum(n) FILTER (gone AND bad), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = [own]), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND bad), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND bad), 0) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z
"""
