"""Language-model scores from a subword lattice (operator 4).

A word's probability sums over all its segmentations into the pieces of an existing vocabulary, by
log-space forward recursion; a text's is the product over its words and one end, because no piece
crosses a word's start.  Pieces, bytes and the end share one unigram distribution, so ``score`` is the
text's marginal probability over all segmentations: known and new words alike are scored by the
lattice, never by word counts.

The vocabulary's scores are ranks, so a piece first weighs 1 / (rank + 1) (Zipf's law).  These weights
are the prior of the model; expected piece counts of the training words under it (forward and backward
recursion, ``passes`` times) are added to a prior mass.  The vocabulary itself is not changed.

Texts are packed into batches of bounded size.  Each batch asks for its distinct words only: counts
are summed by word over all batches, the lattice sees each distinct word of the corpus once, and the
answers go back to the batches, where documents are summed.  Batches are dealt over tasks by
a quarter of their number, so a task reads a few of them whatever the corpus.  Nothing that grows with the
corpus is broadcast; the driver gets one number a piece of the vocabulary.

Defined results: a null text is the empty text, one end token; words are cut at ASCII blanks and A-Z
are folded; any other string is a word, spelled by bytes where no piece fits; a null doc_id has no
checksum and counts as training; rows that repeat are documents like others; a text above the size of
a batch is a batch of its own; with no training text the lattice keeps its prior, and base scores treat
every token as new; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store, words
from riskframe.llm.lattice import START, Lattice

#: bytes of text in a batch; the prior's mass in piece counts
BATCH, PRIOR_MASS = 12 << 20, 32_000.0


def read_pieces(model_file: str) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Pieces, their prior weights, those of the 256 bytes, and of the end; all together they sum to 1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    every = range(model.get_piece_size())
    usable = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and START not in model.id_to_piece(i)[1:] and model.get_score(i) > -1e8]
    prior = np.array([1 / (1 - model.get_score(i)) for i in usable])
    lowest = np.full(256, prior.min())
    end = prior.mean()
    whole = prior.sum() + lowest.sum() + end
    return [model.id_to_piece(i) for i in usable], prior / whole, lowest / whole, end / whole


class Vocabulary:
    """The lattice's parameters: prior weights, and piece counts learned so far."""

    def __init__(self, model_file: str):
        self.pieces, self.prior, self.bytes, self.end = read_pieces(model_file)
        self.counts, self.ends = np.zeros(len(self.pieces)), 0.0

    def lattice(self) -> tuple[Lattice, float]:
        """The lattice, and log10 of the end's weight; pieces, bytes and the end sum to 1."""
        whole = self.counts.sum() + self.ends + PRIOR_MASS
        p, end = (self.counts + PRIOR_MASS * self.prior) / whole, (self.ends + PRIOR_MASS * self.end) / whole
        return Lattice(self.pieces, np.log(p), np.log(PRIOR_MASS * self.bytes / whole)), math.log10(end)


def _blob(ids: pa.Array, held: pa.Array, texts: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids, held, texts], ["key", "held_out", "text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unblob(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]


def _packed(rows: DataFrame) -> DataFrame:
    """batch, blob: documents in batches of about BATCH bytes of text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def pack() -> pa.RecordBatch:
            nonlocal k, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), pa.array([_blob(whole["key"], whole["held_out"], whole["text"])])], ["batch", "blob"])
            k, held, size = k + 1, [], 0
            return out

        for batch in words.slices(batches, "text", BATCH):
            if size and size + batch["text"].nbytes > BATCH:
                yield pack()
            held.append(batch)
            size += batch["text"].nbytes
        if held:
            yield pack()

    return store.keep(rows.mapInArrow(run, "batch long, blob binary"), "uncompressed")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each batch, with their counts in training texts."""
    for rows in batches:
        for number, blob in zip(rows["batch"].to_pylist(), rows["blob"], strict=True):
            docs = _unblob(blob.as_py())
            codes, offsets, distinct = words.ascii_words(docs["text"])
            trains = np.repeat(~np.asarray(docs["held_out"]), np.diff(offsets))
            counts = np.bincount(codes[trains], minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), number)), pa.array(np.arange(len(distinct), dtype=np.int32)), pa.array(distinct, pa.string()), pa.array(counts)], ["batch", "code", "word", "n"])


def score_texts(docs: DataFrame, held_out: Column, model_file: str, key: str = "doc_id", text: str = "text", passes: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    packed = _packed(rows)
    asked = store.keep(packed.mapInArrow(_asked, "batch long, code int, word string, n long"), "zstd")
    counted = store.keep(asked.groupBy("word").agg(F.sum("n").alias("c")), "zstd")
    ends = rows.where(~F.col("held_out")).count()
    n_words, distinct = counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_words + ends, distinct + (ends > 0)

    vocabulary = Vocabulary(model_file)
    for _ in range(passes if n_words else 0):
        lattice, _ = vocabulary.lattice()

        def expected(batches: Iterator[pa.RecordBatch], lattice=lattice) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(lattice.pieces))
            for batch in batches:
                total += lattice.expected(batch["word"].to_pylist(), np.asarray(batch["c"], np.float64))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

        found = counted.where("c > 0").mapInArrow(expected, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        vocabulary.counts, vocabulary.ends = np.zeros(len(vocabulary.pieces)), float(ends)
        vocabulary.counts[[r.piece for r in found]] = [r.n for r in found]
    lattice, end_score = vocabulary.lattice()

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(lattice.log10(batch["word"].to_pylist()))], ["word", "c", "inner"])

    answers = asked.select("batch", "code", "word").join(counted.mapInArrow(known, "word string, c long, inner double"), "word").drop("word")
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    end_known, end_base = int(ends > 0), float(base(np.float64(ends)))

    def summed(packs: pa.Table, told: pa.Table) -> pa.Table:
        docs = _unblob(packs["blob"][0].as_py())
        codes, offsets, distinct = words.ascii_words(docs["text"])
        at = np.asarray(told["code"])
        if len(at) != len(distinct):
            raise ValueError("a batch lacks answers")
        c, inner = np.zeros(len(distinct)), np.zeros(len(distinct))
        c[at], inner[at] = np.asarray(told["c"]), np.asarray(told["inner"])
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        total = lambda x: np.bincount(row, x[codes], len(offsets) - 1)
        n_known = total((c > 0).astype(float)).astype(np.int64) + end_known
        columns = [docs["key"], docs["held_out"], pa.array(np.diff(offsets) + 1), pa.array(n_known), pa.array(np.full(len(n_known), n)), pa.array(total(base(c)) + end_base), pa.array(total(inner) + end_score)]
        return pa.Table.from_arrays([pa.chunked_array([x]) for x in columns], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    parts = -(-packed.count() // 4) or 1
    return packed.repartition(parts, "batch").groupBy("batch").cogroup(answers.repartition(parts, "batch").groupBy("batch")).applyInArrow(summed, schema)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts scored, trained on the documents whose crc32 of the id isn't divisible by 10."""
    import public_tokenizers

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_texts(store.table(spark, sf_dir, "documents"), held_out, public_tokenizers.path("piece_bpe_32k.model"))
