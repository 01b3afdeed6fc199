"""A corpus pipeline of the training-data operators: STAGES, and run() over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the
columns of documents.  Between stages the rows are written and read again.

1. language_id: rejects documents without a language (no letters); those of several languages stay.  The
   model learns from all documents with a label; without any, every document with letters stays.
2. near_duplicates: one document of each class of the n-gram Jaccard join stays (five words, 0.8): the one with
   the smallest doc_id, then the smallest hash of its text.  Rows without words are kept, each of them.
3. personal_data: spans, and secrets, are replaced by their kind in angle brackets.
4. mixing: documents as the mix takes them, repeated documents as repeated rows; what the budget cuts
   off from the last one taken is no reason to drop it.
5. encoding: ids of the word tokenizer, their number, and the digests of ids and decoded text.

Nulls, empty texts, ties, equal rows and empty tables have the results that the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import bpe, jaccard, langid, mixing, pii, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    return langid.predict(docs, model, carry=tuple(COLUMNS)).where("score > 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classed = store.keep(jaccard.jaccard_classes(docs, percent=80, width=5))
    first = classed.where("n_shingles > 0").groupBy("class_id").agg(F.min(F.struct("doc_id", "mark")).alias("row"))
    stays = first.select(F.col("row.doc_id").alias("id"), F.col("row.mark").alias("of"))
    worded = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("mark")).where(worded)
    kept = marked.join(stays, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left_semi")
    one = kept.groupBy("doc_id", "mark", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select("doc_id", "text", "rest.*").select(*COLUMNS).union(docs.select(*COLUMNS).where(~worded))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(*COLUMNS), pii.train(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs, carry=("text", "lang", "n_chars"), shuffle_by=("text",))
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.where("taken > 0").withColumn("time", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("encoding", encoding)]
#: A trained tagger and learned language counts are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = store.table(spark, sf_dir, "documents").select(*COLUMNS), None
    for _, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir))
        if before is not None:
            store.discard(before)
        before = docs
    return docs
