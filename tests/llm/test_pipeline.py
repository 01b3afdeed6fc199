import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from riskframe.llm.pii import base_spans


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) - {()}


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet").select(*P.COLUMNS)
    extra = [(None, None, "en", None, None), (3, "", None, "a", 0), (900001, "12 34", "en", "x", 5), (900001, "12 34", "en", "x", 5), (None, "the that and thing with this of the", None, None, None)]
    docs = documents.union(spark.createDataFrame(extra, documents.schema))
    docs = docs.union(documents.limit(3))

    kept = P.language_id(spark, docs, sf)
    assert kept.columns == P.COLUMNS
    rows = [r[:] for r in kept.collect()]
    gone = [r for r in docs.collect() if r[:] not in rows]
    assert all(not re.search(r"[^\W\d_]", r.text or "") for r in gone) and len(gone) == 4 and len(rows) == docs.count() - 4

    one = [r[:] for r in P.near_duplicates(spark, kept, sf).collect()]
    sets, parent = [grams(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    classes = {}
    for k in range(len(rows)):
        classes.setdefault(find(k), []).append(rows[k])
    assert len(one) == len(classes)
    for own in classes.values():
        ids = [r[0] for r in own]
        assert sum(r in own for r in one) == 1 and any(r in own and r[0] == (None if None in ids else min(ids)) for r in one)

    schema = documents.schema
    clean = P.personal_data(spark, spark.createDataFrame(one, schema), sf)
    after = {r.doc_id: r.text for r in clean.collect()}
    assert len(after) == len(one) and not any(base_spans(t or "") for t in after.values())
    assert all(after[i] == t for i, t, *_ in one if not re.search("[0-9@]", t or ""))

    mixed = P.mix(spark, clean, sf)
    taken = [r[:] for r in mixed.collect()]
    assert mixed.columns == P.COLUMNS and {r[0] for r in taken} <= set(after) and max(sum(r[0] == i for r in taken) for i in after) <= 3
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(t) for t in after.values())
    assert total <= sum(words(r[1]) for r in taken) <= total + max(words(t) for t in after.values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in P.encoding(spark, mixed, sf).limit(40).collect():
        ids = library.encode(after[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_and_empty(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    assert P.run(spark, sf).count() > 100
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_three_words(spark):
    row = (1, "one two three", "en", "a", 13)
    docs = spark.createDataFrame([row], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r[:] for r in P.near_duplicates(spark, docs, "").collect()] == [row]


def test_language_id_keeps_what_has_letters(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    ids = lambda rows: sorted(r.doc_id for r in P.language_id(spark, spark.createDataFrame(rows, schema), "").collect())
    odd = [(1, "12 34", None, "a", 5), (2, None, None, "a", None), (3, "é", None, "a", 1)]
    assert ids([*odd, (4, "plain text", None, "b", 10)]) == [3, 4]  # no labels
    assert ids([(5, "plain text", "en", "b", 10)]) == [5]  # the only label is in op3's held-out quarter
    three = [(6, "river stone " * 9, "en", "a", 1), (7, "река камень " * 9, "ru", "a", 1), (8, "ποτάμι πέτρα " * 9, "el", "a", 1)]
    assert ids([*three, (9, "river stone " * 4 + "река камень " * 4 + "ποτάμι πέτρα " * 4, None, "a", 1), odd[0]]) == [6, 7, 8, 9]


def test_near_duplicates_keeps_every_row_without_words(spark):
    wordless = [(None, None, "en", "a", None), (None, None, "de", "b", None), (3, " \t", None, "a", 2), (3, " \t", None, "a", 2), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame([*wordless, (3, "one", "en", "a", 3), (3, "one", "de", "a", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r[:] for r in P.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([*wordless, (3, "one", "de", "a", 3)], key=str)
