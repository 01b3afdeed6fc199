import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskframe.llm.bpe import WordBPE, encode_texts
from riskframe.llm.token_files import ChunkEncoder, PerfectHash, ShardIndex, StoredIndex, fingerprint, lookup_token_files, read_token_files, write_token_files

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t ", "The cat's  DON'T we'LL a'b's", "éÉ Ǆ İI ß ſ ﬁ ǰ J̌ Σας ΣΑΣ", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|><|", "aaaaaaaaaaaaaaaaaaaaaaa hahahahahaha",
    "日本語 テスト ١٢٣ ½ 12345 1.2.3.4", "a b c\x0bd\x0ce\x1cf\x85g", "🎉🎉 👩‍👩‍👧 ẹ́", "x" * 30000, "\x00\x7f ok", "thththth" * 2000 + " end",
]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, key string")


def test_automaton_equals_library():
    library, own, rng = Tokenizer.from_file(FILE), WordBPE(FILE), random.Random(4)
    tried = [x or "" for x in ODD] + ["".join(rng.choices("aeionrsthld'. é", k=rng.randint(1, 40))) for _ in range(3000)]
    tried += ["".join(rng.choices([chr(rng.randint(33, 0x3000)) for _ in range(8)] + list("ab 's"), k=20)) for _ in range(500)]
    for text in tried:
        expected = library.encode(text, add_special_tokens=False).ids
        got = [i for chunk in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for i in own.chunk(chunk)]
        assert got == expected, text[:60]
        assert own.labels(got) == library.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("form", ["a{}b", "\"{}li", "l'{}we", "{}2", "9({}.", "X{}-{}!?"])
def test_every_character_beside_letters_punctuation_and_digits(form):
    library, own = Tokenizer.from_file(FILE), WordBPE(FILE).ready()
    chunks = [form.replace("{}", chr(c)) for c in range(33, 0x10000) if not 0xD800 <= c < 0xE000]
    _, ids, labels = own.parts(pa.array(chunks, pa.large_string()))
    want = [e.ids for e in library.encode_batch(chunks, add_special_tokens=False)]
    assert [c for c, i, w in zip(chunks, ids.to_pylist(), want, strict=True) if i != " ".join(map(str, w))] == []
    assert [c for c, t, w in zip(chunks, labels.to_pylist(), library.decode_batch(want, skip_special_tokens=False), strict=True) if t != w] == []


def test_encode_texts(spark):
    library = Tokenizer.from_file(FILE)
    rows = [(k, x, "a", "b") for k, x in enumerate(ODD)] + [(3, ODD[4], None, None), (None, "no key", None, None)]
    got = sorted(map(tuple, encode_texts(docs(spark, rows), FILE).collect()), key=str)
    want = []
    for k, x, *_ in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        want.append((k, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert encode_texts(docs(spark, []), FILE).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20000))
    made = PerfectHash.build(keys)
    assert sorted(made(keys)) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0])(keys[:3]).tolist() == [-1] * 3
    assert len(np.unique(fingerprint(keys))) > 19900


def test_token_files(spark):
    library = Tokenizer.from_file(FILE)
    rows = [(37 * k % 101, x, "a", "b") for k, x in enumerate(ODD * 3)] + [(None, "no key", None, None), (None, None, None, None), (5, "again", "", ""), (5, "again", "", "")]
    shards = write_token_files(docs(spark, rows), FILE, 1)
    got = read_token_files(shards).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda k: (k is not None, k))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = {(k, zlib.crc32(np.array([*library.encode(x or "", add_special_tokens=False).ids, 1], "<u4"))) for k, x, *_ in rows}
    assert {(r.doc_id, r.ids_crc32) for r in got} == ids
    asked = spark.createDataFrame([(5,), (100000,), (37,), (None,)], "doc_id long")
    found = lookup_token_files(shards, asked).collect()
    assert {r.doc_id for r in found} == {k for k, *_ in rows if k in (5, 37)}
    assert sum(r.ids == [*library.encode("again", add_special_tokens=False).ids, 1] for r in found) == 2
    assert read_token_files(write_token_files(docs(spark, []), FILE, 1)).count() == 0


def test_stored_index_seeks(tmp_path):
    keys = np.sort(np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 3000))
    keys[100:140] = keys[100]  # one key with many rows
    index = ShardIndex.build(keys, 2, np.arange(3003))
    (tmp_path / "x.mph").write_bytes(index.dump())
    stored = StoredIndex(pa.OSFile(str(tmp_path / "x.mph")))
    asked = [*np.unique(keys)[::7].tolist(), int(keys[100]), 5, -1]
    first, count = index.rows(np.array(asked))
    for k, a, n in zip(asked, first, count, strict=True):
        assert stored.rows(k) == ((int(a), int(n)) if n else (0, 0))
    assert dict(zip(asked, count, strict=True))[int(keys[100])] == 40
    empty = ShardIndex.build(keys[:0], 1, np.arange(2))
    (tmp_path / "y.mph").write_bytes(empty.dump())
    assert StoredIndex(pa.OSFile(str(tmp_path / "y.mph"))).rows(7) == (0, 0)


def test_a_file_of_another_kind_encodes_whole_texts():
    import public_tokenizers as files

    own = ChunkEncoder(files.path("byte_bpe_50k.json"))
    assert not own.by_chunk and ChunkEncoder(FILE).by_chunk
    texts = ["The CAT  sat.", None, "", "a\tb"]
    flat, begins = own.texts(pa.array(texts))
    library = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    assert [flat[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_that_do_not_fit(spark):
    with pytest.raises(Exception, match="does not fit"):
        write_token_files(docs(spark, [(1, "hello world", "", "")]), FILE, 1, id_type="u1")


def test_punctuation_after_a_letter_with_a_mark(spark):
    library = Tokenizer.from_file(FILE)
    rows = [(k, x, "a", "b") for k, x in enumerate(["ALİ. İ!", "İ?! é. ALI.", *(f"x{chr(c)}." for c in range(0x80, 0x250) if chr(c).isalpha())])]
    want = {k: library.encode(x, add_special_tokens=False).ids for k, x, *_ in rows}
    assert {r.doc_id: r.ids for r in encode_texts(docs(spark, rows), FILE).collect()} == want
    got = read_token_files(write_token_files(docs(spark, rows), FILE, 1)).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {k: zlib.crc32(np.array([*ids, 1], "<u4")) for k, ids in want.items()}
