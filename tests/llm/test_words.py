import weakref

import pyarrow as pa

from riskframe.llm import words


def test_slices_and_words():
    texts = ["Ab é\tCD", None, "", "ÉÉ " * 50, "x\x0b y\x0cZ", "Ünï " * 30, "the end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], ["text", "n"])
    got = []
    for part in words.slices(iter([batch.slice(0, 3), batch.slice(3)]), "text", 40):
        codes, offsets, distinct = words.ascii_words(part["text"])
        got += [[distinct[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        codes, offsets, distinct = words.chunks(part["text"])
        plain = [" ".join(distinct[c] for c in codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert plain == [(t or "").replace("\t", " ") for t in part["text"].to_pylist()]
    fold = lambda t: "".join(c.lower() if c < "\x80" else c for c in t or "")
    assert got == [[w for w in fold(t).replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w] for t in texts]


def test_a_worker_keeps_one_operators_tables():
    class Table:
        def __init__(self):
            self.own = self.look  # as a table that remembers by one of its methods

        def look(self):
            return self

    held = words.kept("one")
    held["table"] = Table()
    gone = weakref.ref(held["table"])
    assert words.kept("one") is held and gone() is not None
    del held
    assert words.kept("another") == {} and gone() is None
    assert words.kept("one") == {}
