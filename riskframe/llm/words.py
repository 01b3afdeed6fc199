"""Batches of texts as dictionary-coded chunks, so that per-word work runs once a distinct word.

A chunk is what stands between ASCII blanks (space, tab, line feed, carriage return).  Work of a
tokenizer never crosses such a blank, so the ids of a text are those of its chunks in order.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a worker remembers before it starts afresh; memory only, results are the same.
REMEMBERED = 400_000


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside others on its machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this worker keeps between tasks of an operator.  Workers serve one operator after the other: what was kept for others goes."""
    if operator not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            give_back()
        _kept[operator] = {}
    return _kept[operator]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``size`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < len(ends):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            stop = max(stop, at + 1)
            # a copy: string kernels may misread arrays that start inside a buffer
            yield batch.take(pa.array(range(at, stop)))
            at = stop
        del batch
        give_back()


def coded_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each chunk, where each text's chunks begin, the distinct chunks). Null is the empty text."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    for blank in "\n\t\r":
        plain = pc.replace_substring(plain, blank, " ")
    parts = pc.split_pattern(plain, " ")
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    coded = parts.flatten().dictionary_encode()
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    return np.asarray(coded.indices, dtype=np.int64), offsets - offsets[0], coded.dictionary


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The same with the distinct chunks as a list."""
    codes, offsets, distinct = coded_chunks(texts)
    return codes, offsets, distinct.to_pylist()


def gather(values: list[bytes], codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[code]`` (bytes of 32-bit ids) for all codes; also where each text's part begins."""
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat = np.frombuffer(b"".join(values), "<u4")
    firsts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    per = lengths[codes]
    ends = np.concatenate(([0], np.cumsum(per)))
    index = np.arange(ends[-1]) + np.repeat(firsts[codes] - ends[:-1], per)
    return flat[index], ends[offsets]


class Remembered:
    """``make`` (a list of new keys to their values) with a bounded memory of earlier answers."""

    def __init__(self, make: Callable[[list[str]], list], limit: int = REMEMBERED):
        self.make, self.limit, self.known = make, limit, {}

    def __call__(self, keys: list[str]) -> list:
        if len(self.known) > self.limit:
            self.known = {}
        new = list(dict.fromkeys(k for k in keys if k not in self.known))
        self.known.update(zip(new, self.make(new), strict=True))
        return [self.known[k] for k in keys]


#: A stem that ends with a letter below U+0250, and the punctuation after it.  U+0130 is no such letter:
#: in lower case it ends with a mark, which splitters join to punctuation.
_APART = r"(?s)^(?P<stem>.*[a-zA-ZªµºÀ-ÖØ-öø-įı-ɏ])(?P<tail>[.,;:!?*$%&#]+)$"
_SPECIAL = "<|"


def apart(distinct: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each chunk's stem and the punctuation after its last letter, which every splitter of words separates.

    ASCII chunks come in lower case, as the normaliser of the word tokenizer makes them; others as they are.
    """
    plain = pc.and_(pc.string_is_ascii(distinct), pc.invert(pc.match_substring(distinct, _SPECIAL)))
    folded = pc.if_else(plain, pc.ascii_lower(distinct), distinct)
    found = pc.extract_regex(folded, _APART)
    return pc.coalesce(pc.struct_field(found, "stem"), folded), pc.coalesce(pc.struct_field(found, "tail"), pa.scalar("", distinct.type))


def cuts_chunks(spec: dict) -> bool:
    """Whether a tokenizers file (parsed) works as :func:`apart` and :func:`chunks` assume: lower case, words of letters."""
    normalisers = spec.get("normalizer") or {}
    kinds = [n.get("type") for n in normalisers.get("normalizers", [normalisers])]
    splitters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    patterns = [s["pattern"].get("Regex") for s in splitters if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
    return kinds == ["NFC", "Replace", "Lowercase"] and patterns == [SPLIT] and [s.get("add_prefix_space") for s in splitters[1:]] == [False]


#: Fixed value: the word pattern of the public word tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def ascii_words(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As :func:`chunks`, for words between any of the six ASCII blanks, without empty ones; A-Z in lower case if ``fold``."""
    codes, offsets, distinct = coded_words(texts, fold)
    return codes, offsets, distinct.to_pylist()


def coded_words(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same with the distinct words as an array."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    plain = pc.ascii_lower(plain) if fold else plain
    for blank in "\x0b\x0c":
        plain = pc.replace_substring(plain, blank, " ")
    codes, offsets, distinct = coded_chunks(plain)
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty < 0:
        return codes, offsets, distinct
    full = codes != empty
    bounds = np.concatenate(([0], np.cumsum(full)))[offsets]
    codes = codes[full]
    return codes - (codes > empty), bounds, distinct.filter(pc.not_equal(distinct, ""))
