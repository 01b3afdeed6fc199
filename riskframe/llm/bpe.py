"""BPE encoding and decoding by a tokenization automaton (operator 7).

The merges are compiled, in order, into a deterministic automaton over tokens that accepts a
sequence of tokens exactly if it is the tokenization of the text it spells.  At first there is one
state with a loop for each base symbol.  The gadget of a merge (u, v) -> x acts on every state that
an arc u reaches: that state is copied for u, the copy loses its arc v (u, v would have been merged),
and wherever u could start, x may start too, leading where v led.  So every token has one state, and
copies differ from the copied state only by arcs that were cut.

Compiled form, all integer arrays: a state is the row of its cuts (token, rank of the last gadget for
which they hold), a token the row of what it grew from (token, rank at which it grew), and the cuts
are a sorted array of token pairs with their ranks.  An arc w is missing from a state if one of the
state's cuts removed w, or a token which w grew from later.  All states by all tokens would be 2.4
billion bits, so arcs get their place in a transition table of fixed size when first walked.  A second
table, symbols by trie nodes, yields the longest token that ends at a place, and each token's next
shorter one, so that a walk looks at tokens only.  Many words walk at once, a symbol a step; a word
has one accepted path, whose last arc at each place is the only one that is free.  Decoding emits the
arcs' labels.

The tables are built once by the driver and broadcast, compressed: their size depends on the tokenizer
file alone (41 MB in a worker for 49 thousand tokens).

Defined results: a null text is the empty text, which has no ids and decodes to the empty text.
Rows that repeat, or share a doc_id, each give their own row; null doc_ids stay null; an empty table
gives an empty result.  Texts of any length are encoded whole; a word without blanks is walked once.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store, words

_ALWAYS = (1 << 31) - 1
#: places of the transition table; stems that a worker remembers; symbols above which a lone word walks by itself
ARCS, STEMS, LONG = 1 << 20, 120_000, 256


def byte_letters() -> list[str]:
    """The letter that byte-level files write for each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


def _fit(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16) if values.min() >= 0 and values.max() < 1 << 16 else values.astype(np.int32)


def _joined(bounds: np.ndarray, parts: pa.Array) -> pa.Array:
    """The parts between bounds, with a blank between two."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts), pa.scalar(" ", parts.type))


class TokenAutomaton:
    """Words as bytes; the last byte of a word is a symbol of its own (it has the mark of the word's end)."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], word_end: str):
        spelled: dict[str, tuple[bytes, bool]] = {}
        for b, letter in enumerate(byte_letters()):
            spelled[letter], spelled[letter + word_end] = (bytes([b]), False), (bytes([b]), True)
        state = {vocab[t]: [(vocab[t], _ALWAYS)] for t in spelled}
        starts = {k: list(v) for k, v in state.items()}
        cut = []
        for rank, (u, v) in enumerate(merges):  # the gadgets, one after the other
            a, b, x = vocab[u], vocab[v], vocab[u + v]
            cut.append((a, b, rank))
            state[x] = [(x, _ALWAYS), *((t, min(until, rank - 1)) for t, until in state[b])]
            starts[x] = [(x, _ALWAYS), *((t, min(grown, rank)) for t, grown in starts[a])]
            spelled[u + v] = (spelled[u][0] + spelled[v][0], spelled[v][1])
        self.n = max(vocab.values()) + 1
        self.cuts_of, self.cuts_until = self._rows(state)
        self.grew_from, self.grew_at = self._rows(starts)
        pairs = np.array(cut, np.int64).reshape(-1, 3)
        keys = pairs[:, 0] * self.n + pairs[:, 1]
        order = np.argsort(keys)
        self.cut_pairs, self.cut_ranks = keys[order], pairs[order, 2]
        self._trie({vocab[t]: s for t, s in spelled.items()})

    def _rows(self, chains: dict[int, list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Chains as rows filled up with -1; the last row is the start's, which has none."""
        width = max(map(len, chains.values()))
        tokens, ranks = np.full((self.n + 1, width), -1, np.int32), np.zeros((self.n + 1, width), np.int32)
        for k, chain in chains.items():
            tokens[k, : len(chain)], ranks[k, : len(chain)] = zip(*chain, strict=True)
        return tokens, ranks

    def _trie(self, spelled: dict[int, tuple[bytes, bool]]) -> None:
        many = sorted({b for text, _ in spelled.values() if len(text) > 1 for b in text})
        self.column = np.zeros(256, np.int64)  # 0: a symbol of no merge
        self.column[many] = 1 + np.arange(len(many))
        prefixes = {b""} | {text[:k] for text, ends in spelled.values() for k in range(1, len(text) + (not ends))}
        number = {p: k for k, p in enumerate(sorted(prefixes, key=lambda p: (len(p), p)))}
        token = {text: t for t, (text, ends) in spelled.items() if not ends}
        self.single = np.array([[token[bytes([b])] for b in range(256)], [0] * 256], np.int64)
        goto = np.zeros((len(number), len(many) + 1), np.int32)
        fall, longest = np.zeros(len(number), np.int64), np.full(len(number), -1, np.int64)
        ending: list[list[tuple[int, int, int]]] = [[] for _ in range(1 + max(map(len, number)))]
        for t, (text, ends) in spelled.items():
            if ends:
                if len(text) == 1:
                    self.single[1, text[0]] = t
                else:
                    ending[len(text) - 1].append((number[text[:-1]], self.column[text[-1]], t))
        last = np.zeros(goto.shape, np.int32)
        last[0, 0], last[0, self.column[many]] = -1, self.single[1, many]
        by_depth: list[list[bytes]] = [[] for _ in ending]
        for p in number:
            by_depth[len(p)].append(p)
        for depth, own in enumerate(by_depth):
            at = np.array([number[p] for p in own])
            if depth:
                parent, symbol = np.array([number[p[:-1]] for p in own]), self.column[[p[-1] for p in own]]
                if depth > 1:
                    fall[at] = goto[fall[parent], symbol]
                goto[at], last[at] = goto[fall[at]], last[fall[at]]
                longest[at] = [token.get(p, -1) for p in own]
                longest[at] = np.where(longest[at] < 0, longest[fall[at]], longest[at])
                for node, column, t in ending[depth]:
                    last[node, column] = t
            if depth + 1 < len(by_depth):
                for p in by_depth[depth + 1]:
                    goto[number[p[:-1]], self.column[p[-1]]] = number[p]
            goto[at, 0] = 0
        shorter, length = np.full(self.n + 1, -1, np.int64), np.zeros(self.n + 1, np.int64)
        for t, (text, ends) in spelled.items():
            length[t] = len(text)
            if len(text) > 1:
                shorter[t] = last[fall[number[text[:-1]]], self.column[text[-1]]] if ends else longest[fall[number[text]]]
        last[:, 0] = 0
        self.goto, self.last, self.longest, self.shorter, self.length = _fit(goto), _fit(last), longest.astype(np.int32), shorter.astype(np.int32), length.astype(np.int32)

    def compiled_arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of the token, from the gadgets' cuts."""
        free = np.ones(len(state), bool)
        for a in range(self.cuts_of.shape[1]):
            rows = np.flatnonzero((self.cuts_of[state, a] >= 0) & free)
            for b in range(self.grew_from.shape[1]):
                rows = rows[self.grew_from[token[rows], b] >= 0]
                if not len(rows):
                    break
                pair = self.cuts_of[state[rows], a].astype(np.int64) * self.n + self.grew_from[token[rows], b]
                at = np.minimum(np.searchsorted(self.cut_pairs, pair), len(self.cut_pairs) - 1)
                until = np.minimum(self.cuts_until[state[rows], a], self.grew_at[token[rows], b])
                free[rows[(self.cut_pairs[at] == pair) & (self.cut_ranks[at] <= until)]] = False
        return free

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The same by the transition table, where new arcs take the place of others that share it."""
        if not hasattr(self, "arc_keys"):
            self.arc_keys, self.arc_free = np.full(ARCS, -1, np.int64), np.zeros(ARCS, bool)
        key = state.astype(np.int64) * self.n + token
        place = (key * 0x9E3779B97F4A7C1 >> 20) & (ARCS - 1)
        free = self.arc_free[place]
        new = np.flatnonzero(self.arc_keys[place] != key)
        if len(new):
            free[new] = self.compiled_arcs(state[new], token[new])
            self.arc_keys[place[new]], self.arc_free[place[new]] = key[new], free[new]
            # two new arcs of one place: the table keeps one, and its answer
            kept = np.unique(place[new][::-1], return_index=True)[1]
            self.arc_free[place[new][::-1][kept]], self.arc_keys[place[new][::-1][kept]] = free[new][::-1][kept], key[new][::-1][kept]
        return free

    def _walk(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: (words, length). The tokens of all words in order, and how many each word has."""
        n_words, n = symbols.shape
        rows, node = np.arange(n_words), np.zeros(n_words, np.int64)
        path = np.empty((n + 1, n_words), np.int32)  # the arc of the accepted path that ends here
        path[0] = self.n
        for i in range(1, n + 1):
            symbol = symbols[:, i - 1]
            column = self.column[symbol]
            if i < n:
                node = self.goto[node, column]
                token = self.longest[node]
            else:
                token = self.last[node, column]
            token = np.where(column == 0, self.single[int(i == n), symbol], token)
            left = rows
            while len(left):
                before = i - self.length[token[left]]
                left = left[~self.arcs(path[before, left], token[left])]
                token[left] = self.shorter[token[left]]
                if len(left) and token[left].min() < 0:
                    raise ValueError("no path spells a word")
            path[i] = token
        steps, at = [], np.full(n_words, n)
        while (at > 0).any():
            token = np.where(at > 0, path[at, rows], -1)
            steps.append(token)
            at = at - np.where(token < 0, 0, self.length[token])
        back = np.stack(steps[::-1], 1)
        return back[back >= 0], (back >= 0).sum(1)

    def _walk_alone(self, word: bytes) -> list[int]:
        """The same walk for one long word."""
        known: dict[tuple[int, int], bool] = {}
        path, node = [self.n], 0
        for i, symbol in enumerate(word, 1):
            column, end = int(self.column[symbol]), int(i == len(word))
            if not end:
                node = int(self.goto[node, column])
            token = int(self.single[end, symbol]) if not column else int(self.last[node, column] if end else self.longest[node])
            while True:
                arc = path[i - int(self.length[token])], token
                if arc not in known:
                    known[arc] = bool(self.compiled_arcs(np.array([arc[0]]), np.array([token]))[0])
                if known[arc]:
                    break
                token = int(self.shorter[token])
                if token < 0:
                    raise ValueError("no path spells a word")
            path.append(token)
        ids, i = [], len(word)
        while i:
            ids.append(path[i])
            i -= int(self.length[path[i]])
        return ids[::-1]

    def encode(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none empty), one after the other, and where each word's begin."""
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        counts, flat, order = np.zeros(len(distinct), np.int64), [], np.argsort(lengths, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(same) and len(same) <= 8 and lengths[same[0]] > LONG:
                for k in same:
                    flat.append(np.array(self._walk_alone(distinct[k]), np.int32))
                    counts[k] = len(flat[-1])
                continue
            # the path of a block has a number for each symbol
            size = max(1, (1 << 22) // max(1, int(lengths[same[0]]))) if len(same) else 1
            for own in (same[k : k + size] for k in range(0, len(same), size)):
                symbols = np.frombuffer(b"".join([distinct[k] for k in own]), np.uint8).reshape(len(own), -1)
                ids, counts[own] = self._walk(symbols)
                flat.append(ids)
        ends = np.concatenate(([0], np.cumsum(counts)))
        # from the order of lengths to that of the words
        firsts, per = ends[:-1][order], counts[order]
        out, walked = np.empty(ends[-1], np.int32), np.concatenate([*flat, np.empty(0, np.int32)])
        out[np.arange(len(walked)) + np.repeat(firsts - (np.cumsum(per) - per), per)] = walked
        return out, ends


class WordBPE:
    """The word tokenizer of a tokenizers file: its own normaliser and splitter, our automaton for the merges."""

    # Letters of two scripts that are one in lower case and stay as they are when composed.
    _LATIN = "a-zß-öø-ɏ"
    _EASY = re.compile(r"[!-~À-ÖØ-öø-įı-ȹȻ-Ƚȿ-ɏ]*")
    _WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.word_end = model["end_of_word_suffix"]
        self.automaton = TokenAutomaton([tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], model["vocab"], self.word_end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        label = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.label = [label.get(i, "") for i in range(max(label) + 1)]
        self.splitter = json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []})

    def ready(self) -> WordBPE:
        """What a worker makes of the tables: compiled patterns, the file's splitter, a memory."""
        if not hasattr(self, "part"):
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(self.splitter)
            self.normalise, self.presplit = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
            self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
            self.byte_of = {c: b for b, c in enumerate(byte_letters())}
            self.numbers, self.labelled = pa.array(map(str, range(len(self.label))), pa.large_string()), pa.array(self.label, pa.large_string())
            self.part = words.Remembered(self._spelled, STEMS)
        return self

    def presplit_words(self, part: str) -> list[bytes]:
        if part.isalpha() and part.isascii():
            return [part.lower().encode()]
        lower = part.lower()
        # some letters leave these scripts in lower case
        if self._EASY.fullmatch(part) and self._EASY.fullmatch(lower):
            return [lower.encode()] if lower.isalpha() else [w.encode() for w in self._WORDS.findall(lower)]
        return [bytes([self.byte_of[c] for c in w]) for w, _ in self.presplit(self.normalise(part))]

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and where each chunk's begin."""
        number: dict[bytes, int] = {}
        codes, bounds = [], [0]  # of words; below 0 for special ids
        for chunk in chunks:
            for part in self.split_special.split(chunk) if "<|" in chunk else (chunk,):
                if part in self.special:
                    codes.append(-1 - self.special[part])
                elif part:
                    codes += [number.setdefault(w, len(number)) for w in self.presplit_words(part)]
            bounds.append(len(codes))
        flat, ends = self.automaton.encode(list(number))
        codes, special = np.array(codes, np.int64), np.unique([c for c in codes if c < 0]).astype(np.int64)
        # special ids stand behind those of the words
        flat, firsts, sizes = np.concatenate((flat, -1 - special)), np.concatenate((ends[:-1], ends[-1] + np.arange(len(special)))), np.concatenate((np.diff(ends), np.ones(len(special), np.int64)))
        codes[codes < 0] = len(number) + np.searchsorted(special, codes[codes < 0])
        upto = np.concatenate(([0], np.cumsum(sizes[codes])))
        return flat[np.arange(upto[-1]) + np.repeat(firsts[codes] - upto[:-1], sizes[codes])], upto[bounds]

    def _spelled(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        ids, ends = self._ids(chunks)
        told = []
        for names in (self.numbers, self.labelled):
            told.append(_joined(ends, names.take(pa.array(ids, pa.int64()))).to_pylist())
        return list(zip(np.diff(ends).tolist(), *told, strict=True))

    def chunk(self, chunk: str) -> list[int]:
        return self.ready()._ids([chunk])[0].tolist()

    def parts(self, distinct: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, the ids, their labels) of each chunk; stems and punctuation are remembered apart."""
        told = []
        for half in words.apart(distinct):
            coded = half.dictionary_encode()
            got = self.part(coded.dictionary.to_pylist())
            sizes, ids, labels = zip(*got, strict=True) if got else ((), (), ())
            told.append((np.array(sizes, np.int64)[np.asarray(coded.indices)], *(pa.array(v, pa.large_string()).take(coded.indices) for v in (ids, labels))))
        (n_a, *a), (n_b, *b) = told
        both = pa.array((n_a > 0) & (n_b > 0))
        gap = pc.if_else(both, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
        joined = [pc.binary_join_element_wise(x, gap, y, pa.scalar("", pa.large_string())) for x, y in zip(a, b, strict=True)]
        return n_a + n_b, joined[0], joined[1]

    def labels(self, ids: list[int]) -> str:
        """Decode: the labels of the arcs, one blank between two; special ids are labels like others."""
        return " ".join(self.label[i] for i in ids)


_sent: dict[tuple[str, str], Broadcast] = {}


def _broadcast(spark: SparkSession, tokenizer_file: str) -> Broadcast:
    """(digest, compressed tables) of a tokenizer file, sent once an application."""
    with open(tokenizer_file, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    key = spark.sparkContext.applicationId, digest
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast((digest, zlib.compress(pickle.dumps(WordBPE(tokenizer_file)), 1)))
    return _sent[key]


def _received(sent: tuple[str, bytes]) -> WordBPE:
    """The tables in a worker, unpacked once."""
    made = words.kept("bpe")
    if sent[0] not in made:
        made[sent[0]] = pickle.loads(zlib.decompress(sent[1])).ready()
    return made[sent[0]]


def encode_texts(docs: DataFrame, tokenizer_file: str, columns: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again: key, then the asked columns.

    ``columns`` names what to return of ``n_tokens`` (long), ``ids`` (array of int), ``decoded``
    (string), ``ids_sha256`` and ``decoded_sha256`` (string); by default the first three.
    """
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    names = list(columns or ("n_tokens", "ids", "decoded"))
    tables = _broadcast(docs.sparkSession, tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _received(tables.value)

        for batch in words.slices(batches, "text", 2 << 20):
            codes, offsets, distinct = words.coded_chunks(batch["text"])
            sizes, ids, labels = tokenizer.parts(distinct)
            full = sizes[codes] > 0
            bounds, kept = np.concatenate(([0], np.cumsum(full)))[offsets], pa.array(codes[full])
            out: dict[str, list | np.ndarray] = {"n_tokens": np.diff(np.concatenate(([0], np.cumsum(sizes[codes])))[offsets])}
            for told, told_names in ((ids, ("ids", "ids_sha256")), (labels, ("decoded", "decoded_sha256"))):
                asked = [n for n in told_names if n in names]
                if not asked:
                    continue
                joined = _joined(bounds, told.take(kept))
                for n in asked:
                    if n == "ids":
                        flat = np.fromstring(_joined(np.array([0, len(joined)]), joined)[0].as_py(), np.int32, sep=" ")
                        ends = np.concatenate(([0], np.cumsum(out["n_tokens"])))
                        out[n] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                    else:
                        out[n] = joined.to_pylist() if n == "decoded" else [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in joined]
            columns = [out[n] if n == "ids" else pa.array(out[n], pa.int64() if n == "n_tokens" else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch["key"], *columns], [key, *names])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{n} {kinds[n]}" for n in names)]))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    return encode_texts(store.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["n_tokens", "ids_sha256", "decoded_sha256"])
