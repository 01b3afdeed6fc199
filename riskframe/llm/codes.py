"""Product codes of vectors, with codebooks trained over all of them (operator 12).

Vectors become integers, floor(scale * x), and are cut into PARTS equal consecutive parts.  Each part
position has a codebook; a round assigns every part to its nearest entry and replaces entries by the
floors of their parts' means; the last assignment is the code.

The parts of a position are sorted along a Hilbert curve and packed into flat blocks, so that parts of
one block are near each other.  A block stores its box (least and greatest components) and its sum.
Each round an entry is kept for a block only if no other entry is nearer all over the box:

1. an entry whose least distance to the box is above another's greatest distance goes;
2. so does one that loses everywhere to one of the RIVALS entries nearest the block's mean: the difference of two
   squared distances is linear, so its greatest value over a box is a sum of one bound a component.

What is left is the block's shortlist, in index order.  With one entry left the block's stored sum is
added and no part is looked at; otherwise an exact integer product of the block's parts with its
shortlist gives the nearest entries, ties to the lower index.  Components are integers, so all
sums are exact: in doubles below 2^53, else in 64-bit integers; what exceeds these raises an error.

Scale: one range shuffle makes the blocks (parts with equal keys spread by row number, so copies of one
vector fill many tasks); a round reads them once and shuffles at most one row an entry and task; codes
are put together by row number.  The driver holds codebooks only: entries times components.

Defined results: a vector that is null, or holds a null or non-finite component, is dropped; a null id
is kept and comes after all others, so it seldom begins an entry; rows that repeat count each, equal
ids are ordered by vector; vectors of each length are compressed on their own, with their own codebooks
(length 0: code of zeros, error 0); with fewer vectors than entries there are as many entries as
vectors; labels of all lengths are summed together, null ones too; an empty table gives no rows;
other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: parts in a block; blocks whose boxes are compared with all entries at a time; entries that others are held against
BLOCK, AT_ONCE, RIVALS = 32, 64, 4
_BLOCKS = "dim int, pos int, n int, rows binary, low binary, high binary, total binary, parts binary"
_INT = np.dtype("<i8")


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    return [k * dim // parts for k in range(parts + 1)]


def hilbert_keys(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    """Places of points on the Hilbert curve of a grid over [low, high], as bytes that sort like the curve.

    Bits are found from the highest down: a point's cell among the 2^n of its cube, in Gray order, then
    the reflections and exchanges of axes that turn the curve inside that cell (Skilling's transform).
    """
    count, n = x.shape
    if not n:
        return [b""] * count
    bits = max(1, min(8, 64 // n))
    grid = ((x - low) * (1 << bits) // np.maximum(1, high - low + 1)).clip(0, (1 << bits) - 1).astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (grid[i] & q) != 0
            swap = np.where(on, 0, (grid[0] ^ grid[i]) & p)
            grid[0] ^= np.where(on, p, swap)
            grid[i] ^= swap
        q >>= 1
    for i in range(1, n):
        grid[i] ^= grid[i - 1]
    turn, q = np.zeros(count, np.int64), top
    while q > 1:
        turn ^= np.where((grid[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    grid ^= turn
    planes = np.stack([(grid[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(n)], 1).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes, axis=1)]


def exact_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integers, exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2**53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def check_room(most: float, width: int) -> None:
    """Squared distances of parts of ``width`` components up to ``most`` fit 64 bits."""
    if width * (2 * most + 1) ** 2 >= 2**62:
        raise OverflowError(f"components up to {most:g} give squared distances beyond 64 bits")


def shortlists(low: np.ndarray, high: np.ndarray, middle: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(block, entry): whether the entry can be nearest to a point of the block's box, ties counted as nearest."""
    below, above = low[:, None, :] - entries, entries - high[:, None, :]
    least = (np.maximum(0, np.maximum(below, above)) ** 2).sum(2)
    most = (np.maximum(-below, -above) ** 2).sum(2)
    kept = least <= most.min(1)[:, None]
    # against an entry c near the middle, e loses where |p - e|^2 - |p - c|^2 > 0 for all p of the box
    rivals = ((middle[:, None, :] - entries) ** 2).sum(2).argsort(1, kind="stable")[:, :RIVALS].T
    size = (entries**2).sum(1)
    for near in rivals:
        step = entries[None, :, :] - entries[near][:, None, :]
        reach = np.where(step > 0, high[:, None, :] * step, low[:, None, :] * step).sum(2)  # greatest p . step
        kept &= size[None, :] - size[near][:, None] - 2 * reach <= 0
    return kept


@dataclass
class Block:
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    parts: np.ndarray


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[Block]]]:
    """Groups of at most AT_ONCE blocks of one length and position."""
    held: dict[tuple[int, int], list[Block]] = {}
    for r in batch.to_pylist():
        own = held.setdefault((r["dim"], r["pos"]), [])
        ints = [np.frombuffer(r[c], _INT) for c in ("rows", "low", "high", "total", "parts")]
        own.append(Block(*ints[:4], ints[4].reshape(r["n"], -1)))
        if len(own) == AT_ONCE:
            yield r["dim"], r["pos"], own
            del held[r["dim"], r["pos"]]
    for (dim, pos), own in held.items():
        yield dim, pos, own


def nearest(blocks: list[Block], entries: np.ndarray) -> Iterator[tuple[Block, np.ndarray, np.ndarray | None, int]]:
    """Each block with its shortlist, the place in it of each part's entry (None: all have the only one), and comparisons made."""
    low, high = np.stack([b.low for b in blocks]), np.stack([b.high for b in blocks])
    check_room(float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0), np.abs(entries).max(initial=0))), low.shape[1])
    middle = np.stack([b.total // len(b.rows) for b in blocks])
    size = (entries**2).sum(1)
    for b, kept in zip(blocks, shortlists(low, high, middle, entries), strict=True):
        short = np.flatnonzero(kept)
        if len(short) == 1:
            yield b, short, None, 0
        else:
            yield b, short, (size[short] - 2 * exact_product(b.parts, entries[short])).argmin(1), len(short) * len(b.rows)


class Books:
    """Codebooks by (length of vectors, part position); each has entries as rows."""

    def __init__(self, entries: dict[tuple[int, int], np.ndarray]):
        self.entries = entries

    def digest(self, dim: int) -> str:
        """sha256 of all integer components by part, entry and place, joined by commas."""
        numbers = [str(x) for pos in range(PARTS) for x in self.entries[dim, pos].ravel().tolist()]
        return sha256(",".join(numbers).encode()).hexdigest()

    def dims(self) -> list[int]:
        return sorted({dim for dim, _ in self.entries})


def integer_vectors(rows: DataFrame, id: str, vector: str, label: str, scale: float) -> DataFrame:
    """row, id, label, v (array of long): the vectors that take part, numbered."""
    values = F.col(f"`{vector}`").cast("array<double>")
    finite = values.isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # beyond 2^31 no squared distance fits; such components are told from others, and refused when they are used
    whole = F.transform(values, lambda x: F.floor(F.greatest(F.least(scale * x, F.lit(2.0**31)), F.lit(-(2.0**31)))).cast("long"))
    return store.keep(rows.where(finite).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), whole.alias("v")))


def first_books(vectors: DataFrame, entries: int = ENTRIES) -> Books:
    """The parts of the vectors with the smallest ids, of each length; at most ``entries`` vectors a length reach the driver."""
    dims = [r[0] for r in vectors.select(F.size("v").alias("dim")).distinct().collect()]
    books = {}
    for dim in dims:  # vectors nearly always have one length
        first = vectors.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        x, at = np.array([r.v for r in first], np.int64).reshape(len(first), dim), cuts(dim)
        books |= {(dim, pos): x[:, at[pos] : at[pos + 1]] for pos in range(PARTS)}
    return Books(books)


def packed(vectors: DataFrame, books: Books, block: int = BLOCK) -> DataFrame:
    """Blocks of the parts of all vectors, each position along its Hilbert curve."""
    bounds = {key: (x.min(0), x.max(0)) for key, x in books.entries.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lengths = np.asarray(batch["row"]), np.asarray(batch["v"].value_lengths())
            flat, ends = np.asarray(batch["v"].flatten(), np.int64), np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                own, at = np.flatnonzero(lengths == dim), cuts(dim)
                x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                for pos in range(PARTS):
                    part, n = x[:, at[pos] : at[pos + 1]], len(own)
                    columns = [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, pos, np.int32)), pa.array(hilbert_keys(part, *bounds[dim, pos]), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(row[own]), pa.array([p.tobytes() for p in part.astype("<i4" if np.abs(part).max(initial=0) < 2**31 else _INT)], pa.binary())], ["dim", "pos", "key", "row", "part"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        of: tuple[int, int] | None = None

        def told() -> pa.RecordBatch:
            width = cuts(of[0])[of[1] + 1] - cuts(of[0])[of[1]]
            x = np.stack([np.frombuffer(p, "<i4" if len(p) == 4 * width else _INT).astype(_INT) for _, p in held]).reshape(len(held), width)
            values = [np.array([r for r, _ in held], _INT), x.min(0), x.max(0), x.sum(0), x]
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (*of, len(held))), *(pa.array([v.tobytes()], pa.binary()) for v in values)], ["dim", "pos", "n", "rows", "low", "high", "total", "parts"])

        for batch in batches:
            for dim, pos, row, part in zip(*(batch[c].to_pylist() for c in ("dim", "pos", "row", "part")), strict=True):
                if held and (of != (dim, pos) or len(held) == block):
                    yield told()
                    held.clear()
                of = (dim, pos)
                held.append((row, part))
        if held:
            yield told()

    parts = vectors.select("row", "v").mapInArrow(cut, "dim int, pos int, key binary, row long, part binary")
    order = ["dim", "pos", "key", "row"]
    return store.keep(parts.repartitionByRange(*order).sortWithinPartitions(*order).select("dim", "pos", "row", "part").mapInArrow(pack, _BLOCKS))


def improved(blocks: DataFrame, books: Books) -> tuple[Books, dict[str, int]]:
    """One round: codebooks whose entries are the floors of their parts' means, and what it cost.

    Unused entries stay.  The costs: comparisons of a part with an entry, of how many that all pairs
    would be, and the parts of blocks that were added as a whole.
    """
    entries = books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        counts = {key: np.zeros(len(x), np.int64) for key, x in entries.items()}
        made, of, whole = 0, 0, 0
        for batch in batches:
            for dim, pos, group in _blocks(batch):
                book = entries[dim, pos]
                s, c = sums.setdefault((dim, pos), np.zeros(book.shape, np.int64)), counts[dim, pos]
                for b, short, place, cost in nearest(group, book):
                    of, made = of + len(b.rows) * len(book), made + cost
                    if place is None:
                        s[short[0]] += b.total
                        c[short[0]] += len(b.rows)
                        whole += len(b.rows)
                    else:
                        np.add.at(s, short[place], b.parts)
                        c += np.bincount(short[place], minlength=len(book))
        out = [(d, p, e, counts[d, p][e], s[e].tolist()) for (d, p), s in sums.items() for e in np.flatnonzero(counts[d, p]).tolist()] + [(-1, -1, -1, 0, [made, of, whole])]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["dim", "pos", "entry", "n", "sums"])

    told = blocks.mapInArrow(run, "dim int, pos int, entry int, n long, sums array<long>")
    spread = told.select("dim", "pos", "entry", "n", F.posexplode_outer("sums").alias("at", "x"))
    wide = spread.groupBy("dim", "pos", "entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    new, costs = {key: x.copy() for key, x in entries.items()}, {}
    for r in wide.collect():  # a row a component of an entry
        if r.dim == -1:
            costs[("compared", "pairs", "whole")[r["at"]]] = int(r.x)
        elif r["at"] is not None:
            new[r.dim, r.pos][r.entry, r["at"]] = int(r.x) // int(r.n)
    return Books(new), costs


def assigned(blocks: DataFrame, books: Books) -> DataFrame:
    """row, dim, code (hex digits by position), error: what the codebooks make of every vector."""
    entries = books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, pos, group in _blocks(batch):
                book = entries[dim, pos]
                found = [(b, short[place] if place is not None else np.full(len(b.rows), short[0])) for b, short, place, _ in nearest(group, book)]
                rows, at = np.concatenate([b.rows for b, _ in found]), np.concatenate([e for _, e in found])
                errors = ((np.concatenate([b.parts for b, _ in found]) - book[at]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(np.full(len(rows), v, np.int32)) for v in (dim, pos)), pa.array(at.astype(np.int32)), pa.array(errors)], ["row", "dim", "pos", "entry", "error"])

    each = blocks.mapInArrow(run, "row long, dim int, pos int, entry int, error long")
    entry = lambda pos: F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == pos, F.col("entry"))))), 2, "0")
    return each.groupBy("row", "dim").agg(F.concat(*map(entry, range(PARTS))).alias("code"), F.sum("error").alias("error"))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of equal labels together (nulls too).

    A label of more than a share of 1 / tasks of all rows, of which there are fewer than tasks, comes to
    its rows by broadcast; the other labels meet theirs by shuffle, and none of them is large.
    """
    spark = coded.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sums = store.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    many = (sums.agg(F.sum("n")).first()[0] or 0) / tasks
    known = lambda where: sums.where(where).select(F.col("label").alias("of"), F.col("label_error").alias("sum"), F.lit(True).alias("met"))
    same = F.col("label").eqNullSafe(F.col("of"))
    near = coded.join(F.broadcast(known(F.col("n") > many)), same, "left")
    hot = near.where("met").withColumn("label_error", F.col("sum")).select(*coded.columns, "label_error")
    rest = near.where("met IS NULL").select(*coded.columns).join(known(F.col("n") <= many), same)
    return hot.union(rest.withColumn("label_error", F.col("sum")).select(*coded.columns, "label_error"))


def vector_codes(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 1024.0, entries: int = ENTRIES, rounds: int = ROUNDS, told: list | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part.

    ``told`` gets the costs of each round (see :func:`improved`).
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    vectors = integer_vectors(rows, id, vector, label, scale)
    books = first_books(vectors, entries)
    blocks = packed(vectors, books)
    for _ in range(rounds):
        books, costs = improved(blocks, books)
        if told is not None:
            told.append(costs)
    coded = store.keep(vectors.select("row", "id", "label").join(assigned(blocks, books), "row"))
    digests = [(dim, books.digest(dim)) for dim in books.dims()]
    of = F.create_map(*(F.lit(x) for pair in digests for x in pair))[F.col("dim")] if digests else F.lit("")
    return with_label_error(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", of.alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 4 parts, 256 entries each, 4 rounds."""
    return vector_codes(store.table(spark, sf_dir, "embeddings"))


def _sql(scale: int = 1024, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by plain comparison of every part with every entry; for tables whose vectors have one length."""
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.row, p.pos, min(coalesce({distance}, 0) * 256 + c.entry) AS best FROM p JOIN c{k} c ON p.pos = c.pos GROUP BY p.row, p.pos)")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT pos, best % 256 AS entry, j, sum(p.v[j]) AS x, count(*) AS n FROM a{k} JOIN p USING (row, pos), w WHERE j <= len(p.v) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.pos, c.entry, coalesce(new.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT pos, entry, list(CAST((x - ((x % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM m{k} GROUP BY pos, entry) new ON new.pos = c.pos AND new.entry = c.entry)""")
    return f"""
WITH i AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({scale} * x) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, CAST(k AS INTEGER) AS pos, v[k * len(v) // {PARTS} + 1 : (k + 1) * len(v) // {PARTS}] AS v FROM i, range({PARTS}) AS r(k)),
w AS (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM p))) AS j),
c0 AS MATERIALIZED (SELECT pos, row - 1 AS entry, v FROM p WHERE row <= {entries}),
{", ".join(steps)},
e AS (SELECT row, string_agg(printf('%02x', CAST(best % 256 AS INTEGER)), '' ORDER BY pos) AS code, sum(best // 256) AS error FROM a{rounds} GROUP BY row),
h AS (SELECT sha256(coalesce(string_agg(array_to_string(v, ','), ',' ORDER BY pos, entry), '')) AS digest FROM c{rounds})
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM i JOIN e USING (row), h
"""


SQL_OP12 = _sql()
