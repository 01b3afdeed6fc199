"""Exact top-k inner products by multi-resolution segment statistics (operator 2).

Vectors are integers, floor(scale * x).  Each vector is cut into segments at several resolutions; a
segment keeps its mean and deviation.  By Cauchy-Schwarz the squared distance of two vectors is at
least the sum over segments of length * ((mean difference)^2 + (deviation difference)^2), so the inner
product, (|q|^2 + |x|^2 - distance^2) / 2, is bounded from above.  Coarse bounds come first; what can
still reach a query's k-th best score gets finer bounds; survivors get exact scores, one by one where
they are few, as one matrix product where the bounds let most of a block through (as they do for
vectors of independent components).

Candidates are written once, as blocks of bounded size in the narrowest exact type.  Queries are dealt
over tasks.  A task holds a bounded group of queries, streams all blocks past it, and carries each
query's k best scores along, so that the bounds tighten from block to block, blocks whose longest
vector is too short are passed over, and k rows a query leave the task.  No vector is shuffled for a
meeting; reading grows with candidates times query groups (GROUP queries each).

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor
does a null id; vectors meet only vectors of the same length (length 0 scores 0); a vector does not
meet rows of its own id; equal rows (id and integer vector) count once; ties go to the smaller id;
scores beyond 64 bits raise an error; an empty table gives an empty result; other columns are not
touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store

_BLOCK = "dim int, longest double, ids binary, kind string, vectors binary"
#: numbers of segments, coarse to fine; queries that a task holds at a time, and that meet a block at a time
RESOLUTIONS, GROUP, STRIP = (4, 16), 1 << 14, 512
#: share of a strip's pairs up to which survivors are scored one by one
FEW = 0.05


def segment_statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means, then deviations of ``parts`` segments, scaled so that the products of two rows bound an inner product."""
    n, dim = x.shape
    cuts = [k * dim // parts for k in range(parts + 1)]
    pieces = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    columns = [f(p, 1) * np.sqrt(p.shape[1]) for f in (np.mean, np.std) for p in pieces]
    return np.stack(columns, 1) if columns else np.zeros((n, 1))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products of equally many integer rows, exact."""
    if not q.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)]
    return np.array(sums, dtype=np.int64) if all(abs(s) < 2**63 for s in sums) else _beyond()


def _beyond() -> np.ndarray:
    raise OverflowError("an inner product does not fit 64 bits")


class Best:
    """The k best candidates so far of a group of queries of one length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norms, self.most = np.sqrt((q**2).sum(1)), np.abs(q).max(initial=0)
        self.statistics = [segment_statistics(q, p) for p in RESOLUTIONS]
        self.least = np.full(len(q), -np.inf)  # the k-th best score
        self.rows, self.found, self.scores = (np.empty(0, np.int64) for _ in range(3))

    def offer(self, x_ids: np.ndarray, x: np.ndarray, longest: float) -> None:
        """Let a block of candidates compete; ``longest`` is the norm of its longest vector."""
        # Rounding must not undercut a bound: the slack is above the error of sums of this size.
        slack = 1e-9 * (1 + self.norms * longest)
        if not len(x) or (self.norms * longest + slack < self.least).all():
            return
        statistics, exact = [segment_statistics(x, p) for p in RESOLUTIONS], self.most * np.abs(x).max(initial=0) * x.shape[1] < 2**53
        for a in range(0, len(self.q), STRIP):
            own = slice(a, min(a + STRIP, len(self.q)))
            needed = (self.least[own] - slack[own])[:, None]
            alive = self.ids[own, None] != x_ids[None, :]
            for mine, theirs in zip(self.statistics, statistics, strict=True):
                if np.isneginf(needed).all():
                    break
                alive &= mine[own] @ theirs.T >= needed
            i, j = np.nonzero(alive) if exact and alive.mean() <= FEW else (None, None)
            if i is None:
                product = np.where(alive, self.q[own] @ x.T, -np.inf)
                room = 0 if exact else 2 * slack[own]
                if len(x) > self.k:
                    kth = np.partition(product, len(x) - self.k, 1)[:, len(x) - self.k] - room
                    needed = np.maximum(needed, kth[:, None])
                i, j = np.nonzero((product >= needed) & alive)
                scores = product[i, j].astype(np.int64) if exact else exact_scores(self.q[own][i], x[j])
            else:
                scores = exact_scores(self.q[own][i], x[j])
                good = scores >= self.least[own][i]
                i, j, scores = i[good], j[good], scores[good]
            self._merge(i + a, x_ids[j], scores)

    def _merge(self, rows: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        rows, found, scores = np.concatenate((self.rows, rows)), np.concatenate((self.found, found)), np.concatenate((self.scores, scores))
        order = np.lexsort((found, -scores, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.rows, self.found, self.scores = rows[rank < self.k], found[keep], scores[keep]
        self.least[rows[rank == self.k - 1]] = scores[last]

    def told(self) -> pa.RecordBatch:
        rank = np.arange(len(self.rows)) - np.searchsorted(self.rows, self.rows) + 1
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.rows]), pa.array(rank.astype(np.int32)), pa.array(self.found), pa.array(self.scores)], ["query_id", "rank", "vec_id", "score"])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each length in a batch, in its order."""
    ids, lengths = np.asarray(batch["id"]), np.asarray(batch["vector"].value_lengths())
    flat, ends = np.asarray(batch["vector"].flatten(), np.float64), np.cumsum(lengths)
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        yield ids[own], flat[(ends[own] - dim)[:, None] + np.arange(dim)]


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length, the longest vectors of a task first."""

    def pack(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        most = np.abs(x).max(initial=0)
        kind = "<i2" if most < 2**15 else "<f8"
        values = [[x.shape[1]], [float(np.sqrt((x**2).sum(1)).max())], [ids.tobytes()], [kind], [x.astype(kind).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.float64(), pa.binary(), pa.string(), pa.binary()), strict=True)], ["dim", "longest", "ids", "kind", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, x in _by_length(batch):
                dim = x.shape[1]
                if dim in held:
                    ids, x = np.concatenate((held[dim][0], ids)), np.concatenate((held[dim][1], x))
                while len(ids) >= size:
                    yield pack(ids[:size], x[:size])
                    ids, x = ids[size:], x[size:]
                held[dim] = (ids, x)
        for ids, x in held.values():
            if len(ids):
                yield pack(ids, x)

    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    return store.keep(vectors.sortWithinPartitions(norm.desc()).mapInArrow(run, _BLOCK), "uncompressed")


def _streamed(folder: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(length, ids, vectors, norm of the longest) of every block of a kept table, one in memory at a time."""
    filesystem, base = store.filesystem(folder)
    for name in sorted(f.path for f in filesystem.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet")):
        with filesystem.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                r = batch.to_pylist()[0]
                ids = np.frombuffer(r["ids"], "<i8")
                yield r["dim"], ids, np.frombuffer(r["vectors"], r["kind"]).reshape(len(ids), r["dim"]).astype(np.float64), r["longest"]


def exact_topk(rows: DataFrame, is_query: Column, k: int, id: str, vector: str, scale: float = 1.0, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x)."""
    store.workers_folder(rows.sparkSession)  # blocks are read by workers: told before any job
    spark, values = rows.sparkSession, F.col(f"`{vector}`").cast("array<double>")
    finite = F.col(f"`{id}`").isNotNull() & values.isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # beyond 2^53 a double has no fraction, and floor() would end at 64 bits
    whole = F.transform(values, lambda x: F.when(F.abs(scale * x) < 2.0**53, F.floor(scale * x).cast("double")).otherwise(scale * x))
    clean = rows.where(finite).select(F.col(f"`{id}`").cast("long").alias("id"), whole.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    distinct = store.keep(clean.groupBy("id", "vector").agg(F.max("asks").alias("asks")))
    folder = _blocks(distinct.select("id", "vector"), block)._kept_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def answered() -> Iterator[pa.RecordBatch]:
            groups = {dim: Best(*(np.concatenate(v) for v in zip(*own, strict=True)), k) for dim, own in held.items()}
            held.clear()
            for dim, ids, x, longest in _streamed(folder) if groups else ():
                if dim in groups:
                    groups[dim].offer(ids, x, longest)
            yield from (g.told() for g in groups.values())

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                if n + part.num_rows > GROUP:
                    yield from answered()
                    n = 0
                n += part.num_rows
                for ids, x in _by_length(part):
                    held.setdefault(x.shape[1], []).append((ids, x))
        yield from answered()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    queries = distinct.where("asks").select("id", "vector").repartition(tasks, "id", "vector")
    return queries.mapInArrow(run, "query_id long, rank int, vec_id long, score long")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id is divisible by 20, against all others."""
    return exact_topk(store.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, "vec_id", "embedding", 64.0)


SQL_OP2 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
