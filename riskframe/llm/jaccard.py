"""N-gram Jaccard join by T-occurrence search (operator 6).

Documents are sets of word shingles, kept as 64-bit hashes (collisions of two shingles, or of two
sets, are the only source of error: about N^2 / 2^65 for N of them).  Equal sets are one node.

Two sets with a similarity of at least t have, in any common order of shingles, at least T of them in
common among the first n - ceil(t n) + T of either.  These signatures, in an order with the frequent
shingles last, find the nodes that can have partners at all; only those get their whole sets.

The search itself is DivideSkip.  An index shard is a bounded number of nodes with inverted lists.  A
query's lists are divided: the short ones are merged, and ids that occur often enough there are
probed by binary search for the shingles of the long ones; those that reach the overlap are links.
Every shard is searched with its own nodes first, in the order of a minimum hash, then with the
representatives of what was found, so that large groups of near copies become one class early.  Nodes
with fewer than T signature shingles that another class has, too, are settled then.  Each of the others
visits every other shard whose signatures share T shingles with it and hold another class than its own.
So no link between classes is missed, and none within a class is searched twice.

Defined results: null texts and texts without words have no set and are alone; a set with fewer words
than a shingle is the whole sequence; equal rows, rows that share a doc_id and null doc_ids are
documents like others (a class's id is its smallest non-null doc_id); an empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store, words
from riskframe.llm.graph import components
from riskframe.llm.token_files import mixed

#: nodes of an index shard at most; queries that one search task takes at a time; shingles put last in the order;
#: classes up to which a shingle is counted class by class
SHARD, QUERIES, FREQUENT, CLASSES = 512, 1024, 1 << 19, 64
#: bytes of shingles of a shard at most (a larger set is a shard of its own); how many minimum hashes order the sets
SHARD_BYTES, TURNS = 8 << 20, 3
_SET = "node long, n long, tokens binary"


class Similarity:
    """Links at 100 * intersection >= percent * union; all in integers."""

    def __init__(self, percent: int):
        self.percent = percent

    def least_overlap(self, a, b):
        """Smallest intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def shortest(self, n):
        return -(-self.percent * n // 100)

    def longest(self, n):
        return n * 100 // self.percent

    def occurrences(self, n):
        """T for a set of n: half of the shortest signature."""
        p = n - self.shortest(n) + 1
        return np.maximum(1, p // 2)

    def signature(self, n: int) -> int:
        return int(n - self.shortest(n) + self.occurrences(n))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    plain = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for blank in "\x0b\x0c":
        plain = pc.replace_substring(plain, blank, " ")
    codes, offsets, distinct = words.chunks(plain)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes]
    full = np.fromiter(map(len, distinct), np.int64, len(distinct))[codes] > 0
    bounds, hashes = np.concatenate(([0], np.cumsum(full)))[offsets], hashes[full]
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = mixed(rolled ^ hashes[k : k + len(rolled)], k)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k, x in enumerate(hashes[a:b]):
                h = mixed(h ^ x, 100 + k)
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _node(tokens: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64).item()


class Shard:
    """An index of at most SHARD sets: inverted lists, and DivideSkip over them."""

    def __init__(self, sets: list[np.ndarray], similarity: Similarity):
        self.sets, self.similarity = sets, similarity
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, first, self.lengths = np.unique(flat[order], return_index=True, return_counts=True)
        self.first = first

    def search(self, query: np.ndarray, skip: np.ndarray) -> Iterator[int]:
        """Sets linked to the query, most promising first. ``skip`` (bool a set) is looked at again before each."""
        n, sim = len(query), self.similarity
        low = sim.shortest(n)
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        hit = self.tokens[at] == query
        at = at[hit]
        least = int(sim.least_overlap(n, low))
        if len(at) < least:
            return
        at = at[np.argsort(self.lengths[at], kind="stable")]
        # The long lists: as many as leave at least half of the shortest signature to be met in short ones.
        n_long = max(0, least - max(1, (n - least + 1) // 2))
        short, long = at[: len(at) - n_long], np.sort(self.tokens[at[len(at) - n_long :]])
        met = np.concatenate([self.owners[self.first[k] : self.first[k] + self.lengths[k]] for k in short])
        met = np.sort(met, kind="stable")  # the sorted lists merged
        found, starts, counts = np.unique(met, return_index=True, return_counts=True)
        sizes = self.sizes[found]
        needed = sim.least_overlap(n, sizes)
        good = (sizes >= low) & (sizes <= sim.longest(n)) & (counts >= needed - n_long)
        found, counts, needed = found[good], counts[good], needed[good]
        for k in np.argsort(-counts, kind="stable"):
            y = found[k]
            if skip[y]:
                continue
            own = self.sets[y]
            place = np.searchsorted(own, long)
            place[place == len(own)] = 0
            if counts[k] + np.count_nonzero(own[place] == long) >= needed[k]:
                yield y


def _unpack(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.asarray(table["node"]), [np.frombuffer(t, "<u8") for t in table["tokens"].to_pylist()]


def _search_within(nodes: np.ndarray, sets: list[np.ndarray], similarity: Similarity) -> np.ndarray:
    """The label of each set of a shard, searched with its own sets: the smallest node of its class there."""
    order = np.argsort(nodes)
    shard, label = Shard([sets[k] for k in order], similarity), np.arange(len(nodes))
    for k, s in enumerate(shard.sets):
        skip = label == label[k]
        for y in shard.search(s, skip):
            a, b = sorted((label[k], label[y]))
            label[label == b] = a
            skip |= label == a
    out = np.empty(len(nodes), np.int64)
    out[order] = nodes[order][label]
    return out


def _across(similarity: Similarity):
    """Queries against another shard: (a, b) of linked classes."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        words.kept("jaccard")
        words.give_back()
        links: set[tuple[int, int]] = set()
        if queries.num_rows and index.num_rows:
            nodes, sets = _unpack(index)
            shard, labels = Shard(sets, similarity), np.asarray(index["label"])
            for label, s in zip(np.asarray(queries["label"]), _unpack(queries)[1], strict=True):
                skip = np.isin(labels, [label, *(b for a, b in links if a == label)])
                for y in shard.search(s, skip):
                    links.add((int(label), int(labels[y])))
                    skip |= labels == labels[y]
        pairs = sorted(links)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return run


def _searched(sets: DataFrame, turn: int, similarity: Similarity) -> DataFrame:
    """Sets cut into shards and searched there: adds ``shard`` and ``label``.

    Neighbours in the order of the turn's minimum hash share a shard, at most SHARD of them and SHARD_BYTES of
    shingles; ranges of that order are split where one hash is frequent.  Equal nodes are neighbours; one stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size, last = TaskContext.get().partitionId() << 32, [], 0, None

        def shard() -> pa.RecordBatch:
            nonlocal number, held, size
            words.give_back()
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            nodes, own = _unpack(rows)
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(nodes), number - 1)), pa.array(_search_within(nodes, own, similarity))], [*rows.schema.names, "shard", "label"])

        words.kept("jaccard")
        for batch in batches:
            nodes, bytes_ = np.asarray(batch["node"]), np.asarray(pc.binary_length(batch["tokens"]), np.int64)
            fresh = np.append(True, nodes[1:] != nodes[:-1]) if len(nodes) else np.empty(0, bool)
            if len(nodes):
                fresh[0], last = nodes[0] != last, nodes[-1]
            start, count = 0, sum(b.num_rows for b in held)
            for k in np.flatnonzero(fresh):
                if count and (count == SHARD or size + bytes_[k] > SHARD_BYTES):
                    if k > start:
                        held.append(batch.take(pa.array(np.flatnonzero(fresh[start:k]) + start)))
                    yield shard()
                    start, count = k, 0
                count, size = count + 1, size + int(bytes_[k])
            rest = np.flatnonzero(fresh[start:]) + start
            if len(rest):
                held.append(batch.take(pa.array(rest)))
        if held:
            yield shard()

    names = ", ".join(f"{c} {t}" for c, t in sets.dtypes)
    ranged = sets.repartitionByRange(f"low{turn}", "node").sortWithinPartitions(f"low{turn}", "node")
    return store.keep(ranged.mapInArrow(run, names + ", shard long, label long"), "uncompressed")


def frequent_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """At most FREQUENT hashes that many documents have. They only set the order of shingles, which any order may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.kept("jaccard")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen = np.zeros(1 << 24, np.uint8)  # bits of what this task has met
        for batch in words.slices(batches, "text"):
            flat = np.concatenate([*shingle_sets(batch["text"], width), np.empty(0, np.uint64)])
            own, counts = np.unique(flat, return_counts=True)
            at, bit = (own >> np.uint64(40)).astype(np.int64), (np.uint8(1) << ((own >> np.uint64(37)) & np.uint64(7)).astype(np.uint8))
            often = (counts > 1) | (seen[at] & bit > 0)
            np.bitwise_or.at(seen, at, bit)
            held.append((own[often], counts[often]))
        if held:
            own, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([h[1] for h in held]), len(own)).astype(np.int64)
            top = np.argsort(-counts, kind="stable")[:FREQUENT]
            yield pa.RecordBatch.from_arrays([pa.array(own[top].astype(np.int64)), pa.array(counts[top])], ["token", "n"])

    counted = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "token long, n long")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).where("n >= 5").orderBy(F.col("n").desc(), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(np.asarray(top["token"]).astype(np.uint64))


def jaccard_classes(docs: DataFrame, percent: int = 90, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links), class_id and mark of every row.

    class_id is one for all rows of a class, null without words; mark is the xxhash64 of the text.
    """
    sim = Similarity(percent)
    frequent = frequent_shingles(docs, text, width)
    # Sets below this size are linked with equal sets only.
    alone = next(n for n in range(1, 1000) if sim.least_overlap(n, n + 1) <= n)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.kept("jaccard")
        for batch in words.slices(batches, "text"):
            nodes, sizes, signatures = [], [], []
            for tokens in shingle_sets(batch["text"], width):
                nodes.append(_node(tokens))
                sizes.append(len(tokens))
                if len(tokens) < alone:
                    signatures.append(None)
                    continue
                place = np.searchsorted(frequent, tokens)
                place[place == len(frequent)] = 0
                late = frequent[place] == tokens if len(frequent) else np.zeros(len(tokens), bool)
                signatures.append(np.concatenate((tokens[~late], tokens[late]))[: sim.signature(len(tokens))].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["mark"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.list_(pa.int64()))], ["key", "mark", "node", "n", "signature"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    placed = store.keep(rows.mapInArrow(signed, "key long, mark long, node long, n long, signature array<long>"))
    nodes = placed.where("signature IS NOT NULL").dropDuplicates(["node"])
    spread = nodes.select("node", "n", F.explode("signature").alias("token"))
    shared = spread.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    least = F.greatest(F.lit(1), F.floor((F.ceil(F.lit(percent) * F.col("n") / 100) - F.ceil(F.lit(percent) * F.ceil(F.lit(percent) * F.col("n") / 100) / 100) + 1) / 2))
    occurrences = store.keep(spread.join(shared, "token").select("token", "node", "n"))
    active = store.keep(occurrences.groupBy("node", "n").agg(F.count("*").alias("met")).where(F.col("met") >= least).select("node"))
    label = _classes(rows, placed, occurrences, active, sim, width, least)
    store.discard(occurrences, active)

    lowest = placed.groupBy("node").agg(F.min("key").alias("low"))
    classed = lowest.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = classed.groupBy("label").agg(F.min("low").alias("component_id"))
    named = classed.select("node", "label").join(ids, "label").select("node", "label", "component_id")
    out = placed.select("key", "mark", "node", "n").join(named, "node")
    component = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(F.col("n") > 0, F.col("label")).alias("class_id"), "mark")


def _classes(rows: DataFrame, placed: DataFrame, occurrences: DataFrame, active: DataFrame, sim: Similarity, width: int, least) -> DataFrame:
    """(node, label) of the active nodes."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.kept("jaccard")
        for batch in words.slices(batches, "text"):
            sets = shingle_sets(batch["text"], width)
            lows = [pa.array([int(mixed(s, 1000 + turn).min().astype(np.int64)) if len(s) else 0 for s in sets], pa.int64()) for turn in range(TURNS)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), *lows], ["wanted", "node", "n", "tokens", *(f"low{k}" for k in range(TURNS))])

    one = placed.groupBy("node").agg(F.min(F.struct("mark", "key")).alias("row")).join(active, "node", "left_semi").select("node", F.col("row.mark").alias("own"), F.col("row.key").alias("of"))
    text_of = rows.join(one, (F.col("mark") == F.col("own")) & F.col("key").eqNullSafe(F.col("of"))).select("node", "text")
    sets = store.keep(text_of.mapInArrow(whole, "wanted long, " + _SET + ", " + ", ".join(f"low{k} long" for k in range(TURNS))).where("wanted = node").drop("wanted"), "uncompressed")
    home = _searched(sets, 0, sim)
    store.discard(sets)
    label, leaders = home.select("node", "label"), home
    for turn in range(1, TURNS):
        # the smallest nodes of the classes so far meet others than before
        again = _searched(leaders.where("node = label").drop("shard", "label", f"low{turn - 1}"), turn, sim)
        moved = again.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("to"))
        label = store.keep(label.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        if leaders is not home:
            store.discard(leaders)
        leaders = again
    store.discard(leaders)
    made, home = home, home.select("node", "n", "tokens", "shard")
    known = store.keep(home.select("node", "shard").join(label, "node"))

    met = _open(occurrences.join(known, "node"), least)
    visits = _visits(met, sim, least)
    if visits.isEmpty():
        store.discard(made, met, visits)
        return label
    left = met.select("node", "label").distinct()
    sets = store.keep(home.join(left, "node").select("node", "label", "shard", "tokens"), "uncompressed")
    store.discard(made, met)
    parts = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    queries = visits.join(parts, "shard").select("node", "label", "shard", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    queries = queries.join(store.again(sets).select("node", "tokens"), "node")
    index = sets.join(parts, "shard").select("shard", "node", "label", "tokens", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    linked = store.keep(queries.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(_across(sim), "a long, b long"))
    store.discard(sets, visits)
    merged = components(linked).select(F.col("id").alias("label"), F.col("label").alias("to"))
    return store.keep(label.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def _open(met: DataFrame, least) -> DataFrame:
    """The rows of ``met`` (token, node, n, shard, label) that can still lead to a link between classes.

    Sets of two classes that are linked share T shingles of either signature, so a node needs T of them that
    another class has, too.  Nodes with fewer are settled; without them fewer shingles are shared, so twice.
    """
    met = store.keep(met)
    for _ in range(2):
        shared = met.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
        rows = store.keep(met.join(shared, "token").select(*met.columns))
        nodes = rows.groupBy("node", "n").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("node")
        left = store.keep(rows.join(nodes, "node", "left_semi"))
        store.discard(met, rows)
        met = left
    return met


def _visits(met: DataFrame, sim: Similarity, least) -> DataFrame:
    """(node, label, shard): the shards of lower number where a node can have a partner of another class.

    met: (token, node, n, shard, label), the signatures.  Shingles of few classes count by class; those
    of more than CLASSES are counted by shard, as if one class there had them all.
    """
    by_class = met.groupBy("token", "label", F.col("shard").alias("other")).agg(F.min("n").alias("shortest"), F.max("n").alias("longest"))
    spread = by_class.groupBy("token").agg(F.count("*").alias("classes"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    in_reach = (F.col("longest") * 100 >= F.col("n") * sim.percent) & (F.col("shortest") * sim.percent <= F.col("n") * 100)
    few = spread.where(F.col("classes") <= CLASSES).select("token")
    there = by_class.join(few, "token").withColumnRenamed("label", "their")
    near = met.join(there, "token").where((F.col("shard") > F.col("other")) & (F.col("label") != F.col("their")) & in_reach)
    own = near.groupBy("node", "n", "label", "other", "their").agg(F.count("*").alias("c")).groupBy("node", "n", "label", "other").agg(F.max("c").alias("c"))
    many = spread.where(F.col("classes") > CLASSES).select("token")
    by_shard = by_class.join(many, "token").groupBy("token", "other").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))
    crowd = met.join(by_shard, "token").where((F.col("shard") > F.col("other")) & ((F.col("a") != F.col("label")) | (F.col("b") != F.col("label"))) & in_reach)
    both = own.union(crowd.groupBy("node", "n", "label", "other").agg(F.count("*").alias("c"))).groupBy("node", "n", "label", "other").agg(F.sum("c").alias("c"))
    found = store.keep(both.where(F.col("c") >= least).select("node", "label", F.col("other").alias("shard")))
    return found


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shingles of three words, similarity of 0.9 or more."""
    return jaccard_classes(store.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL_OP6 = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w),
t AS (SELECT rid, doc_id, unnest(g) AS t, len(g) AS n FROM s),
links AS (SELECT a.rid AS a, b.rid AS b FROM t a JOIN t b ON a.t = b.t AND a.rid <> b.rid AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
    GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT rid AS a, rid AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON s.rid = reach.a JOIN s o ON reach.b = o.rid GROUP BY s.rid, s.doc_id, s.g
"""
