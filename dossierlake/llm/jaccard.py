"""Similarity join of texts on word shingles, by a token-group matrix.

1. Texts with equal shingle sets form one class; a class has one row from there on.
2. Shingles get one global order, rarest first, from counts over all documents (a fixed-size table of
   hashed counts). Two sets that reach the threshold ``t`` share ``l`` shingles among the first
   ``n - ceil(t * n) + l`` of both, for any ``l`` up to their overlap. Those are posted; classes with too
   few shared postings leave, and what they leave unshared leaves with them.
3. Classes are compared with two pivots of their postings: the one that shares most of its own, as the
   original of a family does, and another. Those links are merged, so that large families of near copies
   cost a comparison or two each instead of all pairs.
4. What the pivots left apart is settled by the matrix: classes are partitioned into groups of similar
   ones (a merged family, or singles with the same least posting). Groups meet where they share a posting,
   once a pair of groups, whatever their sizes; a group meets all the smaller ones that it must meet
   together. Large groups are cut into blocks of bounded size; of each pair of blocks, the union of either's
   shingles bounds the overlap of every row of the other, and only rows whose bound reaches the threshold
   are opened and compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from dossierlake.llm.common import components, materialize, measured

BLOCK = 250_000  # shingles of a block of a group (2 MB); one longer text stands alone
TASK = 2_000_000  # shingles that meet in one call
FAN_IN = 64  # partial count tables summed at a time
SKETCH_BITS = 22  # hashed shingle counts: 16 MB, whatever the corpus
SLICES = 16
BROADCAST_ROWS = 1_000_000  # rows of ids that may be sent to every executor (under 40 MB)
STEP = 16  # one more shared posting is asked for per so many shingles of overlap
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty where it has no word."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    sizes = [len(s) for s in split]
    total = sum(sizes)
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, total)
    rolled = flat[: max(0, total - width + 1)].copy()
    for j in range(1, width):
        rolled = (rolled ^ (rolled >> np.uint64(31))) * _M1 + flat[j : j + len(rolled)]
    rolled = (rolled ^ (rolled >> np.uint64(30))) * _M2
    rolled = (rolled ^ (rolled >> np.uint64(27))) * _M3
    out, at = [], 0
    for s, n in zip(split, sizes):
        if n >= width:
            out.append(_distinct(rolled[at : at + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\x00short\x00" + b"\x00".join(s))], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _small_batches(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one holds about ``chars`` bytes (a very long text stands alone)."""
    for b in batches:
        step = max(1, int(b.num_rows * chars / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _counts(width: int):
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in _small_batches(batches):
            sets = shingle_sets(b.column(0).to_pylist(), width)
            if sets:
                np.add.at(counts, np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1), 1)
        if counts.any():
            part = TaskContext.get().partitionId()
            for k, piece in enumerate(np.split(counts, SLICES)):
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([zstandard.compress(piece.tobytes(), 1)])}
                )

    return run


def _add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint32)
    for c in pdf["counts"]:
        total += np.frombuffer(zstandard.decompress(c), np.uint32)
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // FAN_IN], "counts": [zstandard.compress(total.tobytes(), 1)]})


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """Hashed shingle counts over all rows of ``texts`` (text): a table of fixed size, summed as a tree."""
    schema = "slice int, part int, counts binary"
    parts = texts.mapInArrow(_counts(width), schema)
    n = max(1, texts.rdd.getNumPartitions())
    while True:
        parts = parts.groupBy("slice", F.expr(f"part div {FAN_IN}").alias("g")).applyInPandas(_add_counts, schema)
        n = -(-n // FAN_IN)
        if n == 1:
            break
    total = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint32)
    for r in parts.collect():  # SLICES rows
        total[r["slice"]] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.uint32)
    return total.reshape(-1)


def _need(n: int, num: int, den: int) -> int:
    """Shared postings of a set of ``n`` that count on: grows with ``n``, never beyond the least overlap."""
    return 1 + (-(-num * n // den) - 1) // STEP


def _signatures(width: int, num: int, den: int, counts):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("need", pa.int64()), ("cls", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        order = counts.value
        for b in _small_batches(batches):
            sets = shingle_sets(b.column(2).to_pylist(), width)
            cls, prefix, need = [], [], []
            for s in sets:
                n = len(s)
                if not n:
                    cls.append(None)
                    prefix.append(None)
                    need.append(0)
                    continue
                keep = n - -(-num * n // den) + _need(n, num, den)
                need.append(_need(-(-num * n // den), num, den))  # the least that a partner can ask
                rank = np.lexsort((s, order[s & np.uint64((1 << SKETCH_BITS) - 1)]))[:keep]
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefix.append(s[rank].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(need, pa.int64()), pa.array(cls, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], schema=schema
            )

    return run


def _token_sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for b in _small_batches(batches):
            sets = shingle_sets(b.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema
            )

    return run


class _Rows:
    """Rows of token sets: labels, sizes, and the tokens laid end to end."""

    def __init__(self, node: np.ndarray, label: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.node, self.label, self.sizes, self.flat = node, label, sizes, flat

    def take(self, keep: np.ndarray) -> _Rows:
        return _Rows(self.node[keep], self.label[keep], self.sizes[keep], self.flat[np.repeat(keep, self.sizes)])

    def within(self, union: np.ndarray) -> np.ndarray:
        """How many tokens of each row a sorted union has."""
        at = np.minimum(np.searchsorted(union, self.flat), len(union) - 1)
        return np.add.reduceat(union[at] == self.flat, self.starts(), dtype=np.int64)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _bounded(rows: _Rows, others: _Rows, num: int, den: int) -> _Rows:
    """Rows that may link with some row of ``others``, by what they share with the union of all of them."""
    if not len(rows.node) or not len(others.node):
        return rows.take(np.zeros(len(rows.node), bool))
    least = np.maximum(rows.sizes, others.sizes.min())
    return rows.take(rows.within(_distinct(others.flat)) * den >= num * least)


def _links(a: _Rows, b: _Rows | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join labels between rows of ``a`` and ``b`` (or among ``a``); rows joined before are not compared."""
    if b is not None:
        a = _bounded(a, b, num, den)
        b = _bounded(b, a, num, den)
    other = a if b is None else b
    if not len(a.node) or not len(other.node):
        return []
    seen, codes = np.unique(np.concatenate((a.flat, other.flat)), return_inverse=True)
    mine, theirs, starts, sizes = codes[: len(a.flat)], codes[len(a.flat) :], other.starts(), other.sizes
    marked = np.zeros(len(seen), bool)
    labels, root = np.unique(np.concatenate((a.label, other.label)), return_inverse=True)
    own, root = root[: len(a.label)], root[len(a.label) :]
    top = np.arange(len(labels))  # where each label stands now
    found, at = [], 0
    for i, n in enumerate(a.sizes.tolist()):
        tokens = mine[at : at + n]
        at += n
        here = top[own[i]]
        near = (top[root] != here) & (np.minimum(sizes, n) * den >= np.maximum(sizes, n) * num)
        if b is None:
            near[: i + 1] = False
        if not near.any():
            continue
        marked[tokens] = True
        if 4 * np.count_nonzero(near) < len(near):
            which = np.flatnonzero(near)
            both = np.add.reduceat(marked[theirs[np.repeat(near, sizes)]], np.cumsum(sizes[which]) - sizes[which], dtype=np.int64)
        else:
            which = np.arange(len(near))
            both = np.where(near, np.add.reduceat(marked[theirs], starts, dtype=np.int64), 0)
        marked[tokens] = False
        for j in which[both * den >= num * (sizes[which] + n - both)].tolist():
            if top[root[j]] != here:
                found.append((int(a.node[i]), int(other.node[j])))
                top[top == top[root[j]]] = here
    return found


def _open_groups(num: int, den: int):
    """Links between the rows of pairs of blocks; a call has pairs of some millions of tokens."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pair", "ascending"), ("side", "ascending")]).combine_chunks()
        pair, side, node, label = (table.column(c).to_numpy() for c in ("pair", "side", "node", "label"))
        lists = table.column("tokens").chunk(0)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        begins = np.r_[0, ends]
        cuts = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (side[1:] != side[:-1]), True])
        found, held = [], None
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = _Rows(node[x:y], label[x:y], np.diff(begins[x : y + 1]), flat[begins[x] : begins[y]])
            if side[x] == 0:
                held = rows
            found += _links(rows, None, num, den) if side[x] == 2 else _links(held, rows, num, den) if side[x] == 1 else []
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def link_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Components of documents whose shingle sets have Jaccard similarity of ``num / den`` or more.

    ``docs`` has doc_id and text (further columns are ignored). Returns a row per input row: doc_id,
    n_shingles (size of the set), component_id (least doc_id reachable by links, its own included).
    Words are what ASCII white space leaves of the text with A-Z lower-cased; a text of fewer than
    ``width`` words has its whole sequence as its one shingle.
    Null, empty or blank texts: n_shingles 0, linked with nothing, component_id their own doc_id.
    Equal texts, and repeated rows, are linked. Null doc_ids stay as rows and never name a component
    that has any other id. Empty table: no rows.
    """
    named = labelled(docs, width, num, den)
    least = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def labelled(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """As ``link_components``, but doc_id, text_key (hash of the text), n_shingles and label: rows of one label, and
    no others, are linked, by whatever doc_id; null where a text has no word."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(shingle_counts(rows.select("text"), width))
    signed = materialize(
        rows.mapInArrow(_signatures(width, num, den, counts), "doc_id long, text_key long, n_shingles long, need long, cls binary, prefix array<long>"), "signatures"
    )
    counts.destroy()  # the rows are written; the driver's copy goes too
    classes = signed.filter("cls is not null")
    ids = _numbered(classes)
    unique = classes.groupBy("cls").agg(F.first("prefix").alias("prefix"), F.first("need").alias("need")).select(ids.alias("node"), "need", "prefix")
    posted = unique.select("node", F.explode("prefix").alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    first = materialize(posted.join(shared, "token"), "postings")
    postings = _enough(first, unique.select("node", "need", F.size("prefix").alias("posted")))
    labels = _settle(rows, signed.withColumn("node", F.when(F.col("cls").isNotNull(), ids)), postings, width, num, den)
    named = signed.select("doc_id", "text_key", "n_shingles", F.when(F.col("cls").isNotNull(), ids).alias("node")).join(labels, "node", "left")
    return named.select("doc_id", "text_key", "n_shingles", F.coalesce("label", "node").alias("label"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each group of linked rows: the least doc_id, a null one only where there is no other.

    Texts without words are linked with nothing, so all of them stay. Rows of one doc_id whose texts differ
    are different rows; of rows that repeat a doc_id with its text one stays. All columns stay, of whatever
    name; an empty table gives no rows. Keys of the rows that go are sent to every task where they are few,
    and texts then stay in place.
    """
    key = "text key"
    while key in docs.columns:
        key += "_"
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")
    rows = materialize(labelled(docs, width, num, den).filter("label is not null").groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "rows-of-labels")
    ranked = rows.join(rows.groupBy("label").agg(F.min(order).alias("first")), "label").withColumn("stays", order == F.col("first"))
    repeats = Observation()
    judged = ranked.observe(repeats, F.count_if(F.expr("stays and n > 1")).alias("rows"))
    gone, many = measured(judged.filter("not stays").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")), "gone", F.count(F.lit(1)))
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    same = lambda other: keyed["doc_id"].eqNullSafe(other["gone_id"]) & (keyed[key] == other["gone_key"])
    kept = keyed.join(_small(gone, many), same(gone), "left_anti")
    if not repeats.get.get("rows"):
        return kept.drop(key)
    twice = ranked.filter("stays and n > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    twice, many = measured(twice, "twice", F.count(F.lit(1)))
    once = keyed.join(_small(twice, many), same(twice), "left_semi").dropDuplicates(["doc_id", key])
    return kept.join(_small(twice, many), same(twice), "left_anti").unionByName(once).drop(key)


def _small(keys: DataFrame, many: int) -> DataFrame:
    return F.broadcast(keys) if many <= BROADCAST_ROWS else keys


def _numbered(classes: DataFrame):
    """A 64-bit number of a class, no two alike: the hash of its 128-bit key under a seed that keeps them apart."""
    distinct = classes.select("cls").distinct()
    for seed in range(100):
        number = F.xxhash64("cls", F.lit(seed))
        if distinct.groupBy(number.alias("node")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
            return number
    raise RuntimeError("no seed keeps the classes apart")


def _enough(postings: DataFrame, needs: DataFrame) -> DataFrame:
    """Postings of nodes that share as many as any partner needs: node, token, alone (share of them that is not shared)."""
    kept = postings.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(needs, "node").filter("n >= need")
    left = postings.join(kept.select("node", (1 - F.col("n") / F.col("posted")).alias("alone")), "node")
    # what they leave unshared leaves with them; of a posting's nodes, low shares most of its own
    shared = left.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("alone", "node")).alias("low"), F.max("node").alias("high")).filter("c > 1").drop("c")
    return materialize(left.join(shared, "token"), "postings")


def _settle(rows: DataFrame, signed: DataFrame, postings: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, label) of the classes that link with another class."""
    sets = _sets_of(rows, signed, postings.select("node").distinct(), width)
    linked = materialize(_pivot_links(postings, sets, num, den), "star-links")
    merged = components(linked).withColumn("merged", F.lit(True))
    labelled = postings.select("token", "node").join(merged, "node", "left")
    labelled = materialize(labelled.select("token", "node", F.coalesce("label", "node").alias("label"), F.coalesce("merged", F.lit(False)).alias("merged")), "labelled-postings")
    open_tokens = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("token")
    apart = labelled.join(open_tokens, "token")
    group = F.when(F.col("merged"), F.xxhash64("label", F.lit(1))).otherwise(F.xxhash64("t", F.lit(0)))
    members = apart.groupBy("node", "label", "merged").agg(F.min("token").alias("t")).join(sets.select("node", "n"), "node")
    members = materialize(members.select("node", "label", "n", group.alias("g")), "groups")
    sizes = members.groupBy("g").agg(
        F.sum("n").alias("size"), F.ceil(F.sum("n") / BLOCK).alias("cuts"), F.min("n").alias("lo"), F.max("n").alias("hi"), (F.min("label") == F.max("label")).alias("one")
    )
    sizes = materialize(sizes, "group-sizes")
    # the matrix: which group has which posting, and the pairs of groups that have one in common
    matrix = materialize(apart.select("token", "node").join(members.select("node", "g"), "node").select("token", "g").distinct(), "matrix")
    # the larger group of a pair is the host, and meets all its smaller guests together, in blocks
    facts = F.struct("size", "g", "lo", "hi", "cuts")
    known, other = sizes.select("g", facts.alias("x")), sizes.select(F.col("g").alias("h"), facts.alias("y"))
    met = matrix.join(matrix.withColumnRenamed("g", "h"), "token").filter("g < h").select("g", "h").distinct().join(known, "g").join(other, "h")
    met = met.filter((F.col("x.hi") * den >= F.col("y.lo") * num) & (F.col("y.hi") * den >= F.col("x.lo") * num))
    met = met.select(F.greatest("x", "y").alias("host"), F.least("x", "y").alias("guest"))
    met = materialize(met.select(F.col("host.g").alias("host"), F.col("host.cuts").alias("host_cuts"), F.col("guest.g").alias("g"), F.col("guest.size").alias("size")), "met")
    shares = met.groupBy("host").agg(F.ceil(F.sum("size") / BLOCK).alias("shares"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    pair = lambda kind, g, i, j: F.xxhash64(F.lit(kind), g, i, j).alias("pair")
    members = members.join(sizes.select("g", "cuts", "one"), "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts")))
    hosts = members.join(shares.withColumnRenamed("host", "g"), "g").withColumn("share", upto("shares")).select("node", "label", "n", pair(0, "g", "block", "share"), F.lit(0).alias("side"))
    guests = members.select("node", "label", "n", "g").join(met.join(shares, "host").select("host", "host_cuts", "g", "shares"), "g")
    guests = guests.withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares"))).withColumn("block", upto("host_cuts"))
    guests = guests.select("node", "label", "n", pair(0, "host", "block", "share"), F.lit(1).alias("side"))
    # a group with several labels also meets itself; side 2: a block that meets itself
    own = members.filter("not one").withColumn("o", upto("cuts"))
    own = own.select(
        "node", "label", "n", pair(1, "g", F.least("block", "o"), F.greatest("block", "o")), F.when(F.col("o") == F.col("block"), 2).when(F.col("o") > F.col("block"), 0).otherwise(1).alias("side")
    )
    meeting, load = measured(hosts.unionByName(guests).unionByName(own), "meetings", F.sum("n"))
    task = F.pmod(F.xxhash64("pair"), F.lit(max(1, -(-load // TASK))))
    meeting = meeting.join(sets.select("node", "tokens"), "node").select(task.alias("task"), "pair", "side", "node", "label", "tokens")
    more, found = measured(meeting.groupBy("task").applyInArrow(_open_groups(num, den), "a long, b long"), "links", F.count(F.lit(1)))
    return components(linked.unionByName(more)) if found else merged.select("node", "label")


def _pivot_links(postings: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of nodes with the pivots of their postings."""
    left, right = sets.toDF("a", "na", "ta"), sets.toDF("b", "nb", "tb")
    stars = postings.groupBy("node").agg(F.min("low").alias("p"), F.max("high").alias("q"))
    pairs = stars.select(F.col("node").alias("a"), F.explode(F.array("p.node", "q")).alias("b")).filter("a != b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    return (
        pairs.join(left, "a").join(right, "b")
        .filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
        .withColumn("both", both)
        .filter(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num)
        .select("a", "b")
    )


def _sets_of(rows: DataFrame, signed: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, tokens) of ``nodes``, from one text of each."""
    nodes, many = measured(nodes, "involved", F.count(F.lit(1)))
    keyed = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("text_key", "doc_id")).alias("k")).join(nodes, "node", "left_semi")
    keyed = keyed.select("node", F.col("k.text_key").alias("text_key"), F.col("k.doc_id").alias("id"))
    keyed = _small(keyed, many)
    texts = rows.join(keyed, "text_key").filter(F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    sets, given = measured(texts.mapInArrow(_token_sets(width), "node long, n long, tokens array<long>"), "token-sets", F.count(F.lit(1)))
    # rows that repeat a doc_id with its text give their set twice; every node has one
    return sets.dropDuplicates(["node"]) if given != many else sets
