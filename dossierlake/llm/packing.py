"""Best-fit packing of token sequences, by hierarchical residual packing.

Pieces are spread over parts by a hash; every part packs its own best-fit, longest first, and sends on full
bins as done. Underfull bins become items of the next round, in which ``FAN_IN`` parts' bins meet and are
packed best-fit again, up a tree, until they meet in one place.

After best-fit a part has at most one bin that is half empty or more, as two would have been put together.
Bins are items of later rounds as they are, and two bins over half full never share one, so in a round only
the ``FAN_IN`` small bins of its parts can be placed. A part sends on its ``RESIDUE`` roomiest bins, and as a bin
that has room for an item is among the roomiest if there is any, the others could not save a sequence: they
stand as they are, and no task of the tree holds more than ``FAN_IN * RESIDUE`` bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.bpe import CHUNK, Texts, batches_of, load
from dossierlake.llm.common import materialize

CAPACITY = 4096
FAN_IN = 8
PART = 50_000  # pieces that a part packs at first, about
RESIDUE = 2_000
END_ID = 1
_BINS = "part long, done boolean, total int, uids array<long>, offsets array<int>"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of every document's ids (its text's ids, then END_ID), of ``capacity`` tokens at most.

    uid (any distinct numbers), doc_id, piece, start, length, ids_crc32 and, if ``with_ids``, ids (binary, unsigned 32-bit).
    """
    fields = [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    end = np.uint32(END_ID).astype("<u4").tobytes()

    def run(batches):
        enc, uid = load(path), TaskContext.get().partitionId() << 34
        for b in batches_of(batches, CHUNK):
            ids, cuts = Texts(enc, b.column(1)).tokens()
            ids, cuts, out = memoryview(ids.astype("<u4")).cast("B"), (4 * cuts).tolist(), []
            for doc_id, x, y in zip(b.column(0).to_pylist(), cuts, cuts[1:]):
                own = bytes(ids[x:y]) + end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    out.append((uid, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(totals: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items longest first, each to the fullest bin that has room for it."""
    order = sorted(range(len(totals)), key=lambda i: (-totals[i], i))
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    mask = 0  # free places that some bin has
    for i in order:
        size = totals[i]
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        left = room - size
        free[left].append(k)
        mask |= 1 << left
    return bins


def _as_bins(part: int, items: list[tuple[int, list[int], list[int]]], capacity: int) -> pd.DataFrame:
    """Pack (total, uids, offsets) items."""
    rows = []
    for members in best_fit([x[0] for x in items], capacity):
        at, uids, offsets = 0, [], []
        for i in members:
            total, u, o = items[i]
            uids += u
            offsets += [x + at for x in o]
            at += total
        rows.append((part, False, at, uids, offsets))
    bins = pd.DataFrame(rows, columns=["part", "done", "total", "uids", "offsets"]).sort_values("total", kind="stable")
    bins["done"] = (bins["total"] >= capacity) | (np.arange(len(bins)) >= RESIDUE)
    return bins


def _first(capacity: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        items = sorted(zip(f["length"].tolist(), f["uid"].tolist()), key=lambda x: (-x[0], x[1]))
        return _as_bins(int(f["part"].iloc[0]), [(n, [u], [0]) for n, u in items], capacity)

    return run


def _again(capacity: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        items = [(int(t), [int(x) for x in u], [int(x) for x in o]) for t, u, o in zip(f["total"], f["uids"], f["offsets"])]
        items.sort(key=lambda x: (-x[0], x[1][0]))
        return _as_bins(int(f["part"].iloc[0]) // FAN_IN, items, capacity)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (uid, length of 1..capacity): uid, sequence_id, offset. Lengths alone travel."""
    parts = max(1, -(-pieces.count() // PART))
    spread = pieces.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part"))
    bins = materialize(spread.groupBy("part").applyInPandas(_first(capacity), _BINS), "bins")
    placed, left = bins.filter("done"), bins.filter("not done")
    while parts > 1:
        merged = materialize(left.groupBy(F.expr(f"part div {FAN_IN}").alias("g")).applyInPandas(_again(capacity), _BINS), "bins")
        placed, left = placed.unionByName(merged.filter("done")), merged.filter("not done")
        parts = -(-parts // FAN_IN)
    # a bin is named by its first piece, which no other bin has
    one = placed.unionByName(left).select(F.element_at("uids", 1).alias("sequence_id"), F.explode(F.arrays_zip("uids", "offsets")).alias("x"))
    return one.select(F.col("x.uids").alias("uid"), "sequence_id", F.col("x.offsets").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of ``capacity`` tokens at most.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, the
    piece's token ids, if ``with_ids``). Only documents over ``capacity`` tokens are cut. Null and empty
    texts are the end id alone. Repeated rows are packed each; null doc_ids stay null; an empty table
    gives no rows.
    """
    pieces = materialize(cut_pieces(docs, path, capacity, with_ids), "pieces")
    return pieces.join(pack(pieces, capacity), "uid").drop("uid")
