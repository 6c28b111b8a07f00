"""Texts packed into containers of a fixed number of tokens by vector best fit.

A container has a capacity of tokens, of documents and of attention cost (the
sum of squared lengths). Items go, largest first, into the open container that
fits under every capacity and is left with the smallest weighted residual norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_tokens(text: Column) -> Column:
    """Tokens under the public byte-level tokenizer: one a UTF-8 byte and one end token; null has none."""
    return F.octet_length(text) + F.lit(1)


def best_fit(sizes: np.ndarray, capacity: int, max_items: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> np.ndarray:
    """The bin of each item; sizes are at most `capacity`. An item whose own cost is above `max_cost` gets a bin to itself."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    n_open, made = 0, 0
    room = np.empty(1024)
    slots, cost = np.empty(1024), np.empty(1024)
    ids = np.empty(1024, dtype=np.int64)
    least = float(sizes.min()) if len(sizes) else 0.0
    wt, ws, wc = weights[0] / capacity**2, weights[1] / max_items**2, weights[2] / max_cost**2
    for i in order:
        size = float(sizes[i])
        at = -1
        if size * size > max_cost:
            bins[i], made = made, made + 1
            continue
        if n_open:
            r, s, c = room[:n_open] - size, slots[:n_open] - 1, cost[:n_open] - size * size
            norm = np.where((r >= 0) & (s >= 0) & (c >= 0), wt * r * r + ws * s * s + wc * c * c, np.inf)
            at = int(norm.argmin())
            if norm[at] == np.inf:
                at = -1
        if at < 0:
            if n_open == len(room):
                room, slots, cost, ids = (np.concatenate([a, np.empty_like(a)]) for a in (room, slots, cost, ids))
            at, n_open = n_open, n_open + 1
            room[at], slots[at], cost[at], ids[at] = capacity, max_items, max_cost, made
            made += 1
        bins[i] = ids[at]
        room[at] -= size
        slots[at] -= 1
        cost[at] -= size * size
        if room[at] < least or slots[at] < 1:  # full: the last open one takes its place
            n_open -= 1
            for a in (room, slots, cost, ids):
                a[at] = a[n_open]
    return bins


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 8192, max_items: int = 64, max_cost: float | None = None) -> DataFrame:
    """key, piece_no (from 0), n_pieces, first_token, n_tokens, container_id of each document's pieces.

    Three capacities hold in every container: `capacity` tokens, `max_items`
    documents, and `max_cost`, the sum of squared lengths, which is what attention
    within documents costs; by default nine tenths of that of one document that
    fills the container. A piece that costs more than that travels alone.

    Only documents of more than `capacity` tokens are divided, into pieces of
    that size and a rest; rests and whole documents share containers. An empty
    text is one end token; a null text has no piece; repeated rows are items of
    their own. Each input partition is packed by itself from lengths alone, so
    texts never leave the JVM and nothing is shuffled; the unused room grows by
    less than a container or two a partition. Container ids are unique over all
    partitions.
    """
    max_cost = 0.9 * float(capacity) ** 2 if max_cost is None else max_cost
    lengths = documents.select(F.col(key).alias("_key"), byte_tokens(F.col(text)).cast("long").alias("_n")).where(F.col("_n").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        b = pd.concat(frames, ignore_index=True)
        n = b["_n"].to_numpy()
        whole, rest = n // capacity, n % capacity
        pieces = whole + (rest > 0)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece < whole[row], capacity, rest[row])
        full = size == capacity
        container = np.empty(len(row), dtype=np.int64)
        container[full] = np.arange(full.sum())
        container[~full] = full.sum() + best_fit(size[~full], capacity, max_items, max_cost)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        yield pd.DataFrame({"_key": b["_key"].to_numpy()[row], "piece_no": piece.astype(np.int32), "n_pieces": pieces[row].astype(np.int32), "first_token": piece * capacity, "n_tokens": size, "container_id": container + base})

    kind = documents.schema[key].dataType.simpleString()
    return lengths.mapInPandas(run, f"_key {kind}, piece_no int, n_pieces int, first_token bigint, n_tokens bigint, container_id bigint").withColumnRenamed("_key", key)


def divided_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the documents the packing had to divide."""
    return pack(documents).where((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select("doc_id")


def packing_report(documents: DataFrame) -> DataFrame:
    """One row: documents, pieces, containers, used tokens and the share of room used."""
    p = pack(documents)
    n = F.col("n_tokens")
    c = p.groupBy("container_id").agg(F.sum(n).alias("t"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("piece_no") == 0).alias("d"), F.sum(n * n).alias("a"))
    alone = F.col("k") == 1
    return c.agg(
        F.sum("d").alias("documents"), F.sum("k").alias("pieces"), F.count(F.lit(1)).alias("containers"), F.sum("t").alias("used_tokens"), F.max("t").alias("largest"), F.max("k").alias("most_pieces"),
        F.max(F.when(~alone, F.col("a") / 8192.0 / 8192.0)).alias("greatest_cost"), (F.sum("t") / (F.count(F.lit(1)) * 8192)).alias("share_used"),
    )


def packing_audit(documents: DataFrame) -> DataFrame:
    """One row: documents, tokens, pieces, divided documents, and whether every container keeps its three capacities."""
    p = pack(documents)
    n = F.col("n_tokens")
    c = p.groupBy("container_id").agg(F.sum(n).alias("t"), F.count(F.lit(1)).alias("k"), F.sum(n * n).alias("a"))
    kept = c.agg(F.bool_and((F.col("t") <= 8192) & (F.col("k") <= 64) & ((F.col("k") == 1) | (F.col("a") <= 0.9 * 8192 * 8192))).alias("capacities_kept"), (F.sum("t") > 0.9 * 8192 * (F.count(F.lit(1)) - 100)).alias("well_filled"))
    sums = p.agg(F.count_if(F.col("piece_no") == 0).alias("documents"), F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.count_if((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).alias("divided"))
    return sums.crossJoin(kept)  # two single rows
