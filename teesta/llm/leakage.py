"""Evaluation passages inside documents, by Wu-Manber search over words.

The patterns are all runs of `length` words of the test items. A shift table
over pairs of words skips positions where no pattern can end; where the shift
is nought, the patterns with that last pair are told apart by their first pair
and compared word by word.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teesta.llm.shelf import Shelf, spread


class _Keep(dict):
    """Translation that keeps letters, marks and digits, makes white space blanks and drops the rest."""

    def __missing__(self, code: int) -> int | None:
        ch = chr(code)
        kind = unicodedata.category(ch)
        out = code if kind[0] in "LM" or kind == "Nd" else 32 if ch.isspace() else None
        self[code] = out
        return out


_KEEP = _Keep()


def words_of(text: str | None) -> list[str]:
    """Words split at white space, lower case, of letters, marks and digits only; empty ones dropped."""
    return text.lower().translate(_KEEP).split() if text else []


class WuManber:
    """Search for the runs of `length` words of the items.

    A run is held as a place in the items' words, not copied; equal runs share
    their first place. Buckets go by the 64-bit hash of the last pair of words,
    then of the first; what they give is compared word by word.
    """

    def __init__(self, items: list[tuple[int, str | None]], length: int = 12) -> None:
        self.length = length
        self.words: list[str] = []
        self.shift: dict[int, int] = {}
        self.buckets: dict[tuple[int, int], list[int]] = {}
        self.holders: dict[int, set[int]] = {}  # first place of a run: the items that have it
        known: dict[str, str] = {}
        for item, text in items:
            w = [known.setdefault(x, x) for x in words_of(text)]
            base = len(self.words)
            self.words += w
            pairs = [hash((a, b)) for a, b in zip(w, w[1:], strict=False)]
            for i in range(len(w) - length + 1):
                for j in range(1, length):
                    pair = pairs[i + j - 1]
                    self.shift[pair] = min(self.shift.get(pair, length - 1), length - 1 - j)
                bucket = self.buckets.setdefault((pairs[i + length - 2], pairs[i]), [])
                first = next((p for p in bucket if self.words[p : p + length] == w[i : i + length]), None)
                if first is None:
                    first = base + i
                    bucket.append(first)
                self.holders.setdefault(first, set()).add(item)

    def find(self, words: list[str]) -> set[int]:
        """Ids of the items a run of which occurs in `words`."""
        m, found = self.length, set()
        i, n = m - 1, len(words)
        shift, buckets, jump = self.shift, self.buckets, self.length - 1
        while i < n:
            pair = hash((words[i - 1], words[i]))
            s = shift.get(pair, jump)
            if s:
                i += s
                continue
            start = i - m + 1
            for p in buckets.get((pair, hash((words[start], words[start + 1]))), ()):
                if self.words[p : p + m] == words[start : i + 1]:
                    found |= self.holders[p]
            i += 1
        return found


# A Python worker keeps the tables of the block it works on from task to task.
_built: dict[str, WuManber] = {}


def _blocks(items: DataFrame, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `most_chars` characters, a longer one alone; one block is held at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.toLocalIterator():
        if block and size + len(r[1]) > most_chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, length: int = 12, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", block_chars: int = 2_000_000) -> DataFrame:
    """key, item_key of each document and each item that have `length` or more successive words in common, once.

    The items are the query set: they go to the tasks in blocks of at most
    `block_chars` characters (tables of some 100 MB), each block a pass over the
    documents, which are read whole and never shuffled. Of several blocks one is
    sent at a time: its finds are written before the next is built. Null or
    shorter texts match nothing; rows repeated under one id count once; items
    with the same words are each reported; other columns are ignored.
    """
    spark = documents.sparkSession
    kinds = f"_doc {documents.schema[key].dataType.simpleString()}, _item {items.schema[item_key].dataType.simpleString()}"
    docs = spread(documents.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()))
    queries = items.select(F.col(item_key), F.col(item_text)).where(F.col(item_text).isNotNull()).distinct()
    shelf = Shelf(spark)

    def search(block: list[tuple[int, str]]) -> tuple[DataFrame, Broadcast]:
        shared, token = spark.sparkContext.broadcast(sorted(block)), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if token not in _built:
                _built.clear()
                _built[token] = WuManber(shared.value, length)
            tables = _built[token]
            for b in batches:
                hits = [(d, i) for d, t in zip(b["_doc"], b["_text"], strict=True) for i in sorted(tables.find(words_of(t)))]
                yield pd.DataFrame(hits, columns=["_doc", "_item"])

        return docs.mapInPandas(run, kinds), shared

    blocks = _blocks(queries, block_chars)
    held = next(blocks, [])
    out = None
    while True:
        after = next(blocks, None)
        found, shared = search(held)
        if after is None and out is None:
            out = found
            break
        part = shelf.put(found)
        shared.destroy()
        out = part if out is None else out.unionByName(part)
        if after is None:
            break
        held = after
    return out.distinct().select(F.col("_doc").alias(key), F.col("_item").alias(item_key))
