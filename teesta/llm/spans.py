"""Long stretches that stand verbatim in more than one text.

Every text is cut down to a few of its k-mers by winnowing, which is sure to
choose one inside any stretch of the sought length, and the same one in every
text that holds the stretch. The seeds two texts share are linked into chains
that rise in both, with gap costs, through a Fenwick tree; every seed is in one
chain. Chains decide what is compared: along each the texts are aligned, exactly
for stretches shared verbatim, with edits in the gaps for passages that were
altered. A seed that very many texts share isn't joined with itself; its
occurrences are grouped by the windows of sought length around it, which gives
the sharing texts as groups.

Texts alike as a whole are one class: only classes are seeded and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teesta.llm.shelf import Shelf, spread

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), 1 << 15)
        for name, base in (("up", _B), ("down", _BINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of `k` code points."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers_to(len(codes))
    c = codes.astype(np.uint64)
    # A multiplied and shifted code spreads each character over all bits before it enters the sum.
    c = (c + np.uint64(0x1234567)) * np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    s = np.cumsum(c * up)
    h = s[k - 1 :].copy()
    h[1:] -= s[: n - 1]
    h *= down[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of every `w` successive ones; of equal ones in a window the first."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= w:
        return np.array([int(h.argmin())])
    blocks = -(-n // w)
    pad = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = h
    grid = pad.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = np.minimum(right[: n - w + 1], left[w - 1 : n])
    # A position is chosen where it holds the minimum of a window that it is the first to hold.
    where = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    chosen = set()
    for a, b in zip(where, np.append(where[1:], n - w + 1), strict=True):
        # windows a..b-1 all have the minimum m[a]; walk its occurrences
        at = a + int(np.argmax(h[a : a + w] == m[a]))
        chosen.add(at)
        while b - 1 > at:  # the last windows begin beyond that occurrence
            more = np.flatnonzero(h[at + 1 : b - 1 + w] == m[a])
            if not len(more):
                break
            at = at + 1 + int(more[0])
            chosen.add(at)
    return np.array(sorted(chosen), dtype=np.int64)


def seeds_of(text: str, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the seeds of one text."""
    if len(text) < least:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = window_hashes(code_points(text), k)
    p = winnow(h, least - k + 1)
    return h[p], p


class Fenwick:
    """Greatest (score, index) over a prefix of keys."""

    def __init__(self, n: int) -> None:
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        i += 1
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def chains(anchors: list[tuple[int, int]], k: int, gap_cost: float = 0.1) -> list[tuple[float, list[tuple[int, int]]]]:
    """Chains of anchors (a, b) that rise in both texts, the best first; every anchor is in one.

    An anchor adds k, or less where it overlaps the one before; a gap costs
    `gap_cost` a code point of either text. With the cost linear in both
    positions the best predecessor is a prefix maximum, held in a Fenwick tree.
    An anchor whose best predecessor went to a better chain begins its own.
    """
    anchors = sorted(set(anchors))
    ranks = {b: i for i, b in enumerate(sorted({b for _, b in anchors}))}
    tree = Fenwick(len(ranks))
    score, back = [0.0] * len(anchors), [-1] * len(anchors)
    i = 0
    while i < len(anchors):
        j = i
        while j < len(anchors) and anchors[j][0] == anchors[i][0]:
            a, b = anchors[j]
            s, at = tree.upto(ranks[b] - 1) if ranks[b] else (float("-inf"), -1)
            score[j] = float(k)
            if at >= 0:
                gain = min(k, a - anchors[at][0], b - anchors[at][1])
                linked = s - gap_cost * (a + b) + gain
                if linked > score[j]:
                    score[j], back[j] = linked, at
            j += 1
        for x in range(i, j):
            a, b = anchors[x]
            tree.put(ranks[b], (score[x] + gap_cost * (a + b), x))
        i = j
    out, used = [], [False] * len(anchors)
    for top in sorted(range(len(anchors)), key=lambda x: (-score[x], x)):
        path, at = [], top
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(anchors[at])
            at = back[at]
        if path:
            out.append((score[top] - (score[at] if at >= 0 else 0.0), path[::-1]))
    return out


def chain(anchors: list[tuple[int, int]], k: int, gap_cost: float = 0.1) -> tuple[float, list[tuple[int, int]]]:
    """The best chain; (0, []) of no anchors."""
    return (chains(anchors, k, gap_cost) or [(0.0, [])])[0]


def edits(s: str, t: str) -> int:
    """Levenshtein distance, by bit vectors over the whole of `s`."""
    if not s or not t:
        return len(s) + len(t)
    match: dict[str, int] = {}
    for i, c in enumerate(s):
        match[c] = match.get(c, 0) | 1 << i
    full, top = (1 << len(s)) - 1, 1 << (len(s) - 1)
    up, down, n = full, 0, len(s)
    for c in t:
        m = match.get(c, 0)
        diagonal = (((m & up) + up) ^ up) | m | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        n += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
    return n


def fuzzy_spans(s: str, t: str, path: list[tuple[int, int]], k: int, wide: int = 60) -> list[tuple[int, int, int, int, int]]:
    """(begin in s, end, begin in t, end, edits) of the passages along a chain: exact between and around its seeds, edited in its gaps.

    A gap wider than `wide` of which more than half would be edits parts the chain into two passages.
    """
    out: list[list[int]] = []
    for a, b in path:
        if s[a : a + k] != t[b : b + k]:
            continue  # two k-mers with one hash
        right = _same_ahead(s, a + k, t, b + k)
        if out:
            last = out[-1]
            if a <= last[1] and a - last[1] == b - last[3]:  # within the stretch before
                last[1], last[3] = max(last[1], a + k + right), max(last[3], b + k + right)
                continue
            left = min(_same_behind(s, a, t, b), max(0, a - last[1]), max(0, b - last[3]))
            p, q = a - left, b - left
            if p < last[1] or q < last[3]:
                cut = max(last[1] - p, last[3] - q)
                p, q = p + cut, q + cut
            n = edits(s[last[1] : p], t[last[3] : q]) if max(p - last[1], q - last[3]) <= 40 * wide else 40 * wide
            if max(p - last[1], q - last[3]) <= wide or n <= max(p - last[1], q - last[3]) / 2:
                last[1], last[3], last[4] = a + k + right, b + k + right, last[4] + n
                continue
            out.append([p, a + k + right, q, b + k + right, 0])
            continue
        left = _same_behind(s, a, t, b)
        out.append([a - left, a + k + right, b - left, b + k + right, 0])
    return [tuple(x) for x in out]


def _same_ahead(s: str, a: int, t: str, b: int) -> int:
    most = min(len(s) - a, len(t) - b)
    lo, step = 0, 64
    while lo < most:
        n = min(step, most - lo)
        if s[a + lo : a + lo + n] == t[b + lo : b + lo + n]:
            lo += n
            step *= 2
        elif n == 1:
            break
        else:
            step = max(1, n // 2)
    return lo


def _same_behind(s: str, a: int, t: str, b: int) -> int:
    most = min(a, b)
    lo, step = 0, 64
    while lo < most:
        n = min(step, most - lo)
        if s[a - lo - n : a - lo] == t[b - lo - n : b - lo]:
            lo += n
            step *= 2
        elif n == 1:
            break
        else:
            step = max(1, n // 2)
    return lo


def align(s: str, t: str, path: list[tuple[int, int]], k: int, done: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Maximal exact stretches (begin in s, begin in t, length) along a chain. `done` keeps how far each diagonal was read, over all chains of two texts."""
    spans: list[tuple[int, int, int]] = []
    for a, b in path:
        if done.get(a - b, (0, -1))[0] <= a and done.get(a - b, (0, -1))[1] >= a + k:
            continue
        if s[a : a + k] != t[b : b + k]:
            continue  # two k-mers with one hash
        left, right = _same_behind(s, a, t, b), _same_ahead(s, a + k, t, b + k)
        spans.append((a - left, b - left, left + k + right))
        done[a - b] = (a - left, a + k + right)
    return spans


def covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _classed(documents: DataFrame, key: str, text: str, least: int) -> DataFrame:
    return documents.where(F.length(text) >= least).select(F.col(key).alias("_id"), F.md5(F.col(text)).alias("_c"), F.col(text).alias("_text"))


def _seeds(docs: DataFrame, k: int, least: int) -> DataFrame:
    kind = docs.schema["_c"].dataType.simpleString()

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs, cs, ps = [], [], []
            for c, t in zip(b["_c"], b["_text"], strict=True):
                h, p = seeds_of(t, k, least)
                hs.append(h)
                ps.append(p)
                cs += [c] * len(h)
            if hs:
                yield pd.DataFrame({"_h": np.concatenate(hs).view(np.int64), "_c": cs, "_p": np.concatenate(ps).astype(np.int32)})

    return spread(docs.select("_c", "_text")).mapInPandas(seed, f"_h bigint, _c {kind}, _p int")


def _several(seeds: DataFrame) -> DataFrame:
    """The seeds of more than one class."""
    return seeds.groupBy("_h").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("_h")


def shared_passages(documents: DataFrame, least: int = 300, k: int = 200, crowd: int = 64, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, pairs, groups) of `passages`."""
    return passages(documents, least, k, crowd, key, text)[:3]


def passages(documents: DataFrame, least: int = 300, k: int = 200, crowd: int = 64, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, pairs, groups, extents): the texts that share a stretch of `least` or more code points.

    members: `_id`, `class_id` of each document of at least that length; equal
    texts have one class (128 bits of a hash of the whole text).
    pairs: class_a < class_b, longest, chain_score (the best chain with such a
    stretch), spans_a, spans_b (begin, end of the exact stretches) of classes
    with a common stretch: those some chain of which, aligned, holds one.
    groups: group_id, class_id, begin, end: classes that hold one same window,
    found where more than `crowd` classes share a seed; any two of a group share
    it. One window stands for all that the same classes hold.
    extents: class_id, begin, end: the united windows around crowded seeds that
    two or more classes hold. Null and shorter texts share nothing; of an empty table all are empty.

    Raw texts cross the network only for classes that share a seed with another;
    everything else moves seeds, about two for each 100 code points.
    """
    shelf = Shelf(documents.sparkSession)
    docs = _classed(documents, key, text, least)
    members = docs.select("_id", F.col("_c").alias("class_id"))

    seeds = shelf.put(_seeds(docs, k, least))
    several = shelf.put(_several(seeds))
    shared = shelf.put(seeds.join(several, "_h").distinct())
    shelf.clear(seeds, several)
    crowded = shared.groupBy("_h").agg(F.count_distinct("_c").alias("_n"))
    sized = shelf.put(shared.join(crowded, "_h"))
    wanted = shelf.put(sized.select("_c").distinct())
    texts = shelf.put(docs.join(wanted, "_c", "left_semi").groupBy("_c").agg(F.min_by("_text", "_id").alias("_text")))

    few = sized.where(F.col("_n") <= crowd).drop("_n")
    a, b = few.select("_h", F.col("_c").alias("_a"), F.col("_p").alias("_pa")), few.select("_h", F.col("_c").alias("_b"), F.col("_p").alias("_pb"))
    anchors = a.join(b, "_h").where(F.col("_a") < F.col("_b")).groupBy("_a", "_b").agg(F.collect_list(F.struct("_pa", "_pb")).alias("_anchors"))
    both = anchors.join(texts.select(F.col("_c").alias("_a"), F.col("_text").alias("_ta")), "_a").join(texts.select(F.col("_c").alias("_b"), F.col("_text").alias("_tb")), "_b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for ca, cb, anchors, s, t in zip(x["_a"], x["_b"], x["_anchors"], x["_ta"], x["_tb"], strict=True):
                points = [(r["_pa"], r["_pb"]) for r in anchors]
                spans, best, done = [], 0.0, {}
                for score, path in chains(points, k):
                    found = [m for m in align(s, t, path, k, done) if m[2] >= least]
                    if found and score > best:
                        best = score
                    spans += found
                if spans:
                    out.append((ca, cb, max(m[2] for m in spans), best, [{"begin": m[0], "end": m[0] + m[2]} for m in spans], [{"begin": m[1], "end": m[1] + m[2]} for m in spans]))
            yield pd.DataFrame(out, columns=["class_a", "class_b", "longest", "chain_score", "spans_a", "spans_b"])

    span = "array<struct<begin:int,end:int>>"
    pairs = shelf.put(both.mapInPandas(compare, f"class_a string, class_b string, longest int, chain_score double, spans_a {span}, spans_b {span}"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for c, places, t in zip(x["_c"], x["_places"], x["_text"], strict=True):
                h = window_hashes(code_points(t), least)
                g = window_hashes(code_points(t)[::-1], least)[::-1]
                at = np.unique(np.concatenate([np.arange(max(0, p - (least - k)), min(len(h), p + 1)) for p in places]))
                yield pd.DataFrame({"_w": h[at].view(np.int64), "_v": g[at].view(np.int64), "_c": c, "_p": at.astype(np.int32)})

    many = sized.where(F.col("_n") > crowd).groupBy("_c").agg(F.collect_set("_p").alias("_places"))
    placed = shelf.put(many.join(texts, "_c").select("_c", "_places", "_text").mapInPandas(windows, "_w bigint, _v bigint, _c string, _p int"))
    # Windows held by the same classes are one group: the signature is a sum over its members.
    w = placed.groupBy("_w", "_v").agg(F.sum(F.xxhash64("_c").cast("decimal(38,0)")).alias("_s"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.count(F.lit(1)).alias("_k")).where(F.col("_lo") != F.col("_hi"))
    kept = shelf.put(w.groupBy("_s", "_k").agg(F.min(F.struct("_w", "_v")).alias("_g")).select("_g.*").distinct())
    groups = shelf.put(placed.join(kept, ["_w", "_v"]).select(F.xxhash64("_w", "_v").alias("group_id"), F.col("_c").alias("class_id"), F.col("_p").alias("begin"), (F.col("_p") + least).alias("end")))
    held = placed.join(w.select("_w", "_v"), ["_w", "_v"]).select("_c", "_p").distinct()
    order = Window.partitionBy("_c").orderBy("_p")  # no more rows than the text has signs
    runs = held.withColumn("_new", F.when(F.col("_p") <= F.lag("_p").over(order) + least, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    extents = shelf.put(runs.groupBy("_c", "_run").agg(F.min("_p").alias("begin"), (F.max("_p") + least).alias("end")).select(F.col("_c").alias("class_id"), "begin", "end"))
    shelf.clear(shared, sized, wanted, texts, placed, kept)
    return members, pairs, groups, extents


def _partners(pairs: DataFrame, groups: DataFrame, shelf: Shelf) -> DataFrame:
    """class_id, partners: the different classes each shares a pair or a group with.

    Classes in just the same groups have the same partners there, so they are
    counted by such sets, not one by one.
    """
    sets = groups.groupBy("class_id").agg(F.array_sort(F.collect_set("group_id")).alias("_g")).withColumn("_set", F.xxhash64("_g"))
    sets = shelf.put(sets)
    of = sets.select("class_id", "_set")
    sizes = of.groupBy("_set").agg(F.count(F.lit(1)).alias("_n"))
    in_groups = sets.groupBy("_set").agg(F.first("_g").alias("_g")).select("_set", F.explode("_g").alias("_g"))
    met = shelf.put(in_groups.join(in_groups.withColumnRenamed("_set", "_other"), "_g").select("_set", "_other").distinct())
    grouped = of.join(met.join(sizes.withColumnRenamed("_set", "_other"), "_other").groupBy("_set").agg((F.sum("_n") - 1).alias("partners")), "_set").select("class_id", "partners")
    linked = pairs.select("class_a", "class_b").unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"))).distinct()
    known = linked.join(of.withColumnsRenamed({"class_id": "class_a"}), "class_a", "left").join(of.withColumnsRenamed({"class_id": "class_b", "_set": "_other"}), "class_b", "left")
    apart = known.join(met, ["_set", "_other"], "left_anti").groupBy(F.col("class_a").alias("class_id")).agg(F.count(F.lit(1)).alias("partners"))
    return grouped.unionByName(apart).groupBy("class_id").agg(F.sum("partners").alias("partners"))


def document_pairs(documents: DataFrame, least: int = 300) -> DataFrame:
    """doc_a < doc_b of the documents that share a stretch of `least` code points exactly, each pair once."""
    members, pairs, groups = shared_passages(documents, least)
    members = members.groupBy("_id").agg(F.min("class_id").alias("class_id"))
    linked = pairs.select("class_a", "class_b")
    g = groups.select("group_id", "class_id").distinct()
    in_groups = g.select("group_id", F.col("class_id").alias("class_a")).join(g.select("group_id", F.col("class_id").alias("class_b")), "group_id").where(F.col("class_a") < F.col("class_b")).select("class_a", "class_b")
    between = linked.unionByName(in_groups).distinct()
    a, b = members.select(F.col("_id").alias("_x"), F.col("class_id").alias("class_a")), members.select(F.col("_id").alias("_y"), F.col("class_id").alias("class_b"))
    across = between.join(a, "class_a").join(b, "class_b").select("_x", "_y")
    repeated = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("class_id")
    copies = members.join(repeated, "class_id")
    within = copies.select("class_id", F.col("_id").alias("_x")).join(copies.select("class_id", F.col("_id").alias("_y")), "class_id").where(F.col("_x") < F.col("_y")).select("_x", "_y")
    return across.unionByName(within).select(F.least("_x", "_y").alias("doc_a"), F.greatest("_x", "_y").alias("doc_b"))


def shared_amounts(documents: DataFrame, least: int = 300, k: int = 200, crowd: int = 64) -> DataFrame:
    """doc_id, class_id, copies, partners, shared_chars, n_chars: how much of each document stands elsewhere.

    One row per document with a common stretch of `least` code points. A text
    with equal copies is shared as a whole; else the stretches found are united.
    partners counts the other classes that share a stretch with it, in pairs or
    groups.
    """
    members, pairs, groups, extents = passages(documents, least, k, crowd)
    spans = pairs.select(F.col("class_a").alias("class_id"), F.explode("spans_a").alias("_s")).unionByName(pairs.select(F.col("class_b").alias("class_id"), F.explode("spans_b").alias("_s")))
    flat = spans.select("class_id", F.col("_s.begin").alias("begin"), F.col("_s.end").alias("end")).unionByName(extents)
    # Stretches repeat over partners: distinct ones are few for one text, however many share it.
    one = flat.groupBy("class_id", "begin").agg(F.max("end").alias("end"))
    per = one.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_l"))
    zero = F.struct(F.lit(0).alias("t"), F.lit(-1).alias("e"))
    per = per.select("class_id", F.aggregate("_l", zero, lambda acc, s: F.struct((acc["t"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], acc["e"]))).alias("t"), F.greatest(acc["e"], s["end"]).alias("e")))["t"].alias("_shared"))
    partners = _partners(pairs, groups, Shelf(documents.sparkSession))
    sizes = documents.select(F.col("doc_id"), F.length("text").alias("n_chars")).where(F.col("n_chars") >= least)
    m = members.withColumnRenamed("_id", "doc_id")
    copies = m.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    x = m.join(copies, "class_id").join(per, "class_id", "left").join(partners, "class_id", "left").join(sizes, "doc_id")
    x = x.where((F.col("copies") > 1) | F.col("_shared").isNotNull())
    return x.select("doc_id", "class_id", "copies", F.coalesce("partners", F.lit(0)).alias("partners"), F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("_shared")).alias("shared_chars"), "n_chars")


def speaking_pairs(h: np.ndarray, p: np.ndarray, k: int, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, distance, gain) of the pairs of seeds in one text that may begin a chain which reaches `far` code points.

    A link of `chains` is worth more than its gaps cost, so up to the first
    anchor that is `far` or more from a chain's root in both texts the gains
    outweigh a tenth of both distances. The gains are no more than either text's
    own seeds cover, nor, up to there, than far - 1 + k. Two texts with such a
    chain therefore hold one pair of seeds whose distances add up to no more than
    ten times the lesser gain. Each key comes once, with its least distance and
    greatest gain. If one seed reaches that far, the keys are the seeds.
    """
    if far <= 0:
        key = np.unique(h)
        return key, np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    most = far - 1 + k
    own = np.cumsum(np.minimum(k, np.diff(p, prepend=p[:1])))
    lo, hi = np.searchsorted(p, p + far), np.searchsorted(p, p + 10 * most - far, "right")
    n = np.maximum(0, hi - lo)
    x = np.repeat(np.arange(len(p)), n)
    y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    d, gain = p[y] - p[x], np.minimum(own[y] - own[x], most)
    fits = d + far <= 10 * gain
    x, y, d, gain = x[fits], y[fits], d[fits], gain[fits]
    key, at = np.unique(h[x] * _B + h[y], return_inverse=True)
    least, best = np.full(len(key), np.iinfo(np.int64).max), np.zeros(len(key), np.int64)
    np.minimum.at(least, at, d)
    np.maximum.at(best, at, gain)
    return key, least, best


def fuzzy_passages(documents: DataFrame, least: int = 300, k: int = 48, alike: float = 0.9, crowd: int = 16, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, passages): passages of `least` or more code points that two texts share but for some edits.

    members: key, class_id of each text of that length; equal texts are one class.
    passages: class_a < class_b, begin_a, end_a, begin_b, end_b, edits, similarity
    (1 - edits over the longer side), at least `alike`. Any exact run of 2 k
    code points holds a common seed, so a smaller k reaches over denser edits
    and makes more seeds, two for each k code points; a passage comes out where chained seeds
    span six tenths of `least` and hold a fifth of what they span, and the
    aligned chain is long and alike enough. Null and shorter texts have none.

    Every two classes are held against each other, however many share a seed: a
    passage in n texts comes out as n (n - 1) / 2 pairs. Seeds aren't joined with
    themselves but pairs of them that stand far enough apart in a text
    (`speaking_pairs`), which leaves out only classes no chain of which can
    suffice; a phrase in many texts alone joins none. Then chains are formed from
    all common seeds, from places alone; texts are read only for the pairs a
    chain speaks for. `crowd` has no effect any more: no number of classes is too many.
    """
    shelf = Shelf(documents.sparkSession)
    name = lambda c: F.lower(F.hex(c))
    docs = _classed(documents, key, text, least).withColumn("_c", F.unhex("_c"))  # sixteen bytes while there are many
    members = docs.select(F.col("_id").alias(key), name("_c").alias("class_id"))
    whole = Window.partitionBy("_h")  # one shuffle of the seeds; a seed in many texts is read once, in order, and spills
    seeds = _seeds(docs, k, 2 * k).withColumns({"_lo": F.min("_c").over(whole), "_hi": F.max("_c").over(whole)}).where(F.col("_lo") != F.col("_hi"))
    places = seeds.groupBy("_c").agg(F.array_sort(F.collect_set(F.struct("_p", "_h"))).alias("_s"))
    # A number instead of the class while seeds are paired: it is written once, so it stays.
    known = shelf.put(places.select(F.monotonically_increasing_id().alias("_i"), "_c", F.col("_s._p").alias("_p"), F.col("_s._h").alias("_h")))
    far = math.ceil(0.6 * least - k)

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out, size = [], 0
            for i, p, h in zip(x["_i"], x["_p"], x["_h"], strict=True):
                q, d, g = speaking_pairs(np.asarray(h, np.int64).view(np.uint64), np.asarray(p, np.int64), k, far)
                out.append((np.full(len(q), i), q.view(np.int64), d.astype(np.int32), g.astype(np.int32)))
                size += len(q)
                if size > 200_000:  # handed on before they grow large
                    yield pd.DataFrame(dict(zip(("_i", "_q", "_d", "_g"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
                    out, size = [], 0
            if out:
                yield pd.DataFrame(dict(zip(("_i", "_q", "_d", "_g"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    keyed = shelf.put(known.select("_i", "_p", "_h").mapInPandas(pair, "_i bigint, _q bigint, _d int, _g int"))
    x, y = keyed.alias("x"), keyed.alias("y")
    near = (F.col("x._i") < F.col("y._i")) & (F.col("x._d") + F.col("y._d") <= 10 * F.least("x._g", "y._g"))
    candidates = shelf.put(x.join(y, F.col("x._q") == F.col("y._q")).where(near).select(F.col("x._i").alias("_i"), F.col("y._i").alias("_j")).distinct())
    shelf.clear(keyed)
    first = known.select("_i", F.col("_c").alias("_a"), F.col("_p").alias("_pa"), F.col("_h").alias("_ha"))
    second = known.select(F.col("_i").alias("_j"), F.col("_c").alias("_b"), F.col("_p").alias("_pb"), F.col("_h").alias("_hb"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for ca, cb, pa, ha, pb, hb in zip(x["_a"], x["_b"], x["_pa"], x["_ha"], x["_pb"], x["_hb"], strict=True):
                if ca > cb:
                    ca, cb, pa, ha, pb, hb = cb, ca, pb, hb, pa, ha
                at: dict[int, list[int]] = {}
                for h, q in zip(hb.tolist(), pb.tolist(), strict=True):
                    at.setdefault(h, []).append(q)
                anchors = [(p, q) for h, p in zip(ha.tolist(), pa.tolist(), strict=True) for q in at.get(h, ())]
                for _, path in chains(anchors, k):
                    reach = min(path[-1][0] - path[0][0], path[-1][1] - path[0][1]) + k
                    if reach >= 0.6 * least and covered([(p, p + k) for p, _ in path]) >= 0.2 * reach:
                        out.append((ca, cb, [{"a": p, "b": q} for p, q in path]))
            yield pd.DataFrame(out, columns=["_a", "_b", "_path"])

    both = candidates.join(first, "_i").join(second, "_j").select("_a", "_b", "_pa", "_ha", "_pb", "_hb")
    linked = shelf.put(both.mapInPandas(link, "_a binary, _b binary, _path array<struct<a:int,b:int>>"))
    wanted = linked.select(F.col("_a").alias("_c")).unionByName(linked.select(F.col("_b").alias("_c"))).distinct()
    texts = shelf.put(docs.join(wanted, "_c", "left_semi").groupBy("_c").agg(F.min_by("_text", "_id").alias("_text")))
    side = lambda c, t: texts.select(F.col("_c").alias(c), F.col("_text").alias(t))
    pairs = linked.join(side("_a", "_ta"), "_a").join(side("_b", "_tb"), "_b").withColumns({"_a": name("_a"), "_b": name("_b")})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for ca, cb, path, s, t in zip(x["_a"], x["_b"], x["_path"], x["_ta"], x["_tb"], strict=True):
                for a0, a1, b0, b1, n in fuzzy_spans(s, t, [(r["a"], r["b"]) for r in path], k):
                    size = max(a1 - a0, b1 - b0)
                    if min(a1 - a0, b1 - b0) >= least and 1 - n / size >= alike:
                        out.append((ca, cb, a0, a1, b0, b1, n, 1 - n / size))
            yield pd.DataFrame(out, columns=["class_a", "class_b", "begin_a", "end_a", "begin_b", "end_b", "edits", "similarity"])

    found = shelf.put(pairs.mapInPandas(compare, "class_a string, class_b string, begin_a int, end_a int, begin_b int, end_b int, edits int, similarity double"))
    shelf.clear(known, candidates, linked, texts)
    return members, found.distinct()
