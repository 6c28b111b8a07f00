"""Forecast models fitted on DataFrames: ridge logistic by reweighted least squares, boosted trees on histograms, rolling origins and gates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RidgeLogistic:
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    deviation: tuple[float, ...]
    beta: tuple[float, ...]

    def probability(self, clip: float = 1e-6) -> Column:
        z = F.lit(self.beta[0])
        for c, m, s, b in zip(self.columns, self.mean, self.deviation, self.beta[1:], strict=True):
            z = z + (F.col(c) - m) / s * b
        z = F.least(F.lit(60.0), F.greatest(F.lit(-60.0), z))
        return F.least(F.lit(1 - clip), F.greatest(F.lit(clip), 1 / (1 + F.exp(-z))))


def fit_ridge_logistic(df: DataFrame, columns: Sequence[str], target: str, ridge: float = 8.0, most: int = 25, tolerance: float = 1e-7) -> RidgeLogistic:
    """Newton steps whose sums are one aggregate a step; rows never leave the executors, only the p x p sums do. The intercept isn't penalised."""
    x = df.select(*columns, target).dropna()
    s = x.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    mean = tuple(float(s[2 * i] or 0.0) for i in range(len(columns)))
    dev = tuple(max(float(s[2 * i + 1] or 0.0), 1e-9) for i in range(len(columns)))
    z = [F.lit(1.0), *[(F.col(c) - m) / d for c, m, d in zip(columns, mean, dev, strict=True)]]
    p = len(z)
    beta = np.zeros(p)
    penalty = np.diag([0.0, *[ridge] * len(columns)])
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(most):
        eta = sum((zi * float(b) for zi, b in zip(z, beta, strict=True)), F.lit(0.0))
        prob = 1 / (1 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), eta))))
        y = x.select(*[zi.alias(f"_z{i}") for i, zi in enumerate(z)], F.greatest(F.lit(1e-9), prob * (1 - prob)).alias("_w"), (F.col(target) - prob).alias("_r"))
        row = y.agg(*[F.sum(F.col("_w") * F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in cells], *[F.sum(F.col("_r") * F.col(f"_z{i}")) for i in range(p)]).first()
        if row[0] is None:
            break
        h = np.zeros((p, p))
        for (i, j), v in zip(cells, row[: len(cells)], strict=True):
            h[i, j] = h[j, i] = v
        step = np.linalg.solve(h + penalty + 1e-9 * np.eye(p), np.array(row[len(cells) :]) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return RidgeLogistic(tuple(columns), mean, dev, tuple(float(b) for b in beta))


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[dict, ...]
    rate: float

    def probability(self) -> Column:
        def walk(t: dict) -> Column:
            return F.lit(t["v"]) if "v" in t else F.when(F.col(t["c"]) <= t["t"], walk(t["l"])).otherwise(walk(t["r"]))

        z = F.lit(self.base)
        for t in self.trees:
            z = z + walk(t) * self.rate
        return 1 / (1 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), z))))


def fit_boosted_trees(df: DataFrame, columns: Sequence[str], target: str, rounds: int = 60, rate: float = 0.1, depth: int = 2, bins: int = 12, least: int = 80, ridge: float = 5.0) -> Boosted:
    """Trees grown level by level from histograms of gradients: one aggregate by (node, bin) for all columns a level.

    Rows of the same bins have the same score in every round, so the rounds run
    over such cells with their counts. Only the histograms, columns x bins x
    nodes, come to the driver; leaves take their sums from the split above. Bin
    edges are quantiles with doubles removed; a value on an edge goes left.
    """
    from teesta.session import cut

    x = df.select(*columns, F.col(target).cast("double").alias("_y")).dropna()
    quantiles = x.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000) for c in columns], F.avg("_y")).first()
    edges = {c: sorted(set(q or [])) for c, q in zip(columns, quantiles[: len(columns)], strict=True)}
    rate0 = min(max(quantiles[len(columns)] or 0.5, 1e-6), 1 - 1e-6)
    base = float(np.log(rate0 / (1 - rate0)))
    x = x.withColumns({f"_b{i}": sum((F.when(F.col(c) > e, 1).otherwise(0) for e in edges[c]), F.lit(0)) for i, c in enumerate(columns)})
    cells = [f"_b{i}" for i in range(len(columns))]
    x = cut(x.groupBy(*cells).agg(F.sum("_y").alias("_y"), F.count(F.lit(1)).alias("_n")).withColumn("_z", F.lit(base)))
    trees: list[dict] = []
    for round_no in range(rounds):
        prob = 1 / (1 + F.exp(-F.col("_z")))
        level = x.select("*", (prob * F.col("_n") - F.col("_y")).alias("_g"), (F.greatest(F.lit(1e-9), prob * (1 - prob)) * F.col("_n")).alias("_h"), F.lit(1).alias("_node"))
        tree: dict[int, dict] = {}
        frontier = [1]
        for d in range(max(1, depth)):
            long = level.where(F.col("_node").isin(frontier)).select("_node", "_g", "_h", "_n", F.posexplode(F.array(*cells)).alias("_f", "_b"))
            hist = long.groupBy("_node", "_f", "_b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.sum("_n").alias("n")).collect()
            nxt = []
            for node in frontier:
                rows = [r for r in hist if r["_node"] == node]
                g, h, n = (sum(r[k] for r in rows if r["_f"] == 0) for k in "ghn")
                tree[node] = {"v": -g / (h + ridge) if rows else 0.0}
                best = (1e-9, -1, -1, 0.0, 0.0)
                if d < depth:
                    for f in range(len(columns)):
                        gl = hl = nl = 0.0
                        for r in sorted((r for r in rows if r["_f"] == f), key=lambda r: r["_b"]):
                            if nl >= least and n - nl >= least:
                                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                                best = max(best, (gain, f, r["_b"], gl, hl))
                            gl, hl, nl = gl + r["g"], hl + r["h"], nl + r["n"]
                if best[1] >= 0:
                    tree[node] = {"f": best[1], "b": best[2]}
                    tree[2 * node], tree[2 * node + 1] = {"v": -best[3] / (best[4] + ridge)}, {"v": -(g - best[3]) / (h - best[4] + ridge)}
                    nxt += [2 * node, 2 * node + 1]
            if not nxt or d == depth - 1:
                break
            step = F.col("_node")
            for node in frontier:
                t = tree[node]
                if "f" in t:
                    step = F.when(F.col("_node") == node, F.when(F.col(f"_b{t['f']}") < t["b"], 2 * node).otherwise(2 * node + 1)).otherwise(step)
            level = level.withColumn("_node", step)
            frontier = nxt

        def nested(node: int, tree: dict[int, dict] = tree) -> dict:
            t = tree[node]
            return {"v": float(t["v"])} if "v" in t else {"c": columns[t["f"]], "t": float(edges[columns[t["f"]]][t["b"] - 1]), "l": nested(2 * node), "r": nested(2 * node + 1)}

        trees.append(nested(1))

        def score(node: int, tree: dict[int, dict] = tree) -> Column:
            t = tree[node]
            return F.lit(float(t["v"])) if "v" in t else F.when(F.col(f"_b{t['f']}") < t["b"], score(2 * node)).otherwise(score(2 * node + 1))

        x = x.withColumn("_z", F.col("_z") + score(1) * rate)
        if round_no % 5 == 4:
            x = cut(x)
    return Boosted(base, tuple(trees), rate)


def rolling_origins(df: DataFrame, week: str, target_week: str, years: Sequence[int], fit: Callable[[DataFrame], Column]) -> DataFrame:
    """`df`'s test rows of every origin year with `fold` and `probability`: trained on target weeks before the year, tested on those in it."""
    out = None
    for y in years:
        origin = F.lit(f"{y}-01-01").cast("date")
        train = df.where(F.col(target_week) < origin)
        test = df.where((F.col(week) >= origin) & (F.year(target_week) == y))
        part = test.withColumn("fold", F.lit(y)).withColumn("probability", fit(train))
        out = part if out is None else out.unionByName(part)
    return out


def fold_base_rates(df: DataFrame, target_week: str, years: Sequence[int], target: str) -> DataFrame:
    """fold, base: the target's rate in the training rows of every origin year, target weeks before it; null where there are none."""
    a = df.agg(*[F.avg(F.when(F.col(target_week) < F.lit(f"{y}-01-01").cast("date"), F.col(target))).alias(f"_{y}") for y in years])
    return a.select(F.explode(F.array(*[F.struct(F.lit(y).alias("fold"), F.col(f"_{y}").alias("base")) for y in years])).alias("_b")).select("_b.*")


def publication_gate(scored: DataFrame, p: str, y: str, base: str, least_events: int = 20) -> DataFrame:
    """n, events, brier, base_brier, reasons, publish: why a model may not be shown."""
    a = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("events"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(F.pow(F.col(base) - F.col(y), 2)).alias("base_brier"))
    reasons = F.array_compact(F.array(F.when(F.col("n") == 0, "no_rows"), F.when(F.coalesce("events", F.lit(0)) < least_events, "too_few_events"), F.when(F.col("events") == F.col("n"), "no_non_events"), F.when(F.col("brier") >= F.col("base_brier"), "no_skill"), F.when(F.isnan("brier"), "undefined_score")))
    return a.withColumn("reasons", reasons).withColumn("publish", F.size("reasons") == 0)


def ladder(train: DataFrame, test: DataFrame, key: str, month: str, recent: str, target: str, prior: float = 5.0, high: float = 0.85, low: float = 0.05, models: dict[str, Column] | None = None) -> DataFrame:
    """contestant, n, brier, chosen: forecasts of growing detail held against one another; the least Brier score is chosen, ties by name.

    unconditional: the training rate. month: the month's rate shrunken to it.
    key_month: the key's month shrunken to the month's. persistence: `high` after
    a recent event, else `low`. `models` adds fitted probabilities by name.
    """
    g = train.agg(F.avg(target).alias("_g"))
    m = train.groupBy(month).agg(F.sum(target).alias("_o"), F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(g)).select(month, ((F.col("_o") + prior * F.col("_g")) / (F.col("_n") + prior)).alias("_m"))  # one row
    k = train.groupBy(key, month).agg(F.sum(target).alias("_o"), F.count(F.lit(1)).alias("_n")).join(m, month).select(key, month, ((F.col("_o") + prior * F.col("_m")) / (F.col("_n") + prior)).alias("_k"))
    x = test.crossJoin(F.broadcast(g)).join(m, month, "left").join(k, [key, month], "left")  # one row
    month_rate = F.coalesce("_m", "_g")
    entries = {"unconditional": F.col("_g"), "month": month_rate, "key_month": F.coalesce(F.col("_k"), month_rate), "persistence": F.when(F.col(recent) > 0, high).otherwise(low)} | (models or {})
    long = x.select(F.col(target).alias("_y"), F.inline(F.array(*[F.struct(F.lit(n).alias("contestant"), p.cast("double").alias("_p")) for n, p in entries.items()])))
    s = long.groupBy("contestant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("_p") - F.col("_y"), 2)).alias("brier"))
    best = s.agg(F.min_by("contestant", F.struct("brier", "contestant")).alias("_best"))
    return s.crossJoin(F.broadcast(best)).select("contestant", "n", "brier", (F.col("contestant") == F.col("_best")).alias("chosen"))  # one row


def nested_ridge(train: DataFrame, columns: Sequence[str], target: str, at: str, ridges: Sequence[float] = (2.0, 8.0, 32.0), inner_share: float = 0.75) -> tuple[float, list[tuple[float, float]]]:
    """(the ridge with the least Brier score, every ridge with its score), chosen within the training rows: fitted on the earlier `inner_share` of the time, scored on the rest."""
    ends = train.agg(F.min(F.unix_date(at)).alias("a"), F.max(F.unix_date(at)).alias("z")).first()
    cutoff = ends["a"] + int((ends["z"] - ends["a"]) * inner_share)
    early, late = train.where(F.unix_date(at) < cutoff), train.where(F.unix_date(at) >= cutoff)
    scored = []
    for r in ridges:
        p = fit_ridge_logistic(early, columns, target, ridge=r).probability()
        scored.append((float(r), float(late.agg(F.avg(F.pow(p - F.col(target), 2))).first()[0])))
    return min(scored, key=lambda s: (s[1], s[0]))[0], scored


def served(rows: DataFrame, key: str, at: str, probability: Column, qualified: DataFrame, low: float = 5e-5, high: float = 0.6) -> DataFrame:
    """key, at, probability, state of each key's latest row: clipped where the key is qualified; without history or qualification it abstains."""
    from teesta.operators.relational import latest

    x = latest(rows.withColumn("_p", probability), [key], [at]).join(qualified.select(key, F.lit(True).alias("_q")).distinct(), key, "left")
    state = F.when(F.col("_q").isNull(), "not_qualified").when(F.col("_p").isNull(), "no_history").otherwise("served")
    return x.select(key, at, F.when(state == "served", F.greatest(F.lit(low), F.least(F.lit(high), F.col("_p")))).alias("probability"), state.alias("state"))
