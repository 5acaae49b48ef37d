"""Training of one model per category and a global one.

A model is fitted in one task on a bounded number of rows (max_rows, drawn by hash; the reference's categories have
under 20,000 rows each), so a hot category or the whole table never lands in a task. The draw is a threshold on the
hash, set from the category's exact count: rows beyond it stay out before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut
from .models import FALLBACK, expand
from .sampling import draw

MAX_ROWS = 100_000


def training_rows(rows: DataFrame, max_rows: int = MAX_ROWS, seed: int = 2026, fallback: bool = True) -> DataFrame:
    """rows once under their category and, unless told not to, once under the fallback; of each some max_rows at most."""
    own = F.coalesce("category", F.lit("None"))
    twice = rows.withColumn("model", F.explode(F.array(own, F.lit(FALLBACK))) if fallback else own)
    sizes = twice.groupBy("model").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(max_rows)) / F.col("n"))
    return twice.join(F.broadcast(sizes), "model").filter(draw(seed, "id1", "id2") < share * float(1 << 32)).drop("n")


def newton_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 30, free_intercept: bool = False) -> tuple[np.ndarray, float]:
    """Minimises half the squared length of coefficients and, unless it is free, intercept plus c times the weighted log loss."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    held = np.append(np.ones(x.shape[1] - 1), 0.0 if free_intercept else 1.0)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = held * w + c * (x.T @ (weight * (p - y)))
        curve = np.diag(held) + c * (x.T @ (x * (weight * p * (1 - p))[:, None]))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train_logistic(rows: DataFrame, features: Column, c: float = 1.0, max_rows: int = MAX_ROWS, weight: str | None = None) -> DataFrame:
    """(category, coef, intercept) of rows (id1, id2, category, target, …); categories of a single class have none."""
    data = training_rows(rows, max_rows).select("model", (F.col("target") >= 0.5).cast("double").alias("y"), expand(features).alias("x"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

    def fit(key, part):
        if part.y.nunique() < 2:
            return pd.DataFrame({"category": [], "coef": [], "intercept": []})
        part = part.sort_values(["y", "w"], kind="stable")
        coef, intercept = newton_logistic(np.stack(part.x.to_numpy()), part.y.to_numpy(), part.w.to_numpy(), c)
        return pd.DataFrame({"category": [key[0]], "coef": [coef.astype(np.float32).tolist()], "intercept": [np.float32(intercept)]})

    return data.groupBy("model").applyInPandas(fit, "category string, coef array<float>, intercept float")


def train_balanced(rows: DataFrame, features: Column, c: float = 1.0, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row (category, coef, intercept) of rows (id1, id2, target, …): features are scaled to mean 0 and deviation 1,
    both classes weigh alike. The scaling is part of the coefficients, so the model takes plain features."""
    data = training_rows(rows.withColumn("category", F.lit(FALLBACK)), max_rows, fallback=False)

    def fit(key, part):
        x, y = np.stack(part.x.to_numpy()).astype(np.float64), part.y.to_numpy()
        if part.y.nunique() < 2:
            raise ValueError("labels of one class only")
        order = np.lexsort((*x.T, y))
        x, y = x[order], y[order]
        mean, deviation = x.mean(0), x.std(0)
        deviation[deviation == 0] = 1.0
        share = np.where(y == 1, y.mean(), 1 - y.mean())
        coef, intercept = newton_logistic((x - mean) / deviation, y, 0.5 / share, c, free_intercept=True)
        coef = coef / deviation
        return pd.DataFrame({"category": [key[0]], "coef": [coef.tolist()], "intercept": [intercept - float(mean @ coef)]})

    data = data.select("model", (F.col("target") >= 0.5).cast("double").alias("y"), features.alias("x"))
    return data.groupBy("model").applyInPandas(fit, "category string, coef array<double>, intercept double")


def grow_tree(codes: np.ndarray, slope: np.ndarray, curve: np.ndarray, bins: int, leaves: int, least: int, l2: float) -> tuple[list[dict], np.ndarray]:
    """One leaf-wise tree on binned features (codes: rows x features, 0 for missing): nodes, and each row's leaf."""
    n, width = codes.shape
    nodes = [{"feature": -1, "bin": 0, "left": -1, "right": -1, "leaf": True}]
    leaf_of = np.zeros(n, np.int64)
    open_leaves: dict[int, tuple[float, int, int]] = {}

    def best(rows: np.ndarray) -> tuple[float, int, int]:
        if len(rows) < 2 * least:
            return (0.0, -1, -1)
        at = codes[rows].astype(np.int64) + np.arange(width) * bins
        g = np.bincount(at.ravel(), np.repeat(slope[rows], width), width * bins).reshape(width, bins).cumsum(1)
        h = np.bincount(at.ravel(), np.repeat(curve[rows], width), width * bins).reshape(width, bins).cumsum(1)
        m = np.bincount(at.ravel(), minlength=width * bins).reshape(width, bins).cumsum(1)
        total_g, total_h, total_m = g[:, -1:], h[:, -1:], m[:, -1:]
        gain = g**2 / (h + l2) + (total_g - g) ** 2 / (total_h - h + l2) - total_g**2 / (total_h + l2)
        gain[(m < least) | (total_m - m < least)] = 0
        feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        return (float(gain[feature, cut]), int(feature), int(cut))

    open_leaves[0] = best(np.arange(n))
    for _ in range(leaves - 1):
        node = max(open_leaves, key=lambda k: (open_leaves[k][0], -k))
        gain, feature, cut = open_leaves.pop(node)
        if gain <= 1e-9:
            break
        rows = np.flatnonzero(leaf_of == node)
        left = codes[rows, feature] <= cut
        nodes[node] |= {"feature": feature, "bin": cut, "left": len(nodes), "right": len(nodes) + 1, "leaf": False}
        for side in (left, ~left):
            leaf_of[rows[side]] = len(nodes)
            open_leaves[len(nodes)] = best(rows[side])
            nodes.append({"feature": -1, "bin": 0, "left": -1, "right": -1, "leaf": True})
        if not open_leaves:
            break
    return nodes, leaf_of


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, iterations: int, leaves: int, least: int, l2: float, bins: int = 64) -> tuple[float, list[dict]]:
    """Baseline log odds and the nodes of all trees; missing values go left, as the lowest bin."""
    edges = [np.unique(np.quantile(c[~np.isnan(c)], np.linspace(0, 1, bins - 1)[1:-1], method="lower")).astype(np.float32) if (~np.isnan(c)).any() else np.zeros(0, np.float32) for c in x.T]
    codes = np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, "left")) for c, e in zip(x.T, edges, strict=True)], 1).astype(np.int16)
    share = float(np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6))
    margin, out = np.full(len(y), np.log(share / (1 - share))), []
    base = float(margin[0]) if len(margin) else 0.0
    for t in range(iterations):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = weight * (p - y), weight * p * (1 - p)
        nodes, leaf_of = grow_tree(codes, slope, curve, bins + 1, leaves, least, l2)
        g, h = np.bincount(leaf_of, slope, len(nodes)), np.bincount(leaf_of, curve, len(nodes))
        value = -rate * g / (h + l2)
        margin += value[leaf_of]
        for k, node in enumerate(nodes):
            e = edges[node["feature"]] if not node["leaf"] else ()
            # Codes up to the bin are values up to its edge; the lowest bin holds missing values alone.
            threshold = float("inf") if node["leaf"] or node["bin"] > len(e) else float(e[node["bin"] - 1]) if node["bin"] else float("-inf")
            out.append({"tree": t, "node": k, "feature": max(node["feature"], 0), "threshold": threshold, "missing_left": True, "left": node["left"], "right": node["right"], "is_leaf": node["leaf"], "value": float(value[k]) if node["leaf"] else 0.0})
    return base, out


def train_boosting(rows: DataFrame, features: Column, rate: float = 0.05, iterations: int = 250, leaves: int = 31, least: int = 40, l2: float = 2.0, max_rows: int = MAX_ROWS, weight: str | None = None, fallback: bool = True) -> tuple[DataFrame, DataFrame]:
    """(forest, baseline) of rows (id1, id2, category, target, …): leaf-wise histogram boosting of the log loss."""
    schema = "category string, tree int, node int, feature int, threshold float, missing_left boolean, left int, right int, is_leaf boolean, value float"
    data = training_rows(rows, max_rows, fallback=fallback).select("model", (F.col("target") >= 0.5).cast("double").alias("y"), features.alias("x"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

    def fit(key, part):
        x = np.stack(part.x.to_numpy()).astype(np.float32)
        order = np.lexsort((*x.T, part.y.to_numpy()))
        base, nodes = boost(x[order], part.y.to_numpy()[order], part.w.to_numpy()[order], rate, iterations, leaves, least, l2)
        # The baseline is a tree of its own, numbered -1: a leaf.
        nodes.append({"tree": -1, "node": 0, "feature": 0, "threshold": 0.0, "missing_left": True, "left": -1, "right": -1, "is_leaf": True, "value": base})
        return pd.DataFrame(nodes).assign(category=key[0])[[c.split()[0] for c in schema.split(", ")]]

    fitted = cut(data.groupBy("model").applyInPandas(fit, schema), "forest")
    return fitted.filter("tree >= 0"), fitted.filter("tree < 0").select("category", F.col("value").alias("baseline"))


def extra_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, tries: int, least: int) -> tuple[list[int], list[float], list[int], list[int], list[float]]:
    """One extra tree (feature, threshold, left, right, value; leaves have left -1): at a node the best, by Gini, of one
    random threshold for each of some drawn features, until no split leaves both sides their least rows."""
    feature, threshold, left, right, value = [0], [0.0], [-1], [-1], [0.0]
    open_nodes = [(0, np.arange(len(y)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        n, ones = len(rows), y[rows].sum()
        value[node] = float(ones / n)
        if n < 2 * least or ones in (0, n):
            continue
        xs = x[rows]
        low, high = xs.min(0), xs.max(0)
        order = rng.permutation(x.shape[1])
        varied = high[order] > low[order]
        # Of the drawn features those that vary; where none does, the next that does.
        found = order[:tries][varied[:tries]] if varied[:tries].any() else order[varied][:1]
        if not len(found):
            continue
        at = rng.uniform(low[found], high[found]).astype(np.float32)
        at = np.where(at >= high[found], low[found], at)
        goes = xs[:, found] <= at
        n_left, ones_left = goes.sum(0), y[rows] @ goes
        n_right, ones_right = n - n_left, ones - ones_left
        fits = (n_left >= least) & (n_right >= least)
        if not fits.any():
            continue
        pure = lambda k, m: (k**2 + (m - k) ** 2) / np.maximum(m, 1)
        best = int(np.where(fits, pure(ones_left, n_left) + pure(ones_right, n_right), -1.0).argmax())
        feature[node], threshold[node], left[node], right[node] = int(found[best]), float(at[best]), len(value), len(value) + 1
        for side in (goes[:, best], ~goes[:, best]):
            open_nodes.append((len(value), rows[side]))
            for column, blank in zip((feature, threshold, left, right, value), (0, 0.0, -1, -1, 0.0), strict=True):
                column.append(blank)
    return feature, threshold, left, right, value


TREES_A_TASK = 25


def train_trees(rows: DataFrame, features: Column, trees: int = 300, share: float = 0.8, least: int = 20, seed: int = 2026, max_rows: int = MAX_ROWS) -> DataFrame:
    """(category, tree, feature, threshold, left, right, value), a row a tree with its nodes as arrays: extra trees of
    each category, without a limit on depth or a fallback. A task grows TREES_A_TASK trees of a category."""
    schema = "category string, tree int, feature array<int>, threshold array<float>, left array<int>, right array<int>, value array<float>"
    data = training_rows(rows, max_rows, fallback=False).select("model", (F.col("target") >= 0.5).cast("double").alias("y"), features.alias("x"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(TREES_A_TASK)))

    def fit(key, part):
        x, y = np.stack(part.x.to_numpy()).astype(np.float32), part.y.to_numpy()
        order = np.lexsort((*x.T, y))
        x, y = x[order], y[order]
        found = []
        for t in range(key[1], min(trees, key[1] + TREES_A_TASK)):
            rng = np.random.default_rng([seed, t, *key[0].encode()])
            found.append((key[0], t, *extra_tree(x, y, rng, max(1, int(share * x.shape[1])), least)))
        return pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    return cut(data.withColumn("block", blocks).groupBy("model", "block").applyInPandas(fit, schema), "trees")


def tree_scores(rows: DataFrame, forest: DataFrame, features: Column, name: str = "predict") -> DataFrame:
    """rows with the mean leaf value of the trees of their category; null without one."""
    held: dict[str, list] = {}
    for r in forest.orderBy("category", "tree").toLocalIterator():
        held.setdefault(r.category, []).append((np.array(r.feature, np.int16), np.array(r.threshold, np.float32), np.array(r.left, np.int32), np.array(r.right, np.int32), np.array(r.value, np.float32)))
    sent = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("double")
    def walk(category: pd.Series, x: pd.Series) -> pd.Series:
        out, which = np.full(len(x), np.nan), category.to_numpy()
        table = np.stack(x.to_numpy()).astype(np.float32) if len(x) else np.zeros((0, 1), np.float32)
        for c in set(which) & set(sent.value):
            at = np.flatnonzero(which == c)
            total = np.zeros(len(at))
            for feature, threshold, left, right, value in sent.value[c]:
                node = np.zeros(len(at), np.int64)
                active = np.flatnonzero(left[node] >= 0)
                while len(active):
                    k = node[active]
                    node[active] = np.where(table[at[active], feature[k]] <= threshold[k], left[k], right[k])
                    active = active[left[node[active]] >= 0]
                total += value[node]
            out[at] = total / len(sent.value[c])
        return pd.Series(out)

    return rows.withColumn(name, F.nanvl(walk(F.coalesce("category", F.lit("None")), features), F.lit(None)))


def confident(soft: DataFrame) -> DataFrame:
    """Soft labels that are 0, or 8/9 and more."""
    return soft.filter((F.col("target") == 0) | (F.col("target") >= 8 / 9))


def hybrid_rows(hard: DataFrame, soft: DataFrame, factor: float) -> DataFrame:
    """Human labels weighing factor and all soft labels weighing 1."""
    return hard.withColumn("weight", F.lit(float(factor))).unionByName(soft.withColumn("weight", F.lit(1.0)))
