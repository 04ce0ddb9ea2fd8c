"""Exact decision trees, and the best split of nodes as a plain DataFrame plan.

`split_candidates` is the distributed form: rows (node, feature, value, ...) are summed by value and
swept by one window a (node, feature).  The fits below take a class-capped sample, whose size is the
cap times the number of classes whatever the corpus, and run NumPy sweeps over features sorted once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_GAIN = 1e-12


def best_split_sse(rows: DataFrame, min_leaf: int = 1) -> DataFrame:
    """node, feature, threshold, reduction: the split that lowers the squared error most.

    `rows` has node, feature (a number), value, y.  Splits lie at observed values (<= goes left), ties
    go to the lower feature, then threshold; a node without a reduction over 1e-12 has no row."""
    by_value = rows.groupBy("node", "feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    w = Window.partitionBy("node", "feature").orderBy("value")
    all_ = Window.partitionBy("node", "feature")
    swept = by_value.select("node", "feature", "value", *(F.sum(c).over(w).alias(f"l{c}") for c in "nsq"), *(F.sum(c).over(all_).alias(f"t{c}") for c in "nsq"))
    sse = lambda n, s, q: q - s * s / n
    right = [F.col(f"t{c}") - F.col(f"l{c}") for c in "nsq"]
    gain = sse(F.col("tn"), F.col("ts"), F.col("tq")) - (sse(F.col("ln"), F.col("ls"), F.col("lq")) + sse(*right))
    return _best(swept.where((F.col("ln") >= min_leaf) & (F.col("tn") - F.col("ln") >= F.greatest(F.lit(min_leaf), F.lit(1)))).withColumn("reduction", gain))


def best_split_gini(rows: DataFrame, classes: int, min_leaf: int = 1) -> DataFrame:
    """The same for class indices y and the Gini impurity, weighted by rows."""
    counts = [F.sum((F.col("y") == k).cast("long")).alias(f"c{k}") for k in range(classes)]
    by_value = rows.groupBy("node", "feature", "value").agg(*counts)
    w, all_ = Window.partitionBy("node", "feature").orderBy("value"), Window.partitionBy("node", "feature")
    ks = range(classes)
    swept = by_value.select("node", "feature", "value", *(F.sum(f"c{k}").over(w).alias(f"l{k}") for k in ks), *(F.sum(f"c{k}").over(all_).alias(f"t{k}") for k in ks))
    total = lambda p: sum((F.col(f"{p}{k}") for k in ks), F.lit(0))
    swept = swept.withColumn("ln", total("l")).withColumn("tn", total("t")).withColumn("rn", F.col("tn") - F.col("ln"))
    swept = swept.where((F.col("ln") >= min_leaf) & (F.col("rn") >= F.greatest(F.lit(min_leaf), F.lit(1))))

    def impurity(counts_: list[Column], n: Column) -> Column:
        return 1.0 - sum(((c / n) * (c / n) for c in counts_), F.lit(0.0))

    left = impurity([F.col(f"l{k}") for k in ks], F.col("ln")) * (F.col("ln") / F.col("tn"))
    right = impurity([F.col(f"t{k}") - F.col(f"l{k}") for k in ks], F.col("rn")) * (F.col("rn") / F.col("tn"))
    return _best(swept.withColumn("reduction", impurity([F.col(f"t{k}") for k in ks], F.col("tn")) - (left + right)))


def _best(candidates: DataFrame) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.round("reduction", 9).desc(), "feature", "value")
    top = candidates.where(F.col("reduction") > LEAST_GAIN).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return top.select("node", "feature", F.col("value").alias("threshold"), "reduction")


def long_form(rows: DataFrame, features: list[str], node: Column, y: Column) -> DataFrame:
    """One row for each feature of each row: node, feature (its place), value, y."""
    values = F.array(*(F.col(f).cast("double") for f in features))
    return rows.select(node.alias("node"), y.alias("y"), F.posexplode(values).alias("feature", "value"))


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1; `value` is a mean or an array of class counts."""

    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, None)):
            column.append(x)
        return len(self.feature) - 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        children = np.array([self.left, self.right])
        node = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(feature[node] >= 0)).size:
            at = node[inner]
            node[inner] = children[(x[inner, feature[at]] > threshold[at]).astype(int), at]
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]

    def column(self, features: list[str], output=lambda v: F.lit(float(v)), node: int = 0) -> Column:
        """The tree as one expression, so that scoring stays in generated code."""
        if self.feature[node] < 0:
            return output(self.value[node])
        test = F.col(features[self.feature[node]]) <= F.lit(float(self.threshold[node]))
        return F.when(test, self.column(features, output, self.left[node])).otherwise(self.column(features, output, self.right[node]))


def _sweep(x: np.ndarray, order: np.ndarray, rows: np.ndarray, targets: np.ndarray, min_leaf: int, classes: int) -> tuple[float, int, float] | None:
    """Gain, feature and threshold of the best split of the rows marked in `rows`."""
    n = int(rows.sum())
    own = order[rows[order]].reshape(order.shape[0], n)  # features x the node's rows by value
    v = np.take_along_axis(x.T, own, 1)
    left_n = np.arange(1, n)
    right_n = n - left_n
    ok = (v[:, 1:] != v[:, :-1]) & (left_n >= min_leaf) & (right_n >= min_leaf)
    if classes:
        gain = np.zeros((len(own), n - 1))
        left_sq, right_sq, all_sq = 0.0, 0.0, 0.0
        for k in range(classes):
            c = np.cumsum(targets[own] == k, axis=1)
            total = c[:, -1:]
            left_sq = left_sq + (c[:, :-1] / left_n) ** 2
            right_sq = right_sq + ((total - c[:, :-1]) / right_n) ** 2
            all_sq = all_sq + (total / n) ** 2
        gain = (1 - all_sq) - ((1 - left_sq) * (left_n / n) + (1 - right_sq) * (right_n / n))
    else:
        y = targets[own]
        s, q = np.cumsum(y, 1), np.cumsum(y * y, 1)
        ls, lq, ts, tq = s[:, :-1], q[:, :-1], s[:, -1:], q[:, -1:]
        gain = (tq - ts * ts / n) - ((lq - ls * ls / left_n) + (tq - lq - (ts - ls) ** 2 / right_n))
    gain = np.where(ok, gain, -np.inf)
    best = int(np.argmax(gain)) if gain.size else 0
    if not gain.size or gain.flat[best] <= LEAST_GAIN:
        return None
    f, i = divmod(best, n - 1)
    return float(gain[f, i]), f, float(v[f, i])


def fit_tree(x: np.ndarray, y: np.ndarray, max_depth: int, min_leaf: int, classes: int = 0, order: np.ndarray | None = None) -> Tree:
    """A regression tree on y, or with `classes` a classification tree on class indices y.

    `order` is x sorted by each feature, kept by callers that fit many trees on one x."""
    order = np.argsort(x, axis=0, kind="stable").T if order is None else order
    tree = Tree()
    todo = [(tree.add(), np.ones(len(x), bool), 0)]
    while todo:
        node, rows, depth = todo.pop()
        own = y[rows]
        tree.value[node] = np.bincount(own, minlength=classes) if classes else (float(own.mean()) if len(own) else 0.0)
        if depth >= max_depth or len(own) < 2 * max(min_leaf, 1):
            continue
        found = _sweep(x, order, rows, y, min_leaf, classes)
        if found is None:
            continue
        _, tree.feature[node], tree.threshold[node] = found
        goes_left = x[:, tree.feature[node]] <= tree.threshold[node]
        tree.left[node], tree.right[node] = tree.add(), tree.add()
        todo += [(tree.left[node], rows & goes_left, depth + 1), (tree.right[node], rows & ~goes_left, depth + 1)]
    return tree
