"""Quality classifier as a sparse ensemble of rules.

Trees are grown on statistics of texts; every path from a root to a node is a
rule, a conjunction of comparisons. A logistic model with an L1 penalty gives
most rules no weight. The rules that keep one are written as one Spark column,
so that scoring is a projection without Python.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text; null counts as empty. Shares are of characters, words or lines and 0 where there are none."""
    text = F.coalesce(text, F.lit(""))
    length = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    share = lambda n, of: F.when(of > 0, n / of).otherwise(F.lit(0.0))
    words = count(WORD)
    lines = F.split(text, "\n")
    n_lines = F.size(lines)
    return {
        "n_words": words.cast("double"),
        "word_length": share(length, words),
        "upper": share(count(r"\p{Lu}"), length),
        "digits": share(count(r"\p{Nd}"), length),
        "stops": share(count(r"[.!?]"), words),
        "marks": share(count(r"[^\p{L}\p{N}\s.,;:'!?-]"), words),
        "doubled_marks": share(count(r"([^\p{L}\p{N}\s])\1"), words),
        "line_words": share(words, n_lines),
        "repeated_lines": share(n_lines - F.size(F.array_distinct(lines)), n_lines),
        "repeated_words": share(count(r"(?<![^\s])([^\s]+)\s+\1(?![^\s])"), words),
    }


def _paths(node, below=()) -> list[tuple]:
    """Every conjunction on the way to a node: ((feature, is_at_most, threshold), ...)."""
    if node.numDescendants() == 0:
        return []
    feature, threshold = node.split().featureIndex(), node.split().threshold()
    out = []
    for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
        path = (*below, (feature, at_most, threshold))
        out += [path, *_paths(child, path)]
    return out


def _condition(rule: tuple, columns: list[Column]) -> Column:
    test = F.lit(True)
    for feature, at_most, threshold in rule:
        test = test & ((columns[feature] <= threshold) if at_most else (columns[feature] > threshold))
    return test


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``statistics``, of the whole text."""
    return docs.withColumn("statistics", F.struct(*(c.alias(n) for n, c in statistics(F.col(text)).items())))


def fit(labelled: DataFrame, label: str = "quality", trees: int = 10, depth: int = 3, penalty: float = 0.002, seed: int = 1, part_rows: int = 20_000) -> dict:
    """The rules and their weights: {"names", "intercept", "rules": [(rule, weight)]}, from ``measured`` rows with a label.

    All labelled rows are used, on the cluster; rows with a null label are
    left out. With one label or none there are no rules, and every text gets the share
    of label 1 (0.5 without rows). A row counts as often as it is labelled.
    Label and statistics are written once, as the trees and weights read them
    often, and read in parts of about ``part_rows``.
    """
    names = labelled.schema["statistics"].dataType.names
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), F.array(*(F.col(f"statistics.{n}") for n in names)).alias("x"))
    rows = stored(rows, "statistics")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().limit(3).collect()}
    parts = max(1, -(-rows.count() // part_rows))
    if len(counts) < 2:
        p = min(max(counts.get(1.0, 0) / sum(counts.values()) if counts else 0.5, 1e-3), 1 - 1e-3)
        return {"names": names, "intercept": math.log(p / (1 - p)), "rules": []}
    train = rows.select("label", array_to_vector("x").alias("features")).coalesce(parts).persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="sqrt", maxBins=32).fit(train)
    java = [t._java_obj.rootNode() for t in forest.trees]
    rules = sorted({tuple(sorted(set(p))) for root in java for p in _paths(root)})
    train.unpersist()
    x = F.col("x")
    tests = [_condition(r, [x[i] for i in range(len(names))]).cast("double") for r in rules]
    held = rows.select("label", array_to_vector(F.array(*tests)).alias("features")).coalesce(parts).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=False).fit(held)
    held.unpersist()
    weights = lasso.coefficients.toArray().tolist()
    return {"names": names, "intercept": float(lasso.intercept), "rules": [(r, w) for r, w in zip(rules, weights) if w]}


def score(docs: DataFrame, model: dict, cut: float = 0.7) -> DataFrame:
    """``measured`` rows with score, the probability of label 1 (0 to 1), and predicted, 1 if score >= cut, else 0.

    Every row is scored, those of empty and null texts too (all statistics 0).
    Columns of these names are replaced, all others but ``statistics`` stay.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted", "statistics")]
    columns = [F.col(f"statistics.{n}") for n in model["names"]]
    total = F.lit(model["intercept"])
    for rule, weight in model["rules"]:
        total = total + F.when(_condition(rule, columns), F.lit(weight)).otherwise(F.lit(0.0))
    return docs.withColumn("score", 1 / (1 + F.exp(-total))).select(*keep, "score", (F.col("score") >= cut).cast("int").alias("predicted"))
