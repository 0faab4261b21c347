"""Quality classifier: a sparse ensemble of rules over text statistics.

A small forest of shallow trees is grown on labelled texts.  Every path from a root
to a node is a rule, a conjunction of bounds on statistics.  A lasso logistic
regression weighs the rules' 0/1 values and leaves most at zero; the rest becomes
one Spark column: the logistic function of a sum of ``CASE WHEN`` terms.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import stored

#: Trees, their depth, and the lasso's penalty.
TREES, DEPTH, PENALTY = 12, 3, 0.002


def statistics() -> dict[str, Column]:
    """The statistics rules may bound, from counted texts (:func:`stats.text_counts`)."""
    c = lambda name: F.col("_s_" + name).cast("double")
    words, chars, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    return {
        "words": c("n_words"), "word_length": c("word_chars") / words, "symbols": c("n_symbols") / words,
        "repeated_lines": c("n_dup_lines") / lines, "repeated_words": c("n_repeat_words") / words,
        "distinct_words": c("n_distinct") / words, "capitals": c("n_upper") / chars, "digits": c("n_digits") / chars,
        "points": c("n_points") / chars, "wide_letters": c("n_wide") / chars, "most_common": c("n_common") / words,
        "longest_word": c("longest_word"), "same_word_again": c("n_same_word") / words, "words_in_line": c("n_words") / lines,
    }


@dataclass(frozen=True)
class Rule:
    """Bounds by statistic: greater than the first, at most the second; None is no bound."""
    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low is not None:
                out = out & (F.col(name) > low)
            if high is not None:
                out = out & (F.col(name) <= high)
        return out


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights other than zero, and the value without any rule."""
    intercept: float
    rules: tuple[tuple[Rule, float], ...] = field(default=())

    def score(self) -> Column:
        """Probability of label 1, over columns named as :func:`statistics`."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.0-9Ee]+)\)$")


def paths(description: str, names: list[str]) -> list[Rule]:
    """The rules of all nodes below the roots of a forest, from the text it describes itself by, each once."""
    found: dict[tuple, None] = {}
    open_: list[tuple[int, str, str, float]] = []
    for line in description.splitlines():
        if line.strip().startswith("Tree "):
            open_ = []
        m = _BRANCH.match(line)
        if not m:
            continue
        depth = len(m[1])
        open_ = [o for o in open_ if o[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, list[float | None]] = {}
        for _, name, side, value in open_:
            low, high = bounds.setdefault(name, [None, None])
            if side == ">":
                bounds[name][0] = value if low is None else max(low, value)
            else:
                bounds[name][1] = value if high is None else min(high, value)
        found[tuple(sorted((n, a, b) for n, (a, b) in bounds.items()))] = None
    return [Rule(b) for b in sorted(found, key=str)]


def train(rows: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Fit on all rows given (the columns of :func:`statistics` and a label 0 or 1); other labels are left out.

    Without rows the score is 0.5 everywhere; with one label alone it is near that label.
    """
    names = list(statistics())
    rows = stored(rows.where(F.col(label).isin(0, 1)).select(
        F.col(label).cast("double").alias("label"), *names, array_to_vector(F.array(*names)).alias("features")), "labelled")
    seen = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return RuleModel(0.0 if not seen else math.log(99) * (1 if 1 in seen else -1))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.7,
                                    featureSubsetStrategy="onethird").fit(rows.select("label", "features"))
    rules = paths(forest.toDebugString, names)
    if not rules:
        return RuleModel(math.log(seen[1] / seen[0]))
    fired = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(stored(fired, "fired"))
    weighed = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-9)
    return RuleModel(float(lasso.intercept), weighed)
