"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditional expressions.

A rule is a conjunction of thresholds on text statistics that covers low-quality rows. Rules are grown one at a time on
two thirds of the labelled sample (the condition of highest information gain next), pruned on the other third (the end
of the conjunction goes while that betters its worth there), and accepted while they are precise; the rows that a rule
covers leave the sample. The list becomes one ``when ... otherwise`` column over Spark's statistics of every whole text.

Defined results: null and empty texts have no words and fail the base rule; an empty label table, or one without
low-quality rows, gives an empty list, which keeps all; repeated rows are judged each; a null id is carried through;
of other columns none are read; a very long text is read whole, alone in its chunk; a value equal to a threshold (a tie) isn't
above it; an empty table of documents gives no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _stats

MOST_CONDITIONS, MOST_RULES = 4, 12
#: Share of rejected rows that must be of low quality, on the grown and on the pruned rows, and the least number of them.
PRECISION, LEAST_COVERED = 0.97, 8
THRESHOLDS = 48
#: A good row weighs as much as so many low-quality ones while a rule grows: rejecting it is the worse mistake.
GOOD_WEIGHT = 20
#: Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def covers(self, x: np.ndarray) -> np.ndarray:
        column = x[:, _stats.FEATURES.index(self.feature)]
        return column >= self.threshold if self.above else column <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] >= self.threshold if self.above else columns[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return functools.reduce(np.logical_and, [c.covers(x) for c in rule], np.ones(len(x), bool))


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition of highest gain until the rule covers no good row or no condition gains."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        before, best = np.log2(p / (p + GOOD_WEIGHT * n)), (0.0, None)
        for f, name in enumerate(_stats.FEATURES):
            values = np.sort(x[inside, f])
            # Midpoints between neighbouring quantiles: a threshold that no row sits on.
            at = np.unique(np.linspace(0, len(values) - 1, 4 * THRESHOLDS).astype(int))
            quantiles = np.unique(np.concatenate([values[at], np.quantile(x[inside & bad, f], np.linspace(0, 1, THRESHOLDS))]))
            cuts = (quantiles[1:] + quantiles[:-1]) / 2
            order = np.sort(x[inside & bad, f]), np.sort(x[inside & ~bad, f])
            for above in (True, False):
                got = [len(o) - np.searchsorted(o, cuts, "left") if above else np.searchsorted(o, cuts, "right") for o in order]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(got[0] > 0, got[0] * (np.log2(got[0] / (got[0] + GOOD_WEIGHT * got[1])) - before), 0.0)
                if len(gain) and (top := int(np.argmax(gain))) is not None and gain[top] > best[0] + 1e-9:
                    best = float(gain[top]), Condition(name, above, float(cuts[top]))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].covers(x)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on other rows; of equals, the shortest."""

    def worth(r: Rule) -> float:
        inside = covers(r, x)
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (round(worth(r), 12), -len(r)), default=())


def learn(x: np.ndarray, good: np.ndarray, seed: int = 7) -> list[Rule]:
    """The ordered decision list; each rule rejects, and what no rule covers is kept."""
    bad, rules = good == 0, []
    part = np.random.RandomState(seed).rand(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and (bad & left & part).sum() >= LEAST_COVERED:
        rule = prune(grow(x[left & part], bad[left & part]), x[left & ~part], bad[left & ~part])
        inside = covers(rule, x) & left
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        held_p, held_n = (bad & inside & ~part).sum(), (~bad & inside & ~part).sum()
        if not rule or p < LEAST_COVERED or p < PRECISION * (p + n) or held_p < PRECISION * (held_p + held_n):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """kept: the first rule that covers the row rejects it, else it is kept."""
    columns = _stats.feature_columns()
    out = None
    for rule in rules:
        test = functools.reduce(lambda a, b: a & b, [c.column(columns) for c in rule])
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every whole text, the base rule and the list's verdict."""
    stats = _stats.statistics(_stats.documents(df, id_col, text_col))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = _stats.SAMPLE) -> list[Rule]:
    return learn(*_stats.labelled(_stats.documents(df, id_col, text_col), labels, sample))
