"""Quality rules: decision lists learned by sequential covering.

From labelled statistics, rules for the rejected class are grown one after the other: conditions `feature >= t` or
`feature < t` are added by information gain on two thirds of the rows, then dropped from the end as long as
that does not lower (hits - errors) / (hits + errors) on the other third. A rule that is not precise enough there ends
the list; else the rows that it covers are taken out and the next rule is sought. The ordered rules
become one Spark conditional expression, first match decides, no match keeps the document.

The list is fitted on the driver from a bounded sample of labelled rows; the statistics of every whole text are computed
in one pass without a shuffle.

Defined results: a null or empty text has no words and fails the base rules; a null id is carried along; without labels
of both kinds the list is empty and only the base rules decide; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import in_arrow, own_prefix
from ledgerloom.llm.gam import MAX_ROWS, labelled_features
from ledgerloom.llm.textstats import BASE, FEATURES, statistics


@dataclass(frozen=True)
class Condition:
    feature: int
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.feature] >= self.threshold) == self.at_least

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + FEATURES[self.feature])
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.at_least else '<'} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_condition(x: np.ndarray, bad: np.ndarray, cuts: int = 64) -> tuple[float, Condition | None]:
    """The condition with the largest gain: covered bad rows times the bits that their share rises by."""
    p, n = int(bad.sum()), int((~bad).sum())
    now = np.log2(p / (p + n))
    best: tuple[float, Condition | None] = (0.0, None)
    for k in range(x.shape[1]):
        t = np.unique(np.concatenate([np.quantile(x[:, k], np.linspace(0, 1, cuts + 1)[1:], method="lower"), np.quantile(x[bad, k], np.linspace(0, 1, cuts + 1), method="lower")]))
        above_bad = p - np.searchsorted(np.sort(x[bad, k]), t, "left")
        above_good = n - np.searchsorted(np.sort(x[~bad, k]), t, "left")
        for at_least, hit, miss in ((True, above_bad, above_good), (False, p - above_bad, n - above_good)):
            gain = np.where(hit > 0, hit * (np.log2(np.maximum(hit, 1) / np.maximum(hit + miss, 1)) - now), 0)
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Condition(k, at_least, float(t[i])))
    return best


def learned(x: np.ndarray, y: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9, least: int = 4) -> list[Rule]:
    """An ordered list of rules for label 0. A rule has to be right in `precision` of its hits on the pruning rows."""
    bad = y == 0
    rules: list[Rule] = []
    prune = np.arange(len(y)) % 3 == 2
    left = np.ones(len(y), bool)
    while len(rules) < max_rules:
        grow_x, grow_bad = x[left & ~prune], bad[left & ~prune]
        if grow_bad.sum() < least or grow_bad.all():
            break
        rule: Rule = ()
        while len(rule) < max_conditions and not grow_bad.all():
            _, c = best_condition(grow_x, grow_bad)
            if c is None:
                break
            rule += (c,)
            inside = c.holds(grow_x)
            grow_x, grow_bad = grow_x[inside], grow_bad[inside]
        prune_x, prune_bad = x[left & prune], bad[left & prune]

        def worth(r: Rule) -> float:
            hit = covers(r, prune_x)
            p, n = int((hit & prune_bad).sum()), int((hit & ~prune_bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covers(rule, x) & left
        if not rule or worth(rule) < 2 * precision - 1 or (hit & bad).sum() < least:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        when = rule[0].column(prefix)
        for c in rule[1:]:
            when = when & c.column(prefix)
        out = F.when(when, i) if out is None else out.when(when, i)
    return F.lit(0) if out is None else out.otherwise(0)


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """A list from labelled documents that pass the base rules; those that fail them are dropped in any case."""
    base, x, y = labelled_features(docs, labels, max_rows)
    if not len(y):
        return []
    passes = (base[:, 0] >= 20) & (100 * base[:, 4] <= 30 * base[:, 0])
    return learned(x[passes], y[passes])


def judged(docs: DataFrame, rules: list[Rule], *keep: str, prefix: str = "") -> DataFrame:
    """The columns `keep` of `docs` (doc_id, text) with the base statistics, base_failed, rule and kept, whose names begin with `prefix`."""
    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    used = sorted({c.feature for r in rules for c in r})
    source = docs.select(*columns)
    stat = own_prefix(source)

    def run(batch: pa.RecordBatch) -> dict:
        base, features = statistics(batch.column("text"))
        out = {c: batch.column(c) for c in batch.schema.names if c != "text" or "text" in keep}
        out |= {f"{stat}{name}": pa.array(base[:, k], pa.int64()) for k, name in enumerate(BASE)}
        return out | {f"{stat}{FEATURES[k]}": pa.array(features[:, k], pa.float64()) for k in used}

    kinds = dict(source.dtypes)
    fields = [c for c in source.columns if c != "text" or "text" in keep]
    schema = [f"`{c}` {kinds[c]}" for c in fields] + [f"`{stat}{n}` long" for n in BASE] + [f"`{stat}{FEATURES[k]}` double" for k in used]
    stats = in_arrow(source, run, ", ".join(schema))
    failed = (F.col(f"{stat}n_words") < 20) | (100 * F.col(f"{stat}n_repeat_words") > 30 * F.col(f"{stat}n_words"))
    rule = verdict(rules, stat)
    made = {**{n: F.col(f"{stat}{n}") for n in BASE}, "base_failed": failed, "rule": rule, "kept": ~failed & (rule == 0)}
    return stats.select(*[F.col(f"`{c}`") for c in fields], *[c.alias(prefix + n) for n, c in made.items()])
