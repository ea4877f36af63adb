"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting goes round the features: a tree of at most four leaves over one
feature's bins is fitted to the current residuals (a Newton step), shrunk and added to that feature's lookup table. Then
the pairs of features that explain most of what is left get tables over coarser bins in the same way. A text's
score is the logistic function of the sum of its table entries, looked up for a whole batch at once.

The model is fitted on the driver from a bounded sample of labelled rows (`max_rows`, those with the smallest hash
of their id), so its memory and its broadcast are bounded; scoring reads every whole text once and shuffles nothing.

Defined results: a null or empty text is scored as one without words; a null id is not held out, and is never sampled;
labels with a null quality are not used; several labels of one id each count; without any label of both kinds all
scores are the share of label 1 (0.5 without labels); extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import in_arrow, text_column
from ledgerloom.llm.textstats import BASE, FEATURES, statistics

#: Labelled rows that a model is fitted on, at most.
MAX_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether labels of this row are kept from fitting; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_features(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE and FEATURES of the texts of at most `max_rows` labelled rows, and their labels. The bound holds again after the join, where
    an id may meet several rows."""
    picked = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    sample = docs.select("doc_id", text_column()).join(F.broadcast(picked), "doc_id")
    kept = sample.select("text", "quality", "doc_id", F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("version"))

    def run(batch: pa.RecordBatch) -> dict:
        base, features = statistics(batch.column(0))
        own = {c: batch.column(c) for c in ("quality", "doc_id", "place", "version")}
        return own | {"base": pa.array(base.tolist(), pa.list_(pa.int64())), "features": pa.array(features.tolist(), pa.list_(pa.float64()))}

    every = in_arrow(kept, run, "quality int, doc_id long, place long, version long, base array<long>, features array<double>")
    rows = every.orderBy("place", "doc_id", "version", "quality").limit(max_rows).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.base))
    base, features = np.array([r.base for r in rows], np.int64), np.array([r.features for r in rows], float)
    return base.reshape(len(rows), len(BASE)), features.reshape(len(rows), len(FEATURES)), np.array([r.quality for r in rows], np.int64)


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + l2) + (g.sum() - a) ** 2 / (h.sum() - b + l2)
    if not len(gain):
        return -1.0, 0
    k = int(gain.argmax())
    return float(gain[k] - g.sum() ** 2 / (h.sum() + l2)), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, l2: float = 5.0, leaves: int = 4) -> np.ndarray:
    """Values by bin of a tree grown best first, for gradients and curvatures summed by bin."""
    parts = [(0, len(g), *_best_cut(g, h, l2))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, gain, cut = parts[k]
        if gain <= 1e-6:
            break
        parts[k : k + 1] = [(a, a + cut, *_best_cut(g[a : a + cut], h[a : a + cut], l2)), (a + cut, b, *_best_cut(g[a + cut : b], h[a + cut : b], l2))]
    out = np.zeros(len(g))
    for a, b, *_ in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, l2: float = 5.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts rows once and then each side's columns once."""
    best, value = -1.0, np.zeros(g.shape)
    whole = g.sum() ** 2 / (h.sum() + l2)
    for cut in range(1, len(g)):
        out, gain = np.zeros(g.shape), -whole
        for side in (slice(0, cut), slice(cut, len(g))):
            a, b = g[side].sum(0), h[side].sum(0)
            more, k = _best_cut(a, b, l2)
            gain += max(more, 0) + a.sum() ** 2 / (b.sum() + l2)
            for cols in (slice(0, k), slice(k, len(a))) if more > 0 else (slice(0, len(a)),):
                out[side, cols] = a[cols].sum() / (b[cols].sum() + l2)
        if gain > best:
            best, value = gain, out
    return best, value


@dataclass
class Gam:
    """Cut points and tables; `pairs` holds (feature, feature, table) over the coarse cut points."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, k], "right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 48, rate: float = 0.15) -> Gam:
    """Fits tables by cyclic boosting; every fifth row only decides after how many rounds to stop."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Gam(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    coarse = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 11)[1:-1])) for k in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    check = np.arange(len(y)) % 5 == 4
    check &= len(y) >= 50
    train = ~check
    share = min(max(float(y[train].mean()), 1e-3), 1 - 1e-3)
    model = Gam(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], coarse)
    z = np.full(len(y), model.intercept)

    def loss() -> float:
        rows = check if check.any() else train
        return float(np.logaddexp(0, np.where(y[rows] == 1, -z[rows], z[rows])).mean())

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.where(train, y - p, 0), np.where(train, p * (1 - p), 0)

    def boost(n: int, step, state: list[np.ndarray]) -> None:
        nonlocal z
        best, kept, kept_z = loss(), [t.copy() for t in state], z.copy()
        since = 0
        for _ in range(n):
            step()
            if (now := loss()) < best - 1e-5:
                best, kept, kept_z, since = now, [t.copy() for t in state], z.copy(), 0
            else:
                since += 1
                if since >= 10:
                    break
        for t, k in zip(state, kept):
            t[:] = k
        z = kept_z

    def main_step() -> None:
        for k, bin_of in enumerate(at):
            g, h = slopes()
            add = rate * shallow_tree(np.bincount(bin_of, g, len(edges[k]) + 1), np.bincount(bin_of, h, len(edges[k]) + 1))
            model.tables[k] += add
            z[:] += add[bin_of]

    boost(rounds, main_step, model.tables)
    g, h = slopes()

    def sums(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(wide[a] * shape[1] + wide[b], v, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((pair_tree(sums(a, b, g), sums(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])), reverse=True)
    model.pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for gain, a, b in gains[:n_pairs] if gain > 0]

    def pair_step() -> None:
        for a, b, table in model.pairs:
            g, h = slopes()
            add = rate * pair_tree(sums(a, b, g), sums(a, b, h))[1]
            table += add
            z[:] += add[wide[a], wide[b]]

    boost(pair_rounds, pair_step, [t for *_, t in model.pairs])
    return model


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """A model from the labels that are not held out."""
    _, x, y = labelled_features(docs, labels.where(~held_out(F.col("doc_id"))), max_rows)
    return fit(x, y)


def scored(docs: DataFrame, model: Gam, *keep: str, prefix: str = "") -> DataFrame:
    """The columns `keep` of `docs` (doc_id, text) with held_out, score and predicted, whose names begin with `prefix`."""
    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    source = docs.select(*columns, held_out(F.col("doc_id")).alias(f"{prefix}held_out"))

    def run(batch: pa.RecordBatch) -> dict:
        score = model.score(statistics(batch.column("text"))[1])
        out = {c: batch.column(c) for c in batch.schema.names if c != "text" or "text" in keep}
        return out | {f"{prefix}score": pa.array(score, pa.float64()), f"{prefix}predicted": pa.array((score >= 0.5).astype(np.int32), pa.int32())}

    kinds = dict(source.dtypes)
    fields = [c for c in source.columns if c != "text" or "text" in keep]
    return in_arrow(source, run, ", ".join(f"`{c}` {kinds[c]}" for c in fields) + f", `{prefix}score` double, `{prefix}predicted` int")
