"""Boosted trees on binned features, one model per group in a task of its own: chances and quantiles.

A group's training and validation rows are bounded samples (the least by a seeded hash of their ids, a documented
parameter); scoring takes every row.  Numbers are cut at quantiles of the training rows, gaps are a bin of their own
that each split sends to the better side, categories are ordered by their mean outcome in the training rows, at most
MOST_CATEGORIES of them with one level for the others.  Rounds stop when the validation loss has not
fallen for PATIENCE rounds, and the best round counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group and split that a model is fitted on.
SAMPLE = 50_000
MOST_CATEGORIES = 254
ROUNDS, PATIENCE, RATE, DEPTH, LEAST, BINS, RIDGE = 300, 30, 0.1, 4, 20, 64, 1.0


class Binner:
    """Codes of features: 0 for a gap, then bins of numbers or places of categories in the order of their means."""

    def __init__(self, numeric: list[str], codes: list[str]):
        self.numeric, self.codes = numeric, codes

    def fit(self, frame: pd.DataFrame, y: np.ndarray) -> Binner:
        self.edges = {}
        for c in self.numeric:
            x = frame[c].to_numpy(float)
            x = x[np.isfinite(x)]
            self.edges[c] = np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
        self.places = {}
        overall = float(np.mean(y)) if len(y) else 0.0
        for c in self.codes:
            column = frame[c].astype("string")
            stats = pd.DataFrame({"v": column, "y": y}).dropna(subset=["v"]).groupby("v")["y"].agg(["size", "sum"])
            kept = stats.sort_values("size", ascending=False, kind="stable").head(MOST_CATEGORIES)
            mean = (kept["sum"] + 10 * overall) / (kept["size"] + 10)
            order = mean.sort_values(kind="stable").index
            self.places[c] = {v: i + 2 for i, v in enumerate(order)}
        return self

    def codes_of(self, frame: pd.DataFrame) -> np.ndarray:
        out = []
        for c in self.numeric:
            x = frame[c].to_numpy(float)
            out.append(np.where(np.isfinite(x), np.searchsorted(self.edges[c], x, "left") + 1, 0))
        for c in self.codes:
            column = frame[c].astype("string")
            # 1 is any value that training did not keep
            out.append(column.map(self.places[c]).fillna(1).where(column.notna(), 0).to_numpy(np.int64))
        return np.column_stack(out).astype(np.int64) if out else np.zeros((len(frame), 0), np.int64)


class Booster:
    """Trees of fixed depth for log loss (``quantile`` None) or the pinball loss of a quantile."""

    def __init__(self, quantile: float | None = None, rounds: int = ROUNDS, seed: int = 7):
        self.quantile, self.rounds = quantile, rounds
        self.trees: list[tuple[list, np.ndarray]] = []

    def loss(self, score: np.ndarray, y: np.ndarray) -> float:
        if self.quantile is None:
            return float(np.mean((1 / (1 + np.exp(-score)) - y) ** 2))
        d = y - score
        return float(np.mean(np.maximum(self.quantile * d, (self.quantile - 1) * d)))

    def fit(self, x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray) -> Booster:
        if self.quantile is None:
            p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
            self.start = float(np.log(p / (1 - p)))
        else:
            self.start = float(np.quantile(y, self.quantile))
        score, held = np.full(len(y), self.start), np.full(len(vy), self.start)
        best, best_at = self.loss(held, vy) if len(vy) else np.inf, 0
        for k in range(1, self.rounds + 1):
            if self.quantile is None:
                p = 1 / (1 + np.exp(-score))
                gradient, curve = y - p, np.maximum(p * (1 - p), 1e-6)
            else:
                gradient, curve = np.where(y > score, self.quantile, self.quantile - 1), np.ones(len(y))
            splits, node = self._grow(x, gradient, curve)
            value = np.zeros(2**DEPTH)
            for n in np.unique(node):
                inside = node == n
                if self.quantile is None:
                    value[n] = RATE * gradient[inside].sum() / (curve[inside].sum() + RIDGE)
                else:
                    value[n] = RATE * np.quantile(y[inside] - score[inside], self.quantile)
            self.trees.append((splits, value))
            score = score + value[node]
            if len(vy):
                held = held + value[self._route(splits, vx)]
                now = self.loss(held, vy)
                if now < best - 1e-12:
                    best, best_at = now, k
                elif k - best_at >= PATIENCE:
                    break
            else:
                best_at = k
        self.trees = self.trees[:best_at]
        return self

    def _grow(self, x, gradient, curve):
        node = np.zeros(len(gradient), np.int64)
        splits: list = []
        for level in range(DEPTH):
            found: list = [None] * 2**level
            for f in range(x.shape[1]):
                width = int(x[:, f].max()) + 1 if len(x) else 1
                cell = node * width + x[:, f]
                g = np.bincount(cell, gradient, 2**level * width).reshape(-1, width)
                h = np.bincount(cell, curve, 2**level * width).reshape(-1, width)
                c = np.bincount(cell, minlength=2**level * width).reshape(-1, width)
                whole = (g.sum(1) ** 2 / (h.sum(1) + RIDGE))[:, None]
                for gap_left in (True, False):
                    first = 0 if gap_left else 1
                    gl, hl, cl = (np.cumsum(a[:, first:], 1)[:, :-1] for a in (g, h, c))
                    if not gl.shape[1]:
                        continue
                    gr, hr, cr = g.sum(1)[:, None] - gl, h.sum(1)[:, None] - hl, c.sum(1)[:, None] - cl
                    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - whole
                    gain[(cl < LEAST) | (cr < LEAST)] = 0
                    at = gain.argmax(1)
                    for n in range(2**level):
                        if gain[n, at[n]] > 1e-9 and (found[n] is None or gain[n, at[n]] > found[n][0]):
                            found[n] = (gain[n, at[n]], f, int(at[n]) + first, gap_left)
            splits.append(found)
            node = self._step(found, x, node)
        return splits, node

    @staticmethod
    def _step(found, x, node):
        right = np.zeros(len(node), np.int64)
        for n, split in enumerate(found):
            if split is not None:
                inside = node == n
                code = x[inside, split[1]]
                right[inside] = (code > split[2]) | ((code == 0) & (not split[3]))
        return 2 * node + right

    def _route(self, splits, x):
        node = np.zeros(len(x), np.int64)
        for found in splits:
            node = self._step(found, x, node)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for splits, value in self.trees:
            out += value[self._route(splits, x)]
        return out if self.quantile is not None else 1 / (1 + np.exp(-out))


def fit_groups(rows: DataFrame, by: list[str], ident: str, split: str, y: str, numeric: list[str], codes: list[str], quantiles: tuple[float, ...] = (), sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """(by, model): one pickled (binner, boosters) per group that has training rows; rows with a null outcome take no part.

    ``split`` tells ``train`` and ``val`` rows.  Without ``quantiles`` the outcome is 0 or 1, else a number.
    """
    from .resample import draw_key, positions

    used = rows.where(F.col(y).isNotNull() & F.col(split).isin("train", "val")).select(*by, ident, F.col(split).alias("__split"), F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in codes])
    placed = positions(used.withColumn("__key", draw_key(F.col(ident), 11)), [*by, "__split"], "__key", ident, "__at").where(F.col("__at") <= sample).drop("__key", "__at")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ident)
        train, val = frame[frame["__split"] == "train"], frame[frame["__split"] == "val"]
        if not len(train):
            return pd.DataFrame({**{c: frame[c].iloc[:0] for c in by}, "model": pd.Series([], dtype=object)})
        target = train["__y"].to_numpy(float)
        binner = Binner(numeric, codes).fit(train, target)
        x, vx = binner.codes_of(train), binner.codes_of(val)
        boosters = [Booster(q, rounds).fit(x, target, vx, val["__y"].to_numpy(float)) for q in (quantiles or (None,))]
        return pd.DataFrame({**{c: frame[c].iloc[:1].to_numpy() for c in by}, "model": [pickle.dumps((binner, boosters))]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    return placed.groupBy(*by).applyInPandas(fit, f"{fields}, model binary")


def predict_groups(rows: DataFrame, models: DataFrame, by: list[str], numeric: list[str], codes: list[str], outputs: int = 1) -> DataFrame:
    """``rows`` of groups with a model, with ``forecasts`` (array of one chance, or one number per quantile).

    Models are a row per group of some 100 kB; they are joined, so rows of one group may be scored in any number of tasks.
    """
    joined = rows.join(models, by)
    kept = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict = {}
        for frame in frames:
            for raw, part in frame.groupby("model", sort=False):
                if raw not in read:
                    read[raw] = pickle.loads(raw)
                binner, boosters = read[raw]
                x = binner.codes_of(part)
                yield part[kept].assign(forecasts=list(np.column_stack([b.score(x) for b in boosters])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return joined.mapInPandas(run, f"{schema}, forecasts array<double>")
