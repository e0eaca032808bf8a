"""Toxicity: a factorization machine over hashed terms, which weighs pairs of terms as well as single ones."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.ship import give_back
from assayer.llm.sparse import Terms, held_out, labelled_sample, row_sums, scores, sparse_rows
from assayer.llm.text import BY_LETTERS

#: Words, and their beginnings (in bytes) for inflected forms.
TERMS = Terms(BY_LETTERS, bits=20, beginnings=(4, 5, 6))
#: So many terms at most are searched for pairs at the start of the factors.
PAIR_TERMS = 2048


@dataclass
class ToxicityModel:
    """score = sigmoid(bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), where x is 1 for a term that occurs.

    Terms without weight and factors have slot -1.
    """

    slot: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def wanted(self) -> np.ndarray:
        return self.slot >= 0

    def logits(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        at = self.slot[index]
        v = self.v[at]
        # The sum over pairs in linear time: half of the squared sum less the sum of squares.
        pairs = (row_sums(v, bounds) ** 2).sum(axis=1) - row_sums((v * v).sum(axis=1), bounds)
        return self.bias + row_sums(self.w[at], bounds) + pairs / 2

    def score(self, index: np.ndarray, count: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(index, bounds), -30, 30)))


def choose_terms(index: np.ndarray, bounds: np.ndarray, label: np.ndarray, bits: int, least_rows: int, most_terms: int, least_chi: float = 0.0) -> np.ndarray:
    """The terms that tell most about the label, by the chi-squared statistic of term and label, which is `least_chi` or more."""
    row_label = np.repeat(label, np.diff(bounds))
    df = np.bincount(index, minlength=1 << bits).astype(np.float64)
    pos = np.bincount(index, weights=row_label, minlength=1 << bits)
    n, p = len(label), label.sum()
    expected = df * p / max(n, 1)
    spread = expected * (1 - df / max(n, 1)) * (1 - p / max(n, 1))
    chi = np.where((df >= least_rows) & (spread > 0), (pos - expected) ** 2 / np.where(spread > 0, spread, 1), -1)
    order = np.argsort(-chi, kind="stable")[:most_terms]
    return np.sort(order[chi[order] >= least_chi])


def fit_machine(
    index: np.ndarray, bounds: np.ndarray, label: np.ndarray, bits: int, factors: int = 8, rounds: int = 4, rate: float = 2.0, pair_rate: float = 0.05, l1: float = 8.0, l2: float = 0.1, batch: int = 32, least_steps: int = 300,
    least_rows: int = 1, most_terms: int | None = None, least_chi: float = 0.0, folds: int = 4, seed: int = 11,
) -> ToxicityModel:
    """Follow-the-regularised-leader on the logistic loss of the machine; small samples are gone through more often.

    Every term of the sample takes part, unless the caller sets one of the three limits. Weights alone are fitted first, for
    each fold on the other ones; pairs that they leave unexplained in rows they have not seen give the factors to start
    from (`pair_factors`), if such pairs prove themselves: found on some folds, they have to lower the loss on the others. Terms whose weight and factors end as zeros add nothing to a score and get slot -1.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    if least_rows <= 1 and most_terms is None and least_chi <= 0:
        chosen, at = np.unique(index, return_inverse=True)
        ends = bounds
    else:
        chosen = choose_terms(index, bounds, label, bits, least_rows, most_terms or 1 << bits, least_chi)
        place = np.full(1 << bits, -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[index] >= 0
        at, ends = place[index][keep], np.concatenate(([0], np.cumsum(keep)))[bounds]
    at = at.astype(np.int32)
    settings = (rounds, rate, pair_rate, l1, l2, batch, least_steps)
    fold, error = random.permutation(len(label)) % folds, np.zeros(len(label))
    parts = [(np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(folds if len(label) >= folds else 0)]
    none = np.zeros((len(chosen), 0))
    for rest, own in parts:
        w, _, bias = _descend(at, ends, label, rest, none, random, *settings)
        error[own] = _chance(at, ends, own, w, none, bias) - label[own]
    start = pair_factors(at, ends, error, factors, len(chosen))
    if start.any() and parts:
        # Pairs stay if, found without a fold's rows, they tell more about these rows than weights alone do.
        gain = 0.0
        for rest, own in parts:
            w, v, bias = _descend(at, ends, label, rest, pair_factors(at, ends, np.where(np.isin(np.arange(len(label)), own), 0, error), factors, len(chosen)), random, *settings)
            gain += _loss(error[own] + label[own], label[own]) - _loss(_chance(at, ends, own, w, v, bias), label[own])
        if gain <= 0:
            start = np.zeros_like(start)
    w, v, bias = _descend(at, ends, label, np.arange(len(label)), start, random, *settings)
    kept = (w != 0) | v.any(axis=1)
    slot = np.full(1 << bits, -1, dtype=np.int32)
    slot[chosen[kept]] = np.arange(np.count_nonzero(kept))
    return ToxicityModel(slot, w[kept], v[kept], bias)


def _chance(at: np.ndarray, ends: np.ndarray, rows: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float) -> np.ndarray:
    """The machine's scores of these rows, some at a time."""
    out = np.zeros(len(rows))
    for first in range(0, len(rows), 1024):
        some = rows[first : first + 1024]
        size = ends[some + 1] - ends[some]
        own = np.concatenate(([0], np.cumsum(size)))
        i = at[np.repeat(ends[some] - own[:-1], size) + np.arange(own[-1])]
        logit = bias + row_sums(w[i], own)
        if v.any():
            logit += ((row_sums(v[i], own) ** 2).sum(axis=1) - row_sums((v[i] ** 2).sum(axis=1), own)) / 2
        out[first : first + len(some)] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return out


def _loss(chance: np.ndarray, label: np.ndarray) -> float:
    chance = np.clip(chance, 1e-6, 1 - 1e-6)
    return float(-(label * np.log(chance) + (1 - label) * np.log(1 - chance)).sum())


def _descend(at: np.ndarray, ends: np.ndarray, label: np.ndarray, rows: np.ndarray, v: np.ndarray, random: np.random.Generator, rounds: int, rate: float, pair_rate: float, l1: float, l2: float, batch: int, least_steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and bias from these rows, with factors that start as `v`; where none does, weights alone."""
    share = np.clip(label[rows].mean(), 1e-3, 1 - 1e-3) if len(rows) else 0.5
    w, bias, gb, paired = np.zeros(len(v)), float(np.log(share / (1 - share))), 1e-6, v.any()
    # The leader's state: sums of gradients less the drift, and of squared gradients.
    zw, nw, zv, nv = np.zeros_like(w), np.zeros_like(w), -v * (1 / pair_rate + l2) - np.sign(v) * l1, np.zeros_like(v)
    groups = _groups(at, ends, label, rows, batch, random)

    def lead(z: np.ndarray, n: np.ndarray, x: np.ndarray, terms: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        before = n[terms]
        after = before + gradient**2
        z[terms] += gradient - (np.sqrt(after) - np.sqrt(before)) / rate * x[terms]
        n[terms] = after
        sums = z[terms]
        x[terms] = np.where(np.abs(sums) <= l1, 0, (np.sign(sums) * l1 - sums) / ((1 + np.sqrt(after)) / rate + l2))

    for _ in range(max(rounds, -(-least_steps // max(1, len(groups)))) if len(w) else 0):
        for g in random.permutation(len(groups)):
            i, own, order, terms, starts, y = groups[g]
            logit = bias + row_sums(w[i], own)
            if paired:
                sums = row_sums(v[i], own)
                logit = logit + ((sums**2).sum(axis=1) - row_sums((v[i] ** 2).sum(axis=1), own)) / 2
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
            if len(i):
                dw = np.add.reduceat(error[order], starts)
                if paired:
                    lead(zv, nv, v, terms, np.add.reduceat((error[:, None] * sums)[order], starts) - dw[:, None] * v[terms], pair_rate)
                lead(zw, nw, w, terms, dw, rate)
            gb += error.sum() ** 2
            bias -= 0.05 * float(error.sum()) / np.sqrt(gb)
    return w, v, bias


def _groups(at: np.ndarray, ends: np.ndarray, label: np.ndarray, rows: np.ndarray, batch: int, random: np.random.Generator) -> list[tuple]:
    """These rows in groups: their terms and bounds; the row of each entry in the order of terms, the terms and where each begins; labels."""
    groups, mixed = [], random.permutation(rows)
    for first in range(0, len(mixed), batch):
        rows = mixed[first : first + batch]
        size = ends[rows + 1] - ends[rows]
        own = np.concatenate(([0], np.cumsum(size)))
        i = at[np.repeat(ends[rows] - own[:-1], size) + np.arange(own[-1])]
        by_term = np.argsort(i, kind="stable")
        touched, starts = np.unique(i[by_term], return_index=True)
        groups.append((i, own, np.repeat(np.arange(len(rows), dtype=np.int16), size)[by_term], touched, starts.astype(np.int32), label[rows]))
    return groups


def pair_factors(at: np.ndarray, ends: np.ndarray, error: np.ndarray, factors: int, n_terms: int, least_mass: float = 4.0, at_most: int = PAIR_TERMS) -> np.ndarray:
    """Factors whose products come near the weights of the pairs that explain what the weights of terms leave over.

    A pair counts if its rows hold `least_mass` of error beyond what either term alone has, and more of it than the
    best of so many pairs has by chance. No pair has more error of one sign than either of its terms, so terms with
    less are left out of the search without loss; of more than `at_most` terms those stay that have most for their rows.
    """
    v = np.zeros((n_terms, factors))
    row = np.repeat(np.arange(len(error)), np.diff(ends))
    mass = np.maximum(*(np.bincount(at, np.maximum(sign * error, 0)[row], n_terms) for sign in (1, -1)))
    able = np.flatnonzero(mass >= least_mass)
    if len(able) > at_most:
        able = np.sort(able[np.argsort(-mass[able] / np.sqrt(np.bincount(at, minlength=n_terms)[able]), kind="stable")[:at_most]])
    if len(able) < 2:
        return v
    place = np.full(n_terms, -1)
    place[able] = np.arange(len(able))
    # Gradients and curvatures of all pairs, a slice of rows at a time.
    gradient, curve = np.zeros((len(able), len(able)), np.float32), np.zeros((len(able), len(able)), np.float32)
    for first in range(0, len(error), 1024):
        rows = slice(ends[first], ends[min(first + 1024, len(error))])
        x = np.zeros((min(1024, len(error) - first), len(able)), np.float32)
        held = place[at[rows]] >= 0
        x[row[rows][held] - first, place[at[rows]][held]] = 1
        e = error[first : first + 1024, None].astype(np.float32)
        gradient -= x.T @ (x * e)
        curve += x.T @ (x * (np.abs(e) * (1 - np.abs(e))))
    own = np.diag(gradient) / (np.diag(curve) + 1)
    beyond = gradient - curve * (own[:, None] + own[None, :])
    least = np.sqrt(2 * np.log(max(2, len(able) * (len(able) - 1) / 2)))
    found = (np.abs(beyond) >= least_mass) & (np.abs(beyond) >= least * np.sqrt(curve + 1))
    np.fill_diagonal(found, False)
    part = np.flatnonzero(found.any(axis=1))
    if not len(part):
        return v
    grid = np.ix_(part, part)
    weight = np.where(found[grid], np.clip(beyond[grid] / (curve[grid] + 1), -4, 4), 0).astype(np.float64)
    np.fill_diagonal(weight, np.abs(weight).max(axis=1))
    value, vector = np.linalg.eigh(weight)
    best = np.argsort(-value)[:factors]
    v[able[part], : len(best)] = vector[:, best] * np.sqrt(np.maximum(value[best], 0))
    return v


def fit(docs: DataFrame, labels: DataFrame, at_most: int = 8000, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on at most `at_most` labelled rows that are not held out; without any, every text scores one half."""
    index, _, bounds, label = sparse_rows(labelled_sample(docs, labels, "toxic", at_most, doc_id, text), TERMS)
    model = fit_machine(index, bounds, label, TERMS.bits)
    del index
    give_back()
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row, from its text alone.

    Null and empty texts have no terms and get the bias's score. Null ids stay null and are not held out; repeated
    rows get equal scores; other columns are not read. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = scores(docs, lambda *group: shared.value.score(*group), TERMS, model.wanted(), doc_id, text)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
