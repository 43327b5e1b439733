"""Positive-unlabelled learning in numpy: class-prior estimate and non-negative unbiased risk.

Only confirmed positives and unlabelled rows are used. The risk of a classifier g is

    prior * E_P[loss(g, +)] + max(0, E_U[loss(g, -)] - prior * E_P[loss(g, -)])

with the logistic loss, so that sigmoid(g) is a probability. Rows are sets of
feature numbers (present or absent) in compressed rows: ``ptr`` and ``idx``. Rows may be
empty or repeat; callers see to it that there is at least one of either kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    ptr: np.ndarray
    idx: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Rows:
        ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        return cls(ptr, np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))

    def renumbered(self, new: np.ndarray) -> Rows:
        """Features by their new numbers; those numbered -1 go."""
        n = new[self.idx]
        counts = np.bincount(self.owner()[n >= 0], minlength=len(self))
        return Rows(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), n[n >= 0])

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.owner(), weights=w[self.idx], minlength=len(self)) + bias

    def take(self, keep: np.ndarray) -> Rows:
        return Rows.of([self.idx[self.ptr[i]:self.ptr[i + 1]] for i in keep])


def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def informative(p: Rows, u: Rows, size: int, most: int, least: int = 4, strength_over: float = 3.0, always: int = 0) -> np.ndarray:
    """New numbers for the ``most`` features whose rates differ most between positives and unlabelled; -1 for others.

    They differ by over ``strength_over`` standard deviations; the first ``always`` features are taken whatever they differ.
    """
    a = np.bincount(p.idx, minlength=size).astype(float)
    b = np.bincount(u.idx, minlength=size).astype(float)
    ra, rb = (a + 0.5) / (len(p) + 1), (b + 0.5) / (len(u) + 1)
    gap = (ra - rb) / np.sqrt(ra * (1 - np.minimum(ra, 0.999)) / (len(p) + 1) + rb * (1 - np.minimum(rb, 0.999)) / (len(u) + 1))
    strength = np.where(a + b >= least, np.abs(gap), 0.0)
    strength[:always] = np.where(a[:always] + b[:always] >= least, np.inf, 0.0)
    chosen = np.argsort(-strength, kind="stable")[:most]
    chosen = np.sort(chosen[strength[chosen] > strength_over])
    new = np.full(size, -1, np.int64)
    new[chosen] = np.arange(len(chosen))
    return new


def adam(grad_of, size: int, steps: int, rate: float) -> np.ndarray:
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad_of(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return x


def fit(p: Rows, u: Rows, size: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) that minimise the non-negative risk; full batches, Adam."""
    po, uo, np_, nu = p.owner(), u.owner(), max(len(p), 1), max(len(u), 1)

    def grad_of(x):
        w, bias = x[:-1], x[-1]
        zp = np.bincount(po, weights=w[p.idx], minlength=len(p)) + bias
        zu = np.bincount(uo, weights=w[u.idx], minlength=len(u)) + bias
        sp, su = sigmoid(zp), sigmoid(zu)
        rest = np.logaddexp(0, zu).sum() / nu - prior * np.logaddexp(0, zp).sum() / np_
        if rest >= 0:
            gp, gu = prior * (sp - 1) / np_ - prior * sp / np_, su / nu
        else:  # the negative part fell below zero: climb back on it alone
            gp, gu = prior * sp / np_, -su / nu
        g = np.empty(size + 1)
        g[:-1] = np.bincount(p.idx, weights=gp[po], minlength=size) + np.bincount(u.idx, weights=gu[uo], minlength=size)
        g[-1] = gp.sum() + gu.sum()
        g[:-1] += l2 * w
        return g

    return adam(grad_of, size + 1, steps, rate)


def estimate_prior(p: Rows, u: Rows, size: int, steps: int = 150) -> float:
    """Share of positives among the unlabelled: the least ratio of upper-tail rates, unlabelled to positive.

    The scores are those of a plain positive-against-unlabelled classifier, each
    half scored by the classifier of the other half. Above any score, the
    unlabelled rate is at least prior * positive rate; the tightest ratio, with
    one standard deviation for the noise of small tails, is the estimate.
    """
    halves_p = [np.arange(k, len(p), 2) for k in (0, 1)]
    halves_u = [np.arange(k, len(u), 2) for k in (0, 1)]
    sp, su = np.zeros(len(p)), np.zeros(len(u))
    for k in (0, 1):
        a, b = p.take(halves_p[k]), u.take(halves_u[k])
        rows = Rows(np.concatenate([a.ptr, a.ptr[-1] + b.ptr[1:]]), np.concatenate([a.idx, b.idx]))
        y = np.concatenate([np.ones(len(a)), np.zeros(len(b))])
        own, n = rows.owner(), len(rows)
        weight = np.concatenate([np.full(len(a), 0.5 / max(len(a), 1)), np.full(len(b), 0.5 / max(len(b), 1))])

        def grad_of(x, rows=rows, y=y, own=own, n=n, weight=weight):
            z = np.bincount(own, weights=x[rows.idx], minlength=n) + x[-1]
            r = (sigmoid(z) - y) * weight
            return np.append(np.bincount(rows.idx, weights=r[own], minlength=size) + 1e-4 * x[:-1], r.sum())

        x = adam(grad_of, size + 1, steps, 0.05)
        other_p, other_u = halves_p[1 - k], halves_u[1 - k]
        sp[other_p], su[other_u] = p.take(other_p).scores(x[:-1], x[-1]), u.take(other_u).scores(x[:-1], x[-1])
    best = 1.0
    for t in np.unique(np.quantile(sp, np.linspace(0, 0.9, 91))):
        fp, fu = (sp >= t).mean(), (su >= t).mean()
        if fp > 0:
            best = min(best, fu / fp + np.sqrt(max(fu * (1 - fu), 1e-9) / len(su)) / fp)
    return float(np.clip(best, 0.005, 0.99))
