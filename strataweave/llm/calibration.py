"""Scores from votes: a rising calibration curve with its error, and copies within a sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Spread of the prior of constant and slope, around no change of the vote.
PRIOR_SPREAD = (1.0, 0.5)
#: Documents of a group of neighbouring votes, and documents that the logistic curve counts as in each.
GROUP = 50
PRIOR_WEIGHT = 4.0
#: Documents that the labelled share counts as where the share among all is sought.
PRIOR_DOCUMENTS = 100
_EDGE = 0.002
#: Share of passages, of the larger document, from which two documents count as copies.
COPY_SHARE = 0.8
_RARE = 20


def _log_odds(votes: np.ndarray) -> np.ndarray:
    v = np.clip(votes, _EDGE, 1 - _EDGE)
    return np.log(v / (1 - v))


@dataclass
class Calibration:
    """Scores at some votes, both as log-odds, with their standard errors, and straight lines between.

    Without labels the score is the vote itself, with an error that says so.
    """

    votes: np.ndarray = field(default_factory=lambda: np.array([_log_odds(np.array(_EDGE)), _log_odds(np.array(1 - _EDGE))]))
    scores: np.ndarray = field(default_factory=lambda: np.array([_log_odds(np.array(_EDGE)), _log_odds(np.array(1 - _EDGE))]))
    errors: np.ndarray = field(default_factory=lambda: np.full(2, PRIOR_SPREAD[0]))
    few: bool = True  # not from GROUP documents or more

    @classmethod
    def fitted(cls, votes: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> Calibration:
        """From votes above 0 of labelled documents; their weights are taken relative to their mean.

        A logistic curve, itself held near the vote by a prior, is the prior of groups of ``GROUP``
        documents with neighbouring votes; the shares of the groups are made to rise with the vote.
        Of fewer documents than a group there is the logistic curve only.
        """
        some = votes > 0
        if not some.any():
            return cls()
        order = np.argsort(votes[some], kind="stable")
        x = _log_odds(votes[some][order])
        y, w = positive[some][order].astype(float), (weight[some] / weight[some].mean())[order]
        at, spread = _logistic(x, y, w)
        if len(x) < GROUP:  # too few for groups: the logistic curve alone, with its error
            ends = np.stack([np.ones(5), np.linspace(_log_odds(np.array(_EDGE)), _log_odds(np.array(1 - _EDGE)), 5)], 1)
            return cls(ends[:, 1], ends @ at, np.sqrt(np.einsum("ij,jk,ik->i", ends, spread, ends)), few=True)
        cut = np.unique(np.searchsorted(x, x[np.arange(0, len(x), GROUP)]))  # equal votes stay together
        n, hits, mid = (np.add.reduceat(v, cut) for v in (w, w * y, w * x))
        mid = mid / n
        curve = 1 / (1 + np.exp(-np.clip(at[0] + at[1] * mid, -30, 30)))
        share, n = _rising((hits + PRIOR_WEIGHT * curve) / (n + PRIOR_WEIGHT), n + PRIOR_WEIGHT)
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return cls(mid, np.log(share / (1 - share)), 1 / np.sqrt(n * share * (1 - share)), few=False)

    def for_all(self, votes: np.ndarray, positive: np.ndarray, weight: np.ndarray, all_votes: np.ndarray, n: np.ndarray) -> Calibration:
        """The same for all documents, of which ``n`` have each of ``all_votes``: positive ones are more frequent among the labelled.

        The share of positive documents among all is found by expectation maximisation
        (Saerens et al.), which takes the votes of positive and of clean documents to be
        distributed as among the labelled; the labelled share counts as ``PRIOR_DOCUMENTS`` documents.
        """
        if self.few or not len(votes) or not n.sum():  # nothing to tell the shares by
            return self
        share = float(np.average(positive, weights=weight))
        if not 0 < share < 1:
            return self
        none = votes <= 0
        missed = (positive[none].sum() + 0.5 * share) / (none.sum() + 0.5)
        p = np.where(all_votes > 0, self.interval(all_votes)[0], missed)
        odds = lambda x: x / (1 - x)
        now = share
        for _ in range(200):
            ratio = odds(now) / odds(share)
            here = ratio * p / (ratio * p + 1 - p)
            last, now = now, float(np.clip((here @ n + PRIOR_DOCUMENTS * share) / (n.sum() + PRIOR_DOCUMENTS), 1e-6, 1 - 1e-6))
            if abs(now - last) < 1e-9:
                break
        return Calibration(self.votes, self.scores + np.log(odds(now) / odds(share)), self.errors, few=False)

    def interval(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and the ends of their intervals of 95 %."""
        x = _log_odds(votes)
        z, error = np.interp(x, self.votes, self.scores), np.interp(x, self.votes, self.errors)
        return tuple(1 / (1 + np.exp(-np.clip(v, -50, 50))) for v in (z, z - 1.96 * error, z + 1.96 * error))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Constant and slope over the log-odds of the vote, by Newton steps, with a prior around 0 and 1; and their covariance."""
    x = np.stack([np.ones(len(x)), x], 1)
    prior, mean = np.diag(1 / np.square(PRIOR_SPREAD)), np.array([0.0, 1.0])
    at = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -50, 50)))
        slope = x.T @ (w * (y - p)) - prior @ (at - mean)
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + prior
        step = np.clip(np.linalg.solve(curve, slope), -1, 1)
        at = at + step
        if np.abs(step).max() < 1e-8:
            break
    if at[1] < 0:  # a higher vote never means less
        at = np.array([_log_odds(np.array(np.average(y, weights=w))), 0.0])
    return at, np.linalg.inv(curve)


def _rising(share: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours that fall are pooled until none does: shares and the sizes of the pools."""
    pools: list[list[float]] = []
    for s, k in zip(share.tolist(), n.tolist(), strict=True):
        pools.append([s, k, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (s1, k1, m1), (s2, k2, m2) = pools[-2], pools[-1]
            pools[-2:] = [[(s1 * k1 + s2 * k2) / (k1 + k2), k1 + k2, m1 + m2]]
    m = [p[2] for p in pools]
    return np.repeat([p[0] for p in pools], m), np.repeat([p[1] for p in pools], m)


def reliability(votes: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> list[tuple[float, float, int, float, float]]:
    """``low, high, n, mean score, share of positive ones`` by tenths of the score; each half is scored by the calibration of the other."""
    half = np.arange(len(votes)) % 2
    score = np.zeros(len(votes))
    for h in (0, 1):
        other = half != h
        score[half == h] = Calibration.fitted(votes[other], positive[other], weight[other]).interval(votes[half == h])[0]
    score[votes <= 0] = 0
    tenth = np.minimum((score * 10).astype(int), 9)
    out = []
    for t in np.unique(tenth):
        at = tenth == t
        out.append((float(t) / 10, float(t + 1) / 10, int(at.sum()), float(np.average(score[at], weights=weight[at])), float(np.average(positive[at], weights=weight[at]))))
    return out


def copies(passages: list[np.ndarray]) -> np.ndarray:
    """The group of copies of each document, given as sorted numbers of its passages.

    Equal documents are copies, and those that share ``COPY_SHARE`` of the passages
    of the larger one. Candidates are documents that share a passage that is rare among the different ones.
    """
    first: dict[bytes, int] = {}
    group = np.array([first.setdefault(p.tobytes(), i) for i, p in enumerate(passages)], np.int64)
    some = [i for i in first.values() if len(passages[i])]
    if some:
        at = np.repeat(some, [len(passages[i]) for i in some])
        passage = np.concatenate([passages[i] for i in some])
        by = np.argsort(passage, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(passage[by]) > 0])
        pairs = set()
        for a, b in zip(starts, np.r_[starts[1:], len(by)], strict=True):
            if 2 <= b - a <= _RARE:
                docs = at[by[a:b]].tolist()
                pairs.update((x, y) for k, x in enumerate(docs) for y in docs[k + 1 :])
        parent = {i: i for i in some}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for x, y in pairs:
            a, b = passages[x], passages[y]
            if min(len(a), len(b)) >= COPY_SHARE * max(len(a), len(b)) and len(np.intersect1d(a, b, assume_unique=True)) >= COPY_SHARE * max(len(a), len(b)):
                parent[root(x)] = root(y)
        group = np.array([root(g) if g in parent else g for g in group.tolist()], np.int64)
    return group


def fold_of(group: np.ndarray, folds: int) -> np.ndarray:
    """The fold of each document; groups are dealt out in turn, in a mixed order that is always the same."""
    names, at = np.unique(group, return_inverse=True)
    return (np.random.default_rng(0).permutation(len(names)) % folds)[at]
