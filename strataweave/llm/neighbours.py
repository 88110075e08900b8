"""Exact nearest neighbours by TF-IDF cosine on a block-max inverted index.

Examples are sorted so that similar ones share a block. For each term the index
holds the blocks it occurs in with the highest weight it has there, and the
postings of each block. A search adds up these block maxima: a block whose bound
stays below the floor, or below the k-th best cosine found so far, cannot hold a
result and is never opened. What is opened is scored exactly. Queries are
searched in batches of numpy arrays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK_EXAMPLES = 64
_CELLS = 1_000_000


class Vectors(NamedTuple):
    """Sparse rows: ``term`` and ``weight`` from ``start[i]`` to ``start[i + 1]``; no term twice in a row."""

    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def pick(self, rows: np.ndarray) -> Vectors:
        n = np.diff(self.start)[rows]
        at = ranges(self.start[rows], n)
        return Vectors(np.r_[0, np.cumsum(n)], self.term[at], self.weight[at])


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` with ``n[i]`` numbers each, end to end."""
    if not len(n):
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1]) + np.repeat(first - ends + n, n)


def tf_idf(start: np.ndarray, term: np.ndarray, idf: np.ndarray) -> Vectors:
    """Unit vectors of rows of term numbers; terms from ``len(idf) - 1`` on count as unknown and only lengthen the vector."""
    unknown = len(idf) - 1
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    cells, tf = np.unique(row * np.int64(unknown + 1) + np.minimum(term, unknown), return_counts=True)
    row, term = np.divmod(cells, unknown + 1)
    weight = (1 + np.log(tf)) * idf[term]
    weight[term == unknown] = np.sqrt(tf[term == unknown]) * idf[unknown]  # different unknown words
    length = np.sqrt(np.bincount(row, weight**2, len(start) - 1))
    weight = weight / length[row]
    known = term < unknown
    row, term, weight = row[known], term[known], weight[known]
    return Vectors(np.searchsorted(row, np.arange(len(start))), term, weight)


class Matches(NamedTuple):
    """Results sorted by query, then by falling cosine."""

    query: np.ndarray
    example: np.ndarray
    cosine: np.ndarray


class BlockMaxIndex:
    def __init__(self, examples: Vectors, n_terms: int) -> None:
        n = len(examples.start) - 1
        heaviest = np.full(n, -1, np.int64)
        if len(examples.term):
            row = examples.row_of()
            by = np.lexsort((examples.weight, row))
            last = np.r_[row[by][1:] != row[by][:-1], True]
            heaviest[row[by][last]] = examples.term[by][last]
        self.order = np.argsort(heaviest, kind="stable")  # place in the index -> number of the example
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        at = place[examples.row_of()]
        by = np.lexsort((at, examples.term))
        term, at = examples.term[by], at[by]
        self.at, self.weight = at, examples.weight[by]
        self.n, self.n_blocks = n, -(-n // BLOCK_EXAMPLES)
        block = at // BLOCK_EXAMPLES
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.entry_block, self.entry_start = block[new], np.r_[new, len(term)]
        self.entry_max = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.term_start = np.searchsorted(term[new], np.arange(n_terms + 1))
        self.term_max = np.zeros(n_terms)
        if len(new):
            np.maximum.at(self.term_max, term[new], self.entry_max)

    def search(self, queries: Vectors, k: int, floor: float) -> Matches:
        """For each query the up to ``k`` examples with the highest cosine of at least ``floor``; ties by example number."""
        n = len(queries.start) - 1
        if not self.n or not n:
            return Matches(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        row = queries.row_of()
        bound = np.bincount(row, queries.weight * self.term_max[queries.term], n)
        live = np.flatnonzero(bound >= floor - 1e-9)
        entries = np.bincount(row, self.term_start[queries.term + 1] - self.term_start[queries.term], n)[live] + self.n_blocks
        part = np.cumsum(entries) // _CELLS  # queries whose work fits into memory together
        found = [self._search(queries, rows, k, floor) for rows in np.split(live, np.flatnonzero(np.diff(part)) + 1) if len(rows)]
        return Matches(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else Matches(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _search(self, queries: Vectors, rows: np.ndarray, k: int, floor: float) -> Matches:
        q = queries.pick(rows)
        n, nb = len(rows), self.n_blocks
        of = q.row_of()
        first, count = self.term_start[q.term], self.term_start[q.term + 1] - self.term_start[q.term]
        entry = ranges(first, count)
        pair = np.repeat(of, count) * nb + self.entry_block[entry]
        weight = np.repeat(q.weight, count)
        bound = np.bincount(pair, weight * self.entry_max[entry], n * nb)
        kth = np.full(n, floor)
        todo = bound >= floor - 1e-9
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        grid = bound.reshape(n, nb)
        # The most promising blocks first; they raise the bar for the others.
        most = min(nb, max(1, -(-k // BLOCK_EXAMPLES) + 1))
        top = np.zeros((n, nb), bool)
        np.put_along_axis(top, np.argpartition(-grid, most - 1, axis=1)[:, :most], True, axis=1)
        for chosen in (top.ravel() & todo, ~top.ravel() & todo):
            chosen = chosen & (grid >= kth[:, None] - 1e-9).ravel()
            if not chosen.any():
                continue
            hits.append(self._open(chosen, pair, entry, weight, nb, floor))
            if len(hits) == 1:
                kth = np.maximum(kth, _kth_best(hits[0][0], hits[0][2], n, k))
        if not hits:
            return Matches(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        query, example, cosine = (np.concatenate(x) for x in zip(*hits, strict=True))
        by = np.lexsort((example, -cosine, query))
        query, example, cosine = query[by], example[by], cosine[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return Matches(rows[query[rank < k]], example[rank < k], cosine[rank < k])

    def _open(self, chosen, pair, entry, weight, nb, floor):
        """Exact cosines within the chosen (query, block) pairs."""
        number = np.cumsum(chosen) - 1
        use = chosen[pair]
        e, pid, w = entry[use], number[pair[use]], weight[use]
        n = self.entry_start[e + 1] - self.entry_start[e]
        post = ranges(self.entry_start[e], n)
        slot = np.repeat(pid, n) * BLOCK_EXAMPLES + self.at[post] % BLOCK_EXAMPLES
        score = np.bincount(slot, np.repeat(w, n) * self.weight[post], int(chosen.sum()) * BLOCK_EXAMPLES)
        good = np.flatnonzero(score >= floor - 1e-9)
        where = np.flatnonzero(chosen)[good // BLOCK_EXAMPLES]
        return where // nb, self.order[(where % nb) * BLOCK_EXAMPLES + good % BLOCK_EXAMPLES], score[good]


def _kth_best(query: np.ndarray, cosine: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``k``-th highest cosine of each query, or 0 where there are fewer."""
    by = np.lexsort((-cosine, query))
    q, c = query[by], cosine[by]
    at = np.searchsorted(q, np.arange(n)) + k - 1
    out = np.zeros(n)
    ok = (at < len(q)) & (at >= 0)
    ok[ok] = q[at[ok]] == np.flatnonzero(ok)
    out[ok] = c[at[ok]]
    return out
