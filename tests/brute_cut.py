"""The dynamic cut of one distance run by the textbook: one merge at a time over a full matrix."""

import numpy as np

from ldmill.operators.prune import _corr, clean_score, merge_pair


def average_linkage(similarity: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges (left node, right node, distance) of average linkage on 1 - similarity, lowest first; leaves 0..n-1, the k-th merge makes node n + k.
    Equal distances are taken in the order of the smaller, then the larger cluster's first leaf."""
    n = len(similarity)
    d = 1 - np.asarray(similarity, dtype=float)
    np.fill_diagonal(d, np.inf)
    node, size = np.arange(n), np.ones(n)
    out = []
    for k in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)  # row-major: the first of equals
        out.append((int(node[i]), int(node[j]), float(d[i, j])))
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        node[i] = n + k
    return out


def pairwise_r2(x: np.ndarray) -> np.ndarray:
    """Squared correlation of the columns over the rows both have; 0 where undefined."""
    m = np.isfinite(x).astype(float)
    v = np.where(m > 0, x, 0.0)
    v = v - v.sum(axis=0) / np.maximum(m.sum(axis=0), 1) * m
    n, s, q, sq = m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v
    top, bottom = n * sq - s * s.T, (n * q - s * s) * (n * q.T - s.T * s.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(bottom > 1e-18, top * top / bottom, 0.0)
    return np.minimum(r2, 1.0)


def dynamic_cut(values: np.ndarray, n_loci: np.ndarray, threshold: float, min_r2: float = 0.2) -> list[tuple[list[int], np.ndarray, float]]:
    """Groups of the columns of ``values`` (individuals x clusters), each with its consensus and score.

    The average-linkage tree on 1 - r2 is walked from the leaves: a merge is taken if the two sides' r2 is at least ``min_r2`` and the merged consensus scores at least
    ``threshold``; a refused merge closes both sides, and everything above a closed side stays closed. Every column ends in one group; one column is its own group.
    """
    n = values.shape[1]
    if len(n_loci) != n:
        raise ValueError("every cluster needs its number of loci")
    state: dict[int, tuple[list[int], np.ndarray, float] | None] = {i: ([i], values[:, i], float(n_loci[i])) for i in range(n)}
    done = []
    close = lambda s: done.append((s[0], s[1], clean_score(s[1])))
    for k, (i, j, _) in enumerate(average_linkage(pairwise_r2(values))):
        left, right = state.pop(i), state.pop(j)
        state[n + k] = None
        if left is None or right is None:
            for s in (left, right):
                if s is not None:
                    close(s)
            continue
        r2 = _corr(left[1], right[1]) ** 2
        merged = merge_pair(left[1], right[1], left[2], right[2])
        if r2 >= min_r2 and clean_score(merged) >= threshold:
            state[n + k] = (left[0] + right[0], merged, left[2] + right[2])
        else:
            close(left)
            close(right)
    for s in state.values():
        if s is not None:
            close(s)
    return done
