"""Where topics change: vectorised group boundaries for similarity chunkers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from passagemill.functions.vectors import SCORE_DECIMALS, list_parts, term_matrix

# Units compared at once.
SLICE_UNITS = 1 << 15


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dots = (a * b).sum(axis=1)
    norms = (a * a).sum(axis=1) * (b * b).sum(axis=1)
    return np.round(np.divide(dots, np.sqrt(norms), out=np.zeros_like(dots), where=norms > 0), SCORE_DECIMALS)


def resolve_threshold(threshold: float | str, sims: np.ndarray) -> float:
    """A number up to 1 as it is, above 1 as a percentile of the similarities;
    ``auto``: their mean less one standard deviation."""
    if threshold == "auto":
        return round(float(sims.mean() - sims.std()), SCORE_DECIMALS) if len(sims) else 0.0
    if threshold > 1:
        return round(float(np.percentile(sims, threshold)), SCORE_DECIMALS) if len(sims) else 0.0
    return float(threshold)


def group_starts(
    dim: int, threshold: float | str, window: int, mode: str, skip_window: int
) -> Callable[[pa.Array], pa.Array]:
    """Kernel: joined terms per unit and part -> first unit of each group.

    Works on a whole Arrow batch: all units of all parts form one matrix of
    whole numbers. Sums and similarities are worked out in slices of units, in
    float64, so that they are exact and only that matrix grows with the batch.
    """

    def kernel(parts: pa.Array) -> pa.Array:
        sizes, units = list_parts(parts)
        vectors = term_matrix(units, dim)
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        part_of = np.repeat(np.arange(len(sizes)), sizes)
        index = np.arange(len(vectors))

        # Similarity of each unit to the sum of the units just before it.
        low = np.maximum(firsts[part_of], index - window)
        sims = np.zeros(len(vectors))
        for a in range(0, len(vectors), SLICE_UNITS):
            own = slice(a, min(a + SLICE_UNITS, len(vectors)))
            base = int(low[own].min())
            block = vectors[base : own.stop].astype(np.float64)
            sums = np.vstack([np.zeros((1, dim)), np.cumsum(block, axis=0)])
            sims[own] = _cosine(block[a - base :], sums[index[own] - base] - sums[low[own] - base])
        limits = np.array(
            [resolve_threshold(threshold, sims[f + 1 : e]) for f, e in zip(firsts, ends)], dtype=np.float64
        )
        is_first = np.zeros(len(vectors), dtype=bool)
        is_first[firsts[sizes > 0]] = True
        if mode == "cumulative":
            starts = _cumulative(vectors, is_first, limits[part_of])
        else:
            starts = is_first | (sims < limits[part_of])
        group_first = np.flatnonzero(starts)
        if skip_window > 0 and len(group_first):
            group_first = _merge_across(vectors, group_first, part_of, limits, skip_window)
        owner = part_of[group_first]
        counts = np.bincount(owner, minlength=len(sizes))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((group_first - firsts[owner]).astype(np.int32)))

    return kernel


def _cumulative(vectors: np.ndarray, is_first: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Compare each unit with the sum of its group so far."""
    starts = is_first.copy()
    running = np.zeros(vectors.shape[1])
    for i, vector in enumerate(vectors):
        vector = vector.astype(np.float64)
        if not is_first[i]:
            starts[i] = _cosine(vector[None, :], running[None, :])[0] < limits[i]
        running = vector if starts[i] else running + vector
    return starts


def _merge_across(
    vectors: np.ndarray, group_first: np.ndarray, part_of: np.ndarray, limits: np.ndarray, skip_window: int
) -> np.ndarray:
    """Second pass: a group reaches to the furthest similar one within
    ``skip_window``; overlapping reaches form one group."""
    groups = np.add.reduceat(vectors, group_first, axis=0, dtype=np.float64)
    owner = part_of[group_first]
    index = np.arange(len(groups))
    reach = index.copy()
    for j in range(1, min(skip_window, len(groups) - 1) + 1):
        left = index[: len(groups) - j]
        near = owner[left] == owner[left + j]
        near &= _cosine(groups[left], groups[left + j]) >= limits[owner[left]]
        reach[left[near]] = left[near] + j
    furthest = np.concatenate([[-1], np.maximum.accumulate(reach)[:-1]])
    return group_first[index > furthest]
