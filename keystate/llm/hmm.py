"""The numerical part of the hidden Markov language model: forward and backward recursions.

Sequences of a batch go through the recursions in step, sorted from long to short, so
that a step is a few numpy operations over all sequences that still run. All values
are scaled at every token, so the likelihood is exact at any length.
"""

from __future__ import annotations

import numpy as np


class Parameters:
    """start (K), move (K x K) and emit (classes x K) probabilities of K hidden states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def _in_step(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First positions from the longest sequence on, their order, and how many run at each step."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    return offsets[:-1][order], order, np.searchsorted(-lengths[order], -np.arange(longest), "left")


def log_likelihoods(ids: np.ndarray, offsets: np.ndarray, p: Parameters) -> np.ndarray:
    """Natural logarithm of each sequence's probability. Sequence i is ids[offsets[i]:offsets[i + 1]]."""
    firsts, order, running = _in_step(offsets)
    total = np.zeros(len(order))
    alpha = None
    for t, n in enumerate(running.tolist()):
        e = p.emit[ids[firsts[:n] + t]]
        alpha = (p.start if alpha is None else alpha[:n] @ p.move) * e
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(order))
    out[order] = total
    return out


def expected_counts(ids: np.ndarray, offsets: np.ndarray, p: Parameters, own: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts: of starts (K), of moves (K x K), of emissions (classes x K); and the log likelihood.

    own: for parts of longer texts, where each sequence's own tokens begin and end; those
    around them only lead in and out. A move counts where it arrives at an own token, a
    start where a sequence's own tokens begin at its first.
    """
    firsts, order, running = _in_step(offsets)
    k = len(p.start)
    lo, hi = (x[order] for x in own) if own else (np.zeros(len(order), np.int64), np.diff(offsets)[order])
    # all tokens step by step: what does not depend on the step before is done for all at once
    ends = np.cumsum(running)
    since = ends - running
    step = np.repeat(np.arange(len(running)), running)
    row = np.arange(len(step)) - since[step]
    code = ids[firsts[row] + step]
    counted = ((step >= lo[row]) & (step < hi[row])).astype(p.emit.dtype)
    cuts = [slice(a, b) for a, b in zip(since.tolist(), ends.tolist(), strict=True)]
    ones = np.ones(k, p.emit.dtype)

    e = p.emit[code]
    alphas, scales = np.empty_like(e), np.empty(len(e), e.dtype)
    for t, now in enumerate(cuts):
        alpha = alphas[now]
        if t:
            np.dot(alphas[cuts[t - 1]][: len(alpha)], p.move, out=alpha)
            alpha *= e[now]
        else:
            np.multiply(e[now], p.start, out=alpha)
        scale = np.dot(alpha, ones, out=scales[now])
        alpha /= scale[:, None]
    log_p = float(np.log(scales) @ counted)

    e /= scales[:, None]
    betas, back = np.ones_like(e), np.ascontiguousarray(p.move.T)
    moves = np.zeros((k, k))
    for t in range(len(cuts) - 1, 0, -1):
        ahead = e[cuts[t]]
        ahead *= betas[cuts[t]]
        before = slice(cuts[t - 1].start, cuts[t - 1].start + len(ahead))
        np.dot(ahead, back, out=betas[before])
        ahead *= counted[cuts[t], None]
        moves += alphas[before].T @ ahead
    betas *= alphas
    betas *= counted[:, None]  # the occupancy, which is all that is left to need
    emissions = np.stack([np.bincount(code, betas[:, j], len(p.emit)) for j in range(k)], axis=1)
    return betas[cuts[0]].sum(0, dtype=np.float64), moves * p.move, emissions, log_p


def maximised(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, shares: np.ndarray, weight: float) -> Parameters:
    """New parameters from counts. Each state's emissions are eked out with ``weight``
    emissions in the classes' overall shares, so none is ever zero."""
    start = (starts + 0.1) / (starts + 0.1).sum()
    move = (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True)
    emit = emissions + weight * shares[:, None]
    return Parameters(start, move, emit / emit.sum(0))


def seeded(shares: np.ndarray, states: int, seed: int = 1) -> Parameters:
    """Where training starts: states that last, with emissions moved at random from the overall shares."""
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * rng.gamma(2.0, 0.5, (len(shares), states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    return Parameters(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))
