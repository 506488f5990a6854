"""A label model over the votes of noisy labelling functions.

Two latent classes, votes independent given the class. Rows with the same votes
are one pattern, so after one aggregation expectation-maximization runs over at
most 2**functions patterns, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    prior: float
    hit: np.ndarray  # chance of a vote from each function where the defect is there
    false: np.ndarray  # and where it isn't

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        a = np.log(self.prior) + votes @ np.log(self.hit) + (1 - votes) @ np.log1p(-self.hit)
        b = np.log1p(-self.prior) + votes @ np.log(self.false) + (1 - votes) @ np.log1p(-self.false)
        return 1 / (1 + np.exp(np.clip(b - a, -700, 700)))


def fit(votes: np.ndarray, counts: np.ndarray, start_hit: Sequence[float], start_false: Sequence[float], prior: float = 0.02, strength: float = 50.0, rounds: int = 40) -> Model:
    """Estimate a Model by EM from patterns (rows of 0 and 1) and their counts.

    The starting accuracies also serve as Beta priors of the given strength,
    which keeps the classes from changing places where few rows have the defect.
    """
    hit0, false0 = np.asarray(start_hit, float), np.asarray(start_false, float)
    m = Model(prior, hit0.copy(), false0.copy())
    n = counts.sum()
    if n == 0:
        return m
    for _ in range(rounds):
        p = m.posterior(votes) * counts
        q = counts - p
        m = Model(
            float(np.clip((p.sum() + prior * strength) / (n + strength), 1e-6, 0.5)),
            np.clip((p @ votes + hit0 * strength) / (p.sum() + strength), 1e-4, 1 - 1e-4),
            np.clip((q @ votes + false0 * strength) / (q.sum() + strength), 1e-6, 1 - 1e-4),
        )
    return m
