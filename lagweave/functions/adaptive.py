"""Predictors that learn sample by sample: weighted least squares, normalised LMS and a mix of experts, in floating point rounded to integers.

A decoder that sees the same samples makes the same predictions; all state starts fresh in a segment.
"""

from __future__ import annotations

import numpy as np


class LeastSquares:
    """Exponentially weighted least squares over the last ``taps`` values (of several channels, one after another); weights are solved every ``every`` samples."""

    def __init__(self, taps: int, memory: float = 0.998, every: int = 8, ridge: float = 1e-3):
        self.cov, self.cross, self.weights = np.zeros((taps, taps)), np.zeros(taps), np.zeros(taps)
        self.memory, self.every, self.ridge, self.seen = memory, every, ridge, 0

    def predict(self, history: np.ndarray) -> float:
        return float(self.weights @ history)

    def learn(self, history: np.ndarray, value: float, error: float) -> None:
        """Large errors weigh less, as iteratively reweighted least squares has it."""
        w = 1 / (1 + abs(error)) ** 0.5
        self.cov = self.memory * self.cov + w * np.outer(history, history)
        self.cross = self.memory * self.cross + w * value * history
        self.seen += 1
        if self.seen % self.every == 0:
            damp = self.ridge * (np.trace(self.cov) / len(self.cross) + 1)
            self.weights = np.linalg.solve(self.cov + damp * np.eye(len(self.cross)), self.cross)


class NormalisedLms:
    """Least mean squares with the step divided by the history's energy."""

    def __init__(self, taps: int, rate: float = 0.005):
        self.weights, self.rate = np.zeros(taps), rate

    def predict(self, history: np.ndarray) -> float:
        return float(self.weights @ history)

    def learn(self, history: np.ndarray, error: float) -> None:
        self.weights += self.rate * error / (1 + history @ history / len(history)) ** 0.5 * np.sign(history) / len(history) ** 0.5


class Cascade:
    """A least-squares stage, LMS stages on what it leaves, and a mix of the running sums by their inverse squared errors."""

    def __init__(self, taps: int = 16, lms: tuple[int, ...] = (32, 16)):
        self.ols, self.lms = LeastSquares(taps), [NormalisedLms(n) for n in lms]
        self.past, self.left = np.zeros(taps), [np.zeros(n) for n in lms]
        self.power = np.ones(1 + len(lms))
        self.parts = np.zeros(1 + len(lms))

    def predict(self) -> int:
        self.parts[0] = self.ols.predict(self.past)
        for k, (stage, history) in enumerate(zip(self.lms, self.left, strict=True), 1):
            self.parts[k] = stage.predict(history)
        sums = np.cumsum(self.parts)
        share = 1 / self.power
        self.sums = sums
        return int(np.floor(sums @ share / share.sum() + 0.5))

    def update(self, value: int) -> None:
        self.power = 0.97 * self.power + 0.03 * (value - self.sums) ** 2 + 1e-6
        rest = value - self.parts[0]
        self.ols.learn(self.past, value, rest)
        for k, stage in enumerate(self.lms):
            history = self.left[k]
            stage.learn(history, rest - self.parts[k + 1])
            history[1:] = history[:-1].copy()
            history[0] = rest
            rest -= self.parts[k + 1]
        self.past[1:] = self.past[:-1].copy()
        self.past[0] = value


def residual(x: np.ndarray) -> np.ndarray:
    """What the cascade leaves of a segment."""
    c, out = Cascade(), np.empty(len(x), np.int64)
    for i, v in enumerate(x.tolist()):
        out[i] = v - c.predict()
        c.update(v)
    return out


def restore(r: np.ndarray) -> np.ndarray:
    c, out = Cascade(), np.empty(len(r), np.int64)
    for i, e in enumerate(r.tolist()):
        out[i] = e + c.predict()
        c.update(int(out[i]))
    return out
