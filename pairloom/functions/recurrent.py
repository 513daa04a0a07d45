"""A recurrent cell with long short-term memory: forecasts and gradients of a batch of sequences.

Parameters are one flat vector, so a gradient is a vector of the same fixed size and gradients of
parts of the data add up.
"""

from __future__ import annotations

import numpy as np


class Cell:
    """``inputs`` numbers a step, ``hidden`` memory cells, a linear read-out of the last step."""

    def __init__(self, inputs: int, hidden: int):
        self.inputs, self.hidden = inputs, hidden
        self.shapes = ((inputs + hidden, 4 * hidden), (4 * hidden,), (hidden,), (1,))
        self.size = sum(int(np.prod(s)) for s in self.shapes)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [flat[e - int(np.prod(s)):e].reshape(s) for e, s in zip(ends, self.shapes)]

    def initial(self, seed: int) -> np.ndarray:
        flat = np.zeros(self.size)
        weights, bias, out, _ = self.parts(flat)
        draw = np.random.default_rng(seed)
        weights[:] = draw.normal(0, 1 / np.sqrt(len(weights)), weights.shape)
        bias[self.hidden:2 * self.hidden] = 1.0  # remember at first
        out[:] = draw.normal(0, 1 / np.sqrt(self.hidden), self.hidden)
        return flat

    def _forward(self, flat: np.ndarray, x: np.ndarray):
        """Values of every step for sequences x (rows x steps x inputs), and the forecasts."""
        weights, bias, out, level = self.parts(flat)
        n, h = len(x), self.hidden
        state, memory, steps = np.zeros((n, h)), np.zeros((n, h)), []
        for t in range(x.shape[1]):
            before = np.concatenate([x[:, t], state], axis=1)
            z = before @ weights + bias
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * h], -40, 40)))
            take, keep, show = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            new = np.tanh(z[:, 3 * h:])
            old, memory = memory, keep * memory + take * new
            seen = np.tanh(memory)
            state = show * seen
            steps.append((before, take, keep, show, new, old, seen))
        return steps, state, state @ out + level[0]

    def predict(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._forward(flat, x)[2]

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of squared errors and its gradient, by back-propagation through all steps."""
        steps, state, made = self._forward(flat, x)
        weights, _, out, _ = self.parts(flat)
        total = np.zeros(self.size)
        d_weights, d_bias, d_out, d_level = self.parts(total)
        error = 2 * (made - y)
        d_out += error @ state
        d_level += error.sum()
        d_state, d_memory = error[:, None] * out, np.zeros_like(state)
        for before, take, keep, show, new, old, seen in reversed(steps):
            d_memory = d_memory + d_state * show * (1 - seen * seen)
            d_z = np.concatenate([
                d_memory * new * take * (1 - take), d_memory * old * keep * (1 - keep),
                d_state * seen * show * (1 - show), d_memory * take * (1 - new * new)], axis=1)
            d_weights += before.T @ d_z
            d_bias += d_z.sum(axis=0)
            d_state = d_z @ weights[self.inputs:].T
            d_memory = d_memory * keep
        return float(((made - y) ** 2).sum()), total


class Adam:
    """Step sizes from running first and second moments of the gradient."""

    def __init__(self, size: int, rate: float):
        self.rate, self.first, self.second, self.steps = rate, np.zeros(size), np.zeros(size), 0

    def step(self, flat: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * slope
        self.second = 0.999 * self.second + 0.001 * slope ** 2
        first = self.first / (1 - 0.9 ** self.steps)
        second = self.second / (1 - 0.999 ** self.steps)
        return flat - self.rate * first / (np.sqrt(second) + 1e-8)
