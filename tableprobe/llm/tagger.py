"""A small character tagger in NumPy: bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import numpy as np

PAD, OTHER, LETTERS = 128, 129, 130


def codes(text: str) -> np.ndarray:
    """ASCII characters as they are, all others as one code."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, OTHER).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embeds characters, reads them in both directions, and scores tags and their transitions."""

    def __init__(self, tags: int, hidden: int = 20, embed: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.hidden = hidden
        self.p = {"E": draw(LETTERS, embed) * 3, "U": draw(2 * hidden, tags), "c": np.zeros(tags), "A": np.zeros((tags, tags))}
        for d in "fb":
            self.p |= {f"W{d}": draw(embed, 4 * hidden), f"R{d}": draw(hidden, 4 * hidden), f"v{d}": np.zeros(4 * hidden)}
            self.p[f"v{d}"][hidden : 2 * hidden] = 1  # remember at first

    def _read(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, row, hidden) of one direction, and what the way back needs."""
        p, h = self.p, self.hidden
        inputs = p["E"][x] @ p[f"W{d}"] + p[f"v{d}"]
        state = cell = np.zeros((x.shape[1], h))
        out, trace = np.zeros((*x.shape, h)), []
        for t in range(len(x)):
            gates = inputs[t] + state @ p[f"R{d}"]
            i, f, o = (_sigmoid(gates[:, k * h : (k + 1) * h]) for k in range(3))
            g = np.tanh(gates[:, 3 * h :])
            before, last = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            trace.append((i, f, o, g, before, squashed, last))
        return out, trace

    def _unread(self, x: np.ndarray, d: str, trace: list, grad: np.ndarray, into: dict) -> None:
        p, h = self.p, self.hidden
        embedded = p["E"][x]
        d_state, d_cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        for t in reversed(range(len(x))):
            i, f, o, g, before, squashed, last = trace[t]
            d_out = grad[t] + d_state
            d_cell = d_cell + d_out * o * (1 - squashed**2)
            parts = (d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_out * squashed * o * (1 - o), d_cell * i * (1 - g**2))
            d_gates = np.concatenate(parts, axis=1)
            into[f"R{d}"] += last.T @ d_gates
            into[f"W{d}"] += embedded[t].T @ d_gates
            into[f"v{d}"] += d_gates.sum(axis=0)
            np.add.at(into["E"], x[t], d_gates @ p[f"W{d}"].T)
            d_state, d_cell = d_gates @ p[f"R{d}"].T, d_cell * f

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Tag scores (time, row, tag); ``x`` is (time, row)."""
        ahead, one = self._read(x, "f")
        back, two = self._read(x[::-1], "b")
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ self.p["U"] + self.p["c"], both, (one, two)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags ``y`` and its gradient."""
        p, (steps, rows) = self.p, x.shape
        score, both, traces = self.scores(x)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[0] = score[0]
        for t in range(1, steps):
            alpha[t] = score[t] + _logsum(alpha[t - 1][:, :, None] + p["A"], 1)
        for t in reversed(range(steps - 1)):
            beta[t] = _logsum(p["A"] + (score[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        row = np.arange(rows)
        path = sum(score[t, row, y[t]] for t in range(steps)) + sum(p["A"][y[t - 1], y[t]] for t in range(1, steps))
        d_score = np.exp(alpha + beta - total[:, None])
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        for t in range(steps):
            d_score[t, row, y[t]] -= 1
            if t:
                pair = alpha[t - 1][:, :, None] + p["A"] + (score[t] + beta[t])[:, None, :] - total[:, None, None]
                grads["A"] += np.exp(pair).sum(axis=0)
                np.add.at(grads["A"], (y[t - 1], y[t]), -1)
        grads["U"] = np.einsum("tbh,tbk->hk", both, d_score)
        grads["c"] = d_score.sum(axis=(0, 1))
        d_both = d_score @ p["U"].T
        self._unread(x, "f", traces[0], d_both[:, :, : self.hidden], grads)
        self._unread(x[::-1], "b", traces[1], d_both[::-1, :, self.hidden :], grads)
        return float((total - path).mean()), {k: g / rows for k, g in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 0) -> float:
        """Adam over rows of characters and tags (row, time); the loss of the last epoch."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, last = 0, 0.0
        for epoch in range(epochs):
            losses = []
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                value, grads = self.loss(x[rows].T, y[rows].T)
                losses.append(value)
                step += 1
                size = np.sqrt(sum((g**2).sum() for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (size + 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g**2
                    lower = rate * (1 - epoch / epochs) * mean[k] / (1 - 0.9**step)
                    self.p[k] = self.p[k] - lower / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            last = float(np.mean(losses))
        return last

    def tag(self, x: np.ndarray) -> np.ndarray:
        """Best tags (row, time) of rows of characters, by Viterbi."""
        score, _, _ = self.scores(x.T)
        steps, rows, tags = score.shape
        best, back = score[0], np.zeros((steps, rows, tags), np.int64)
        for t in range(1, steps):
            ways = best[:, :, None] + self.p["A"]
            back[t] = ways.argmax(axis=1)
            best = score[t] + ways.max(axis=1)
        out = np.zeros((steps, rows), np.int64)
        out[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, np.arange(rows), out[t]]
        return out.T
