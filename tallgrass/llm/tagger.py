"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    """Tags 0..tags-1 for sequences of symbols; arrays are (time, batch, ...)."""

    symbols: int
    tags: int
    hidden: int = 16
    seed: int = 3
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.p:
            rng = np.random.default_rng(self.seed)
            h = self.hidden
            draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
            for d in "fb":
                self.p |= {f"x{d}": draw(self.symbols, 4 * h, s=0.3), f"h{d}": draw(h, 4 * h, s=0.25)}
                self.p[f"x{d}"][:, h : 2 * h] += 1  # forget gates start open
            self.p |= {"o": draw(2 * h, self.tags, s=0.3), "c": np.zeros(self.tags, np.float32), "t": np.zeros((self.tags, self.tags), np.float32)}

    def _run(self, x: np.ndarray, keep: bool):
        """Hidden states (time, batch, 2 * hidden) of both directions, which step side by side; and what a step back needs."""
        h_, steps, n = self.hidden, len(x), x.shape[1]
        both = np.stack([x, x[::-1]], 1)  # the second direction reads from the end
        of_symbol, of_state = (np.stack([self.p[f"{k}f"], self.p[f"{k}b"]]) for k in "xh")
        way = np.arange(2)[:, None]
        h, c = np.zeros((2, n, h_), np.float32), np.zeros((2, n, h_), np.float32)
        out, saved = np.empty((steps, 2, n, h_), np.float32), []
        for t in range(steps):
            z = of_symbol[way, both[t]] + h @ of_state
            gates = _sigmoid(z[..., : 3 * h_])
            i, f, o = gates[..., :h_], gates[..., h_ : 2 * h_], gates[..., 2 * h_ :]
            g = np.tanh(z[..., 3 * h_ :])
            before = c
            c = f * c + i * g
            u = np.tanh(c)
            h = o * u
            out[t] = h
            if keep:
                saved.append((i, f, o, g, u, before))
        return np.concatenate([out[:, 0], out[::-1, 1]], 2), out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, batch, tags) of symbols (time, batch)."""
        return self._run(x, False)[0] @ self.p["o"] + self.p["c"]

    def _crf(self, e: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood and its gradients by emissions and transitions."""
        steps, n, k = e.shape
        e, trans = e.astype(np.float64), self.p["t"].astype(np.float64)
        here, step = np.exp(e - e.max(2, keepdims=True)), np.exp(trans - trans.max())
        forward, backward, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, n))
        for t in range(steps):
            row = (forward[t - 1] @ step) * here[t] if t else here[0]
            scale[t] = row.sum(1)
            forward[t] = row / scale[t][:, None]
        for t in range(steps - 2, -1, -1):
            row = (here[t + 1] * backward[t + 1]) @ step.T
            backward[t] = row / row.sum(1, keepdims=True)
        z = np.log(scale).sum(0) + e.max(2).sum(0) + (steps - 1) * trans.max()
        marginal = forward * backward
        marginal /= marginal.sum(2, keepdims=True)
        left, right = forward[:-1], here[1:] * backward[1:]
        left = left / ((left @ step) * right).sum(2, keepdims=True)
        pair = step * (left.reshape(-1, k).T @ right.reshape(-1, k))
        rows = np.arange(n)
        score = e[np.arange(steps)[:, None], rows, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
        np.add.at(pair, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        marginal[np.arange(steps)[:, None], rows, y] -= 1
        return float((z - score).mean()), (marginal / n).astype(np.float32), (pair / n).astype(np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h_, steps, n = self.hidden, *x.shape
        both, out, saved = self._run(x, True)
        loss, de, dt = self._crf(both @ self.p["o"] + self.p["c"], y)
        grad = {"t": dt, "c": de.sum((0, 1)), "o": both.reshape(-1, 2 * h_).T @ de.reshape(-1, self.tags)}
        dboth = de @ self.p["o"].T
        part = np.stack([dboth[:, :, :h_], dboth[::-1, :, h_:]], 1)
        back = np.stack([self.p["hf"].T, self.p["hb"].T])
        all_dz = np.empty((steps, 2, n, 4 * h_), part.dtype)
        dh = np.zeros(part.shape[1:], np.float32)
        dc = np.zeros_like(dh)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, u, c_before = saved[t]
            dh = dh + part[t]
            dc = dc + dh * o * (1 - u * u)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * u * o * (1 - o), dc * i * (1 - g * g)], 2)
            all_dz[t] = dz
            dh, dc = dz @ back, dc * f
        once = np.eye(self.symbols, dtype=np.float32)
        for d, way in enumerate("fb"):
            dz = all_dz[:, d].reshape(-1, 4 * h_)
            grad[f"x{way}"] = once[(x if d == 0 else x[::-1]).ravel()].T @ dz
            grad[f"h{way}"] = out[:-1, d].reshape(-1, h_).T @ dz[n:]  # the first step's state before is zero
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.03) -> list[float]:
        """About ``steps`` Adam steps over shuffled batches of (batch, time) arrays; the mean loss of each epoch."""
        epochs = -(-steps // -(-len(x) // batch))
        rng = np.random.default_rng(self.seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, history = 0, []
        for epoch in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                loss, grad = self.gradients(x[at].T, y[at].T)
                losses.append(loss)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                clip = min(1.0, 5.0 / (size + 1e-9))
                pace = rate * (1 - 0.9 * epoch / max(1, epochs))
                for name, g in grad.items():
                    g = g * clip
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] = (self.p[name] - pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            history.append(float(np.mean(losses)))
        return history

    def viterbi(self, e: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Best tags of one sequence of emissions under the transitions that are allowed."""
        trans = np.where(allowed, self.p["t"], -1e9)
        best, back = e[0] + np.where(allowed[0], 0, -1e9), np.zeros(e.shape, np.int64)
        for t in range(1, len(e)):
            step = best[:, None] + trans
            back[t] = step.argmax(0)
            best = step.max(0) + e[t]
        out = np.empty(len(e), np.int64)
        out[-1] = int(best.argmax())
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def marginals(self, e: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Probability of each tag at each place of one sequence under the transitions that are allowed."""
        trans = np.where(allowed, self.p["t"], -1e9).astype(np.float64)
        step = np.exp(trans - trans.max())
        forward, backward = np.empty(e.shape), np.empty(e.shape)
        here = np.exp((e - e.max(1, keepdims=True)).astype(np.float64))
        forward[0] = here[0] * allowed[0]
        for t in range(1, len(e)):
            row = (forward[t - 1] @ step) * here[t]
            forward[t] = row / row.sum()
        backward[-1] = 1
        for t in range(len(e) - 2, -1, -1):
            row = step @ (here[t + 1] * backward[t + 1])
            backward[t] = row / row.sum()
        both = forward * backward
        return both / both.sum(1, keepdims=True)
