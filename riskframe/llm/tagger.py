"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa


class Tagger:
    """Sequences of character classes (n, length) to labels. Parameters are float32 arrays by name."""

    def __init__(self, classes: int, labels: int, hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.labels, self.hidden = classes, labels, hidden
        draw = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
        self.p = {"E": np.zeros((labels, labels), np.float32), "O": draw(2 * hidden, labels), "c": np.zeros(labels, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(classes, 4 * hidden), f"U{d}": draw(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1

    # gates in the order input, forget, output, candidate; both directions take a step together
    def _run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(length, 2, n, hidden): states from the left, and from the right in reversed order."""
        n, length = x.shape
        k, u = self.hidden, np.stack((self.p["Uf"], self.p["Ub"]))
        into = np.stack([(self.p[f"W{d}"] + self.p[f"b{d}"])[x.T[::step]] for d, step in (("f", 1), ("b", -1))], 1)
        h, c = np.zeros((2, n, k), into.dtype), np.zeros((2, n, k), into.dtype)
        out = np.empty((length, 2, n, k), into.dtype)
        for t in range(length):
            z = into[t]
            z += h @ u
            z[..., : 3 * k] *= 0.5
            np.tanh(z, out=z)
            g, a = z[..., : 3 * k], z[..., 3 * k :]
            g *= 0.5
            g += 0.5
            before, h_before = c, h
            c = g[..., k : 2 * k] * c + g[..., :k] * a
            s = np.tanh(c)
            h = np.multiply(g[..., 2 * k :], s, out=out[t])
            if keep is not None:
                keep.append((t, g, a, before, s, h_before))
        return out

    def _states(self, out: np.ndarray) -> np.ndarray:
        return np.concatenate((out[:, 0], out[::-1, 1]), 2)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(length, n, labels)"""
        return self._states(self._run(x)) @ self.p["O"] + self.p["c"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi labels (n, length)."""
        e, move = self.emissions(x), self.p["E"]
        length, n, _ = e.shape
        score, back = e[0], np.empty(e.shape, np.int8)
        for t in range(1, length):
            through = score[:, :, None] + move
            back[t] = through.argmax(1)
            score = through.max(1) + e[t]
        out = np.empty((n, length), np.int8)
        out[:, -1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out

    def _loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood a sequence, and its gradients."""
        n, length = x.shape
        kept: list[tuple] = []
        states = self._states(self._run(x, kept))
        e, move = states @ self.p["O"] + self.p["c"], self.p["E"]
        # forward and backward in probabilities, scaled at each step
        top, through = e.max(2, keepdims=True), np.exp(move - move.max())
        seen, scale = np.exp(e - top), np.empty((length, n, 1), e.dtype)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for t in range(length):
            alpha[t] = seen[t] if t == 0 else (alpha[t - 1] @ through) * seen[t]
            scale[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= scale[t]
        for t in range(length - 2, -1, -1):
            beta[t] = (seen[t + 1] * beta[t + 1] / scale[t + 1]) @ through.T
        log_z = np.log(scale).sum() + top.sum() + n * (length - 1) * move.max()
        rows, steps = np.arange(n), np.arange(length)
        gold = e[steps[:, None], rows, y.T].sum() + move[y[:, :-1], y[:, 1:]].sum()
        d_e = alpha * beta
        flat = lambda v: v.reshape(-1, v.shape[-1])
        pair = through * (flat(alpha[:-1]).T @ flat(seen[1:] * beta[1:] / scale[1:]))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d_e[steps[:, None], rows, y.T] -= 1
        grads = {"E": pair, "O": flat(states).T @ flat(d_e), "c": d_e.sum((0, 1))}
        d_h = d_e @ self.p["O"].T
        k, back = self.hidden, np.stack((self.p["Uf"].T, self.p["Ub"].T))
        own = np.stack((d_h[:, :, :k], d_h[::-1, :, k:]), 1)
        d_z, h_last = np.empty((length, 2, n, 4 * k), e.dtype), np.empty((length, 2, n, k), e.dtype)
        into_h, into_c = np.zeros((2, n, k), e.dtype), np.zeros((2, n, k), e.dtype)
        for t, g, a, before, s, h_before in reversed(kept):
            dh = own[t] + into_h
            dc = into_c + dh * g[..., 2 * k :] * (1 - s * s)
            z = d_z[t]
            z[..., :k], z[..., k : 2 * k], z[..., 2 * k : 3 * k] = dc * a, dc * before, dh * s
            z[..., : 3 * k] *= g * (1 - g)
            z[..., 3 * k :] = dc * g[..., :k] * (1 - a * a)
            h_last[t] = h_before
            into_h, into_c = z @ back, dc * g[..., k : 2 * k]
        for side, (d, step) in enumerate((("f", 1), ("b", -1))):
            # rows of the input table are summed class by class
            read, gate = x.T[::step].ravel(), flat(np.ascontiguousarray(d_z[:, side]))
            order = np.argsort(read, kind="stable")
            used, first = np.unique(read[order], return_index=True)
            w = np.zeros_like(self.p[f"W{d}"])
            w[used] = np.add.reduceat(gate[order], first, 0)
            grads |= {f"W{d}": w, f"U{d}": flat(h_last[:, side]).T @ gate, f"b{d}": gate.sum(0)}
        return float(log_z - gold) / n, {name: v / n for name, v in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.03, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        rng, state, losses = np.random.default_rng(seed), Moments(), []
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            losses.append(self.epoch(x[order], y[order], state, batch, rate * (1 - epoch / epochs) + 0.002))
        return losses

    def epoch(self, x: np.ndarray, y: np.ndarray, state: Moments, batch: int, rate: float) -> float:
        """One pass over the rows in their order; changes the parameters and ``state``, returns the mean loss."""
        total = []
        for k in range(0, len(x), batch):
            loss, grads = self._loss(x[k : k + batch], y[k : k + batch])
            total.append(loss)
            state.step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = (g * min(1, 20 / (norm + 1e-9))).astype(np.float32)
                m = state.m[name] = 0.9 * state.m.get(name, 0) + 0.1 * g
                v = state.v[name] = 0.99 * state.v.get(name, 0) + 0.01 * g * g
                self.p[name] -= (rate * (m / (1 - 0.9**state.step)) / (np.sqrt(v / (1 - 0.99**state.step)) + 1e-6)).astype(np.float32)
        return float(np.mean(total)) if total else 0.0

    def fit_together(self, x: np.ndarray, y: np.ndarray, shards: int, epochs: int, batch: int, rate: float, spark=None, seed: int = 11) -> None:
        """Shards of the rows train side by side; after each epoch their parameters and moments are averaged.

        With ``spark`` each shard's epoch is a task, without it they run here; the result is the same.
        """
        rng, state = np.random.default_rng(seed), Moments()
        x, y = x.astype(np.uint8), y.astype(np.int8)
        sent = spark.sparkContext.broadcast((x, y)) if spark else None
        for epoch in range(epochs):
            order, slow = rng.permutation(len(x)), rate * (1 - epoch / epochs) + 0.002
            parts = np.array_split(order, shards)
            args = (self.classes, self.labels, self.hidden, self.p, state, batch, slow)
            if spark:
                made = [pickle.loads(r[0]) for r in _in_tasks(spark, sent, parts, args)]
            else:
                made = [_shard_epoch(x, y, part, args) for part in parts]
            weights = np.array([len(p) for p in parts], np.float64) / max(1, len(x))
            mean = lambda k, made=made, weights=weights: {n: sum(w * own[k][n].astype(np.float64) for w, own in zip(weights, made, strict=True)).astype(np.float32) for n in made[0][k]}
            self.p, state = mean(0), Moments(mean(1), mean(2), made[0][3])
        if sent:
            sent.destroy()


@dataclass
class Moments:
    """What Adam remembers between steps."""

    m: dict[str, np.ndarray] = field(default_factory=dict)
    v: dict[str, np.ndarray] = field(default_factory=dict)
    step: int = 0


def _shard_epoch(x: np.ndarray, y: np.ndarray, part: np.ndarray, args: tuple) -> tuple:
    classes, labels, hidden, p, state, batch, rate = args
    own = Tagger(classes, labels, hidden)
    own.p = {name: value.copy() for name, value in p.items()}
    now = Moments(dict(state.m), dict(state.v), state.step)
    own.epoch(x[part].astype(np.int16), y[part].astype(np.int64), now, batch, rate)
    return own.p, now.m, now.v, now.step


def _in_tasks(spark, sent, parts: list[np.ndarray], args: tuple) -> list:
    """The shards' epochs as tasks of one job: a few kilobytes of parameters come back from each."""

    def run(batches):
        for batch in batches:
            for k in batch["id"].to_pylist():
                x, y = sent.value
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(_shard_epoch(x, y, parts[k], args))], pa.binary())], ["id", "made"])

    told = spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "id long, made binary").collect()
    return [(r.made,) for r in sorted(told, key=lambda r: r.id)]
