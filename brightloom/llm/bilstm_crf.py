"""A bidirectional LSTM with CRF transitions over characters, in numpy."""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN = 10, 14


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """Hidden states (batch, time, hidden) of one direction, and what the
    backward pass needs."""
    n, steps, h = x.shape[0], x.shape[1], u.shape[0]
    inputs = x @ w + b
    state = cell = np.zeros((n, h), x.dtype)
    out, kept = np.empty((n, steps, h), x.dtype), []
    for t in range(steps):
        z = inputs[:, t] + state @ u
        gates = _sigmoid(z[:, : 3 * h])
        i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
        before, cell = cell, f * cell + i * g
        tc = np.tanh(cell)
        if keep:
            kept.append((state, before, i, f, o, g, tc))
        state = o * tc
        out[:, t] = state
    return out, kept


def _back(x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: list, dout: np.ndarray):
    n, steps, h = dout.shape
    dz = np.empty((n, steps, 4 * h), x.dtype)
    du, dh, dc = np.zeros_like(u), np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype)
    for t in reversed(range(steps)):
        state, before, i, f, o, g, tc = kept[t]
        d = dout[:, t] + dh
        dc = dc + d * o * (1 - tc * tc)
        dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        du += state.T @ dz[:, t]
        dh, dc = dz[:, t] @ u.T, dc * f
    flat = dz.reshape(-1, 4 * h)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _viterbi(e: np.ndarray, size: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest tags of each row of emissions (rows, steps, tags), of
    which the first ``size`` steps count."""
    score, came, own = e[:, 0], [], np.arange(e.shape[2])
    for t in range(1, e.shape[1]):
        live = (t < size)[:, None]
        every = score[:, :, None] + move
        came.append(np.where(live, every.argmax(1), own))
        score = np.where(live, every.max(1) + e[:, t], score)
    tags = np.empty(e.shape[:2], np.int8)
    tags[:, -1] = now = score.argmax(1)
    for t in range(len(came) - 1, -1, -1):
        tags[:, t] = now = np.take_along_axis(came[t], now[:, None], 1)[:, 0]
    return tags


def best_paths(e: np.ndarray, starts: np.ndarray, ends: np.ndarray, move: np.ndarray, cells: int = 1 << 16) -> np.ndarray:
    """The likeliest tags (Viterbi) of each sequence ``[start, end)`` of the
    steps ``e`` (all steps, tags); the sequences follow each other.

    Where tag 0 is ahead of all others by more than two transitions can make
    up, every likeliest path has it: changing it there changes two transitions.
    Only what lies between such steps, they included, is searched."""
    sure = e[:, 0] - e[:, 1:].max(1) > 2 * (move.max() - move.min())
    tags = np.zeros(len(e), np.int8)
    # runs of steps in doubt, and the sure steps at their sides within the sequence
    first, last = np.zeros(len(e) + 1, bool), np.zeros(len(e) + 1, bool)
    first[starts], last[ends] = True, True
    doubt = np.flatnonzero(~sure)
    if not len(doubt):
        return tags
    begins = doubt[np.append(True, (np.diff(doubt) > 1) | first[doubt[1:]])]
    finish = doubt[np.append((np.diff(doubt) > 1) | first[doubt[1:]], True)] + 1
    begins, finish = begins - ~first[begins], finish + ~last[finish]
    size = finish - begins
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # as many runs as fit if all are as long as the longest of them
        most = np.arange(1, len(order) - at + 1) * size[order[at:]]
        n = max(1, int(np.searchsorted(most, cells, "right")))
        some = order[at : at + n]
        step = np.arange(size[some[-1]])
        place = np.minimum(begins[some][:, None] + step, len(e) - 1)
        part = e[place].copy()
        part[sure[place], 1:] = -1e9
        found = _viterbi(part, size[some], move)
        live = step < size[some][:, None]
        tags[place[live]] = found[live]
        at += n
    return tags


class Tagger:
    """Tags each character of fixed-size windows of character classes.

    ``unlike`` are transitions that make no sense, whose weights start low."""

    def __init__(self, classes: int, tags: int, seed: int = 11, unlike: tuple[tuple[int, int], ...] = ()):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": make(classes, EMBED) * np.float32(np.sqrt(classes) * 0.5), "out": make(2 * HIDDEN, tags), "bias": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32)}
        for pair in unlike:
            self.p["move"][pair] = -3
        for d in "fb":
            self.p |= {f"w{d}": make(EMBED, 4 * HIDDEN), f"u{d}": make(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _hidden(self, ids: np.ndarray, keep: bool):
        p, x = self.p, self.p["embed"][ids]
        fwd, kf = _run(x, p["wf"], p["uf"], p["bf"], keep)
        bwd, kb = _run(x[:, ::-1], p["wb"], p["ub"], p["bb"], keep)
        return x, np.concatenate([fwd, bwd[:, ::-1]], 2), kf, kb

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self._hidden(ids, False)[1] @ self.p["out"] + self.p["bias"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The likeliest tags of each window."""
        n, steps = ids.shape
        e = self.emissions(ids).reshape(n * steps, -1)
        return best_paths(e, np.arange(n) * steps, np.arange(1, n + 1) * steps, self.p["move"]).reshape(n, steps)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a batch, and its gradients."""
        p, n, steps = self.p, *ids.shape
        x, hidden, kf, kb = self._hidden(ids, True)
        e, move = hidden @ p["out"] + p["bias"], p["move"]
        alpha = np.empty_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
        whole = _logsumexp(alpha[:, -1], 1)
        beta, dmove = np.zeros_like(e), np.zeros_like(move)
        for t in range(steps - 2, -1, -1):
            ahead = move + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = _logsumexp(ahead, 2)
            dmove += np.exp(alpha[:, t, :, None] + ahead - whole[:, None, None]).sum(0)
        de = np.exp(alpha + beta - whole[:, None, None])
        rows = np.arange(n)[:, None]
        true = e[rows, np.arange(steps), tags].sum() + move[tags[:, :-1], tags[:, 1:]].sum()
        de[rows, np.arange(steps), tags] -= 1
        np.add.at(dmove, (tags[:, :-1], tags[:, 1:]), -1)
        de, dmove = de / n, dmove / n
        g = {"move": dmove, "bias": de.sum((0, 1)), "out": hidden.reshape(-1, hidden.shape[2]).T @ de.reshape(-1, de.shape[2])}
        dh = de @ p["out"].T
        dxf, g["wf"], g["uf"], g["bf"] = _back(x, p["wf"], p["uf"], kf, dh[:, :, :HIDDEN])
        dxb, g["wb"], g["ub"], g["bb"] = _back(x[:, ::-1], p["wb"], p["ub"], kb, dh[:, ::-1, HIDDEN:])
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], ids, dxf + dxb[:, ::-1])
        return float((whole.sum() - true) / n), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam on seeded batches; returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            some = rng.integers(0, len(ids), batch)
            loss, g = self.gradients(ids[some], tags[some])
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            scale, lr = min(1.0, 5 / (norm + 1e-9)), rate * (1 - 0.9 * step / steps)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x * scale
                v[k] = 0.99 * v[k] + 0.01 * (x * scale) ** 2
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses
