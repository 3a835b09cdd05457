"""A bidirectional LSTM line labeller in numpy: hashed-word embeddings and shape features in, one logit a line out."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Batch:
    """Pages as padded sequences: shape features (pages, steps, s), word ids of each line with line starts, and lengths."""

    shapes: np.ndarray
    ids: np.ndarray
    starts: np.ndarray  # first id of each line, page by page
    lengths: np.ndarray

    @property
    def mask(self) -> np.ndarray:
        return np.arange(self.shapes.shape[1])[None, :] < self.lengths[:, None]


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Reverse each sequence within its length; padding stays at the end."""
    steps = np.arange(x.shape[1])
    at = np.where(steps[None, :] < lengths[:, None], lengths[:, None] - 1 - steps[None, :], steps[None, :])
    return np.take_along_axis(x, at[:, :, None], axis=1)


@dataclass
class Labeller:
    words: int
    width: int
    shape: int
    hidden: int
    seed: int = 11
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.p:
            return
        rng = np.random.default_rng(self.seed)
        d, h = self.width + self.shape, self.hidden
        init = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (rng.normal(size=(self.words, self.width)) * 0.3).astype(np.float32), "v": init(2 * h, 1), "c": np.zeros(1, np.float32)}
        for way in "fb":
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # remember at first
            self.p |= {f"W{way}": init(d, 4 * h), f"U{way}": init(h, 4 * h), f"b{way}": bias}

    def inputs(self, b: Batch) -> np.ndarray:
        pages, steps, _ = b.shapes.shape
        counts = np.diff(np.append(b.starts, len(b.ids)))
        lines = np.zeros((len(b.starts), self.width), np.float32)
        some = counts > 0
        if some.any():
            lines[some] = np.add.reduceat(self.p["E"][b.ids], b.starts[some], axis=0)
        lines /= np.sqrt(np.maximum(counts, 1))[:, None]
        x = np.zeros((pages, steps, self.width + self.shape), np.float32)
        x[:, :, self.width :] = b.shapes
        emb = np.zeros((pages, steps, self.width), np.float32)
        emb[b.mask] = lines
        x[:, :, : self.width] = emb
        return x

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        h = self.hidden
        pages, steps, _ = x.shape
        xw = x @ self.p[f"W{way}"] + self.p[f"b{way}"]
        state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        out, tape = np.zeros((pages, steps, h), np.float32), []
        for t in range(steps):
            z = xw[:, t] + state @ self.p[f"U{way}"]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            m = mask[:, t, None]
            new = f * cell + i * g
            tc = np.tanh(new)
            if keep:
                tape.append((state, cell, i, f, o, g, tc, m))
            cell = np.where(m, new, cell)
            state = np.where(m, o * tc, state)
            out[:, t] = state
        return out, tape

    def logits(self, b: Batch) -> np.ndarray:
        x, mask = self.inputs(b), b.mask
        hf, _ = self._run(x, mask, "f", False)
        hb, _ = self._run(_flip(x, b.lengths), mask, "b", False)
        return (np.concatenate((hf, _flip(hb, b.lengths)), axis=2) @ self.p["v"] + self.p["c"])[:, :, 0]

    def gradients(self, b: Batch, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted logistic loss of a batch and its gradients, back through time in both directions."""
        x, mask, h = self.inputs(b), b.mask, self.hidden
        hf, tf = self._run(x, mask, "f", True)
        hb, tb = self._run(_flip(x, b.lengths), mask, "b", True)
        both = np.concatenate((hf, _flip(hb, b.lengths)), axis=2)
        z = (both @ self.p["v"] + self.p["c"])[:, :, 0]
        prob = _sigmoid(z)
        w = np.where(mask, weight, 0).astype(np.float32)
        n = max(w.sum(), 1)
        loss = float((w * (np.logaddexp(0, z) - y * z)).sum() / n)
        dz = (w * (prob - y) / n)[:, :, None].astype(np.float32)
        g = {"v": both.reshape(-1, 2 * h).T @ dz.reshape(-1, 1), "c": dz.sum(axis=(0, 1))}
        dboth = dz @ self.p["v"].T
        dx = np.zeros_like(x)
        for way, tape, dout in (("f", tf, dboth[:, :, :h]), ("b", tb, _flip(dboth[:, :, h:], b.lengths))):
            xin = x if way == "f" else _flip(x, b.lengths)
            dxw = np.zeros((*x.shape[:2], 4 * h), np.float32)
            dh, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            du = np.zeros_like(self.p[f"U{way}"])
            for t in range(x.shape[1] - 1, -1, -1):
                state, cell, i, f, o, gg, tc, m = tape[t]
                dh = dh + dout[:, t]
                dhm = np.where(m, dh, 0)
                dcm = np.where(m, dc, 0) + dhm * o * (1 - tc * tc)
                dzt = np.concatenate((dcm * gg * i * (1 - i), dcm * cell * f * (1 - f), dhm * tc * o * (1 - o), dcm * i * (1 - gg * gg)), axis=1)
                dxw[:, t] = dzt
                du += state.T @ dzt
                dh = np.where(m, dzt @ self.p[f"U{way}"].T, dh)
                dc = np.where(m, dcm * f, dc)
            flat = dxw.reshape(-1, 4 * h)
            g |= {f"W{way}": xin.reshape(-1, x.shape[2]).T @ flat, f"U{way}": du, f"b{way}": flat.sum(axis=0)}
            d = (flat @ self.p[f"W{way}"].T).reshape(x.shape)
            dx += d if way == "f" else _flip(d, b.lengths)
        counts = np.diff(np.append(b.starts, len(b.ids)))
        line = dx[:, :, : self.width][mask] / np.sqrt(np.maximum(counts, 1))[:, None]
        g["E"] = ge = np.zeros_like(self.p["E"])
        if len(b.ids):
            # ids in order, so that each word's lines are added in one sweep
            order = np.argsort(b.ids, kind="stable")
            words, first = np.unique(b.ids[order], return_index=True)
            ge[words] = np.add.reduceat(line[np.repeat(np.arange(len(counts)), counts)[order]], first, axis=0)
        return loss, g

    def fit(self, batches: list[tuple[Batch, np.ndarray, np.ndarray]], epochs: int, rate: float = 0.01) -> list[float]:
        """Adam over (batch, labels, line weights); the loss of each epoch."""
        rng = np.random.default_rng(self.seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            total, lr = 0.0, rate * (1 - 0.8 * epoch / max(epochs - 1, 1))
            for j in rng.permutation(len(batches)):
                loss, g = self.gradients(*batches[j])
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / max(norm, 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                total += loss
            losses.append(total / max(len(batches), 1))
        return losses
