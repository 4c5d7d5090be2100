"""A bidirectional gated recurrent network with attention pooling, in NumPy: forward, backward and Adam."""

from __future__ import annotations

import numpy as np

_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * (np.tanh(_F(0.5) * x) + _F(1))


class Network:
    """Inputs are (windows, steps) of token numbers into a table of token vectors; below zero is padding.

    Each direction has a gated recurrent unit; an attention weight for each step, from
    both directions' states, pools the states; a linear layer gives the log-odds.
    """

    def __init__(self, width: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)

        def matrix(rows: int, columns: int) -> np.ndarray:
            return (rng.standard_normal((rows, columns)) / np.sqrt(rows)).astype(_F)

        self.hidden = hidden
        self.p = {"attend": matrix(2 * hidden, 1)[:, 0], "out": matrix(2 * hidden, 1)[:, 0], "bias": np.zeros(1, _F)}
        for way in ("f", "b"):
            self.p |= {f"w{way}": matrix(width, 3 * hidden), f"u{way}": matrix(hidden, 3 * hidden), f"c{way}": np.zeros(3 * hidden, _F)}

    def projected(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What each token adds to the gates of each direction; the last row is for padding."""
        pad = np.zeros((1, 3 * self.hidden), _F)
        return {way: np.concatenate([vectors @ self.p[f"w{way}"] + self.p[f"c{way}"], pad]) for way in ("f", "b")}

    def _walk(self, way: str, gates: np.ndarray, tokens: np.ndarray, keep: list | None) -> np.ndarray:
        n, steps, h = len(tokens), tokens.shape[1], self.hidden
        u = self.p[f"u{way}"]
        state, out = np.zeros((n, h), _F), np.zeros((steps, n, h), _F)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, live = gates[tokens[:, t]], (tokens[:, t] >= 0).astype(_F)[:, None]
            zr = _sigmoid(x[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h] * live, zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            new = state + z * (c - state)
            if keep is not None:
                keep.append((t, state, z, r, c, live))
            state = out[t] = new
        return out

    def forward(self, gates: dict[str, np.ndarray], tokens: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log-odds of each window."""
        kept = {way: [] if keep is not None else None for way in ("f", "b")}
        states = np.concatenate([self._walk(way, gates[way], tokens, kept[way]) for way in ("f", "b")], axis=2)
        mark = np.where(tokens.T >= 0, states @ self.p["attend"], _F(-1e9))
        weight = np.exp(mark - mark.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep |= {"kept": kept, "states": states, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, keep: dict, tokens: np.ndarray, slope: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
        """Gradients of the parameters but ``w``, and of each direction's gates by step and window."""
        states, weight, pooled, h = keep["states"], keep["weight"], keep["pooled"], self.hidden
        d_pooled = slope[:, None] * self.p["out"]
        d_mark = weight * ((states * d_pooled).sum(axis=2) - (pooled * d_pooled).sum(axis=1))
        d_states = weight[:, :, None] * d_pooled + d_mark[:, :, None] * self.p["attend"]
        grads = {
            "out": pooled.T @ slope, "bias": slope.sum(keepdims=True),
            "attend": np.tensordot(d_mark, states, axes=([0, 1], [0, 1])),
        }
        d_gates = {}
        for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, carried = self.p[f"u{way}"], np.zeros((len(tokens), h), _F)
            d_u, d_x = np.zeros_like(u), np.zeros((tokens.shape[1], len(tokens), 3 * h), _F)
            for t, state, z, r, c, live in reversed(keep["kept"][way]):
                d = carried + d_states[t][:, part]
                d_c = d * z * (1 - c * c)
                d_rs = d_c @ u[:, 2 * h :].T
                d_r = d_rs * state * r * (1 - r)
                raw = np.where(live > 0, z, 0)
                d_z = d * (c - state) * raw * (1 - raw)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_u[:, : 2 * h] += state.T @ d_zr
                d_u[:, 2 * h :] += (r * state).T @ d_c
                d_x[t] = np.concatenate([d_zr, d_c], axis=1)
                carried = d * (1 - z) + d_rs * r + d_zr @ u[:, : 2 * h].T
            grads[f"u{way}"], d_gates[way] = d_u, d_x
            grads[f"c{way}"] = d_x.sum(axis=(0, 1))
        return grads, d_gates


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = _F(0.9) * self.m[k] + _F(0.1) * g
            self.v[k] = _F(0.999) * self.v[k] + _F(0.001) * g * g
            m, v = self.m[k] / _F(1 - 0.9**self.t), self.v[k] / _F(1 - 0.999**self.t)
            self.params[k] -= (_F(self.rate) * m / (np.sqrt(v) + _F(1e-8))).astype(_F)
