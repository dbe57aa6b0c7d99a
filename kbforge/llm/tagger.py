"""Character-level bidirectional LSTM with CRF transitions, in numpy: batched decoding and training."""

from __future__ import annotations

import numpy as np

KINDS = ["email", "phone", "id_number", "address", "person"]
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
PAD_FLAGS = 3  # extra inputs per character besides its embedding


def char_ids() -> dict[str, int]:
    """Fixed alphabet: printable ASCII one by one; other characters fall in classes (see char_class)."""
    return {chr(c): c - 31 for c in range(32, 127)}


# Length-preserving normal forms: other spaces, hyphens, at signs and decimal digits read as their ASCII kin.
_ALIKE = {**dict.fromkeys("\u00a0\u2007\u2009\u202f", " "), **dict.fromkeys("\u2010\u2011\u2012\u2013", "-"), "\uff20": "@"}


def _plain(c: str) -> str:
    return _ALIKE.get(c) or (str(int(c)) if c.isdecimal() and not c.isascii() else c)


_IDS = char_ids()
N_CHARS = 96 + 8


def char_class(c: str) -> int:
    if c in _IDS:
        return _IDS[c]
    if c == "\n":
        return 96
    if c.isdigit():
        return 97
    if c.isspace():
        return 98
    if c.isupper():
        return 99
    if c.islower():
        return 100
    if c in "‐‑‒–—":
        return 101
    return 102


def encode(text: str) -> np.ndarray:
    return np.fromiter((_IDS.get(c) or char_class(_plain(c)) for c in text), dtype=np.int16, count=len(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Parameters: emb [chars, D]; per direction W [D + flags, 4H], U [H, 4H], b; output V [2H, tags], c; transitions A [tags, tags], start."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params
        self.hidden = params["Uf"].shape[0]

    @staticmethod
    def fresh(dim: int = 12, hidden: int = 24, seed: int = 0) -> Tagger:
        r = np.random.default_rng(seed)
        n = len(TAGS)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"emb": (0.3 * r.standard_normal((N_CHARS, dim))).astype(np.float32), "V": g(2 * hidden, n), "c": np.zeros(n, np.float32), "A": np.zeros((n, n), np.float32), "s": np.zeros(n, np.float32)}
        for d in "fb":
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1.0
            p |= {f"W{d}": g(dim + PAD_FLAGS, 4 * hidden), f"U{d}": g(hidden, 4 * hidden), f"b{d}": b}
        return Tagger(p)

    @staticmethod
    def load(path: str) -> Tagger:
        with np.load(path) as z:
            return Tagger({k: z[k].astype(np.float32) for k in z.files if len(k) <= 3})

    def _lstm(self, x: np.ndarray, d: str, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x [T, B, in] to h [T, B, H]; beyond a sequence's length the state stays, so reversed padding is harmless."""
        h_size = self.hidden
        steps, batch, _ = x.shape
        pre = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        u = self.p[f"U{d}"]
        h, c = np.zeros((batch, h_size), np.float32), np.zeros((batch, h_size), np.float32)
        out = np.zeros((steps, batch, h_size), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ u
            i, f, o = _sigmoid(z[:, :h_size]), _sigmoid(z[:, h_size : 2 * h_size]), _sigmoid(z[:, 2 * h_size : 3 * h_size])
            g = np.tanh(z[:, 3 * h_size :])
            m = mask[t][:, None]
            c_new = (f * c + i * g) * m + c * (1 - m)
            tc = np.tanh(c_new)
            h_new = o * tc * m + h * (1 - m)
            if keep is not None:
                keep.append((t, i, f, o, g, c, tc, h, m))
            h, c = h_new, c_new
            out[t] = h_new
        return out

    def emissions(self, ids: np.ndarray, flags: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """ids [B, T], flags [B, T, F], mask [B, T] to scores [T, B, tags]."""
        x = np.concatenate([self.p["emb"][ids.T], flags.transpose(1, 0, 2)], axis=2).astype(np.float32)
        m = mask.T.astype(np.float32)
        h = np.concatenate([self._lstm(x, "f", m), self._lstm(x, "b", m)], axis=2)
        return h @ self.p["V"] + self.p["c"]

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag paths [B, T] for emissions [T, B, tags]."""
        steps, batch, n = e.shape
        a = self.p["A"]
        score = e[0] + self.p["s"]
        back = np.zeros((steps, batch, n), dtype=np.int8)
        for t in range(1, steps):
            cand = score[:, :, None] + a
            best = cand.argmax(1)
            new = np.take_along_axis(cand, best[:, None, :], 1)[:, 0] + e[t]
            live = (t < lengths)[:, None]
            back[t] = np.where(live, best, np.arange(n))
            score = np.where(live, new, score)
        path = np.zeros((batch, steps), dtype=np.int8)
        at = score.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, -1, -1):
            path[:, t] = at
            at = back[t, rows, at]
        return path

    # --- training ---

    def loss_and_grads(self, ids: np.ndarray, flags: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean CRF negative log likelihood per sequence, and gradients by backpropagation through time."""
        p, hs = self.p, self.hidden
        x = np.concatenate([p["emb"][ids.T], flags.transpose(1, 0, 2)], axis=2).astype(np.float32)
        m = mask.T.astype(np.float32)
        kf: list = []
        kb: list = []
        hf, hb = self._lstm(x, "f", m, kf), self._lstm(x, "b", m, kb)
        h = np.concatenate([hf, hb], axis=2)
        e = h @ p["V"] + p["c"]
        steps, batch, n = e.shape
        a, tags = p["A"], y.T
        rows = np.arange(batch)

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis, keepdims=True)
            return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

        alpha = np.zeros_like(e)
        alpha[0] = e[0] + p["s"]
        for t in range(1, steps):
            new = lse(alpha[t - 1][:, :, None] + a, 1) + e[t]
            alpha[t] = np.where(m[t][:, None] > 0, new, alpha[t - 1])
        log_z = lse(alpha[-1], 1)
        beta = np.zeros_like(e)
        grad_a = np.zeros_like(a)
        for t in range(steps - 2, -1, -1):
            nxt = beta[t + 1] + e[t + 1]
            on = m[t + 1][:, None] > 0
            beta[t] = np.where(on, lse(a[None] + nxt[:, None, :], 2), beta[t + 1])
            pair = np.exp(alpha[t][:, :, None] + a[None] + nxt[:, None, :] - log_z[:, None, None]) * on[:, :, None]
            grad_a += pair.sum(0)
            np.add.at(grad_a, (tags[t], tags[t + 1]), -on[:, 0].astype(np.float32))
        de = np.exp(alpha + beta - log_z[None, :, None]) * m[:, :, None]
        gold = p["s"][tags[0]].sum() + (e[np.arange(steps)[:, None], rows[None], tags] * m).sum() + (a[tags[:-1], tags[1:]] * m[1:]).sum()
        loss = float((log_z.sum() - gold) / batch)
        de[np.arange(steps)[:, None], rows[None], tags] -= m
        de /= batch
        out = {"A": grad_a / batch, "s": de[0].sum(0), "c": de.sum((0, 1)), "V": np.einsum("tbh,tbn->hn", h, de, optimize=True)}
        dh = de @ p["V"].T
        dx = np.zeros_like(x)
        for d, keep, part in (("f", kf, dh[:, :, :hs]), ("b", kb, dh[:, :, hs:])):
            w, u = p[f"W{d}"], p[f"U{d}"]
            dz_all = np.zeros((steps, batch, 4 * hs), np.float32)
            h_prev = np.zeros((steps, batch, hs), np.float32)
            dh_next, dc_next = np.zeros((batch, hs), np.float32), np.zeros((batch, hs), np.float32)
            for t, i, f, o, g, c0, tc, h0, mt in reversed(keep):
                dht = part[t] + dh_next
                live = dht * mt
                dc = dc_next * mt + live * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), live * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                h_prev[t] = h0
                dh_next = dz @ u.T + dht * (1 - mt)
                dc_next = dc * f + dc_next * (1 - mt)
            out[f"W{d}"] = np.einsum("tbi,tbz->iz", x, dz_all, optimize=True)
            out[f"U{d}"] = np.einsum("tbh,tbz->hz", h_prev, dz_all, optimize=True)
            out[f"b{d}"] = dz_all.sum((0, 1))
            dx += dz_all @ w.T
        emb = np.zeros_like(p["emb"])
        np.add.at(emb, ids.T, dx[:, :, : emb.shape[1]])
        out["emb"] = emb
        return loss, out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 4e-3) -> None:
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            hat = self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            self.p[k] -= ((rate or self.rate) * hat).astype(np.float32)
