"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation through time.

Texts run through the model in lanes, one after another; an end token closes each text and resets its lane's state, and
the state is carried from window to window, so that a text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place. exp overflows to infinity, and so the result to 0, far out."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exponentials(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's logit at its place, the row's exponentials and their sum; in place. Within 80 of 0, none overflows or vanishes."""
    np.minimum(logits, 80, out=logits)
    np.maximum(logits, -80, out=logits)
    mine = logits[np.arange(len(at)), at]
    e = np.exp(logits, out=logits)
    return mine, e, e @ np.ones(e.shape[1], e.dtype)


@dataclass
class GRU:
    """words: classes * per_class symbols, numbered class by class. p: parameters by name.

    x [words, 3H] is a symbol's input to update, reset and candidate; u [H, 3H] the state's; the probability of a symbol
    is its class's (c, cb) times its own within the class (w, wb).
    """

    p: dict[str, np.ndarray]
    classes: int

    @classmethod
    def new(cls, counts: np.ndarray, classes: int, hidden: int, seed: int = 7) -> GRU:
        """Starts out with the symbols' shares of counts as its probabilities, whatever the state."""
        n = len(counts)
        rnd = np.random.default_rng(seed)
        share = np.log((counts + 0.1) / (counts + 0.1).sum()).reshape(classes, n // classes)
        top = np.logaddexp.reduce(share, 1)
        small = lambda *shape: (rnd.standard_normal(shape) * 0.1).astype(F32)
        p = {
            "x": small(n, 3 * hidden), "u": small(hidden, 3 * hidden), "c": small(hidden, classes) * F32(0.1), "cb": top.astype(F32),
            "w": small(classes, hidden, n // classes) * F32(0.1), "wb": (share - top[:, None]).astype(F32),
        }
        return cls(p, classes)

    def forward(self, tokens: np.ndarray, keep: np.ndarray, h: np.ndarray, cache: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """tokens [T, B]; keep 0 where a token ends a text. The states before each token [T, H, B], and the one after the last [H, B]. cache: gets gates, candidates and the state's part of them for each step."""
        hidden = len(h)
        states = np.empty((len(tokens), *h.shape), F32)
        inputs, u = np.ascontiguousarray(self.p["x"][tokens].transpose(0, 2, 1)), np.ascontiguousarray(self.p["u"].T)
        for t, i in enumerate(inputs):
            states[t] = h
            a = u @ h
            gates = i[: 2 * hidden]
            gates += a[: 2 * hidden]
            _sigmoid(gates)
            z, r, n = gates[:hidden], gates[hidden:], i[2 * hidden :]
            n += r * a[2 * hidden :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if cache is not None:
                cache.append((z, r, n, a[2 * hidden :]))
            new *= keep[t]
            h = new
        return states, h

    def log_probabilities(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Natural logs for flat states [N, H] and tokens [N]."""
        return self._output(states, tokens)[0]

    def _output(self, states: np.ndarray, tokens: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        p, per = self.p, self.p["w"].shape[2]
        of, word = tokens // per, tokens % per
        n = np.arange(len(tokens))
        logits = states @ p["c"]
        logits += p["cb"]
        mine, e, total = _exponentials(logits, of)
        out = mine - np.log(total)
        back = None
        if grads is not None:
            e /= total[:, None]
            e[n, of] -= 1
            back = e @ p["c"].T
            grads["c"], grads["cb"] = states.T @ e, e.sum(0)
            grads["w"], grads["wb"] = np.zeros_like(p["w"]), np.zeros_like(p["wb"])
        order = np.argsort(of.astype(np.int16), kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.classes + 1)).tolist()
        sorted_states, sorted_words = states[order], word[order]
        within = np.empty(len(tokens), out.dtype)
        more = None if grads is None else np.empty_like(sorted_states)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a == b:
                continue
            s, at = sorted_states[a:b], sorted_words[a:b]
            logits = s @ p["w"][k]
            logits += p["wb"][k]
            mine, e, total = _exponentials(logits, at)
            within[a:b] = mine - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[np.arange(b - a), at] -= 1
                more[a:b] = e @ p["w"][k].T
                grads["w"][k], grads["wb"][k] = s.T @ e, e.sum(0)
        out[order] += within
        if grads is not None:
            back[order] += more
        return out, back

    def gradients(self, tokens: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean negative log probability over a window, the state before it taken as given; and the state after it."""
        cache: list = []
        states, after = self.forward(tokens, keep, h, cache)
        steps, hidden, lanes = states.shape
        grads: dict[str, np.ndarray] = {}
        flat = tokens.reshape(-1)
        before = np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, hidden)
        back = np.ascontiguousarray(self._output(before, flat, grads)[1].reshape(steps, lanes, hidden).transpose(0, 2, 1))
        z, r, n, a = (np.stack(x) for x in zip(*cache, strict=True))
        # What a step's gradient is multiplied by on its way to the update, the reset and the candidate.
        to_n = (1 - z) * (1 - n * n)
        to_z, to_r = (states - n) * z * (1 - z), to_n * a * r * (1 - r)
        gx = np.empty((steps, 3 * hidden, lanes), F32)
        dh, u = np.zeros_like(h), self.p["u"]
        for t in reversed(range(steps)):
            d = dh * keep[t]
            g = gx[t]
            np.multiply(d, to_z[t], out=g[:hidden])
            np.multiply(d, to_r[t], out=g[hidden : 2 * hidden])
            np.multiply(d, to_n[t], out=g[2 * hidden :])
            d *= z[t]
            d += u[:, : 2 * hidden] @ g[: 2 * hidden]
            d += u[:, 2 * hidden :] @ (g[2 * hidden :] * r[t])
            d += back[t]
            dh = d
        rows = np.ascontiguousarray(gx.transpose(0, 2, 1)).reshape(-1, 3 * hidden)
        gx[:, 2 * hidden :] *= r
        grads["u"] = before.T @ gx.transpose(0, 2, 1).reshape(-1, 3 * hidden)
        order = np.argsort(flat, kind="stable")
        cuts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grads["x"] = np.zeros_like(self.p["x"])
        grads["x"][flat[order][cuts]] = np.add.reduceat(rows[order], cuts)
        return {k: g / len(flat) for k, g in grads.items()}, after

    def train(self, texts: list[np.ndarray], end: int, lanes: int, window: int, rate: float, piece: int = 512) -> int:
        """One pass of Adam over texts, arrays of symbols that close with end. Returns the number of tokens.

        Long texts are learnt from in pieces, each from a state of zero on, so that all lanes are equally long.
        """
        parts = [t[i : i + piece] for t in texts for i in range(0, len(t), piece)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        rows = lanes_of([len(t) for t in parts], lanes)
        step, last = 0, max(1, sum(len(parts[j]) for j in rows[0]) // window) if rows else 1
        for tokens, _, starts in laid_out(parts, rows, end, window):
            h = np.zeros((self.p["u"].shape[0], tokens.shape[1]), F32) if step == 0 else h[:, : tokens.shape[1]]
            h = h * ~starts
            grads, h = self.gradients(tokens, (tokens != end).astype(F32), h)
            step += 1
            pace = rate * (1 - 0.9 * min(1.0, step / (last + 1))) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g *= F32(min(1.0, 1.0 / (norm + 1e-9)))
                m[k] += F32(0.1) * (g - m[k])
                v2[k] += F32(0.01) * (g * g - v2[k])
                self.p[k] -= F32(pace) * m[k] / (np.sqrt(v2[k]) + F32(1e-8))
        return sum(map(len, texts))

    def score(self, texts: list[np.ndarray], end: int, lanes: int = 512, window: int = 64) -> np.ndarray:
        """The log10 probability of each text, arrays of symbols that close with end. The state is carried through the whole text."""
        h, out = None, np.zeros(len(texts) + 1)
        for tokens, owner, _ in laid_out(texts, lanes_of([len(t) for t in texts], lanes), end, window):
            h = np.zeros((self.p["u"].shape[0], tokens.shape[1]), F32) if h is None else h[:, : tokens.shape[1]]
            states, h = self.forward(tokens, (tokens != end).astype(F32), h)
            logs = self.log_probabilities(states.transpose(0, 2, 1).reshape(-1, states.shape[1]), tokens.reshape(-1))
            out += np.bincount(owner.reshape(-1), logs, len(out))
        return out[:-1] / np.log(10)


def lanes_of(lengths: list[int], lanes: int) -> list[list[int]]:
    """Which texts follow each other in each lane: longest first into the emptiest; the fullest lane comes first."""
    import heapq

    rows: list[list[int]] = [[] for _ in range(max(1, min(lanes, len(lengths))))]
    heap = [(0, i) for i in range(len(rows))]
    for j in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        load, i = heapq.heappop(heap)
        rows[i].append(j)
        heapq.heappush(heap, (load + lengths[j], i))
    return sorted((r for r in rows if r), key=lambda r: -sum(lengths[j] for j in r))


def laid_out(texts: list[np.ndarray], rows: list[list[int]], end: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens [T, B], owner [T, B], starts [B]) for every steps tokens of the lanes; owner len(texts) marks filling.

    Lanes that have come to their end drop out, so that memory and work grow with the tokens, however long one text is.
    starts: lanes whose first token here begins a text.
    """
    if not rows:
        return
    flat = np.concatenate([texts[j] for r in rows for j in r])
    owner = np.repeat(np.array([j for r in rows for j in r], np.int32), [len(texts[j]) for r in rows for j in r])
    load = np.array([sum(len(texts[j]) for j in r) for r in rows])
    base = np.cumsum(load) - load
    for a in range(0, int(load[0]), steps):
        alive = int(np.searchsorted(-load, -a, "left"))
        t = min(steps, int(load[0]) - a)
        at = base[:alive] + a + np.arange(t)[:, None]
        inside = np.arange(a, a + t)[:, None] < load[:alive]
        at[~inside] = 0
        of = np.where(inside, owner[at], len(texts))
        starts = np.zeros(alive, bool) if a == 0 else owner[at[0] - 1] != of[0]
        yield np.where(inside, flat[at], end).astype(np.int32), of, starts


def averaged(models: Iterator[tuple[int, dict[str, np.ndarray]]]) -> tuple[int, dict[str, np.ndarray] | None]:
    """Parameters averaged by the numbers of tokens that they were trained on."""
    weight, total = 0, None
    for n, p in models:
        weight += n
        total = {k: v * n for k, v in p.items()} if total is None else {k: total[k] + v * n for k, v in p.items()}
    return weight, None if total is None or not weight else {k: (v / weight).astype(F32) for k, v in total.items()}
