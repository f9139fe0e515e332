"""A small gated recurrent language model in numpy.

The next token is predicted in two steps, its class and then the token within the class. Texts run in lanes side by side,
one after another; a lane's state is carried from window to window and cleared where a text begins, so a text of any
length has one log-likelihood. Training is backpropagation truncated at the window's start, with Adagrad steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapreplace

import numpy as np

END, OTHER = 0, 1  # token numbers: the end of a text (also what precedes its first token), and words out of the vocabulary
F32 = np.float32


def initial(log_p: np.ndarray, hidden: int, per_class: int, seed: int) -> dict[str, np.ndarray]:
    """Weights of a model that predicts the given log probabilities whatever the state; classes are runs of tokens."""
    rng, classes = np.random.default_rng(seed), -(-len(log_p) // per_class)
    padded = np.full(classes * per_class, -30.0)
    padded[:len(log_p)] = np.maximum(log_p, -30)
    by_class = padded.reshape(classes, per_class)
    mass = np.log(np.exp(by_class).sum(1))
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
    return {
        "input": small(len(log_p), 3 * hidden), "bias": np.zeros(3 * hidden, F32),
        "gates": small(hidden, 2 * hidden), "candidate": small(hidden, hidden),
        "class": np.zeros((hidden, classes), F32), "class_bias": mass.astype(F32),
        "word": np.zeros((classes, hidden, per_class), F32), "word_bias": (by_class - mass[:, None]).astype(F32),
    }


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(F32)
        at += like[k].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * F32(0.5)) * F32(0.5) + F32(0.5)


def _softmax(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For choices by rows, log probabilities: that of each row's target, and all as parts and their sums. Rows lie side by
    side, so that sums over the few choices of a row run over whole arrays."""
    x -= x.max(0)
    log_p = x[target, np.arange(x.shape[1])]
    parts = np.exp(x, out=x)
    total = parts.sum(0)
    return log_p - np.log(total), parts, total


class Lanes:
    """Token arrays laid side by side: the longest first, each to the shortest lane so far."""

    def __init__(self, texts: list[np.ndarray], lanes: int):
        self.n = len(texts)
        load = [(0, k) for k in range(min(lanes, len(texts)))]
        members: list[list[int]] = [[] for _ in load]
        for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
            size, lane = load[0]
            members[lane].append(k)
            heapreplace(load, (size + len(texts[k]), lane))
        members.sort(key=lambda m: -sum(len(texts[k]) for k in m))
        self.lengths = np.array([sum(len(texts[k]) for k in m) for m in members])
        self.next = np.zeros((int(self.lengths.max()), len(members)), np.int32)
        self.text = np.full(self.next.shape, -1, np.int32)
        for lane, m in enumerate(members):
            row = np.concatenate([texts[k] for k in m])
            self.next[:len(row), lane] = row
            self.text[:len(row), lane] = np.repeat(m, [len(texts[k]) for k in m])
        self.given = np.vstack([np.zeros((1, len(members)), np.int32), self.next[:-1]])
        begins = np.ones(self.text.shape, bool)
        begins[1:] = self.text[1:] != self.text[:-1]
        self.given[begins] = END
        self.carried = (~begins).astype(F32)

    def windows(self, size: int) -> Iterator[tuple[slice, int]]:
        """Steps and the number of lanes that still have tokens."""
        for at in range(0, len(self.next), size):
            yield slice(at, min(at + size, len(self.next))), int((self.lengths > at).sum())


class Gru:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.hidden, self.per_class = len(weights["candidate"]), weights["word_bias"].shape[1]

    def _forward(self, given: np.ndarray, carried: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
        w, h2, (steps, lanes) = self.w, 2 * self.hidden, given.shape
        x = (w["input"] + w["bias"])[given]
        before, gates, new, after = (np.empty((steps, lanes, n), F32) for n in (self.hidden, h2, self.hidden, self.hidden))
        for t in range(steps):
            h = before[t] = state * carried[t][:, None]
            g = gates[t] = _sigmoid(x[t, :, :h2] + h @ w["gates"])
            keep, reset = g[:, :self.hidden], g[:, self.hidden:]
            c = new[t] = np.tanh(x[t, :, h2:] + (reset * h) @ w["candidate"])
            state = after[t] = c + keep * (h - c)
        return [before, gates, new, after]

    def _output(self, h: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target; with ``grads`` also the gradient of their negative sum by ``h``."""
        w, of, within = self.w, target // self.per_class, target % self.per_class
        log_p, d, total = _softmax(w["class"].T @ h.T + w["class_bias"][:, None], of)
        dh = None
        if grads is not None:
            d /= total
            d[of, np.arange(len(h))] -= 1
            grads["class"], grads["class_bias"] = h.T @ d.T, d.sum(1)
            grads["word"], grads["word_bias"] = np.zeros_like(w["word"]), np.zeros_like(w["word_bias"])
            dh = d.T @ w["class"].T
        order = np.argsort(of.astype(np.int16), kind="stable") if len(w["word"]) < 1 << 15 else np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(w["word"]) + 1)).tolist()
        for c in range(len(w["word"])):
            if cuts[c] == cuts[c + 1]:
                continue
            at = order[cuts[c]:cuts[c + 1]]
            mine, chosen = h[at], within[at]
            inside, d, total = _softmax(w["word"][c].T @ mine.T + w["word_bias"][c][:, None], chosen)
            log_p[at] += inside
            if grads is not None:
                d /= total
                d[chosen, np.arange(len(at))] -= 1
                grads["word"][c], grads["word_bias"][c] = mine.T @ d.T, d.sum(1)
                dh[at] += d.T @ w["word"][c].T
        return log_p, dh

    def score(self, texts: list[np.ndarray], lanes: int = 512, window: int = 32) -> np.ndarray:
        """Natural log probability of each text."""
        if not texts:
            return np.zeros(0)
        laid, total = Lanes(texts, lanes), np.zeros(len(texts))
        state = np.zeros((len(laid.lengths), self.hidden), F32)
        for steps, n in laid.windows(window):
            after = self._forward(laid.given[steps, :n], laid.carried[steps, :n], state[:n])[3]
            state = after[-1]
            real = laid.text[steps, :n] >= 0
            log_p, _ = self._output(after[real], laid.next[steps, :n][real], None)
            total += np.bincount(laid.text[steps, :n][real], log_p, len(texts))
        return total

    def train(self, texts: list[np.ndarray], squares: dict[str, np.ndarray], rate: float = 0.15, lanes: int = 256,
              window: int = 32, carry: int = 1024) -> None:
        """One pass over all tokens of ``texts``, a step per window. ``squares`` holds the sums of squared gradients
        between calls. The state is carried over ``carry`` tokens, so that long texts don't run on alone."""
        texts = [part for x in texts for part in np.split(x, range(carry, len(x), carry))]
        if not texts:
            return
        laid, w, h1, h2 = Lanes(texts, lanes), self.w, self.hidden, 2 * self.hidden
        state = np.zeros((len(laid.lengths), h1), F32)
        for steps, n in laid.windows(window):
            given, carried = laid.given[steps, :n], laid.carried[steps, :n]
            before, gates, new, after = self._forward(given, carried, state[:n])
            state = after[-1]
            real = laid.text[steps, :n] >= 0
            grads: dict[str, np.ndarray] = {}
            d_after = np.zeros_like(after)
            d_after[real] = self._output(after[real], laid.next[steps, :n][real], grads)[1]
            d_in, dh = np.empty((*given.shape, 3 * h1), F32), np.zeros((n, h1), F32)
            for t in range(len(given) - 1, -1, -1):
                dh += d_after[t]
                h, keep, reset, c = before[t], gates[t, :, :h1], gates[t, :, h1:], new[t]
                dc = d_in[t, :, h2:] = dh * (1 - keep) * (1 - c * c)
                d_reset = dc @ w["candidate"].T
                d_in[t, :, :h1] = dh * (h - c) * keep * (1 - keep)
                d_in[t, :, h1:h2] = d_reset * h * reset * (1 - reset)
                dh = (dh * keep + d_reset * reset + d_in[t, :, :h2] @ w["gates"].T) * carried[t][:, None]
            flat, h = d_in.reshape(-1, 3 * h1), before.reshape(-1, h1)
            grads["bias"], grads["gates"] = flat.sum(0), h.T @ flat[:, :h2]
            grads["candidate"] = (gates[:, :, h1:].reshape(-1, h1) * h).T @ flat[:, h2:]
            used, at = np.unique(given, return_index=False, return_inverse=True)
            order = np.argsort(at.ravel(), kind="stable")
            rows = np.add.reduceat(flat[order], np.searchsorted(at.ravel()[order], np.arange(len(used))), axis=0)
            scale = F32(1 / (lanes * window))  # a window with few lanes left takes a small step
            g = rows * scale
            squares["input"][used] += g * g
            w["input"][used] -= F32(rate) * g / (np.sqrt(squares["input"][used]) + F32(1e-6))
            for name, grad in grads.items():
                g = grad * scale
                squares[name] += g * g
                w[name] -= F32(rate) * g / (np.sqrt(squares[name]) + F32(1e-6))
