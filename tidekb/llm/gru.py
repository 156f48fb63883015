"""A gated recurrent language model in numpy: class-factored softmax and truncated backpropagation through time.

Documents run in lanes: each lane holds documents one after another, the state is reset where one begins, and it is
carried from window to window, so a document is scored whole whatever its length.
"""

from __future__ import annotations

import heapq

import numpy as np

UNKNOWN, END = 0, 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Gru:
    """Ids below ``classes * members`` are words; an id's class is ``id // members``. 0 is any other word, 1 the end of a text."""

    def __init__(self, classes: int, members: int, inputs: int, hidden: int, log_freq: np.ndarray | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.members, self.hidden = classes, members, hidden
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = {"emb": draw(classes * members, inputs) * 3, "wx": draw(inputs, 3 * hidden), "u": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32)}
        self.p |= {"wc": draw(hidden, classes) * 0.1, "bc": np.zeros(classes, np.float32), "wo": draw(classes, hidden, members) * 0.1, "bo": np.zeros((classes, members), np.float32)}
        if log_freq is not None:  # biases begin at the words' own frequencies
            f = log_freq.reshape(classes, members)
            top = f.max(1)
            self.p["bc"] = (top + np.log(np.exp(f - top[:, None]).sum(1))).astype(np.float32)
            self.p["bo"] = f.astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def states(self, ids: np.ndarray, resets: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each step of a window (steps, lanes, hidden), the last ones, and with ``keep`` what the backward pass needs.

        Inside, lanes are the last axis, so that gates are contiguous blocks; embeddings are projected once a window.
        """
        p, n = self.p, self.hidden
        steps, wide = ids.shape
        half = np.ones(3 * n, p["u"].dtype)
        half[: 2 * n] = 0.5  # a sigmoid is a tanh of half its argument
        a = ((p["emb"] @ p["wx"] + p["b"]) * half)[ids.reshape(-1)].reshape(steps, wide, 3 * n).transpose(0, 2, 1)
        a, u, h = np.ascontiguousarray(a), (p["u"] * half).T.copy(), np.ascontiguousarray(h.T)
        out = np.empty((steps, n, wide), a.dtype)
        before, below = (np.empty_like(out), np.empty_like(out)) if keep else (None, None)
        live = (~resets).astype(a.dtype)
        fresh = resets.any(1)
        for t in range(steps):
            if fresh[t]:
                h = h * live[t]
            g, gates = u @ h, a[t]
            rz, c = gates[: 2 * n], gates[2 * n :]
            rz += g[: 2 * n]
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            if keep:
                before[t], below[t] = h, g[2 * n :]
            g[2 * n :] *= rz[:n]
            c += g[2 * n :]
            np.tanh(c, out=c)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= rz[n:]
            new += c
            h = new
        return out.transpose(0, 2, 1), h.T, (a, before, below)

    def bounded(self) -> bool:
        """Whether no logit can leave the range in which exponentials are safe; states lie between -1 and 1."""
        p = self.p
        return max(float((np.abs(p["wc"]).sum(0) + np.abs(p["bc"])).max()), float((np.abs(p["wo"]).sum(1) + np.abs(p["bo"])).max())) < 60

    def log_probs(self, hs: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target; with ``grads`` adds the output layer's gradients and returns those of the states.

        Targets are put in order of their classes once; each class is a slice then, with words as the first axis.
        """
        p, size = self.p, self.members
        safe = self.bounded()
        cls = (targets // size).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        cls, word = cls[order].astype(np.int64), (targets % size)[order]
        x, rows = hs[order], np.arange(len(hs))
        logits = p["wc"].T @ x.T
        logits += p["bc"][:, None]
        if not safe:
            logits -= logits.max(0)
        got = logits[cls, rows]
        np.exp(logits, out=logits)
        total = logits.sum(0)
        got -= np.log(total)
        dx = None
        if grads is not None:
            logits /= total
            logits[cls, rows] -= 1
            grads["wc"] += (logits @ x).T
            grads["bc"] += logits.sum(1)
            dx = p["wc"] @ logits
        edges = np.searchsorted(cls, np.arange(self.classes + 1))
        for c in np.flatnonzero(edges[1:] > edges[:-1]):
            lo, hi = edges[c], edges[c + 1]
            own, at = word[lo:hi], np.arange(hi - lo)
            logits = p["wo"][c].T @ x[lo:hi].T
            logits += p["bo"][c][:, None]
            if not safe:
                logits -= logits.max(0)
            chosen = logits[own, at]
            np.exp(logits, out=logits)
            total = logits.sum(0)
            got[lo:hi] += chosen - np.log(total)
            if grads is not None:
                logits /= total
                logits[own, at] -= 1
                grads["wo"][c] += (logits @ x[lo:hi]).T
                grads["bo"][c] += logits.sum(1)
                dx[:, lo:hi] += p["wo"][c] @ logits
        out = np.empty_like(got)
        out[order] = got
        if grads is None:
            return out
        dh = np.empty_like(x)
        dh[order] = dx.T
        return out, dh

    def backward(self, ids, resets, kept, dhs, grads) -> None:
        """Gradients of a window's states, truncated at its start. Those of embeddings are summed per word first."""
        p, n = self.p, self.hidden
        gates, before, below = kept
        dhs = np.ascontiguousarray(dhs.transpose(0, 2, 1))
        da = np.empty_like(gates)
        dg = np.empty_like(gates[0])
        dh = np.zeros_like(dhs[0])
        live = (~resets).astype(dh.dtype)
        for t in range(len(ids) - 1, -1, -1):
            h, r, z, c, x = before[t], gates[t][:n], gates[t][n : 2 * n], gates[t][2 * n :], da[t]
            dh += dhs[t]
            dz = dh * z
            np.subtract(dh, dz, out=x[2 * n :])
            x[2 * n :] *= 1 - c * c
            np.multiply(dz, 1 - z, out=x[n : 2 * n])
            x[n : 2 * n] *= h - c
            np.multiply(x[2 * n :], r, out=dg[2 * n :])
            np.multiply(dg[2 * n :], below[t], out=x[:n])
            x[:n] *= 1 - r
            dg[: 2 * n] = x[: 2 * n]
            grads["u"] += h @ dg.T
            dh = p["u"] @ dg
            dh += dz
            dh *= live[t]
        flat = da.transpose(0, 2, 1).reshape(-1, 3 * n)
        at = ids.reshape(-1)
        order = np.argsort(at.astype(np.int16), kind="stable") if len(p["emb"]) < 1 << 15 else np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums, at = np.add.reduceat(flat[order], starts, axis=0), at[starts]
        grads["wx"] += p["emb"][at].T @ sums
        grads["b"] += sums.sum(0)
        grads["emb"][at] += sums @ p["wx"].T


class Adam:
    def __init__(self, model: Gru, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in model.p.items()}
        self.v = {k: np.zeros_like(x) for k, x in model.p.items()}

    def step(self, grads: dict, clip: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / max(norm, 1e-9))
        even = np.float32(1 / np.sqrt(1 - 0.99**self.t))
        rate = np.float32(self.rate / (1 - 0.9**self.t))
        for k, g in grads.items():
            g *= np.float32(scale)
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            v *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            v += g
            np.sqrt(v, out=g)
            g *= even
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= rate
            self.model.p[k] -= g


def lanes(docs: list[np.ndarray], most: int) -> list[list[int]]:
    """Documents per lane, lanes by falling length; the longest document goes first, each to the shortest lane."""
    heap = [(0, k) for k in range(max(1, min(most, len(docs))))]
    out: list[list[int]] = [[] for _ in heap]
    size = [0] * len(heap)
    for i in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        n, k = heapq.heappop(heap)
        out[k].append(i)
        size[k] = n + len(docs[i])
        heapq.heappush(heap, (size[k], k))
    return [out[k] for k in sorted(range(len(out)), key=lambda k: (-size[k], k))]


def windows(docs: list[np.ndarray], most: int, steps: int):
    """(inputs, resets, targets, document numbers) per window, each (steps, lanes); a target of -1 is no token.

    A lane begins each of ``docs`` anew, with END as its first input. Lanes that are through fall away at the end, so lane
    k stays lane k.
    """
    plan = lanes(docs, most)
    size = [sum(len(docs[i]) for i in lane) for lane in plan]
    longest = size[0] if size else 0
    lane_ids = [np.concatenate([docs[i] for i in lane]) if lane else np.zeros(0, np.int32) for lane in plan]
    lane_doc = [np.repeat(np.array(lane, np.int32), [len(docs[i]) for i in lane]) if lane else np.zeros(0, np.int32) for lane in plan]
    last, owner = np.full(len(plan), END, np.int32), np.full(len(plan), -1, np.int32)
    for at in range(0, longest, steps):
        wide = sum(n > at for n in size)
        deep = min(steps, longest - at)
        targets, doc = np.full((deep, wide), -1, np.int32), np.full((deep, wide), -1, np.int32)
        for k in range(wide):
            part = lane_ids[k][at : at + deep]
            targets[: len(part), k] = part
            doc[: len(part), k] = lane_doc[k][at : at + deep]
        resets = doc != np.concatenate([owner[None, :wide], doc[:-1]])
        inputs = np.concatenate([last[None, :wide], targets[:-1]])
        inputs[resets | (inputs < 0)] = END
        last, owner = targets[-1], doc[-1]
        yield inputs, resets, targets, doc


def score(model: Gru, docs: list[np.ndarray], most: int = 384, steps: int = 32) -> np.ndarray:
    """Natural log probability of each document; its state is carried from its first token to its last."""
    out = np.zeros(len(docs))
    h = None
    for inputs, resets, targets, doc in windows(docs, most, steps):
        h = np.zeros((inputs.shape[1], model.hidden), np.float32) if h is None else h[: inputs.shape[1]]
        hs, h, _ = model.states(inputs, resets, h)
        real = targets >= 0
        out += np.bincount(doc[real], weights=model.log_probs(hs[real], targets[real]).astype(np.float64), minlength=len(docs))
    return out


def train(model: Gru, docs: list[np.ndarray], rate: float = 0.01, most: int = 256, steps: int = 24, opt: Adam | None = None, segment: int = 1024) -> Adam:
    """One pass of truncated backpropagation over the documents, updating the model after each window.

    Longer documents are learnt from in segments, so that lanes stay even; every token is a target once.
    """
    opt, h = opt or Adam(model, rate), None
    parts = [d[at : at + segment] for d in docs for at in range(0, len(d), segment)]
    for inputs, resets, targets, _ in windows(parts, most, steps):
        h = np.zeros((inputs.shape[1], model.hidden), np.float32) if h is None else h[: inputs.shape[1]]
        grads = {k: np.zeros_like(x) for k, x in model.p.items()}
        hs, h, kept = model.states(inputs, resets, h, keep=True)
        real = targets >= 0
        _, dh = model.log_probs(hs[real], targets[real], grads)
        dhs = np.zeros(hs.shape, dh.dtype)
        dhs[real] = dh
        model.backward(inputs, resets, kept, dhs, grads)
        n = np.float32(max(1, real.sum()))
        for g in grads.values():
            g /= n
        opt.step(grads)
    return opt
