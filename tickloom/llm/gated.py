"""A gated recurrent network over word streams in numpy: class-factored softmax, truncated backpropagation, carried state.

An output is a class and a word inside it. Head classes hold HEAD frequent words, learned
by a softmax each; tail classes are drawn by the network like the others, and the word
inside a tail class has a probability from counts, which the caller knows.
"""

from __future__ import annotations

import heapq

import numpy as np

CLASS_WORDS, HEAD_CLASSES, TAIL_CLASSES, HIDDEN = 64, 32, 32, 24
HEAD = CLASS_WORDS * HEAD_CLASSES
CLASSES = HEAD_CLASSES + TAIL_CLASSES
INPUTS = HEAD + TAIL_CLASSES
#: Steps of one window of backpropagation and of scoring, lanes at most, and updates that a small corpus gets at least.
STEPS, SCORE_STEPS, LANES, UPDATES = 32, 32, 256, 150
#: Weights by name; the last input row of Wc and Wo is the bias.
SHAPES = {"Wx": (3 * HIDDEN, INPUTS), "U": (3 * HIDDEN, HIDDEN), "b": (3 * HIDDEN,), "Wc": (HIDDEN + 1, CLASSES), "Wo": (HEAD_CLASSES, HIDDEN + 1, CLASS_WORDS)}
#: Scores of greater size than this are shifted before they are exponentiated.
SAFE = 80
PAD = 16
Params = dict[str, np.ndarray]


def initial(head_counts: np.ndarray, tail_masses: np.ndarray, seed: int = 5) -> Params:
    """Small random weights; biases that make the untrained network the unigram model. head_counts are 0 for free places."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.08).astype(np.float32) for k, s in SHAPES.items()}
    masses = np.where(head_counts > 0, head_counts + 0.1, 1e-6).reshape(HEAD_CLASSES, CLASS_WORDS)
    p["b"][:] = 0
    p["Wc"] *= 0.3
    p["Wo"] *= 0.3
    p["Wo"][:, -1] = np.log(masses / masses.sum(1, keepdims=True))
    p["Wc"][-1] = np.log(np.concatenate((masses.sum(1), tail_masses)) / (masses.sum() + tail_masses.sum()))
    return p


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(v: np.ndarray) -> Params:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32).copy()
        at += n
    return out


class Lanes:
    """Documents dealt to parallel lanes, longest first to the lane that is shortest; each lane is one stream in time."""

    def __init__(self, docs: list[np.ndarray], most: int) -> None:
        sizes = np.array([len(d) for d in docs])
        lanes = int(max(1, min(most, sizes.sum() // max(1, sizes.max()))))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for i in np.argsort(-sizes, kind="stable").tolist():
            load, k = heapq.heappop(heap)
            held[k].append(i)
            heapq.heappush(heap, (load + int(sizes[i]), k))
        length = max(load for load, _ in heap)
        self.target = np.zeros((length, lanes), np.int32)
        self.doc = np.full((length, lanes), -1, np.int32)
        self.first = np.zeros((length, lanes), bool)
        for k, these in enumerate(held):
            if these:
                n = int(sizes[these].sum())
                self.target[:n, k] = np.concatenate([docs[i] for i in these])
                self.doc[:n, k] = np.repeat(these, sizes[these])
                self.first[np.concatenate(([0], np.cumsum(sizes[these])[:-1])), k] = True


class Network:
    """Weights and the passes over windows. Arrays hold features by row and lanes, or steps and lanes, by column, so that every operation runs over long rows."""

    def __init__(self, p: Params, end: int) -> None:
        self.end, self.updates = end, 0
        self.theta = flat(p)
        self.p, at = {}, 0
        for k, shape in SHAPES.items():
            n = int(np.prod(shape))
            self.p[k] = self.theta[at : at + n].reshape(shape)
            at += n
        self.first, self.second = np.zeros_like(self.theta), np.zeros_like(self.theta)
        self.buffers: dict[str, np.ndarray] = {}

    def _buffer(self, name: str, rows: int, columns: int) -> np.ndarray:
        """Memory for one array of a window, used again by the next. Rows are PAD apart, so that their starts do not share cache lines' places."""
        n, held = rows * (columns + PAD), self.buffers.get(name)
        if held is None or len(held) < n:
            held = self.buffers[name] = np.empty(n, self.theta.dtype)
        return held[:n].reshape(rows, -1)[:, :columns]

    def _steps(self, name: str, steps: int, rows: int, lanes: int) -> np.ndarray:
        return self._buffer(name, 1, steps * rows * lanes)[0].reshape(steps, rows, lanes)

    def _run(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, learn: bool) -> dict[str, np.ndarray]:
        """States h after each step of a window of inputs x (steps, lanes) from the state h, as (step, feature, lane); what backpropagation needs too if asked."""
        p, (steps, lanes), n = self.p, x.shape, HIDDEN
        table = p["Wx"] + p["b"][:, None]
        out, kept = self._steps("h", steps, n, lanes), steps if learn else 1
        s = {"h": out, "gates": self._steps("gates", kept, 2 * n, lanes), **{k: self._steps(k, kept, n, lanes) for k in ("hp", "c")}, "g": self._steps("g", kept, 3 * n, lanes)}
        own, u, whole = self._steps("input", 1, 3 * n, lanes)[0], p["U"], (keep.min(1) == 1).tolist()
        first, candidate = own[: 2 * n], own[2 * n :]
        with np.errstate(over="ignore"):  # a closed gate
            for t, new in enumerate(out):
                if t < kept:
                    hp, gates, c, g = s["hp"][t], s["gates"][t], s["c"][t], s["g"][t]
                    z, r, opened, pulled = gates[:n], gates[n:], g[: 2 * n], g[2 * n :]
                if not whole[t]:
                    h = np.multiply(h, keep[t], out=hp)
                elif learn:
                    hp[...] = h
                np.take(table, x[t], axis=1, out=own, mode="clip")
                np.matmul(u, h, out=g)
                np.add(first, opened, out=gates)
                np.exp(gates, out=gates)
                np.add(gates, 1, out=gates)
                np.reciprocal(gates, out=gates)
                np.multiply(r, pulled, out=c)
                np.add(c, candidate, out=c)
                np.tanh(c, out=c)
                np.subtract(h, c, out=new)
                np.multiply(new, z, out=new)
                np.add(new, c, out=new)
                h = new
        return s

    @staticmethod
    def _normalised(scores: np.ndarray, bound: float, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(scores), in place, and its sums by column; the first result is each column's log probability of row at."""
        if bound > SAFE:
            scores -= scores.max(0)
        own = scores[at, np.arange(scores.shape[1])]
        np.exp(scores, out=scores)
        sums = np.ones(len(scores), scores.dtype) @ scores
        return own - np.log(sums), sums

    def _outputs(self, states: np.ndarray, target: np.ndarray, live: np.ndarray | None, grads: Params | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target's class and head word; with grads, also the loss's gradient at the states. Columns outside live are no targets."""
        p, n, columns = self.p, HIDDEN, len(target)
        h = self._buffer("states", n + 1, columns)
        h[:n] = states.transpose(1, 0, 2).reshape(n, columns)
        h[n] = 1
        cls = np.where(target < HEAD, target // CLASS_WORDS, target - HEAD + HEAD_CLASSES)
        scores = np.matmul(p["Wc"].T, h, out=self._buffer("classes", CLASSES, columns))
        logs, sums = self._normalised(scores, np.abs(p["Wc"]).sum(0).max(), cls)
        out, dh = logs.astype(np.float64), None
        if live is not None:
            out *= live
        if grads is not None:
            scores *= 1 / sums if live is None else live / sums
            scores[cls, np.arange(columns)] -= 1 if live is None else live
            np.matmul(h, scores.T, out=grads["Wc"])
            dh = np.matmul(p["Wc"][:n], scores, out=self._buffer("dh", n, columns))
        at = np.flatnonzero(target < HEAD if live is None else (target < HEAD) & (live > 0))
        at = at[np.argsort(cls[at].astype(np.uint8), kind="stable")]
        if not len(at):
            return out, dh
        ends = np.searchsorted(cls[at], np.arange(HEAD_CLASSES + 1))
        own = np.take(h, at, axis=1, out=self._buffer("own", n + 1, len(at)), mode="clip")
        words, runs = self._buffer("words", CLASS_WORDS, len(at)), [(k, slice(ends[k], ends[k + 1])) for k in range(HEAD_CLASSES) if ends[k] < ends[k + 1]]
        for k, run in runs:
            np.matmul(p["Wo"][k].T, own[:, run], out=words[:, run])
        row = target[at] % CLASS_WORDS
        logs, sums = self._normalised(words, np.abs(p["Wo"]).sum(1).max(), row)
        out[at] += logs
        if grads is not None:
            words *= 1 / sums
            words[row, np.arange(len(at))] -= 1
            back = self._buffer("back", n, len(at) + 1)
            for k, run in runs:
                np.matmul(own[:, run], words[:, run].T, out=grads["Wo"][k])
                np.matmul(p["Wo"][k, :n], words[:, run], out=back[:, run])
            back[:, -1] = 0
            place = np.full(columns, len(at))
            place[at] = np.arange(len(at))
            dh += np.take(back, place, axis=1, out=self._buffer("spread", n, columns), mode="clip")
        return out, dh

    def _back(self, s: dict[str, np.ndarray], x: np.ndarray, keep: np.ndarray, dh_all: np.ndarray, grads: Params) -> None:
        """Gradients of the recurrent weights and inputs, from the gradient at each step's state."""
        p, n, (steps, lanes) = self.p, HIDDEN, x.shape
        z, r, c, hp, q = s["gates"][:, :n], s["gates"][:, n:], s["c"], s["hp"], s["g"][:, 2 * n :]
        dx, dq = self._buffer("dx", 3 * n, steps * lanes), self._steps("dq", steps, n, lanes)
        # What a step's gradient at h is multiplied with: at the candidate, at the update gate, and the candidate's at the reset gate.
        to_c = np.multiply(c, c, out=self._steps("to_c", steps, n, lanes))
        np.subtract(1, to_c, out=to_c)
        to_c *= np.subtract(1, z, out=dq)
        to_z = np.subtract(c, hp, out=self._steps("to_z", steps, n, lanes))
        dq *= z
        to_z *= dq
        to_r = np.subtract(r, 1, out=self._steps("to_r", steps, n, lanes))
        to_r *= r
        to_r *= q
        dh, d, whole = np.zeros((n, lanes), dx.dtype), np.empty((3 * n, lanes), dx.dtype), (keep.min(1) == 1).tolist()
        ut, more, (d_z, d_r, d_c) = np.ascontiguousarray(p["U"].T), np.empty_like(dh), (d[:n], d[n : 2 * n], d[2 * n :])
        for t in range(steps - 1, -1, -1):
            at = slice(t * lanes, (t + 1) * lanes)
            np.add(dh, dh_all[:, at], out=dh)
            np.multiply(dh, to_c[t], out=d_c)
            np.multiply(dh, to_z[t], out=d_z)
            np.multiply(d_c, to_r[t], out=d_r)
            dx[:, at] = d
            np.multiply(d_c, r[t], out=d_c)
            dq[t] = d_c
            if t:
                np.multiply(dh, z[t], out=dh)
                np.add(dh, np.matmul(ut, d, out=more), out=dh)
                if not whole[t]:
                    np.multiply(dh, keep[t], out=dh)
        # What the gates' and the candidate's rows of U are multiplied with lies in hp; the candidate's part went through the reset gate.
        before = self._buffer("states", n, steps * lanes)
        before[...] = hp.transpose(1, 0, 2).reshape(n, -1)
        np.matmul(dx[: 2 * n], before.T, out=grads["U"][: 2 * n])
        inner = self._buffer("own", n, steps * lanes)
        inner[...] = dq.transpose(1, 0, 2).reshape(n, -1)
        np.matmul(inner, before.T, out=grads["U"][2 * n :])
        dx.sum(1, out=grads["b"])
        ids = x.ravel().astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        begins = np.flatnonzero(np.diff(ids[order].astype(np.int32), prepend=-1))
        grads["Wx"][:] = 0
        sorted_ = np.take(dx, order, axis=1, out=self._buffer("inputs", 3 * n, steps * lanes), mode="clip")
        grads["Wx"][:, ids[order][begins]] = np.add.reduceat(sorted_, begins, axis=1)

    def _update(self, g: np.ndarray, tokens: int, rate: float) -> None:
        self.updates += 1
        norm = float(np.sqrt(g @ g)) / tokens
        g *= np.float32(min(1.0, 1.0 / max(norm, 1e-12)) / tokens)
        step = rate * np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates)
        work = self._buffer("work", 1, len(g))[0]
        self.first *= np.float32(0.9)
        self.first += np.multiply(g, np.float32(0.1), out=work)
        g *= g
        self.second *= np.float32(0.999)
        self.second += np.multiply(g, np.float32(0.001), out=work)
        np.sqrt(self.second, out=work)
        work += np.float32(1e-7)
        np.divide(self.first, work, out=work)
        work *= np.float32(step)
        self.theta -= work

    def gradients(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, target: np.ndarray, live: np.ndarray | None, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of a window's targets and the states after it; the gradient of their negative sum goes to g, which is flat like theta."""
        grads, at = {}, 0
        for k, shape in SHAPES.items():
            n = int(np.prod(shape))
            grads[k] = g[at : at + n].reshape(shape)
            at += n
        grads["Wo"][:] = 0
        s = self._run(x, keep, h, learn=True)
        logs, dh = self._outputs(s["h"], target, live, grads)
        self._back(s, x, keep, dh, grads)
        return logs, s["h"][-1]

    def stream(self, docs: list[np.ndarray], rate: float | None = None) -> np.ndarray:
        """Natural log probability of each document; with a rate, the network learns from each window after it has read it.

        A document starts from the zero state and the end symbol; state passes from window
        to window, so its probability is that of the complete text, and gradients stop at
        a window's start.
        """
        lanes = Lanes(docs, LANES if rate is None else max(8, min(LANES, sum(map(len, docs)) // (STEPS * UPDATES))))
        length, width = lanes.target.shape
        previous = np.vstack((np.full((1, width), self.end, np.int32), lanes.target[:-1]))
        previous[lanes.first] = self.end
        h, out = np.zeros((HIDDEN, width), self.theta.dtype), np.zeros(len(docs))
        steps, g = SCORE_STEPS if rate is None else STEPS, np.zeros_like(self.theta)
        for t in range(0, length, steps):
            x, doc = previous[t : t + steps], lanes.doc[t : t + steps].ravel()
            keep, target = (~lanes.first[t : t + steps]).astype(self.theta.dtype), lanes.target[t : t + steps].ravel()
            live = None if doc.min() >= 0 else (doc >= 0).astype(self.theta.dtype)
            if rate is None:
                states = self._run(x, keep, h, learn=False)["h"]
                (logs, _), h = self._outputs(states, target, live, None), states[-1]
            else:
                logs, h = self.gradients(x, keep, h, target, live, g)
                self._update(g, len(doc) if live is None else int(live.sum()), rate)
            out += np.bincount(np.maximum(doc, 0), logs, len(docs))
            h = h.copy()
        return out
