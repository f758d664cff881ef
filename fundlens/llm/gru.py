"""A small gated recurrent network with a class-factored output, in numpy."""

from __future__ import annotations

import numpy as np

HIDDEN = 32
#: Frequent words have a softmax inside their class; classes of rare words share out their probability by counts.
WORDS = 2048
IN_CLASS = 32
RARE = 96
WINDOW = 16
LANES = 128
RATE = 0.05
#: States whose outputs are worked out together: small enough for the processor's cache.
FLUSH = 4096
ROWS = 512
#: Rows of a key up to which they are added up for all keys at once.
FEW = 8


def _safe(logits: np.ndarray) -> np.ndarray:
    """Logits whose exponentials neither overflow nor vanish; they rarely need it."""
    if -60 < logits.min() and logits.max() < 60:
        return logits
    return logits - logits.max(axis=1, keepdims=True)


def _softmax(logits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of each row's own place, the exponentials, in the place of the logits, and their sums."""
    rows = np.arange(len(own))
    out = logits[rows, own].astype(float)
    p = np.exp(logits, out=logits)
    total = p @ np.ones(p.shape[1], p.dtype)  # a product sums up rows faster than sum()
    out -= np.log(total)
    return out, p, total


def _less_own(p: np.ndarray, total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What the logits' gradient is: probabilities, less one at each row's own place."""
    p *= (1 / total)[:, None]
    p[np.arange(len(own)), own] -= 1
    return p


def _sums(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, in order, and for each the sum of its rows.

    Most keys have a few rows: those are added up one after the other, for all keys at once; only the others are added key by key.
    """
    order = np.argsort(keys.astype(np.int16), kind="stable")  # inputs are few; short numbers sort faster
    starts = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
    sizes = np.diff(np.append(starts, len(keys)))
    out = rows.take(order[starts], axis=0)
    for k in range(1, FEW):
        more = np.flatnonzero((sizes > k) & (sizes <= FEW))
        if not len(more):
            break
        out[more] += rows.take(order[starts[more] + k], axis=0)
    for k in np.flatnonzero(sizes > FEW):
        some = rows.take(order[starts[k] : starts[k] + sizes[k]], axis=0)
        out[k] = np.ones(len(some), np.float32) @ some
    return keys[order[starts]], out


class Net:
    """P(word | state) = P(class | state) P(word | class, state). Inputs: frequent words, then classes of rare words."""

    SHAPES = {"x": (WORDS + RARE, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, WORDS // IN_CLASS + RARE), "cb": (WORDS // IN_CLASS + RARE,), "w": (WORDS // IN_CLASS, HIDDEN, IN_CLASS), "wb": (WORDS // IN_CLASS, IN_CLASS)}

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            setattr(self, name, flat[at : (at := at + int(np.prod(shape)))].reshape(shape))

    @classmethod
    def fresh(cls, class_mass: np.ndarray, word_mass: np.ndarray) -> Net:
        """Random weights; biases make it the unigram model of the given masses."""
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES.values()), np.float32))
        rng = np.random.default_rng(5)
        net.x[:] = rng.normal(0, 0.3, net.x.shape)
        net.u[:] = rng.normal(0, 0.18, net.u.shape)
        net.cb[:] = np.log(class_mass)
        net.wb[:] = np.log(word_mass)
        return net

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """What inputs and states add to the two gates and the candidate, each of them in one piece."""
        return (np.ascontiguousarray(t.reshape(len(t), 3, HIDDEN).transpose(1, 0, 2)) for t in (self.x, self.u))

    def step(self, word: np.ndarray, h: np.ndarray, parts=None, out: np.ndarray | None = None):
        """The next state, and the gates and the candidate, by what the state adds to it. parts: gates(), for many steps; out: room for them."""
        xs, us = parts or self.gates()
        g = np.empty((3, *h.shape), np.float32) if out is None else out
        for k in range(3):
            xs[k].take(word, axis=0, out=g[k], mode="clip")
        u = np.matmul(h, us)
        zr, z, r, n, un = g[:2], g[0], g[1], g[2], u[2]
        zr += u[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n += np.multiply(r, un, out=u[0])
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, (g, un)

    def log_p(self, h: np.ndarray, cls: np.ndarray, inside: np.ndarray, grads: Net | None = None):
        """Natural log probability of class and, for frequent words, of the word inside it (else 0). With grads: adds to them, returns dh too."""
        out = np.empty(len(cls))
        dh = None if grads is None else np.empty_like(h)
        back = None if grads is None else np.ascontiguousarray(self.c.T)
        for a in range(0, len(cls), ROWS):
            some, own = h[a : a + ROWS], cls[a : a + ROWS]
            logits = some @ self.c
            logits += self.cb
            out[a : a + ROWS], p, total = _softmax(_safe(logits), own)
            if grads is not None:
                p = _less_own(p, total, own)
                grads.c += some.T @ p
                grads.cb += np.ones(len(p), np.float32) @ p
                np.matmul(p, back, out=dh[a : a + ROWS])
        frequent = np.flatnonzero(inside >= 0)
        of = cls[frequent].astype(np.int16)
        order = frequent[np.argsort(of, kind="stable")]
        if not len(order):
            return out if grads is None else (out, dh)
        edges = np.append(0, np.cumsum(np.bincount(of, minlength=WORDS // IN_CLASS)))
        full = np.flatnonzero(np.diff(edges)).tolist()
        hs, own = h.take(order, axis=0), inside[order]
        logits = self.wb.take(cls[order], axis=0)
        for k in full:
            at = slice(edges[k], edges[k + 1])
            logits[at] += hs[at] @ self.w[k]
        inner, p, total = _softmax(_safe(logits), own)
        out[order] += inner
        if grads is None:
            return out
        p, more = _less_own(p, total, own), np.empty_like(hs)
        for k in full:
            at = slice(edges[k], edges[k + 1])
            grads.w[k] += hs[at].T @ p[at]
            np.matmul(p[at], self.w[k].T, out=more[at])
        grads.wb[full] += np.add.reduceat(p, edges[full], axis=0)
        dh[order] += more
        return out, dh


def lanes(sizes: np.ndarray, n: int) -> list[np.ndarray]:
    """Documents dealt to at most n lanes of even length, longest first; lanes in descending order of length."""
    import heapq

    heap = [(0, k) for k in range(min(n, len(sizes)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        filled, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (filled + int(sizes[d]), k))
    total = [int(sizes[x].sum()) for x in dealt]
    return [np.array(dealt[k]) for k in sorted(range(len(dealt)), key=lambda k: -total[k])]


class Streams:
    """Documents laid out in lanes. words: their model inputs one after another, each document closed by the end word.

    Position i of a document predicts words[i] from what precedes it; its first input is the end word (0), and the
    state is fresh there. `at` maps (step, lane) to positions in the flat arrays.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray, n: int):
        sizes = np.diff(bounds)
        self.words, self.first = words, np.zeros(len(words) + 1, bool)
        self.first[bounds[:-1]] = True
        self.inputs = np.append(0, words[:-1]) if len(words) else words
        self.inputs = np.where(self.first[:-1], 0, self.inputs)
        self.lanes = [np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in lane]) for lane in lanes(sizes, n)]
        self.lengths = np.array([len(x) for x in self.lanes])

    def window(self, a: int, b: int, n: int) -> np.ndarray:
        return np.array([lane[a:b] for lane in self.lanes[:n]]).T


def score(net: Net, streams: Streams, cls: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Natural log probability of each position's class and word; states are carried from window to window to each document's end."""
    out = np.zeros(len(streams.words))
    if not len(streams.words):
        return out
    h = np.zeros((len(streams.lanes), HIDDEN), np.float32)
    states, places = [], []
    held, parts = 0, tuple(net.gates())
    cuts = np.unique(np.append(streams.lengths, np.arange(0, streams.lengths[0] + 1, 512)))
    cuts = np.unique(np.append(0, cuts))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = int((streams.lengths > a).sum())
        at = streams.window(int(a), int(b), n)
        words, fresh = streams.inputs[at], streams.first[at]
        begins = fresh.any(axis=1)
        h = h[:n]
        for t in range(len(at)):
            if begins[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            h, _ = net.step(words[t], h, parts)
            states.append(h)
            places.append(at[t])
            held += n
            if held >= FLUSH:
                p = np.concatenate(places)
                out[p] = net.log_p(np.concatenate(states), cls[p], inside[p])
                states, places, held = [], [], 0
    if held:
        p = np.concatenate(places)
        out[p] = net.log_p(np.concatenate(states), cls[p], inside[p])
    return out


def train(net: Net, memory: np.ndarray, streams: Streams, cls: np.ndarray, inside: np.ndarray) -> float:
    """One pass of truncated backpropagation, WINDOW steps back; Adagrad with its memory. Returns the mean loss.

    A lane's last window is shorter: its missing steps are masked, so every token counts once.
    """
    grads = Net(np.zeros_like(net.flat))
    rest = slice(net.x.size, None)  # of the input words only those of the window have gradients
    memory_x = memory[: net.x.size].reshape(net.x.shape)
    h = np.zeros((len(streams.lanes), HIDDEN), np.float32)
    loss, seen = 0.0, 0
    for a in range(0, int(streams.lengths[0]) if len(streams.lengths) else 0, WINDOW):
        n = int((streams.lengths > a).sum())
        steps = min(WINDOW, int(streams.lengths[0]) - a)
        at = np.zeros((steps, n), np.int64)
        real = np.arange(a, a + steps)[:, None] < streams.lengths[None, :n]
        at.T[real.T] = np.concatenate([lane[a : a + steps] for lane in streams.lanes[:n]])
        words, fresh = streams.inputs[at], streams.first[at]
        begins = fresh.any(axis=1)
        h = h[:n]
        parts = tuple(net.gates())
        before, un, states = (np.empty((steps, n, HIDDEN), np.float32) for _ in range(3))
        gates = np.empty((steps, 3, n, HIDDEN), np.float32)
        for t in range(steps):
            if begins[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            before[t] = h
            h, (_, un[t]) = net.step(words[t], h, parts, gates[t])
            states[t] = h
        p, mask = at[real], real.ravel()
        whole = bool(mask.all())
        flat_states = states.reshape(steps * n, HIDDEN)
        lp, some_dh = net.log_p(flat_states if whole else flat_states[mask], cls[p], inside[p], grads)
        loss -= lp.sum()
        seen += len(p)
        if whole:
            dh = some_dh.reshape(steps, n, HIDDEN)
        else:
            dh = np.zeros((steps * n, HIDDEN), np.float32)
            dh[mask] = some_dh  # what is masked comes after a lane's tokens and sends nothing back
            dh = dh.reshape(steps, n, HIDDEN)
        back, dx, du = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, 3, HIDDEN), np.float32), np.empty((3, steps, n, HIDDEN), np.float32)
        turned = np.ascontiguousarray(parts[1].transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            z, r, m = gates[t]
            d = back
            d += dh[t]
            less = d * z  # what the state before gets
            dn = np.subtract(d, less, out=d)
            gz, gr, gn = du[0, t], du[1, t], du[2, t]
            np.subtract(before[t], m, out=gz)
            gz *= less
            np.multiply(gz, z, out=z)
            gz -= z
            m *= m
            np.subtract(1, m, out=m)
            dn *= m
            dx[t, :, 2] = dn
            np.multiply(dn, r, out=gn)
            np.multiply(gn, r, out=r)
            np.subtract(gn, r, out=gr)
            gr *= un[t]
            turn = np.matmul(du[:, t], turned)
            back = turn[0]
            back += turn[1]
            back += turn[2]
            back += less
            if begins[t]:
                back[fresh[t]] = 0
        dx[:, :, 0], dx[:, :, 1] = du[0], du[1]
        all_before = before.reshape(steps * n, HIDDEN).T
        for k in range(3):
            grads.u[:, k * HIDDEN : (k + 1) * HIDDEN] += all_before @ du[k].reshape(steps * n, HIDDEN)
        flat = dx.reshape(steps * n, 3 * HIDDEN)
        some, gx = _sums(flat if whole else flat[mask], words[real])
        scale = np.float32(WINDOW / len(p))
        for g, held, value, put in ((gx, memory_x[some], net.x, some), (grads.flat[rest], memory[rest], net.flat, rest)):
            g *= scale
            square = g * g
            held += square
            np.sqrt(held, out=square)
            square += np.float32(1e-4)
            g *= np.float32(RATE)
            g /= square
            value[put] -= g
            if put is some:
                memory_x[some] = held
        grads.flat[rest] = 0
    return loss / max(seen, 1)
