"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, state carried across windows.

Token numbers are ranks by falling count, so that a class of the factored softmax is a run of numbers. Documents are laid end to
end in a number of lanes that move on together, one step at a time; a lane's state is zero where a document begins and is
carried from one window to the next until it ends, however long it is.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Units of the state, steps of a window, lanes in training and in scoring.
UNITS, STEPS, TRAIN_LANES, SCORE_LANES = 16, 32, 128, 256
#: Size of the adaptive steps, and what their sums of squares start from.
RATE, START = 0.15, 0.05
#: What gradients are multiplied by.
SCALE = np.float32(1 / 32)
PARAMETERS = ("x", "u", "ug", "oc", "bc", "ow", "bw")


def classes(counts: np.ndarray, n: int) -> np.ndarray:
    """First number of each class, and the end: runs of about equal mass, in square roots of the counts. So a token's class and
    the tokens within it are few together: 24 and 28 on the mean of the sample corpus, where runs of equal counts gave 18 and 64."""
    mass = np.cumsum(np.sqrt(counts)) / max(1, np.sqrt(counts).sum())
    of = np.minimum((np.concatenate([[0], mass[:-1]]) * n).astype(np.int64), n - 1)
    return np.concatenate([np.flatnonzero(np.diff(of, prepend=-1)), [len(counts)]])


@dataclass
class Network:
    edges: np.ndarray  # of the classes
    x: np.ndarray  # what each token adds to update, reset and candidate
    u: np.ndarray  # state to update and reset
    ug: np.ndarray  # state to candidate
    oc: np.ndarray  # state to classes
    bc: np.ndarray
    ow: np.ndarray  # state to tokens within their class
    bw: np.ndarray
    square: dict[str, np.ndarray] = field(default_factory=dict)  # sums of squared gradients

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in PARAMETERS])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in PARAMETERS:
            old = getattr(self, p)
            setattr(self, p, flat[at : at + old.size].reshape(old.shape).astype(np.float32).copy())
            at += old.size


def fresh(counts: np.ndarray, n_classes: int, units: int = UNITS, seed: int = 7) -> Network:
    """A network that predicts by the counts alone."""
    edges = classes(counts, n_classes)
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    mass = np.add.reduceat(counts.astype(float), edges[:-1])
    within = np.log(counts + 1e-9) - np.repeat(np.log(mass + 1e-9), np.diff(edges))
    x = small(len(counts), 3 * units)
    x[:, :units] -= 1.0  # a slow state to begin with
    return Network(
        edges, x, small(units, 2 * units), small(units, units), small(len(edges) - 1, units) * 0.1, np.log(mass + 1e-9).astype(np.float32),
        small(len(counts), units) * 0.1, within.astype(np.float32),
    )


@dataclass
class Lanes:
    """Documents laid out over lanes: inputs, targets and document of every (step, lane); -1 where a lane has ended."""

    inputs: np.ndarray
    targets: np.ndarray
    doc: np.ndarray
    begins: np.ndarray

    @staticmethod
    def of(tokens: np.ndarray, off: np.ndarray, end: int, most: int) -> Lanes:
        """Every document gets ``end`` as its last target and as its first input."""
        sizes = np.diff(off) + 1
        n = int(min(most, max(1, -(-sizes.sum() // max(1, sizes.max(initial=1)))), max(1, len(sizes))))
        ends = [(0, i) for i in range(n)]
        lane, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for d in np.argsort(-sizes, kind="stable").tolist():  # the longest first, each to the shortest lane
            at, i = ends[0]
            lane[d], start[d] = i, at
            heapq.heapreplace(ends, (at + int(sizes[d]), i))
        shape = (max(at for at, _ in ends), n)
        inputs, targets, doc, begins = (np.full(shape, v, kind) for v, kind in ((end, np.int32), (0, np.int32), (-1, np.int32), (False, bool)))
        of = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = step == sizes[of] - 1
        place = (start[of] + step, lane[of])
        said = np.full(len(of), end, np.int64)
        said[~last] = tokens
        targets[place], doc[place], begins[place] = said, of, step == 0
        before = np.where(step == 0, end, np.roll(said, 1))
        inputs[place] = before
        return Lanes(inputs, targets, doc, begins)


@dataclass
class Window:
    """Some steps of all lanes, units before lanes: the state before and after each, gates (update, then reset) and candidates."""

    before: np.ndarray
    gates: np.ndarray
    new: np.ndarray
    after: np.ndarray

    @staticmethod
    def of(net: Network, lanes: Lanes, a: int, z: int, state: np.ndarray) -> Window:
        units, n = state.shape
        x = np.ascontiguousarray(net.x[lanes.inputs[a:z]].transpose(0, 2, 1))
        x[:, : 2 * units] *= -1
        u, ug = np.ascontiguousarray(-net.u.T), np.ascontiguousarray(net.ug.T)
        before, new, after = (np.empty((z - a, units, n), np.float32) for _ in range(3))
        gates, held = np.empty((z - a, 2 * units, n), np.float32), np.empty((units, n), np.float32)
        for t, any_begins in enumerate(lanes.begins[a:z].any(axis=1).tolist()):
            b, g, c = before[t], gates[t], new[t]
            b[:] = state
            if any_begins:
                b[:, lanes.begins[a + t]] = 0
            np.matmul(u, b, out=g)
            g += x[t, : 2 * units]
            np.exp(np.minimum(g, 80, out=g), out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[units:], b, out=held)
            np.matmul(ug, held, out=c)
            c += x[t, 2 * units :]
            np.tanh(c, out=c)
            state = after[t]
            np.subtract(c, b, out=state)
            state *= g[:units]
            state += b
        return Window(before, gates, new, after)

    def states(self) -> np.ndarray:
        """The states after each step, a row for each (step, lane)."""
        return self.after.transpose(0, 2, 1)

    def gradients(self, net: Network, back: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients by what the inputs add (a row for each (step, lane)), ``u`` and ``ug`` from those by the states, which are used up."""
        units = net.ug.shape[0]
        update, reset = self.gates[:, :units], self.gates[:, units:]
        stay = 1 - update
        by_new = update * (1 - self.new * self.new)
        by_update = (self.new - self.before) * update * stay
        by_reset = self.before * reset * (1 - reset)
        dx = np.empty((len(back), 3 * units, back.shape[2]), np.float32)
        carried, held = np.zeros(back.shape[1:], np.float32), np.empty(back.shape[1:], np.float32)
        any_begins = begins.any(axis=1).tolist()
        for t in range(len(back) - 1, -1, -1):
            d, own = back[t], dx[t]
            d += carried
            np.multiply(d, by_new[t], out=own[2 * units :])
            np.matmul(net.ug, own[2 * units :], out=held)
            np.multiply(d, by_update[t], out=own[:units])
            np.multiply(held, by_reset[t], out=own[units : 2 * units])
            np.matmul(net.u, own[: 2 * units], out=carried)
            d *= stay[t]
            held *= reset[t]
            carried += d
            carried += held
            if any_begins[t]:
                carried[:, begins[t]] = 0
        rows = np.ascontiguousarray(dx.transpose(0, 2, 1))
        du = np.matmul(self.before, rows[:, :, : 2 * units]).sum(axis=0)
        dug = np.matmul(reset * self.before, rows[:, :, 2 * units :]).sum(axis=0)
        return rows.reshape(-1, 3 * units), du, dug


def _with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([w, b[:, None]], axis=1)


def _with_ones(states: np.ndarray) -> np.ndarray:
    return np.concatenate([states, np.ones((len(states), 1), np.float32)], axis=1)


def _exponentials(states: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits up to one common factor, and their sums by row. One bound replaces each row's maximum: the
    greatest is e**40, and only rows that lie below it by a factor of e**120 would lose theirs."""
    logits = states @ w.T
    logits -= logits.max() - 40
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(len(w), np.float32) + np.float32(1e-37)


def _picked(states: np.ndarray, w: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Log softmax at one place of each row."""
    e, total = _exponentials(states, w)
    return np.log((e[np.arange(len(of)), of] + np.float32(1e-37)) / total).astype(np.float64)


def _by_class(net: Network, targets: np.ndarray):
    """(order of the targets by class, class of each in that order, and of each class that occurs: its tokens' range and its run)."""
    of = np.repeat(np.arange(len(net.edges) - 1, dtype=np.uint16), np.diff(net.edges))[targets]
    order = np.argsort(of, kind="stable")
    of = of[order]
    cuts = np.searchsorted(of, np.arange(len(net.edges)))
    runs = [(int(net.edges[c]), int(net.edges[c + 1]), slice(int(cuts[c]), int(cuts[c + 1]))) for c in np.flatnonzero(np.diff(cuts)).tolist()]
    return order, of, runs


def log_probabilities(net: Network, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after its state: that of its class times that within the class."""
    if not len(targets):
        return np.zeros(0)
    order, of, runs = _by_class(net, targets)
    states, said, ow = _with_ones(states[order]), targets[order], _with_bias(net.ow, net.bw)
    found = _picked(states, _with_bias(net.oc, net.bc), of)
    for lo, hi, at in runs:
        if hi - lo > 1:
            found[at] += _picked(states[at], ow[lo:hi], said[at] - lo)
    out = np.empty(len(found))
    out[order] = found
    return out


def score(net: Network, tokens: np.ndarray, off: np.ndarray, end: int, lanes: int = SCORE_LANES) -> np.ndarray:
    """Natural log probability of each whole document and its end."""
    out = np.zeros(len(off) - 1)
    if not len(out):
        return out
    laid = Lanes.of(tokens, off, end, lanes)
    state = np.zeros((net.ug.shape[0], laid.doc.shape[1]), np.float32)
    for a in range(0, len(laid.doc), STEPS):
        z = min(a + STEPS, len(laid.doc))
        window = Window.of(net, laid, a, z, state)
        state = window.after[-1]
        doc = laid.doc[a:z]
        on = doc >= 0
        out += np.bincount(doc[on], log_probabilities(net, window.states()[on], laid.targets[a:z][on]), len(out))
    return out


def _step(net: Network, name: str, grad: np.ndarray, rows=slice(None)) -> None:
    """An adaptive gradient step on some rows of a parameter."""
    own = getattr(net, name)
    if name not in net.square:
        net.square[name] = np.full(own.shape, START, np.float32)
    seen = net.square[name][rows] + grad * grad
    net.square[name][rows] = seen
    own[rows] -= RATE * grad / np.sqrt(seen)


def _softmax_gradients(states: np.ndarray, w: np.ndarray, of: np.ndarray, by_w: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of a softmax's loss by the states, and the loss; that by the weights goes to ``by_w``."""
    d, total = _exponentials(states, w)
    at = np.arange(len(of))
    loss = -float(np.log((d[at, of] + np.float32(1e-37)) / total).sum(dtype=np.float64))
    d *= (SCALE / total)[:, None]
    d[at, of] -= SCALE
    np.matmul(d.T, states, out=by_w)
    return d @ w, loss


def _learn_output(net: Network, states: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the loss by the states; the output layer takes its step."""
    order, of, runs = _by_class(net, targets)
    states, said, ow, oc = _with_ones(states[order]), targets[order], _with_bias(net.ow, net.bw), _with_bias(net.oc, net.bc)
    by_ow, by_oc = np.zeros_like(ow), np.empty_like(oc)
    found, loss = _softmax_gradients(states, oc, of, by_oc)
    for lo, hi, at in runs:
        if hi - lo > 1:
            more, lost = _softmax_gradients(states[at], ow[lo:hi], said[at] - lo, by_ow[lo:hi])
            found[at] += more
            loss += lost
    for w, b, grad in (("oc", "bc", by_oc), ("ow", "bw", by_ow)):
        _step(net, w, grad[:, :-1])
        _step(net, b, grad[:, -1])
    back = np.empty((len(found), found.shape[1] - 1), np.float32)
    back[order] = found[:, :-1]
    return back, loss


def train(net: Network, tokens: np.ndarray, off: np.ndarray, end: int, lanes: int = TRAIN_LANES) -> tuple[float, int]:
    """One pass over the documents in windows of truncated backpropagation: (loss before each step, tokens)."""
    if len(off) < 2:
        return 0.0, 0
    laid = Lanes.of(tokens, off, end, lanes)
    state = np.zeros((net.ug.shape[0], laid.doc.shape[1]), np.float32)
    total, n = 0.0, 0
    for a in range(0, len(laid.doc), STEPS):
        z = min(a + STEPS, len(laid.doc))
        window = Window.of(net, laid, a, z, state)
        state = window.after[-1]
        on = laid.doc[a:z] >= 0
        back = np.zeros((*on.shape, len(state)), np.float32)
        back[on], loss = _learn_output(net, window.states()[on], laid.targets[a:z][on])
        total, n = total + loss, n + int(on.sum())
        dx, du, dug = window.gradients(net, np.ascontiguousarray(back.transpose(0, 2, 1)), laid.begins[a:z])
        said = laid.inputs[a:z].ravel().astype(np.uint16 if len(net.x) <= 1 << 16 else np.int32)
        order = np.argsort(said, kind="stable")
        said = said[order]
        first = np.flatnonzero(np.diff(said.astype(np.int32), prepend=-1))
        _step(net, "x", np.add.reduceat(dx[order], first), said[first])
        _step(net, "u", du)
        _step(net, "ug", dug)
    return total, n
