"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

The model reads and predicts units, every word being of one. The softmax is factored thrice: ``side`` classes of
``side`` words each, those ranked first by count, and ``side`` classes of ``side`` buckets each, which have ``leaves``
units each: most of them words of their own, the next by count, the others shared by a hash, where shares within a
unit are counted, not learned. So the number of units is about ``1 + LEAVES`` times the square root of the vocabulary,
which keeps the weights, that every task holds, to a share of it. With one leaf a bucket is one unit. The cell has one
gate, which decides how much of the old state goes into the candidate and how much of the candidate into the new state.
Targets are sorted, so that those of a class or a bucket are rows next to one another, and its weights are read once.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: The state, and with it a constant that carries the biases of the softmax.
HIDDEN = 11
OUT = HIDDEN + 1
#: A side is at least so long.
SIDE = 32
#: Units of a bucket.
LEAVES = 32
WINDOW = 8
STREAMS = 512
RATE = 1.4e-2
#: Rows whose softmax is taken at a time, so that it stays in the cache.
BLOCK = 2048
#: Rows whose softmax is taken by one walk through all classes and buckets in scoring; the more, the more of them share a product.
ROWS = 1 << 17
#: The rate of the buckets' units, whose steps are scaled by the squares of all their gradients so far, a mean for each bucket.
LEAF_RATE = 0.03

Weights = dict[str, np.ndarray]


def side_of(vocabulary: int) -> int:
    """Classes of words, and words or buckets of a class: their product is about the square root of the vocabulary."""
    return max(SIDE, math.ceil(math.sqrt(math.sqrt(vocabulary))))


def shapes(side: int, leaves: int = 1) -> dict[str, tuple[int, ...]]:
    """x: what a unit adds to gate and candidate, the last row a document's start; u: what the state adds; c: classes;
    w: words and buckets; v: units of buckets of several."""
    classes = 2 * side
    found = {"x": (side * side * (1 + leaves) + 1, 2 * HIDDEN), "u": (HIDDEN, 2 * HIDDEN), "c": (classes, OUT), "w": (classes, side, OUT)}
    return found | ({"v": (side * side, OUT, leaves)} if leaves > 1 else {})


def leaves_of(p: Weights) -> int:
    return p["v"].shape[2] if "v" in p else 1


def initial(words: np.ndarray, buckets: np.ndarray) -> Weights:
    """Weights before training, with which the model is the unigram model of the given masses.

    ``words``: of the ranked words, at most as many as buckets; ``buckets``: of all buckets, a square number, and of
    their units if it has two dimensions.
    """
    side, rng = math.isqrt(len(buckets)), np.random.default_rng(7)
    within = buckets.reshape(len(buckets), -1)
    mass = np.concatenate([words, np.zeros(len(buckets) - len(words)), within.sum(axis=1)]).reshape(2 * side, side)
    classes = np.maximum(mass.sum(axis=1), 1e-9)
    spread = {"x": 0.3, "u": 0.2, "c": 0.05, "w": 0.05, "v": 0.0}
    p = {k: rng.normal(0, spread[k], s).astype("f4") for k, s in shapes(side, within.shape[1]).items()}
    p["c"][:, HIDDEN] = np.log(classes / classes.sum())
    share = lambda m: np.where(m > 0, np.log(np.maximum(m, 1)) - np.log(np.maximum(m.max(axis=1, keepdims=True), 1)), -20.0)
    p["w"][:, :, HIDDEN] = share(mass)
    if "v" in p:
        p["v"][:, HIDDEN] = share(within)
    return p


def pack(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpack(flat: np.ndarray, side: int, leaves: int = 1) -> Weights:
    out, at = {}, 0
    for k, shape in sorted(shapes(side, leaves).items()):
        size = math.prod(shape)
        out[k] = flat[at : at + size].reshape(shape).astype("f4")
        at += size
    return out


def step(u: np.ndarray, gx: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The state after units with the input rows ``gx``, the gate, the candidate, and what the old state adds to it."""
    gh = h @ u
    f = gh[:, :HIDDEN] + gx[:, :HIDDEN]
    np.negative(f, out=f)
    np.exp(f, out=f)
    f += 1.0
    np.reciprocal(f, out=f)
    hn = gh[:, HIDDEN:]
    n = f * hn
    n += gx[:, HIDDEN:]
    np.tanh(n, out=n)
    new = n - h
    new *= f
    new += h
    return new, f, n, hn


def _exp(a: np.ndarray) -> np.ndarray | float:
    """exp of ``a`` in place, and what was taken off first: nothing unless a number is so large that it might overflow."""
    top: np.ndarray | float = 0.0
    if a.size and a.max() > 60.0:
        top = a.max(axis=1, keepdims=True)
        a -= top
    np.exp(a, out=a)
    return top


def _sorting(units: np.ndarray) -> np.ndarray:
    """The order that sorts units; equal ones stay as they are."""
    return np.argsort(units.astype(np.uint16) if units.size and units.max() < 65_536 else units, kind="stable")


def _first(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _runs(label: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, first row, row after the last) of sorted labels."""
    first = _first(label)
    return list(zip(label[first].tolist(), first.tolist(), (first + np.diff(first, append=len(label))).tolist(), strict=True))


def _by_run(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each run, ``first`` being where they start."""
    return np.add.reduceat(a, first, axis=0) if len(first) else a


def _within(p: Weights, h: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    a = np.empty((len(h), p["w"].shape[1]), "f4")
    for k, i, j in runs:
        np.matmul(h[i:j], p["w"][k].T, out=a[i:j])
    return a


def _sums(a: np.ndarray) -> np.ndarray:
    """Of each row; a product takes less time than a sum over short rows."""
    return a @ np.ones(a.shape[1], "f4")


def _log_share(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    chosen = a[np.arange(len(a)), at]
    top = _exp(a)
    return (chosen - np.ravel(top)).astype("f8") - np.log(_sums(a))


def _placed(p: Weights, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and buckets of units, the buckets after the words, and the units' numbers within all buckets, else negative."""
    own = p["w"].shape[1] ** 2
    inside = units - own
    return np.where(inside < 0, units, own + inside // leaves_of(p)), inside


def log_probs(p: Weights, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithms of the units' probabilities; ``h`` has the constant as its last column."""
    side, leaves = p["w"].shape[1], leaves_of(p)
    out = np.empty(len(h))
    order = _sorting(targets)
    hs = h.take(order, axis=0)
    placed, inside = _placed(p, targets[order])
    label, inner = np.divmod(placed, side)
    turned, found = np.ascontiguousarray(p["c"].T), np.empty(len(hs))
    for k, i, j in _runs(label):
        for at in range(i, j, BLOCK):
            part = slice(at, min(at + BLOCK, j))
            found[part] = _log_share(hs[part] @ p["w"][k].T, inner[part])
    for at in range(0, len(hs), BLOCK):
        part = slice(at, at + BLOCK)
        found[part] += _log_share(hs[part] @ turned, label[part])
    if leaves > 1:
        start = int(np.searchsorted(inside, 0))  # the buckets' units are the last ones
        bucket, leaf = np.divmod(inside[start:], leaves)
        # A product for each bucket of a block, then one softmax of them all.
        for at in range(0, len(bucket), BLOCK):
            within, h = slice(at, at + BLOCK), hs[start + at :]
            a = np.empty((len(bucket[within]), leaves), "f4")
            for b, i, j in _runs(bucket[within]):
                np.matmul(h[i:j], p["v"][b], out=a[i:j])
            found[start + at : start + at + BLOCK] += _log_share(a, leaf[within])
    out[order] = found
    return out


def _leaf_gradients(v: np.ndarray, hs: np.ndarray, inside: np.ndarray, back_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the targets ``inside`` buckets, which are sorted, the gradients of their units, and the weights they had;
    what goes back to the states is added to ``back_out``. Buckets with equally many targets are taken together."""
    bucket, at = np.divmod(inside, v.shape[2])
    first = _first(bucket)
    counts = np.diff(first, append=len(bucket))
    order = _sorting(counts)
    first = first[order]
    rows = bucket[first]
    out, table = np.empty((len(rows), *v.shape[1:]), "f4"), v.take(rows, axis=0)
    for n, i, j in _runs(counts[order]):
        members = (first[i:j, None] + np.arange(n)).ravel()
        h = hs.take(members, axis=0).reshape(j - i, n, OUT)
        e = np.matmul(h, table[i:j]).reshape(len(members), -1)
        _exp(e)
        e *= (1.0 / _sums(e))[:, None]
        e[np.arange(len(e)), at[members]] -= 1
        e = e.reshape(j - i, n, -1)
        back_out[members] += np.matmul(e, table[i:j].transpose(0, 2, 1)).reshape(len(members), OUT)
        if n == 1:
            np.einsum("no,nl->nol", h[:, 0], e[:, 0], out=out[i:j])
        else:
            np.matmul(h.transpose(0, 2, 1), e, out=out[i:j])
    return rows, out, table


def gradients(p: Weights, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict[str, tuple], np.ndarray]:
    """Gradients of the loss over one window (time, stream), and the state after it; negative targets have no loss.

    A gradient is (rows, values): only the inputs and classes of the window have one. That of ``v`` has its rows' weights
    as well. A softmax is not divided by its sums; what is computed of it is, which is narrower, and the targets' part
    of a gradient is a sum over runs of equal targets.
    """
    side, everywhere, (length, width) = p["w"].shape[1], slice(None), inputs.shape
    gx = p["x"].take(inputs, axis=0)
    before, f, n, hn = (np.empty((length, width, HIDDEN), "f4") for _ in range(4))
    states = np.ones((length, width, OUT), "f4")
    for i in range(length):
        before[i] = h
        h, f[i], n[i], hn[i] = step(p["u"], gx[i], h)
        states[i, :, :HIDDEN] = h
    flat = targets.ravel()
    live = np.flatnonzero(flat >= 0)
    wanted = flat[live]
    order = _sorting(wanted)
    live, wanted = live[order], wanted[order]
    placed, inside = _placed(p, wanted)
    label = placed // side
    runs = _runs(label)
    hs = states.reshape(-1, OUT).take(live, axis=0)
    # Of each word or bucket among the targets, and of each class: the sum of its states.
    first = _first(placed)
    words = placed[first]
    by_word = _by_run(hs, first)
    word_label = words // side
    starts = _first(word_label)
    classes = word_label[starts]
    by_class = _by_run(by_word, starts)
    back_out, gc, turned = np.empty((len(live), OUT), "f4"), np.zeros_like(p["c"]), np.ascontiguousarray(p["c"].T)
    for i in range(0, len(live), BLOCK):
        part = hs[i : i + BLOCK]
        d = part @ turned
        _exp(d)
        share = (1.0 / _sums(d))[:, None]
        gc += d.T @ (part * share)
        np.multiply(d @ p["c"], share, out=back_out[i : i + BLOCK])
    gc[classes] -= by_class
    back_out -= p["c"].take(label, axis=0)
    e = _within(p, hs, runs)
    _exp(e)
    share = (1.0 / _sums(e))[:, None]
    part, back = hs * share, np.empty_like(hs)
    gw = np.empty((len(runs), side, OUT), "f4")
    for m, (k, i, j) in enumerate(runs):
        np.matmul(e[i:j].T, part[i:j], out=gw[m])
        np.matmul(e[i:j], p["w"][k], out=back[i:j])
    flat_w = gw.reshape(-1, OUT)
    flat_w[np.repeat(np.arange(len(starts)), np.diff(starts, append=len(words))) * side + words % side] -= by_word
    back *= share
    back_out += back
    back_out -= p["w"].reshape(-1, OUT).take(placed, axis=0)
    g: dict[str, tuple] = {"c": (everywhere, gc), "w": (classes, gw)}
    if "v" in p:
        start = int(np.searchsorted(inside, 0))  # the buckets' units are the last ones
        g["v"] = _leaf_gradients(p["v"], hs[start:], inside[start:], back_out[start:])
    dh_out = np.zeros((len(flat), HIDDEN), "f4")
    dh_out[live] = back_out[:, :HIDDEN]
    dh_out = dh_out.reshape(length, width, HIDDEN)
    keep = 1 - f
    curve = 1 - n * n
    curve *= f
    open_ = n - before
    open_ *= f
    open_ *= keep
    twist = hn * f
    twist *= keep
    gates, back, dh, turned = np.empty_like(gx), np.empty_like(gx), np.zeros_like(h), np.ascontiguousarray(p["u"].T)
    for i in range(length - 1, -1, -1):
        dh += dh_out[i]
        new = gates[i, :, HIDDEN:]
        np.multiply(dh, curve[i], out=new)
        gate = gates[i, :, :HIDDEN]
        np.multiply(dh, open_[i], out=gate)
        gate += new * twist[i]
        back[i, :, :HIDDEN] = gate
        np.multiply(new, f[i], out=back[i, :, HIDDEN:])
        dh = dh * keep[i]
        dh += back[i] @ turned
    g["u"] = (everywhere, before.reshape(-1, HIDDEN).T @ back.reshape(-1, 2 * HIDDEN))
    units = inputs.ravel()
    order = _sorting(units)
    units = units[order]
    first = _first(units)
    g["x"] = (units[first], _by_run(gates.reshape(-1, 2 * HIDDEN).take(order, axis=0), first))
    return g, h


def train(p: Weights, documents: list[np.ndarray]) -> Weights:
    """One pass of Adam over the documents, joined into at most STREAMS streams; the state is carried from window to window.

    Rows of units and classes that a window lacks stay as they are in its step.
    """
    start = len(p["x"]) - 1
    tokens = np.concatenate([np.append(start, d) for d in documents]).astype(np.int32) if documents else np.zeros(0, np.int32)
    # Few words make fewer streams, so that there are some steps at least.
    streams = max(1, min(STREAMS, len(tokens) // (4 * WINDOW)))
    length = -(-(len(tokens) - 1) // streams)
    if length < 1:
        return p
    p = {k: v.copy() for k, v in p.items()}
    # The last streams are filled up with what is not learned; a document's start is no word to predict either.
    pad = length * streams + 1 - len(tokens)
    inputs = np.append(tokens[:-1], np.full(pad, start, np.int32)).reshape(streams, length).T
    targets = np.append(tokens[1:], np.full(pad, start, np.int32)).reshape(streams, length).T
    targets = np.where(targets == start, -1, targets)
    first, second = ({k: np.zeros_like(v) for k, v in p.items() if k != "v"} for _ in range(2))
    squares = np.zeros(len(p["v"]) if "v" in p else 0, "f4")
    h, n = np.zeros((streams, HIDDEN), "f4"), 0
    for at in range(0, length, WINDOW):
        g, h = gradients(p, np.ascontiguousarray(inputs[at : at + WINDOW]), targets[at : at + WINDOW], h)
        n += 1
        scale = np.float32(RATE * math.sqrt(1 - 0.999**n) / (1 - 0.9**n))
        if "v" in p:
            rows, v, old = g.pop("v")
            each = v.reshape(len(v), math.prod(v.shape[1:]))
            squares[rows] += np.einsum("nf,nf->n", each, each) / each.shape[1]
            each *= (np.float32(LEAF_RATE) / np.sqrt(squares[rows] + np.float32(1e-12)))[:, None]
            old -= v
            p["v"][rows] = old
        for k, (rows, v) in g.items():
            v *= np.float32(1 / (streams * WINDOW))
            if not isinstance(rows, slice) and len(rows) == len(p[k]):
                rows = slice(None)
            mean, square = first[k][rows], second[k][rows]
            moved = v - mean
            moved *= np.float32(0.1)
            mean += moved
            v *= v
            v -= square
            v *= np.float32(0.001)
            square += v
            first[k][rows], second[k][rows] = mean, square
            np.sqrt(square, out=v)
            v += np.float32(1e-8)
            np.divide(mean, v, out=v)
            v *= scale
            p[k][rows] -= v
    return p


def score(p: Weights, documents: list[np.ndarray], streams: int = 512) -> np.ndarray:
    """Natural log-likelihood of each document, its state carried from its first to its last word.

    Documents follow one another in streams, the longest first and each into the stream that is shortest so far; the
    state starts anew with each. So streams run side by side at full width, whatever the lengths.
    """
    out = np.zeros(len(documents))
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return out
    start, heap = len(p["x"]) - 1, [(0, s) for s in range(min(streams, len(documents)))]
    begins, stream = np.zeros(len(documents), np.int64), np.zeros(len(documents), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        at, s = heap[0]
        begins[i], stream[i] = at, s
        heapq.heapreplace(heap, (at + int(sizes[i]), s))
    ends = np.zeros(len(heap), np.int64)
    for at, s in heap:
        ends[s] = at
    rank = np.empty(len(heap), np.int64)
    rank[np.argsort(-ends, kind="stable")] = np.arange(len(heap))
    stream, ends = rank[stream], np.sort(ends)
    # One time after another in one array, of each the streams that are still running, the first ones.
    base = np.append(0, np.cumsum(len(ends) - np.searchsorted(ends, np.arange(ends[-1]), side="right")))
    words, before, owner = np.empty(base[-1], np.int32), np.empty(base[-1], np.int32), np.empty(base[-1], np.int32)
    for i, d in enumerate(documents):
        if len(d):
            places = base[begins[i] : begins[i] + len(d)] + stream[i]
            words[places] = d
            before[places[0]] = start
            before[places[1:]] = d[:-1]
            owner[places] = i
    fresh = np.flatnonzero(before == start)
    h, at = np.zeros((len(heap), HIDDEN), "f4"), 0
    while at < len(base) - 1:
        stop = max(at + 1, int(np.searchsorted(base, base[at] + ROWS, side="right")) - 1)
        edges, news = base[at : stop + 1].tolist(), np.searchsorted(fresh, base[at : stop + 1]).tolist()
        whole = np.ones((edges[-1] - edges[0], OUT), "f4")
        for t, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            h = h[: j - i]
            if news[t] < news[t + 1]:
                h[fresh[news[t] : news[t + 1]] - i] = 0
            h = step(p["u"], p["x"].take(before[i:j], axis=0), h)[0]
            whole[i - edges[0] : j - edges[0], :HIDDEN] = h
        part = slice(edges[0], edges[-1])
        out += np.bincount(owner[part], log_probs(p, whole, words[part]), len(documents))
        at = stop
    return out
