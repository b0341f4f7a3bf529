"""A small causal self-attention model over classes of subword ids, in numpy.

The ids fall into CLASSES classes: the frequent ones are classes of their own, the others share some. The probability of
an id is that of its class, given the classes before it in a window, times its share of its class. A class's logit is a
bigram log probability, counted over the whole training corpus, plus what one attention layer and one hidden layer add.

Ids that start a word and ids that go on with one are in different classes, so the model also gives the probability that
a word ends: that of the classes from ``start`` on, in which the end of a text is the last.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np

CLASSES = 160


def keep_pages() -> None:
    """From now on this process keeps freed pages for its next arrays, 64 MB at most: a step makes arrays of up to 1 MB again
    and again, and the C library would give each back to the system, whose fresh pages cost more than the arithmetic."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # of glibc
    if mallopt:
        for name, most in ((-3, 32 << 20), (-1, 64 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            mallopt(name, most)


#: Classes that share the ids without a class of their own, for either kind of id; the last class is the end of a text.
SHARED = 8
WIDTH = 16
HIDDEN = 16
#: Positions of a window, and those at its front that are context only (but in a text's first window).
WINDOW, CONTEXT = 32, 16
assert WINDOW == 2 * CONTEXT  # ``gradient`` takes queries by halves of windows
END, BEGIN = CLASSES - 1, CLASSES


def class_map(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """The class of each id, and the first class of ids that start words."""
    own = np.zeros(len(counts), bool)
    own[np.argsort(-counts, kind="stable")[: CLASSES - 1 - 2 * SHARED]] = True
    out, at = np.empty(len(counts), np.int16), 0
    for kind in (~starts, starts):
        if kind is starts:
            start = at
        mine = np.flatnonzero(own & kind)
        out[mine] = at + np.arange(len(mine))
        rest = np.flatnonzero(~own & kind)
        rest = rest[np.argsort(-counts[rest], kind="stable")]
        mass = counts[rest] + 1e-3
        out[rest] = at + len(mine) + np.minimum((np.cumsum(mass) - mass) * SHARED // mass.sum(), SHARED - 1).astype(np.int16)
        at += len(mine) + SHARED
    return out, start


def windows(classes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of classes, each with its END -> (inputs, targets, scored) of overlapping windows; every target is scored once.

    A text's first window starts with BEGIN and scores WINDOW targets; each next one goes on with WINDOW - CONTEXT
    targets and has CONTEXT inputs in front.
    """
    step = WINDOW - CONTEXT
    ends = np.cumsum(lens)
    starts = ends - lens
    room = np.zeros(WINDOW, np.int16)
    targets = np.concatenate((classes.astype(np.int16), room))
    inputs = np.concatenate(([np.int16(BEGIN)], targets[:-1]))
    inputs[starts] = BEGIN
    n = 1 + np.maximum(0, -(-(lens - WINDOW) // step))
    text = np.repeat(np.arange(len(lens)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = starts[text] + nth * step
    place = np.arange(WINDOW)
    scored = (place < (ends[text] - first)[:, None]) & (place >= np.where(nth, CONTEXT, 0)[:, None])
    # what follows a text's end is neither scored nor seen by what is
    return (*(np.lib.stride_tricks.sliding_window_view(m, WINDOW)[first] for m in (inputs, targets)), scored)


NAMES = ("embed", "place", "q", "k", "v", "mix", "bias", "out", "skip")
SHAPES = {
    "embed": (CLASSES + 1, WIDTH), "place": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
    "mix": (2 * WIDTH, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "skip": (CLASSES,),
}
SIZES = {n: int(np.prod(SHAPES[n])) for n in NAMES}
PARAMETERS = sum(SIZES.values())


def initial(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    scale = {"out": 0.0, "bias": 0.0, "skip": 0.0, "place": 0.1, "embed": 0.5}
    return np.concatenate([rng.normal(0, scale.get(n, SHAPES[n][0] ** -0.5), SIZES[n]) for n in NAMES]).astype(np.float32)


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in NAMES:
        out[n] = flat[at : at + SIZES[n]].reshape(SHAPES[n])
        at += SIZES[n]
    return out


FUTURE = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
#: Exponentials of logits this far from 0 and their sums stay well inside single precision.
STEADY = 60.0


def steady(z: np.ndarray) -> bool:
    """Whether exponentials of all logits can be summed as they are; if not, each row's maximum is to be taken off first."""
    return z.max() < STEADY and z.min() > -STEADY


def bounded(out: np.ndarray, prior: np.ndarray) -> bool:
    """``steady`` for all logits that a hidden layer between -1 and 1 can give."""
    return np.abs(out).sum(axis=0).max() + max(prior.max(), -prior.min()) < STEADY


def class_sums(classes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows by their class (or BEGIN)."""
    n = np.bincount(classes, minlength=CLASSES + 1)
    found, first = np.flatnonzero(n), np.cumsum(n) - n
    out = np.zeros((CLASSES + 1, values.shape[1]), np.float32)
    out[found] = np.add.reduceat(values.take(np.argsort(classes, kind="stable"), axis=0), first[found])
    return out


class Model:
    def __init__(self, flat: np.ndarray, bigram: np.ndarray):
        """bigram: log probabilities of a class after a class (or BEGIN)."""
        self.flat, self.p, self.bigram = flat, parts(flat), bigram.astype(np.float32, copy=False)

    def tables(self) -> dict[str, np.ndarray]:
        """What a class and a place give to queries, keys, values and the hidden layer: gathered instead of multiplied."""
        p, scale = self.p, np.float32(WIDTH**-0.5)
        out = {}
        for name, m in (("q", p["q"] * scale), ("k", p["k"]), ("v", p["v"] @ p["mix"][:WIDTH]), ("m", p["mix"][WIDTH:])):
            out[name], out[name + "p"] = p["embed"] @ m, p["place"] @ m
        out["mp"] = out["mp"] + p["bias"]
        out["big"] = self.bigram + p["skip"]
        return {name: m.astype(np.float32) for name, m in out.items()}

    def log_probability(self, x: np.ndarray, y: np.ndarray, start: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each target from position ``first``, and of any class from ``start`` on."""
        if not hasattr(self, "_tables"):
            self._tables = self.tables()
            self._bounded = bounded(self.p["out"], self._tables["big"])
        t, xq = self._tables, x[:, first:]
        a = (t["q"].take(xq, axis=0) + t["qp"][first:]) @ (t["k"].take(x, axis=0) + t["kp"]).transpose(0, 2, 1)
        fits = steady(a)
        a += FUTURE[first:]
        if not fits:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        h = a @ (t["v"].take(x, axis=0) + t["vp"])
        h /= a @ np.ones((WINDOW, 1), np.float32)
        h += t["m"].take(xq, axis=0)
        h += t["mp"][first:]
        np.tanh(h, out=h)
        z = h.reshape(-1, HIDDEN) @ self.p["out"]
        z += t["big"].take(xq.ravel(), axis=0)
        if not self._bounded:
            z -= z.max(axis=1, keepdims=True)
        target = z[np.arange(len(z)), y[:, first:].ravel()]
        np.exp(z, out=z)
        halves = np.zeros((CLASSES, 2), np.float32)  # the classes before ``start``, and from it on
        halves[:start, 0] = halves[start:, 1] = 1
        other, begin = (z @ halves).T
        begin = np.maximum(begin, np.finfo(np.float32).tiny)
        total = np.log(other + begin)
        return (target - total).reshape(len(x), -1), (np.log(begin) - total).reshape(len(x), -1)

    def gradient(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of the scored targets and its gradient. Only scored halves of windows are queries.

        What classes and places give to queries, keys, values and the hidden layer is gathered from tables, and the tables'
        gradients are sums over the rows of a class or a place; so no product is as long as the rows.
        """
        p, scale, n_out = self.p, np.float32(WIDTH**-0.5), int(scored.sum())
        mix, inner = p["mix"][:WIDTH], p["mix"][WIDTH:]
        weights = np.concatenate((p["q"] * scale, inner, p["k"], p["v"] @ mix), axis=1)
        (q, m, k, v), (q_at, m_at, k_at, v_at) = (np.split(e @ weights, (WIDTH, WIDTH + HIDDEN, 2 * WIDTH + HIDDEN), axis=1) for e in (p["embed"], p["place"]))
        # the windows with their ends as queries, then those whose fronts are scored too once more
        front = np.flatnonzero(scored[:, :CONTEXT].any(axis=1))
        halves = ((slice(len(x)), slice(CONTEXT, WINDOW)), (slice(len(x), None), slice(CONTEXT)))
        own = lambda m: np.concatenate((m[:, CONTEXT:], m[front, :CONTEXT])).ravel()
        before, wanted, on, keys = own(x), own(y), own(scored).astype(np.float32), np.concatenate((x, x[front]))
        at, shape = np.arange(len(on)), (len(keys), CONTEXT, -1)
        k, v = k.take(keys, axis=0), v.take(keys, axis=0)
        k += k_at
        v += v_at
        q, h = q.take(before, axis=0).reshape(shape), (m + p["bias"]).take(before, axis=0).reshape(shape)
        for some, places in halves:
            q[some] += q_at[places]
            h[some] += m_at[places]
        a = q @ k.transpose(0, 2, 1)
        fits = steady(a)
        for some, places in halves:
            a[some] += FUTURE[places]
        if not fits:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        sums = 1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32))[:, None]
        o = (a @ v).reshape(-1, HIDDEN)
        o *= sums
        h = h.reshape(-1, HIDDEN)
        h += o
        np.tanh(h, out=h)
        z, prior = h @ p["out"], self.bigram + p["skip"]
        z += prior.take(before, axis=0)
        if not bounded(p["out"], prior):
            z -= z.max(axis=1, keepdims=True)
        hit = z[at, wanted]
        np.exp(z, out=z)
        total = z @ np.ones(CLASSES, np.float32)
        loss = float((np.log(total) - hit) @ on) / n_out
        z[at, wanted] -= total
        part = on / (total * np.float32(n_out))  # what the rows of z are to be multiplied by: done on narrower arrays
        left = np.empty((len(h), HIDDEN + 1), np.float32)
        np.multiply(h, part[:, None], out=left[:, :HIDDEN])
        left[:, HIDDEN] = part
        product = (z.T @ left).T
        g = {"out": product[:HIDDEN], "skip": product[HIDDEN]}
        dh = z @ p["out"].T
        dh *= 1 - h * h
        dh *= part[:, None]
        do = dh * sums  # a is not divided by its sums
        da = do.reshape(shape) @ v.transpose(0, 2, 1)
        da -= ((do * o) @ np.ones(HIDDEN, np.float32)).reshape(shape)  # the sums of da * a over the keys
        da *= a
        dq = np.concatenate(((da @ k).reshape(-1, WIDTH), dh), axis=1)
        dk = np.concatenate((da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do.reshape(shape)), axis=2)
        by_place = np.zeros((WINDOW, weights.shape[1]), np.float32)
        for some, places in halves:
            by_place[places, : dq.shape[1]] += dq.reshape(shape)[some].sum(axis=0)
        by_place[:, dq.shape[1] :] = dk.sum(axis=0)
        by_class = np.concatenate((class_sums(before, dq), class_sums(keys.ravel(), dk.reshape(len(keys) * WINDOW, -1))), axis=1)
        g["embed"], g["place"] = by_class @ weights.T, by_place @ weights.T
        g["q"], inner, g["k"], values = np.split(p["embed"].T @ by_class + p["place"].T @ by_place, (WIDTH, WIDTH + HIDDEN, 2 * WIDTH + HIDDEN), axis=1)
        g["q"] = g["q"] * scale
        g["v"], g["mix"], g["bias"] = values @ mix.T, np.concatenate((p["v"].T @ values, inner)), dh.sum(axis=0)
        return loss, np.concatenate([g[n].ravel() for n in NAMES]).astype(np.float32, copy=False)


def fit(flat: np.ndarray, bigram: np.ndarray, blocks: Iterator[tuple[np.ndarray, ...]], least: int, rng: np.random.Generator, batch: int = 64, rate: float = 0.01) -> tuple[np.ndarray, int]:
    """Adam over every window of ``blocks`` (inputs, targets, scored) once, each block's in random order -> parameters, windows.

    Where that gives fewer than ``least`` steps, the windows are drawn again until it does.
    """
    flat, m, v = flat.copy(), np.zeros(PARAMETERS, np.float32), np.zeros(PARAMETERS, np.float32)
    bigram = bigram.astype(np.float32)
    k = seen = 0

    def step(x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> None:
        nonlocal flat, m, v, k
        k += 1
        _, g = Model(flat, bigram).gradient(x, y, scored)
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        lr = rate * min(1, k / 20) * max(0.05, (1 + k / 60) ** -0.5)
        flat -= (lr * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-8)).astype(np.float32)

    kept: list[tuple[np.ndarray, ...]] = []  # all windows, if they are so few that they are drawn again
    rest: tuple[np.ndarray, ...] | None = None  # less than a batch
    for block in blocks:
        seen += len(block[0])
        if seen <= least * batch:
            kept.append(block)
        order = rng.permutation(len(block[0]))
        own = tuple(a[order] if rest is None else np.concatenate((b, a[order])) for a, b in zip(block, rest or block, strict=True))
        full = len(own[0]) // batch * batch
        for at in range(0, full, batch):
            step(*(a[at : at + batch] for a in own))
        rest = tuple(a[full:] for a in own)
    if rest is not None and len(rest[0]):
        step(*rest)
    if seen and k < least:
        own = tuple(np.concatenate(a) for a in zip(*kept, strict=True))
        while k < least:
            i = rng.integers(0, len(own[0]), batch)
            step(*(a[i] for a in own))
    return flat, seen
