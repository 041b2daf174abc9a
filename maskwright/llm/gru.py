"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax."""

from __future__ import annotations

import io

import numpy as np

#: Production parameters.
HIDDEN = 24
EMBED = 24
WINDOW = 16
LANES = 256
#: Steps of a window when nothing is learned.
LONG = 64
#: A window is so many times as long, at most, where that many times fewer lanes are left: a few long texts don't cost a window's fixed work for every few tokens.
STRETCH = 8
RATE = 0.08
CLIP = 1.0
#: Rows of one class that a block of the output layer holds, fewer where classes have few.
ROWS = 64
#: Gates are straight lines cut at 0 and 1, which numpy works out some ten times as fast as the logistic function.
SLOPE, HALF, NONE, ONE = np.float32(0.25), np.float32(0.5), np.float32(0), np.float32(1)
#: Logits beyond this size are cut; padding lies below it and has no weight worth a bit.
EDGE = 60.0


def class_size(n_tokens: int) -> int:
    """Tokens of a class: runs of tokens by falling frequency, about the square root of their number long."""
    return max(1, int(np.ceil(np.sqrt(n_tokens))))


def initial(counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters whose outputs start at the smoothed frequencies of ``counts``, in descending order.

    Output rows are padded to whole classes.
    """
    rng = np.random.default_rng(seed)
    n = len(counts)
    size = class_size(n)
    classes = -(-n // size)
    p = np.zeros(classes * size)
    p[:n] = (counts + 0.5) / (counts + 0.5).sum()
    mass = p.reshape(classes, size).sum(axis=1)
    within = np.where(p > 0, np.log(np.maximum(p, 1e-300) / np.repeat(mass, size)), -1e4)
    small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
    return {
        "E": small(n, EMBED), "Wx": small(EMBED, 3 * HIDDEN), "Uh": small(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
        "Wc": np.zeros((HIDDEN, classes), np.float32), "bc": np.log(mass).astype(np.float32),
        "Wo": np.zeros((classes, size, HIDDEN), np.float32), "bo": within.reshape(classes, size).astype(np.float32),
    }


def dump(params: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **params)
    return out.getvalue()


def load(raw: bytes) -> dict:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def _softmax(x: np.ndarray, rows: np.ndarray, at: np.ndarray, learn: bool) -> np.ndarray:
    """Log softmax of ``rows`` of ``x`` at one column each; with ``learn`` x becomes softmax less the target, 0 in other rows."""
    np.minimum(np.maximum(x, np.float32(-EDGE), out=x), np.float32(EDGE), out=x)
    picked = x[rows, at]
    np.exp(x, out=x)
    z = x @ np.ones(x.shape[1], np.float32)
    if learn:
        part = np.zeros(len(x), np.float32)
        part[rows] = 1 / z[rows]
        x *= part[:, None]
        x[rows, at] -= 1
    return picked - np.log(z[rows])


def lay_out(lengths: np.ndarray, lanes: int = LANES) -> list[list[int]]:
    """Documents dealt to lanes, the longest first to the shortest lane."""
    import heapq

    order = np.argsort(-lengths, kind="stable").tolist()
    lanes = max(1, min(lanes, len(order)))
    heap = [(0, k) for k in range(lanes)]
    out: list[list[int]] = [[] for _ in range(lanes)]
    for d in order:
        if not lengths[d]:
            continue
        n, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), k))
    return sorted((x for x in out if x), key=lambda x: -sum(int(lengths[d]) for d in x))


class Model:
    """The network; states and gates lie as (unit, lane), so that a step works on whole runs of memory."""

    def __init__(self, params: dict):
        self.p = {k: v.copy() for k, v in params.items()}
        self.size = self.p["Wo"].shape[1]
        self.square = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        self.table = None  # inputs of the gates for every token, while nothing is learned

    def _forward(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, learn=None):
        """States of a window: x (steps, lanes) inputs, keep (steps, lanes) 0 where a document starts; ``learn`` has the distinct inputs and which each is."""
        p, (steps, lanes), H = self.p, x.shape, HIDDEN
        if self.table is None:
            self.table = p["E"] @ p["Wx"] + p["b"]
        if learn:  # of the tokens met alone
            x, table = learn[1], p["E"][learn[0]] @ p["Wx"] + p["b"]
        else:
            table = self.table
        a = np.ascontiguousarray(np.take(table, x, axis=0).transpose(0, 2, 1))
        across = np.ascontiguousarray(p["Uh"].T)
        states = np.empty((steps, H, lanes), np.float32)
        z_r = np.empty((steps, 2 * H, lanes), np.float32)
        before, un, n = (np.empty_like(states) for _ in range(3))
        spare = np.empty((H, lanes), np.float32)
        for t in range(steps):
            h = np.multiply(h, keep[t], out=before[t])
            u = across @ h
            g = np.add(a[t, : 2 * H], u[: 2 * H], out=z_r[t])
            g *= SLOPE
            g += HALF
            np.minimum(np.maximum(g, NONE, out=g), ONE, out=g)
            un[t] = u[2 * H :]
            new = np.multiply(g[H:], un[t], out=n[t])
            new += a[t, 2 * H :]
            np.tanh(new, out=new)
            np.subtract(h, new, out=spare)
            spare *= g[:H]
            h = np.add(new, spare, out=states[t])
        return states, (before, z_r, un, n), h

    def _outputs(self, s: np.ndarray, y: np.ndarray, grads: dict | None):
        """Natural log probabilities of tokens y given states s (rows); with ``grads``, also the states' gradients.

        Rows are laid by class in blocks of ``ROWS`` at most, so that all classes are worked on together; where a class has few, smaller blocks hold less padding.
        """
        p, learn = self.p, grads is not None
        c = (y // self.size).astype(np.int16)
        x = s @ p["Wc"]
        x += p["bc"]
        out = _softmax(x, np.arange(len(y)), c, learn).astype(np.float64)
        ds = None
        if learn:
            grads["Wc"], grads["bc"] = s.T @ x, x.sum(axis=0)
            ds = x @ p["Wc"].T
        by = np.argsort(c, kind="stable")
        rows = np.bincount(c, minlength=len(p["bo"]))
        each = min(ROWS, 1 << max(3, (len(y) // (4 * len(rows))).bit_length()))
        blocks = -(-rows // each)
        first = np.cumsum(blocks) - blocks
        place = np.arange(len(y)) + np.repeat(first * each - (np.cumsum(rows) - rows), rows)
        which = np.repeat(np.arange(len(rows)), blocks)
        w = p["Wo"][which]
        laid = np.zeros((len(which) * each, HIDDEN), np.float32)
        laid[place] = s[by]
        laid = laid.reshape(-1, each, HIDDEN)
        x = laid @ w.transpose(0, 2, 1)
        x += p["bo"][which][:, None, :]
        flat = x.reshape(-1, self.size)
        out[by] += _softmax(flat, place, (y % self.size)[by], learn)
        if learn:
            some = np.flatnonzero(blocks)
            grads["classes"] = some
            grads["Wo"] = np.add.reduceat(x.transpose(0, 2, 1) @ laid, first[some], axis=0)
            grads["bo"] = np.add.reduceat(x.sum(axis=1), first[some], axis=0)
            ds[by] += (x @ w).reshape(-1, HIDDEN)[place]
        return out, ds

    def _learn(self, x, y, real, keep, h):
        """One window: forward, gradients cut at its start, one step of the parameters; returns the last state."""
        p, H = self.p, HIDDEN
        met, which = np.unique(x, return_inverse=True)
        which = which.reshape(x.shape)
        states, (before, z_r, un, n), last = self._forward(x, keep, h, (met, which))
        z, r = z_r[:, :H], z_r[:, H:]
        flat = np.flatnonzero(real.reshape(-1))
        grads: dict[str, np.ndarray] = {}
        _, ds = self._outputs(states.transpose(0, 2, 1).reshape(-1, H)[flat], y.reshape(-1)[flat], grads)
        dstate = np.zeros((real.size, H), np.float32)
        dstate[flat] = ds
        dstate = np.ascontiguousarray(dstate.reshape(*real.shape, H).transpose(0, 2, 1))
        # what a change of the state does to each gate's input, for the whole window
        by_n = (1 - z) * (1 - n * n)
        by_z = (before - n) * (SLOPE * ((z > 0) & (z < 1)))
        by_r = un * (SLOPE * ((r > 0) & (r < 1)))
        da = np.empty((len(x), 3 * H, x.shape[1]), np.float32)
        du = np.empty_like(da)
        dh = np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            dh += dstate[t]
            dn = np.multiply(dh, by_n[t], out=da[t, 2 * H :])
            np.multiply(dh, by_z[t], out=da[t, :H])
            np.multiply(dn, by_r[t], out=da[t, H : 2 * H])
            du[t, : 2 * H] = da[t, : 2 * H]
            np.multiply(dn, r[t], out=du[t, 2 * H :])
            dh *= z[t]
            dh += p["Uh"] @ du[t]
            dh *= keep[t]
        grads["Uh"] = (before @ du.transpose(0, 2, 1)).sum(axis=0)
        rows = da.transpose(0, 2, 1).reshape(-1, 3 * H)
        at = which.reshape(-1)
        grads["Wx"], grads["b"] = p["E"][met][at].T @ rows, rows.sum(axis=0)
        cells = (at * EMBED)[:, None] + np.arange(EMBED)
        grads["E"] = np.bincount(cells.reshape(-1), weights=(rows @ p["Wx"].T).reshape(-1), minlength=len(met) * EMBED).reshape(-1, EMBED).astype(np.float32)
        classes = grads.pop("classes")
        scale = 1 / max(1, len(flat))
        norm = np.sqrt(sum(float(np.dot(g.reshape(-1), g.reshape(-1))) for g in grads.values())) * scale
        scale *= min(1.0, CLIP / max(norm, 1e-9)) * 8
        rows = {"E": met, "Wo": classes, "bo": classes}  # the others of these have no gradient
        for k, g in grads.items():
            g *= np.float32(scale)
            at = rows.get(k, slice(None))
            square = self.square[k][at] + g * g
            self.square[k][at] = square
            g *= np.float32(RATE)
            g /= np.sqrt(square)
            p[k][at] -= g
        return last

    def run(self, docs: list[np.ndarray], start: int, learn: bool = False, lanes: int = LANES, window: int | None = None) -> np.ndarray:
        """Natural log probability of each document (its tokens, the first after ``start``).

        Documents lie end to end in lanes; a lane's state is carried from window to window and reset at
        each document, so a text of any length is scored whole. With ``learn`` every window also trains.
        """
        window = window or (WINDOW if learn else LONG)
        lengths = np.array([len(d) for d in docs], np.int64)
        score = np.zeros(len(docs))
        plan = lay_out(lengths, lanes)
        if not plan:
            return score
        # all lanes end to end; a window is a rectangle of places in them
        order = [d for lane in plan for d in lane]
        sizes = np.array([int(lengths[lane].sum()) for lane in plan])
        begin = np.cumsum(sizes) - sizes
        ys = np.concatenate([docs[d] for d in order])
        who = np.repeat(order, lengths[order])
        first = np.cumsum(lengths[order]) - lengths[order]
        xs = np.concatenate([[start], ys[:-1]])
        xs[first] = start
        fresh = np.ones(len(ys), np.float32)
        fresh[first] = 0
        h = np.zeros((HIDDEN, len(plan)), np.float32)
        self.table = None
        t = steps = 0
        while (t := t + steps) < sizes[0]:
            live = int((sizes > t).sum())
            steps = min(window * min(STRETCH, len(plan) // live), int(sizes[0]) - t)
            place = t + np.arange(steps)[:, None]
            real = place < sizes[:live]
            at = np.where(real, begin[:live] + place, 0)
            x, y, owner = np.where(real, xs[at], 0), np.where(real, ys[at], 0), who[at]
            keep = np.where(real, fresh[at], np.float32(1))
            if learn:
                h = self._learn(x, y, real, keep, h[:, :live])
            else:
                states, _, h = self._forward(x, keep, h[:, :live])
                flat = np.flatnonzero(real.reshape(-1))
                out, _ = self._outputs(states.transpose(0, 2, 1).reshape(-1, HIDDEN)[flat], y.reshape(-1)[flat], None)
                score += np.bincount(owner.reshape(-1)[flat], weights=out, minlength=len(docs))
        return score
