"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Tags are O and begin/inside for each kind. Training minimises the CRF's negative
log likelihood by back-propagation through time with Adam; every window goes
through both directions, and decoding is Viterbi, left out only at places where the
scores prove that the best path has no span.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOLS = 98  # 0 padding, 1-95 printable ASCII, 96 other control characters, 97 everything else


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where(code > 126, 97, np.where(code < 32, 96, code - 31))


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): bounded and smooth like the hyperbolic tangent, at a tenth of its cost."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``_squash`` where its value is ``y``."""
    return np.square(1 - np.abs(y))


@dataclass
class Tagger:
    """Parameters by name: emb, wx/wh/b for both directions, wo, bo, trans, start."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, tags: int, embed: int, hidden: int, rng: np.random.Generator) -> "Tagger":
        def glorot(*shape: int) -> np.ndarray:
            return rng.normal(0, (2 / sum(shape)) ** 0.5, shape).astype(np.float32)

        p = {"emb": glorot(SYMBOLS, embed), "wo": glorot(2 * hidden, tags), "bo": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1  # open forget gates
            p |= {f"wx{d}": glorot(embed, 4 * hidden), f"wh{d}": glorot(hidden, 4 * hidden), f"b{d}": bias}
        return cls(p)

    def _run(self, ids: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction, time first."""
        gates = (self.p["emb"] @ self.p[f"wx{d}"] + self.p[f"b{d}"])[ids.T]  # T, B, 4H
        wh = self.p[f"wh{d}"]
        hidden = wh.shape[0]
        h = np.zeros((ids.shape[0], hidden), np.float32)
        c = h
        out = np.empty((ids.shape[1], ids.shape[0], hidden), np.float32)
        for t in range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1):
            g = gates[t] + h @ wh
            s, u = 0.5 * _squash(g[:, :3 * hidden]) + 0.5, _squash(g[:, 3 * hidden:])
            i, f, o = s[:, :hidden], s[:, hidden:2 * hidden], s[:, 2 * hidden:]
            before, last = c, h
            c = f * c + i * u
            squashed = _squash(c)
            h = o * squashed
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, u, before, squashed, last))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores of windows (B, T) less those of O, which leaves every best path: T, tags, B.

        Both directions advance in one step. A step's input (last state, embedded character, 1) is one block, so its gates
        and the last state's scores are one product; they stand one below the other, each a contiguous block, with the
        cells last, so that input and forget gates meet the update and the cells at once. A gate is (1 + q) / 2 with q its
        squashed sum: the halves of the states are moved into the weights, those of the cells are taken once a step.
        """
        p, (size, steps) = self.p, ids.shape
        hidden, embed, tags = p["whf"].shape[0], p["emb"].shape[1], len(p["bo"]) - 1
        heads = 0.5 * (p["wo"][:, 1:] - p["wo"][:, :1]).T
        weights = np.zeros((2, tags + 4 * hidden, hidden + embed + 1), np.float32)
        for k, d in enumerate("fb"):
            weights[k, :tags, :hidden] = heads[:, k * hidden:(k + 1) * hidden]
            i, f, o, u = np.split(np.concatenate([0.5 * p[f"wh{d}"], p[f"wx{d}"], p[f"b{d}"][None]]).T, 4)
            weights[k, tags:] = np.concatenate([o, i, f, u])
        seen = np.ascontiguousarray(p["emb"].astype(np.float32)[ids.T].transpose(0, 2, 1))  # T, embed, B
        out = np.zeros((steps, tags + 1, size), np.float32)
        out[:, 1:] = (p["bo"][1:] - p["bo"][0])[:, None]
        given = np.zeros((2, hidden + embed + 1, size), np.float32)
        given[:, -1] = 1
        h, x = given[:, :hidden], given[:, hidden:-1]
        rows, work = np.zeros((2, tags + 5 * hidden, size), np.float32), np.empty((2, 4 * hidden, size), np.float32)
        product, scores, g = rows[:, :-hidden], rows[:, :tags], rows[:, tags:-hidden]
        o, both, pair, u, c = (rows[:, tags + s * hidden:tags + e * hidden] for s, e in ((0, 1), (1, 3), (3, 5), (3, 4), (4, 5)))
        for t in range(steps):
            x[0], x[1] = seen[t], seen[steps - 1 - t]
            np.matmul(weights, given, out=product)
            if t:
                out[t - 1, 1:] += scores[0]
                out[steps - t, 1:] += scores[1]
            np.abs(g, out=work)
            work += 1
            g /= work
            both *= pair
            pair += both
            c += u
            c *= 0.5
            np.abs(c, out=h)
            h += 1
            np.divide(c, h, out=h)
            o *= h
            h += o
        out[-1, 1:] += weights[0, :tags, :hidden] @ h[0]
        out[0, 1:] += weights[1, :tags, :hidden] @ h[1]
        return out

    def _open(self, e: np.ndarray) -> np.ndarray:
        """Places whose tag is not O for certain: B, T.

        A run of other tags differs from the plain path by its emission differences, the way in, the way out and its
        inner transitions, and a run of the best path wins. A place is open if some run through it may win, each part
        taken at its most; sums from both sides give the best such run of every place.
        """
        trans, start = self.p["trans"] - self.p["trans"][0, 0], self.p["start"] - self.p["start"][0]
        way_in, way_out, inner = trans[0, 1:].max(), trans[1:, 0].max(), trans[1:, 1:].max()
        gain = e[:, 1].copy()
        for k in range(2, e.shape[1]):
            np.maximum(gain, e[:, k], out=gain)
        gain += inner - e[:, 0]
        left, right = np.empty_like(gain), np.empty_like(gain)  # of runs that end, or begin, at a place
        left[0], right[-1] = gain[0] + start[1:].max(), gain[-1]
        for t in range(1, len(gain)):
            np.maximum(left[t - 1], way_in, out=left[t])
            left[t] += gain[t]
            np.maximum(right[-t], way_out, out=right[-t - 1])
            right[-t - 1] += gain[-t - 1]
        left += right
        left -= gain
        return (left >= inner - 1e-2).T

    def decode(self, ids: np.ndarray, skip_plain: bool = True) -> np.ndarray:
        """The best tag path of every window: B, T.

        Places that are O for certain cut a window into stretches that are searched apart, all windows' stretches of at
        least a length at once. The search keeps the best scores and no back pointers: the way back takes the best
        predecessor of the one tag that the path has.
        """
        e, trans, start = self.emissions(ids), self.p["trans"], self.p["start"]
        wide = np.zeros((len(ids), ids.shape[1] + 2), np.int8)
        wide[:, 1:-1] = self._open(e) if skip_plain else True
        step = np.diff(wide, axis=1).ravel()
        row, first = np.divmod(np.flatnonzero(step == 1), wide.shape[1] - 1)
        size = np.flatnonzero(step == -1) % (wide.shape[1] - 1) - first
        path = np.zeros(ids.shape, np.int8)
        if not len(row):
            return path
        order = np.argsort(-size, kind="stable")
        row, first, size = row[order], first[order], size[order]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # stretches longer than k
        ends = np.cumsum(active)
        which = np.arange(ends[-1]) - np.repeat(ends - active, active)  # the stretch of every place, places in order of k
        row, at = row[which], first[which] + np.repeat(np.arange(len(active)), active)
        best = np.ascontiguousarray(e[at, :, row].T)
        best[:, :active[0]] += np.where(first == 0, start[:, None], trans[0][:, None])
        options = np.empty((*trans.shape, min(active[0], 256)), np.float32)
        for k in range(1, len(active)):
            n, before, last = active[k], ends[k - 1] - active[k - 1], ends[k - 1]
            for s in range(0, n, 256):
                m = min(256, n - s)
                np.add(best[:, None, before + s:before + s + m], trans[:, :, None], out=options[:, :, :m])
                best[:, last + s:last + s + m] += options[:, :, :m].max(0)
        after = np.where(first + size < ids.shape[1], trans[:, :1], np.float32(0))
        found, ending = np.zeros(ends[-1], np.int8), 0
        for n, end in zip(active[::-1], ends[::-1], strict=True):
            way = best[:, end - n:end]
            if ending:
                way[:, :ending] += trans[:, tag]
            way[:, ending:] += after[:, ending:n]
            tag, ending = way.argmax(0), n
            found[end - n:end] = tag
        path[row, at] = found
        return path

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood and its gradient."""
        size, steps = ids.shape
        keep: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(ids, d, keep[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        e = both @ self.p["wo"] + self.p["bo"]
        loss, de, g = self._crf(e, tags)
        g["wo"] = np.einsum("tbh,tbk->hk", both, de)
        g["bo"] = de.sum((0, 1))
        dboth = de @ self.p["wo"].T
        hidden = states["f"].shape[2]
        g["emb"] = np.zeros_like(self.p["emb"])
        for d, part in (("f", dboth[:, :, :hidden]), ("b", dboth[:, :, hidden:])):
            wh, wx = self.p[f"wh{d}"], self.p[f"wx{d}"]
            dh, dc = np.zeros((size, hidden), np.float32), np.zeros((size, hidden), np.float32)
            dgates = np.empty((steps, size, 4 * hidden), np.float32)
            g[f"wh{d}"] = np.zeros_like(wh)
            for t, i, f, o, u, before, squashed, last in reversed(keep[d]):
                dh = dh + part[t]
                dc = dc + dh * o * _slope(squashed)
                dg = dgates[t]
                dg[:, :hidden] = dc * u * 0.5 * _slope(2 * i - 1)
                dg[:, hidden:2 * hidden] = dc * before * 0.5 * _slope(2 * f - 1)
                dg[:, 2 * hidden:3 * hidden] = dh * squashed * 0.5 * _slope(2 * o - 1)
                dg[:, 3 * hidden:] = dc * i * _slope(u)
                g[f"wh{d}"] += last.T @ dg
                dh = dg @ wh.T
                dc = dc * f
            flat = dgates.reshape(-1, 4 * hidden)
            where = ids.T.ravel()
            by_symbol = (np.arange(SYMBOLS)[:, None] == where).astype(np.float32) @ flat
            g[f"wx{d}"] = self.p["emb"].T @ by_symbol
            g[f"b{d}"] = flat.sum(0)
            g["emb"] += by_symbol @ wx.T
        return loss, g

    def _crf(self, e: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        steps, size, kinds = e.shape
        trans, start = self.p["trans"], self.p["start"]

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        alpha = np.empty_like(e)
        alpha[0] = e[0] + start
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        beta = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        rows, gold = np.arange(size), tags.T
        score = start[gold[0]] + e[np.arange(steps)[:, None], rows, gold].sum(0) + trans[gold[:-1], gold[1:]].sum(0)
        de = np.exp(alpha + beta - z[None, :, None])
        dstart = de[0].copy()
        dtrans = np.zeros_like(trans)
        for t in range(1, steps):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dtrans, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        de[np.arange(steps)[:, None], rows, gold] -= 1
        dstart[rows, gold[0]] -= 1
        return float((z - score).mean()), de / size, {"trans": dtrans / size, "start": dstart.sum(0) / size}


def train(ids: np.ndarray, tags: np.ndarray, kinds: int, *, embed: int = 12, hidden: int = 16, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Tagger:
    """Fit on windows (N, T) of character ids and tags."""
    rng = np.random.default_rng(seed)
    model = Tagger.fresh(kinds, embed, hidden, rng)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, total = 0, epochs * (-(-len(ids) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for s in range(0, len(ids), batch):
            pick = order[s:s + batch]
            _, g = model.gradients(ids[pick], tags[pick])
            step += 1
            norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            lr = rate * (1 - 0.9 * step / total)
            for k, v in g.items():
                v = v * scale
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.p[k] = (model.p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model
