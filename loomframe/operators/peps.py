"""Kernels of a lattice of site tensors, in numpy and without Spark: amplitudes, holes, samples.

A site tensor has the axes left, up, right, down and physical. A line is a list of tensors (left bond, vertical, right
bond); rows are absorbed into it one by one and its bonds are cut by QR to the right and SVD back to the left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Draws after which a sampler gives up.
TRIES = 10_000

Site = tuple[int, int]
Tensors = dict[Site, np.ndarray]


def compressed(line: list[np.ndarray], cut: int) -> list[np.ndarray]:
    line = list(line)
    for j in range(len(line) - 1):
        a, v, b = line[j].shape
        q, r = np.linalg.qr(line[j].reshape(a * v, b))
        line[j] = q.reshape(a, v, -1)
        line[j + 1] = np.tensordot(r, line[j + 1], 1)
    for j in range(len(line) - 1, 0, -1):
        a, v, b = line[j].shape
        u, s, w = np.linalg.svd(line[j].reshape(a, v * b), full_matrices=False)
        keep = max(1, min(cut, int((s > 1e-15 * max(s[0], 1e-300)).sum())))
        line[j] = w[:keep].reshape(keep, v, b)
        line[j - 1] = np.tensordot(line[j - 1], u[:, :keep] * s[:keep], 1)
    return line


def absorbed(line: list[np.ndarray], row: list[np.ndarray], cut: int) -> list[np.ndarray]:
    """The line after a row of (left, up, right, down) tensors below it."""
    out = []
    for a, t in zip(line, row):
        x = np.einsum("aub,lurd->aldbr", a, t)
        out.append(x.reshape(x.shape[0] * x.shape[1], x.shape[2], -1))
    return compressed(out, cut)


def flipped(row: list[np.ndarray]) -> list[np.ndarray]:
    """The row seen from below."""
    return [t.transpose(0, 3, 2, 1) for t in row]


def edge_line(n: int) -> list[np.ndarray]:
    return [np.ones((1, 1, 1))] * n


def lines(rows: list[list[np.ndarray]], cut: int) -> tuple[list[list[np.ndarray]], list[list[np.ndarray]]]:
    """For each row the line of all rows above it, and of all below."""
    n = len(rows[0])
    up, down = [edge_line(n)], [edge_line(n)]
    for r in rows[:-1]:
        up.append(absorbed(up[-1], r, cut))
    for r in reversed(rows[1:]):
        down.append(absorbed(down[-1], flipped(r), cut))
    return up, down[::-1]


def step_right(env: np.ndarray, a: np.ndarray, t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The environment (upper bond, row bond, lower bond) one column on."""
    return np.einsum("xly,xua,lurd,ydb->arb", env, a, t, b, optimize=True)


def chosen(tensors: Tensors, shape: Site, c: dict[Site, int]) -> list[list[np.ndarray]]:
    return [[tensors[i, j][..., c[i, j]] for j in range(shape[1])] for i in range(shape[0])]


def amplitude(tensors: Tensors, shape: Site, c: dict[Site, int], cut: int) -> float:
    rows = chosen(tensors, shape, c)
    line = edge_line(shape[1])
    for r in rows:
        line = absorbed(line, r, cut)
    out = np.ones((1, 1))
    for a in line:
        out = out @ a[:, 0, :]
    return float(out[0, 0])


class Surroundings:
    """A configuration with the lines above and below each row, computed when first asked for, so that the amplitude of a
    configuration that differs in a few sites takes the rows of these sites alone."""

    def __init__(self, tensors: Tensors, shape: Site, c: dict[Site, int], cut: int):
        self.tensors, self.shape, self.c, self.cut = tensors, shape, dict(c), cut
        self.rows = chosen(tensors, shape, c)
        self.up, self.down = {0: edge_line(shape[1])}, {shape[0] - 1: edge_line(shape[1])}

    def above(self, i: int) -> list[np.ndarray]:
        for k in range(max(j for j in self.up if j <= i), i):
            self.up[k + 1] = absorbed(self.up[k], self.rows[k], self.cut)
        return self.up[i]

    def below(self, i: int) -> list[np.ndarray]:
        for k in range(min(j for j in self.down if j >= i), i, -1):
            self.down[k - 1] = absorbed(self.down[k], flipped(self.rows[k]), self.cut)
        return self.down[i]

    def amplitude(self, change: dict[Site, int] | None = None) -> float:
        """With other states on some sites."""
        change = {s: x for s, x in (change or {}).items() if self.c[s] != x}
        first, last = (min(i for i, _ in change), max(i for i, _ in change)) if change else (self.shape[0] - 1,) * 2
        line = self.above(first)
        for i in range(first, last + 1):
            line = absorbed(line, [self.tensors[i, j][..., change.get((i, j), self.c[i, j])] for j in range(self.shape[1])], self.cut)
        env = np.ones((1, 1))
        for a, b in zip(line, self.below(last)):
            env = np.einsum("xy,xva,yvb->ab", env, a, b, optimize=True)
        return float(env[0, 0])

    def changed(self, change: dict[Site, int]) -> Surroundings:
        """The surroundings after a change; lines that don't pass the changed rows stay."""
        out = Surroundings(self.tensors, self.shape, self.c | change, self.cut)
        rows = [i for (i, j), x in change.items() if self.c[i, j] != x]
        if rows:
            out.up |= {i: line for i, line in self.up.items() if i <= min(rows)}
            out.down |= {i: line for i, line in self.down.items() if i >= max(rows)}
        else:
            out.up, out.down = dict(self.up), dict(self.down)
        return out


def holes(tensors: Tensors, shape: Site, c: dict[Site, int], cut: int) -> Tensors:
    """The derivative of the amplitude by each site's tensor; zero at the physical states that c doesn't have."""
    rows = chosen(tensors, shape, c)
    up, down = lines(rows, cut)
    out = {}
    for i, row in enumerate(rows):
        left, right = [np.ones((1, 1, 1))], [np.ones((1, 1, 1))]
        for j in range(shape[1] - 1):
            left.append(step_right(left[-1], up[i][j], row[j], down[i][j]))
        turned = lambda a: a.transpose(2, 1, 0)
        for j in range(shape[1] - 1, 0, -1):
            right.append(step_right(right[-1], turned(up[i][j]), row[j].transpose(2, 1, 0, 3), turned(down[i][j])))
        right.reverse()
        for j in range(shape[1]):
            h = np.einsum("xly,xua,ydb,arb->lurd", left[j], up[i][j], down[i][j], right[j], optimize=True)
            out[i, j] = np.zeros_like(tensors[i, j])
            out[i, j][..., c[i, j]] = h
    return out


def doubled(t: np.ndarray) -> np.ndarray:
    """A tensor (left, up, right, down, physical) times itself, summed over the physical states."""
    x = np.einsum("lurdp,LURDp->lLuUrRdD", t, t)
    s = t.shape
    return x.reshape(s[0] ** 2, s[1] ** 2, s[2] ** 2, s[3] ** 2)


class DirectSampler:
    """Draws sites one after another from their distribution given the earlier ones, the later ones summed out through
    double-layer lines cut at `cut`; `alpha` flattens it. Negative weights of a cut line count as none."""

    def __init__(self, tensors: Tensors, shape: Site, cut: int, alpha: float = 1.0):
        self.tensors, self.shape, self.cut, self.alpha = tensors, shape, cut, alpha
        self.full = [[doubled(tensors[i, j]) for j in range(shape[1])] for i in range(shape[0])]
        self.down = lines(self.full, cut)[1]

    def draw(self, rng: np.random.Generator) -> tuple[float, dict[Site, int]]:
        """(possibility, configuration); draws anew, `TRIES` times at most, where rounding leaves no weight."""
        for _ in range(TRIES):
            found = self._drawn(rng)
            if found is not None:
                return found
        raise ValueError("every configuration has weight zero")

    def _drawn(self, rng: np.random.Generator) -> tuple[float, dict[Site, int]] | None:
        l1, l2 = self.shape
        up, c, possibility = edge_line(l2), {}, 1.0
        for i in range(l1):
            turned = lambda a: a.transpose(2, 1, 0)
            right = [np.ones((1, 1, 1))]
            for j in range(l2 - 1, 0, -1):
                right.append(step_right(right[-1], turned(up[j]), self.full[i][j].transpose(2, 1, 0, 3), turned(self.down[i][j])))
            right.reverse()
            env, row = np.ones((1, 1, 1)), []
            for j in range(l2):
                t = self.tensors[i, j]
                options = [doubled(t[..., p : p + 1]) for p in range(t.shape[4])]
                envs = [step_right(env, up[j], o, self.down[i][j]) for o in options]
                weight = np.array([max(float((e * right[j]).sum()), 0.0) for e in envs]) ** self.alpha
                if weight.sum() == 0:
                    return None
                weight /= weight.sum()
                p = min(int(np.searchsorted(np.cumsum(weight), rng.random(), "right")), len(weight) - 1)
                possibility *= weight[p]
                c[i, j], env = p, envs[p]
                row.append(options[p])
            up = absorbed(up, row, self.cut)
        return possibility, c


Element = tuple[list[Site], dict[tuple[int, ...], list[tuple[tuple[int, ...], float]]]]


def sweep(tensors: Tensors, shape: Site, elements: list[Element], c: dict[Site, int], cut: int, rng: np.random.Generator, restrict: Callable[[dict[Site, int]], bool] | None = None) -> tuple[dict[Site, int], float]:
    """One Metropolis step over all terms in their order; the configuration and its amplitude."""
    here = Surroundings(tensors, shape, c, cut)
    ws = here.amplitude()
    for sites, moves in elements:
        old = tuple(here.c[s] for s in sites)
        options = moves.get(old)
        if not options:
            continue
        new, _ = options[int(rng.integers(len(options)))]
        change = dict(zip(sites, new))
        if restrict is not None and not restrict(here.c | change):
            continue
        other = here.amplitude(change)
        back = len(moves.get(new, ())) or 1
        if ws == 0 or rng.random() < (other / ws) ** 2 * len(options) / back:
            here, ws = here.changed(change), other
    return here.c, ws


def local_energy(tensors: Tensors, shape: Site, elements: list[Element], c: dict[Site, int], ws: float, cut: int) -> float:
    here = Surroundings(tensors, shape, c, cut)
    known: dict[tuple, float] = {(): ws}
    total = 0.0
    for sites, moves in elements:
        for new, v in moves.get(tuple(c[s] for s in sites), ()):
            change = {s: x for s, x in zip(sites, new) if c[s] != x}
            key = tuple(sorted(change.items()))
            if key not in known:
                known[key] = here.amplitude(change)
            total += v * known[key] / ws
    return total
