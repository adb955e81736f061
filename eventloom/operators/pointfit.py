"""Fits of mutually-exciting processes on designs: what each event has behind it, once, in time linear in the events.

For fixed time scales the intensity at an event is linear in the parameters: mu of its kind plus, for each kind j and
scale m, alpha times the kernel mass E[c, j, m] of earlier events of kind j within reach. E does not depend on the
parameters, so it is made once, by prefix sums, and every step of a fit is a product of matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Design:
    """Of one or several realizations: each event's kind and E, the kernel mass G[j, m] that sources have, and the time."""

    kind: np.ndarray
    e: np.ndarray  # events by kinds by scales
    g: np.ndarray  # kinds by scales
    length: float

    @property
    def shape(self) -> tuple[int, int]:
        return self.g.shape


def design(t: np.ndarray, kind: np.ndarray, n_kinds: int, length: float, betas: np.ndarray, reach: float) -> Design:
    """Ties have no part in each other, and events exactly `reach` apart have."""
    order = np.argsort(t, kind="stable")
    t, kind = np.asarray(t, float)[order], np.asarray(kind, int)[order]
    e = np.zeros((len(t), n_kinds, len(betas)))
    for m, beta in enumerate(betas):
        # Slots as long as the reach keep the exponents small; beyond 600 time scales a kernel is nothing.
        far = min(reach, 600.0 / beta)
        slot = np.floor(t / far)
        for j in range(n_kinds):
            tj = t[kind == j]
            sj = np.floor(tj / far)
            total = np.concatenate(([0.0], np.cumsum(np.exp(beta * (tj - sj * far)))))
            begin = np.searchsorted(sj, slot, "left")  # the first of the event's own slot
            now = np.searchsorted(tj, t, "left")
            back = np.searchsorted(tj, t - far, "left")
            old = np.minimum(begin, np.maximum(back, np.searchsorted(sj, slot - 1, "left")))
            own = total[now] - total[np.maximum(begin, np.minimum(back, now))]
            before = total[begin] - total[old]
            e[:, j, m] = beta * (np.exp(-beta * (t - slot * far)) * own + np.exp(-beta * (t - (slot - 1) * far)) * before)
    g = np.zeros((n_kinds, len(betas)))
    np.add.at(g, kind, 1 - np.exp(-np.outer(np.minimum(reach, length - t), betas)))
    return Design(kind, e, g, length)


def together(parts: list[Design]) -> Design:
    """Several realizations with the same parameters as one."""
    return Design(np.concatenate([p.kind for p in parts]), np.concatenate([p.e for p in parts]), sum(p.g for p in parts), sum(p.length for p in parts))


@dataclass
class Fit:
    mu: np.ndarray
    alpha: np.ndarray  # kinds by kinds by scales
    loglik: float
    steps: int

    def branching(self, betas: np.ndarray, reach: float) -> np.ndarray:
        return (self.alpha * (1 - np.exp(-np.asarray(betas) * reach))).sum(axis=2)


def intensities(d: Design, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return mu[d.kind] + (alpha[d.kind] * d.e).sum(axis=(1, 2))


def loglik(d: Design, mu: np.ndarray, alpha: np.ndarray) -> float:
    with np.errstate(divide="ignore"):
        return float(np.log(intensities(d, mu, alpha)).sum() - mu.sum() * d.length - (alpha * d.g).sum())


def classes_of(n_kinds: int, sharing: str) -> np.ndarray:
    """The class of each pair of kinds whose kernels have one shape: cell (each its own), class (own and other), global."""
    if sharing == "cell":
        return np.arange(n_kinds * n_kinds).reshape(n_kinds, n_kinds)
    if sharing == "class":
        return (~np.eye(n_kinds, dtype=bool)).astype(int)
    if sharing == "global":
        return np.zeros((n_kinds, n_kinds), int)
    raise ValueError(f"no such sharing of kernels: {sharing}")


def fit(d: Design, sharing: str = "cell", l1: float = 0.0, start: np.ndarray | None = None, tol: float = 1e-8, most: int = 500) -> Fit:
    """Parameters of greatest (penalized) likelihood, by expectation and conditional maximization with squared extrapolation.

    alpha[i, j] = mass[i, j] * shape of its class. cell: masses and shapes are free, and the step is plain EM. Else
    masses are renewed given shapes, then shapes given masses. l1 is taken off for each unit of mass.
    """
    j, m = d.shape
    cls = classes_of(j, sharing)
    n_cls = int(cls.max()) + 1
    n = np.bincount(d.kind, minlength=j)
    flat = np.concatenate([np.maximum(0.5 * n / d.length, 1e-12), np.full(j * j * m, 0.1 / (j * m))]) if start is None else start.copy()

    def parts(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return theta[:j], theta[j:].reshape(j, j, m)

    def step(theta: np.ndarray) -> tuple[np.ndarray, float]:
        """The next parameters, and the penalized log-likelihood of these."""
        mu, alpha = parts(theta)
        lam = intensities(d, mu, alpha)
        value = float(np.log(lam).sum() - mu.sum() * d.length - (alpha * d.g).sum() - l1 * alpha.sum())
        ratio = d.e / lam[:, None, None]
        s = np.zeros((j, j, m))
        np.add.at(s, d.kind, ratio)
        s *= alpha
        base = np.maximum(mu * np.bincount(d.kind, 1 / lam, j) / d.length, 1e-12)
        if sharing == "cell":
            new = s / (d.g[None] + l1 + 1e-300)
        else:
            mass = alpha.sum(axis=2)
            shape = alpha / np.maximum(mass[..., None], 1e-300)
            mass = s.sum(axis=2) / np.maximum((shape * d.g[None]).sum(axis=2) + l1, 1e-300)
            top, low = np.zeros((n_cls, m)), np.zeros((n_cls, m))
            np.add.at(top, cls, s)
            np.add.at(low, cls, mass[..., None] * (d.g[None] + l1))
            new = mass[..., None] * (top / np.maximum(low, 1e-300))[cls]
        return np.concatenate([base, np.maximum(new, 1e-12).ravel()]), value

    if sharing != "cell" and start is not None:  # shapes must be shared from the start
        mu, alpha = parts(flat)
        mean = np.zeros((n_cls, m))
        np.add.at(mean, cls, alpha)
        shape = mean / mean.sum(axis=1, keepdims=True)
        flat = np.concatenate([mu, (alpha.sum(axis=2)[..., None] * shape[cls]).ravel()])
    old, steps = -np.inf, 0
    while steps < most:
        one, value = step(flat)
        steps += 1
        if abs(value - old) <= tol * max(1.0, abs(value)):
            break
        old = value
        two, value_one = step(one)
        r, v = one - flat, two - 2 * one + flat
        size = np.linalg.norm(v)
        far = min(-1.0, -np.linalg.norm(r) / size) if size > 1e-300 else -1.0
        leap = np.maximum(flat - 2 * far * r + far * far * v, 1e-3 * two)
        if sharing != "cell":  # a leap may leave shapes apart: a plain step shares them again
            leap = step(leap)[0]
        flat = leap if step(leap)[1] >= value_one else two
        steps += 2
    mu, alpha = parts(flat)
    return Fit(mu, alpha, loglik(d, mu, alpha), steps)


def multi_start(d: Design, sharing: str, n_starts: int, seed: int, **kw) -> tuple[Fit, float]:
    """The best fit from several starts, and how far the worst is below it."""
    j, m = d.shape
    rng = np.random.default_rng(seed)
    n = np.bincount(d.kind, minlength=j)
    fits = [fit(d, sharing, **kw)]
    for _ in range(n_starts - 1):
        start = np.concatenate([np.maximum(rng.uniform(0.2, 0.9, j) * n / d.length, 1e-12), rng.dirichlet(np.ones(j * m), j).ravel() * rng.uniform(0.1, 0.6)])
        fits.append(fit(d, sharing, start=start, **kw))
    best = max(fits, key=lambda f: f.loglik)
    return best, best.loglik - min(f.loglik for f in fits)


def gradient(d: Design, mu: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lam = intensities(d, mu, alpha)
    s = np.zeros_like(alpha)
    np.add.at(s, d.kind, d.e / lam[:, None, None])
    return np.bincount(d.kind, 1 / lam, len(mu)) - d.length, s - d.g[None]


def certificate(d: Design, f: Fit) -> float:
    """How much likelihood a better fit could have at most, by weak duality; 0 only at the greatest.

    The likelihood is concave, and at its greatest the compensators add up to the number of events. Scaled so that
    they do, no gradient may be above the most that its parameter's compensator allows: n * log(1 + worst) bounds the gap.
    """
    n = len(d.kind)
    own = f.mu.sum() * d.length + (f.alpha * d.g).sum()
    scale = n / own
    mu, alpha = f.mu * scale, f.alpha * scale
    gm, ga = gradient(d, mu, alpha)
    worst = max(float((gm / d.length).max()), float((ga / np.maximum(d.g[None], 1e-300))[:, d.g > 1e-12].max(initial=-1.0)), 0.0)
    return max(0.0, n * np.log1p(worst) + loglik(d, mu, alpha) - f.loglik)


def newton(d: Design, f: Fit, tol: float = 1e-9, most: int = 60) -> tuple[Fit, float]:
    """A second phase from a fit of free cells: projected Newton steps, kind by kind, and the certificate at the end.

    The likelihood is a sum over the kinds of targets, each with its own parameters, so each kind is a small concave
    problem. Parameters at zero whose gradient points below zero stay there.
    """
    j, m = d.shape
    mu, alpha = f.mu.copy(), f.alpha.copy()
    steps = f.steps
    for i in range(j):
        rows = d.kind == i
        x = np.column_stack([np.ones(rows.sum()), d.e[rows].reshape(rows.sum(), j * m)])
        cost = np.concatenate(([d.length], d.g.ravel()))
        w = np.concatenate(([mu[i]], alpha[i].ravel()))
        if not rows.any():
            mu[i], alpha[i] = 0.0, 0.0
            continue
        value = lambda w: float(np.log(np.maximum(x @ w, 1e-300)).sum() - cost @ w)
        now = value(w)
        for _ in range(most):
            lam = x @ w
            grad = x.T @ (1 / lam) - cost
            free = (w > 1e-10) | (grad > 0)
            if not free.any() or np.abs(np.where(free, grad * np.maximum(w, 1e-6 / cost.max()), 0)).max() < tol * len(lam):
                break
            h = (x[:, free] / lam[:, None]).T @ (x[:, free] / lam[:, None])
            move = np.zeros_like(w)
            move[free] = np.linalg.lstsq(h + 1e-12 * np.trace(h) * np.eye(free.sum()), grad[free], rcond=None)[0]
            size = 1.0
            while size > 1e-12:
                at = np.maximum(w + size * move, 0.0)
                if (x @ at > 0).all() and (v := value(at)) >= now:
                    break
                size /= 2
            else:
                break
            steps += 1
            better, w, now = v - now, at, v
            if better <= 1e-12 * max(1.0, abs(now)):
                break
        mu[i], alpha[i] = w[0], w[1:].reshape(j, m)
    out = Fit(mu, alpha, loglik(d, mu, alpha), steps)
    return out, certificate(d, out)


def held_out(parts: list[Design], penalties: list[float], sharing: str = "cell", folds: int = 4) -> list[tuple[float, float]]:
    """(penalty, mean log-likelihood of held-out realizations for each event) for each penalty; realizations are dealt to folds in turn."""
    out = []
    for p in penalties:
        total = n = 0.0
        for k in range(min(folds, len(parts))):
            train = [x for i, x in enumerate(parts) if i % folds != k]
            test = [x for i, x in enumerate(parts) if i % folds == k]
            if train and test:
                f = fit(together(train), sharing, l1=p, most=150, tol=1e-6)
                d = together(test)
                total += loglik(d, np.maximum(f.mu, 1e-9), f.alpha)
                n += len(d.kind)
        out.append((p, total / max(n, 1.0)))
    return out


# ---------------------------------------------------------------- truths, blocks, acceptance


def truth(rng: np.random.Generator, n_kinds: int, radius: float, dense: float) -> tuple[np.ndarray, np.ndarray]:
    """(mu, branching matrix) of a made process with this spectral radius and share of pairs that have any effect."""
    n = rng.gamma(2.0, 1.0, (n_kinds, n_kinds)) * (rng.random((n_kinds, n_kinds)) < dense)
    n[np.arange(n_kinds), np.arange(n_kinds)] += 0.5
    n *= radius / np.abs(np.linalg.eigvals(n)).max()
    return rng.uniform(0.2, 1.0, n_kinds), n


def expected_counts(mu: np.ndarray, n: np.ndarray, length: float) -> np.ndarray:
    """The mean number of events of each kind of a long realization."""
    return np.linalg.solve(np.eye(len(mu)) - n, mu * length)


def arm(mu: np.ndarray, n: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A truth matched to a fit: as it is; without any effect of a kind on itself; with that doubled. Mean counts stay as fitted."""
    own = np.diag(np.diag(n))
    changed = {"fitted": n, "no_self": n - own, "boosted_self": n + own}[name]
    radius = np.abs(np.linalg.eigvals(changed)).max()
    if radius >= 0.95:
        changed = changed * (0.95 / radius)
    counts = expected_counts(mu, n, 1.0)
    return np.maximum(counts - changed @ counts, 1e-3 * counts), changed


def spectral_blocks(weight: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A block for each node of a weighted graph: the normalized Laplacian's first vectors, parted by k means. Blocks are numbered by their first node."""
    w = (weight + weight.T) / 2
    degree = np.maximum(w.sum(axis=1), 1e-12)
    lap = np.eye(len(w)) - w / np.sqrt(np.outer(degree, degree))
    _, vec = np.linalg.eigh(lap)
    x = vec[:, :k]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    best, cost = np.zeros(len(x), int), np.inf
    for _ in range(10):
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:  # the farthest is likeliest to be the next
            far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centres)
        for _ in range(50):
            at = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[at == b].mean(axis=0) if (at == b).any() else c[b] for b in range(k)])
            if np.allclose(new, c):
                break
            c = new
        now = ((x - c[at]) ** 2).sum()
        if now < cost - 1e-12:
            best, cost = at, now
    names: dict[int, int] = {}
    return np.array([names.setdefault(int(b), len(names)) for b in best])


def block_means(n: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Means of a matrix over pairs of blocks, its diagonal left out where a block has other cells."""
    k = int(blocks.max()) + 1
    out = np.zeros((k, k))
    for a in range(k):
        for b in range(k):
            cells = np.outer(blocks == a, blocks == b)
            inner = cells & ~np.eye(len(n), dtype=bool)
            out[a, b] = n[inner if inner.any() else cells].mean()
    return out


def accept(units: list[Design], least: int, radius: float, betas: np.ndarray, reach: float) -> list[tuple[int, int, Fit]]:
    """(first unit, last unit, fit): successive units are fitted, and one that has too few events or whose fit explodes is merged
    with its smaller neighbour and fitted again, until every fit is accepted or one is left."""
    spans = [(i, i) for i in range(len(units))]
    fits: dict[tuple[int, int], Fit] = {}

    def fitted(s: tuple[int, int]) -> Fit:
        if s not in fits:
            fits[s] = fit(together(units[s[0] : s[1] + 1]), most=120, tol=1e-6)
        return fits[s]

    size = lambda s: sum(len(u.kind) for u in units[s[0] : s[1] + 1])
    while len(spans) > 1:
        bad = next((k for k, s in enumerate(spans) if size(s) < least or np.abs(np.linalg.eigvals(fitted(s).branching(betas, reach))).max() >= radius), None)
        if bad is None:
            break
        side = min((k for k in (bad - 1, bad + 1) if 0 <= k < len(spans)), key=lambda k: (size(spans[k]), k))
        a, b = sorted((bad, side))
        spans[a : b + 1] = [(spans[a][0], spans[b][1])]
    return [(*s, fitted(s)) for s in spans]
