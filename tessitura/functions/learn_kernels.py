"""Learning on sufficient statistics and small dense problems."""

from __future__ import annotations

import numpy as np

from tessitura.functions import kernels as K


def gaussian_models(sums: dict[str, np.ndarray], least: int, floor: float = 1e-6) -> dict | None:
    """Means and covariances, pooled and of each class, from sums of (1, z) (1, z)'; None with fewer than two classes of ``least`` rows."""
    kept = {c: g for c, g in sums.items() if g[0, 0] >= least}
    if len(kept) < 2:
        return None
    total = sum(kept.values())
    mean = total[0, 1:] / total[0, 0]
    spread = max(float(np.trace(total[1:, 1:]) / total[0, 0] - mean @ mean) / len(mean), 1e-12)
    eye = np.eye(len(mean)) * floor * spread
    means = np.array([g[0, 1:] / g[0, 0] for g in kept.values()])
    within = [g[1:, 1:] - g[0, 0] * np.outer(m, m) for g, m in zip(kept.values(), means, strict=True)]
    pooled = sum(within) / max(total[0, 0] - len(kept), 1) + eye
    own = [w / max(g[0, 0] - 1, 1) + eye for w, g in zip(within, kept.values(), strict=True)]
    return {"classes": list(kept), "means": means, "pooled": pooled, "own": own}


def gaussian_scores(model: dict, z: np.ndarray, pooled: bool) -> np.ndarray:
    """Probabilities of the model's classes for rows, with even priors: one covariance for all (LDA) or each its own (QDA)."""
    logs = []
    for m, own in zip(model["means"], model["own"], strict=True):
        cov = model["pooled"] if pooled else own
        d = z - m
        logs.append(-0.5 * ((d @ np.linalg.inv(cov)) * d).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1])
    logs = np.array(logs).T
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def ridge(gram: np.ndarray, xty: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(gram + alpha * np.eye(len(gram)), xty)


def effective_dof(gram: np.ndarray, lam: float) -> float:
    """Sum of s^2 / (s^2 + lambda) over the singular values."""
    e = np.maximum(np.linalg.eigvalsh(gram), 0)
    return float((e / (e + lam)).sum())


class ConvolutionModel:
    """A filter (channels x lags) and bias in terms of the Gramian of its design matrix, whose last column is ones."""

    def __init__(self, gram: np.ndarray, xty: np.ndarray, yty: float, n: int):
        self.gram, self.xty, self.yty, self.n = gram, xty, yty, n

    def error(self, w: np.ndarray) -> float:
        return float(self.yty - 2 * w @ self.xty + w @ self.gram @ w)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return 2 * (self.gram @ w - self.xty)

    def usefulness(self, w: np.ndarray) -> np.ndarray:
        """Correlation of every column with the residual."""
        return self.xty - self.gram @ w


def threshold_descent(model: ConvolutionModel, start: np.ndarray, step: float = 1e-3, threshold: float = 0.0, rounds: int = 5000, groups: np.ndarray | None = None, normalize: bool = True, slope: float = -1e-3, held: ConvolutionModel | None = None, patience: int = 10) -> np.ndarray:
    """Gradient descent on the entries whose size is at least threshold times the largest (of all, or of their group).

    It ends when the error's fall over five rounds is small. With a ``held``-out model it also ends when that one's error
    hasn't fallen for ``patience`` rounds, and returns the weights at which it was least.
    """
    w, errors = np.array(start, float), []
    best = (np.inf, w, 0)
    for _ in range(rounds):
        g = model.gradient(w)
        size = np.abs(g)
        top = np.array([size[groups == k].max() for k in groups]) if groups is not None else size.max()
        g = np.where(size >= threshold * top, g, 0)
        if normalize:
            g = g / max(np.linalg.norm(g), 1e-300)
        w = w - step * g
        errors.append(model.error(w))
        if held is not None:
            error = held.error(w)
            best = (error, w, 0) if error < best[0] else (best[0], best[1], best[2] + 1)
            if best[2] >= patience:
                break
        if len(errors) >= 5:
            last = np.array(errors[-5:])
            if np.polyfit(np.arange(5), last / max(abs(last[0]), 1e-300), 1)[0] > slope:
                break
    return w if held is None else best[1]


def in_crowd(model: ConvolutionModel, l1: float, l2: float = 0.0, fraction: float = 0.75, contrast: float = np.inf, rounds: int = 50, positive: bool = False, solver=None) -> np.ndarray:
    """Active-set basis pursuit: add the most useful columns, solve the small problem, drop zeros, until the set stays.

    ``solver``(gram, xty) solves the small problem instead of the elastic net.
    """
    w, active = np.zeros(len(model.xty)), np.zeros(0, int)
    for _ in range(rounds):
        use = np.abs(model.usefulness(w))
        rest = np.setdiff1d(np.arange(len(w)), active)
        add = rest[(use[rest] > l1) & (use[rest] >= fraction * use[rest].max(initial=0))]
        trial = np.union1d(active, add)
        if not len(trial):
            break
        small = model.gram[np.ix_(trial, trial)], model.xty[trial]
        sub = solver(*small) if solver else K.elastic_net(*small, l1, l2, positive)
        if np.isfinite(contrast):
            sub = np.where(np.abs(sub) >= np.abs(sub).max() / contrast, sub, 0)
        w = np.zeros(len(w))
        w[trial] = sub
        new = trial[sub != 0]
        if not len(add) or np.array_equal(new, active):
            break
        active = new
    return w


def sign_constrained(gram: np.ndarray, xty: np.ndarray, signs: np.ndarray, l1: float = 200.0) -> np.ndarray:
    """Least squares with l1 |w|_1 under given signs of the weights (1 or -1): columns are flipped, and what is solved is
    nonnegative."""
    s = np.where(signs < 0, -1.0, 1.0)
    return s * K.elastic_net(gram * np.outer(s, s), xty * s, l1, 0.0, True)


def difference_gradient(f, w: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    base = f(w)
    return np.array([(f(w + eps * e) - base) / eps for e in np.eye(len(w))])


def complex_pca(cov: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a Hermitian covariance, largest size first; each vector's largest entry is real and positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-np.abs(values), kind="stable")[:k]
    vectors = vectors[:, order]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values[order], vectors * (np.conj(lead) / np.abs(lead))


def complex_transform(z: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of complex rows on the components."""
    return z @ vectors


def complex_inverse(scores: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Rows from scores, by the conjugate transpose."""
    return scores @ np.conj(vectors).T


def demodulate(z: np.ndarray, over_space: bool = True, depth: int = 1) -> np.ndarray:
    """Complex signals (channels, times) with the phases of their leading components taken out.

    Over space the components are those of the channels' real and imaginary parts together; over time those of the two parts apart.
    """
    out = np.array(z, complex)
    for _ in range(depth):
        if over_space:
            parts = np.concatenate([out.real, out.imag])
            u, s, v = np.linalg.svd(parts - parts.mean(axis=1, keepdims=True), full_matrices=False)
            lead = v[0] * s[0] + 1j * (v[1] * s[1] if len(v) > 1 else 0)
        else:
            lead = sum(f * np.linalg.svd(p - p.mean(axis=1, keepdims=True), full_matrices=False)[2][0] for f, p in ((1, out.real), (1j, out.imag)))
        out = out * np.exp(-1j * np.angle(lead))[None]
    return out


def radial_fit(x: np.ndarray, y: np.ndarray, df: int = 3, folds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centers, widths, weights) of a radial basis: centers at percentiles, ridge strength by unshuffled cross-validation."""
    centers = np.percentile(x, [int((k + 1) * 100 / (df + 1)) for k in range(df)])
    edges = np.concatenate([[x.min()], centers, [x.max()]])
    widths = np.array([x[(x >= a) & (x <= b)].std(ddof=1) for a, b in zip(edges[:-2], edges[2:], strict=True)])
    basis = np.exp(-((x[:, None] - centers) ** 2) / widths)
    best = None
    for alpha in np.logspace(-4, 4, 20):
        scores, weights = [], []
        for part in np.array_split(np.arange(len(x)), folds):
            rest = np.setdiff1d(np.arange(len(x)), part)
            w = ridge(basis[rest].T @ basis[rest], basis[rest].T @ y[rest], alpha)
            err = y[part] - basis[part] @ w
            scores.append(1 - (err**2).sum() / max(((y[part] - y[part].mean()) ** 2).sum(), 1e-300))
            weights.append(w)
        if best is None or np.mean(scores) > best[0]:
            best = (np.mean(scores), np.mean(weights, axis=0))
    return centers, widths, best[1]


# --- nearest-neighbour information ----------------------------------------------------------------------------------


def _distances(a: np.ndarray, b: np.ndarray, block: int = 512):
    for lo in range(0, len(a), block):
        yield lo, np.abs(a[lo : lo + block, None, :] - b[None]).max(axis=2)


def _kth(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(a))
    for lo, d in _distances(a, b):
        out[lo : lo + len(d)] = np.partition(d, k, axis=1)[:, k]
    return out


def _within(a: np.ndarray, radius: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), int)
    for lo, d in _distances(a, a):
        out[lo : lo + len(d)] = (d <= radius[lo : lo + len(d), None]).sum(axis=1)
    return out


def knn_entropy(x: np.ndarray, k: int = 3, base: float = 2, seed: int = 0) -> float:
    x = x + 1e-10 * np.random.default_rng(seed).random(x.shape)
    n, d = x.shape
    return float((K.digamma(n) - K.digamma(k) + d * np.log(2) + d * np.mean(np.log(_kth(x, x, k)))) / np.log(base))


def knn_mi(x: np.ndarray, y: np.ndarray, k: int = 3, base: float = 2, seed: int = 0) -> float:
    """Kraskov's first estimator, with strict radii in the margins."""
    rng = np.random.default_rng(seed)
    x, y = x + 1e-10 * rng.random(x.shape), y + 1e-10 * rng.random(y.shape)
    r = _kth(np.hstack([x, y]), np.hstack([x, y]), k) - 1e-15
    a, b = K.digamma(_within(x, r)).mean(), K.digamma(_within(y, r)).mean()
    return float((-a - b + K.digamma(k) + K.digamma(len(x))) / np.log(base))


def knn_cmi(x: np.ndarray, y: np.ndarray, z: np.ndarray, k: int = 3, base: float = 2, seed: int = 0) -> float:
    rng = np.random.default_rng(seed)
    x, y, z = (v + 1e-10 * rng.random(v.shape) for v in (x, y, z))
    r = _kth(np.hstack([x, y, z]), np.hstack([x, y, z]), k) - 1e-15
    a, b, c = (K.digamma(_within(v, r)).mean() for v in (np.hstack([x, z]), np.hstack([y, z]), z))
    return float((-a - b + c + K.digamma(k)) / np.log(base))


def knn_kl(x: np.ndarray, other: np.ndarray, k: int = 3, base: float = 2) -> float:
    """Divergence of x from other; rows at distance 0 are left out of the mean."""
    own, far = _kth(x, x, k), _kth(x, other, k - 1)
    ok = (own > 0) & (far > 0)
    return float((np.log(len(other)) - np.log(len(x) - 1) + x.shape[1] * np.mean(np.log(far[ok] / own[ok]))) / np.log(base))
