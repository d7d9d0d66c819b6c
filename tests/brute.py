"""Plain NumPy versions of the semantics, sample by sample, for small fixtures."""

import numpy as np


def stack(df, column, keys=("instance_id", "sample_id")):
    """Vectors of a samples frame as (instances, samples, D), in key order."""
    pdf = df.select(*keys, column).toPandas().sort_values(list(keys))
    rows = np.stack(pdf[column].to_list())
    n = pdf[keys[0]].nunique()
    return rows.reshape(n, len(pdf) // n, -1)


def scores(X, w, bias):
    return 1 / (1 + np.exp(-(X @ np.asarray(w) + bias)))


def weights(X, x0, kw=1.0):
    return np.exp(-((X - x0) ** 2).sum(-1) / kw**2)


def normal_system(X, y, w):
    mean, std = X.mean(0), X.std(0) + 1e-8
    Z = np.c_[np.ones(len(X)), (X - mean) / std]
    return mean, std, Z, Z.T @ (Z * w[:, None]), Z.T @ (w * y)


def unscale(beta, mean, std):
    coeff = beta[1:] / std
    return coeff, beta[0] - coeff @ mean


def closed_form(X, y, w, ridge=1e-3):
    mean, std, Z, A, b = normal_system(X, y, w)
    return unscale(np.linalg.solve(A + ridge * np.eye(len(b)), b), mean, std)


def descent(X, y, w, ridge=1e-3, iters=500, lr=1e-2):
    mean, std, Z, _, b = normal_system(X, y, w)
    beta = np.zeros(len(b))
    for _ in range(iters):
        grad = Z.T @ (w * (Z @ beta - y)) + ridge * beta
        beta -= lr / max(w.sum(), 1e-12) * grad
    return unscale(beta, mean, std)


def adam(X, y, w, epochs=300, lr=0.01):
    mean, std, Z, _, b = normal_system(X, y, w)
    wn = w / w.sum()
    beta, m, v, loss = np.zeros(len(b)), np.zeros(len(b)), np.zeros(len(b)), []
    for t in range(1, epochs + 1):
        r = Z @ beta - y
        loss.append((wn * r * r).sum())
        g = 2 * Z.T @ (wn * r)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        beta = beta - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return *unscale(beta, mean, std), np.array(loss)


def r2(X, y, w, coeff, intercept, normalized=False):
    p = X @ coeff + intercept
    if normalized:
        w = w / w.sum()
        tot = (w * (y - (w * y).sum()) ** 2).sum()
    else:
        tot = (w * y * y).sum() - (w * y).sum() ** 2 / max(w.sum(), 1e-12)
    return 1 - (w * (y - p) ** 2).sum() / tot if tot > 1e-12 else 0.0
