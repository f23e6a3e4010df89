"""Hidden-state models of one series or of many: Kalman trend, Gaussian HMM."""

from __future__ import annotations

import numpy as np


def kalman_trend(x: np.ndarray, rounds: int = 5, min_rows: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(level, slope) of a local linear trend, filtered; noise variances are re-estimated ``rounds`` times from
    filter residuals. Below ``min_rows`` rows: the series itself and its differences."""
    n = len(x)
    if n < min_rows:
        return x.astype(float), np.diff(x, prepend=x[:1]).astype(float)
    step = np.array([[1.0, 1.0], [0.0, 1.0]])
    r = max(np.var(np.diff(x)) / 2, 1e-9)
    q = np.diag([r / 10, r / 100])
    for _ in range(max(rounds, 1)):
        state, cov = np.array([x[0], 0.0]), np.eye(2) * r * 10
        states, residual, moved = np.zeros((n, 2)), np.zeros(n), np.zeros((n, 2))
        for i in range(n):
            ahead, spread = step @ state, step @ cov @ step.T + q
            gain = spread[:, 0] / (spread[0, 0] + r)
            residual[i] = x[i] - ahead[0]
            moved[i] = gain * residual[i]
            state = ahead + moved[i]
            cov = spread - np.outer(gain, spread[0])
            states[i] = state
        fitted = x - states[:, 0]
        r = max(float(np.mean(residual[1:] * fitted[1:])), 1e-9)
        q = np.diag(np.maximum(np.mean(moved[1:] ** 2, axis=0), 1e-12))
    return states[:, 0], states[:, 1]


def log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """(rows, states) log density of full-covariance Gaussians."""
    out = np.empty((len(x), len(mean)))
    for s in range(len(mean)):
        root = np.linalg.cholesky(cov[s])
        z = np.linalg.solve(root, (x - mean[s]).T)
        out[:, s] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def forward_backward(log_b: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(state posteriors, summed transition posteriors, log likelihood) with scaled recursions."""
    n, k = log_b.shape
    shift = log_b.max(axis=1, keepdims=True)
    b = np.exp(log_b - shift)
    a, scale = np.empty((n, k)), np.empty(n)
    for i in range(n):
        a[i] = (start if i == 0 else a[i - 1] @ move) * b[i]
        scale[i] = a[i].sum() + 1e-300
        a[i] /= scale[i]
    back, moves = np.ones(k), np.zeros((k, k))
    post = np.empty((n, k))
    post[-1] = a[-1]
    for i in range(n - 2, -1, -1):
        pull = b[i + 1] * back / scale[i + 1]
        moves += a[i][:, None] * move * pull[None, :]
        back = move @ pull
        post[i] = a[i] * back
    post /= post.sum(axis=1, keepdims=True)
    return post, moves, float(np.log(scale).sum() + shift.sum())


def start_model(x: np.ndarray, k: int) -> dict:
    """Deterministic start: means at quantiles of the first dimension, common covariance, sticky moves."""
    order = np.argsort(x[:, 0], kind="stable")
    mean = np.array([x[part].mean(axis=0) for part in np.array_split(order, k)])
    cov = np.cov(x.T).reshape(x.shape[1], -1) + np.eye(x.shape[1]) * 1e-6
    move = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(move, 0.9)
    return {"start": np.full(k, 1 / k), "move": move, "mean": mean, "cov": np.array([cov] * k)}


def expect(x: np.ndarray, m: dict) -> dict[str, np.ndarray]:
    """Sufficient statistics of one series under a model; they add up over series."""
    post, moves, ll = forward_backward(log_density(x, m["mean"], m["cov"]), m["start"], m["move"])
    return {"start": post[0], "move": moves, "n": post.sum(axis=0), "x": post.T @ x, "xx": np.einsum("ts,ti,tj->sij", post, x, x), "ll": np.array([ll])}


def maximise(s: dict[str, np.ndarray], floor: float = 1e-6) -> dict:
    """Model from summed statistics."""
    n = s["n"][:, None] + 1e-9
    mean = s["x"] / n
    cov = s["xx"] / n[:, :, None] - mean[:, :, None] * mean[:, None, :] + np.eye(mean.shape[1]) * floor
    return {"start": (s["start"] + 1e-3) / (s["start"] + 1e-3).sum(), "move": (s["move"] + 1e-3) / (s["move"] + 1e-3).sum(axis=1, keepdims=True), "mean": mean, "cov": cov}


def viterbi(log_b: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    n, k = log_b.shape
    score, back, log_move = np.log(start + 1e-300) + log_b[0], np.zeros((n, k), int), np.log(move + 1e-300)
    for i in range(1, n):
        ways = score[:, None] + log_move
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + log_b[i]
    path = np.empty(n, int)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def hmm_regime(returns: np.ndarray, k: int = 3, rounds: int = 20, min_rows: int = 20) -> dict[str, np.ndarray]:
    """Most likely states of one series (not causal), numbered by rising mean, rows in the state so far and the
    probability to move to the lowest state next. Below ``min_rows`` rows: the middle state throughout."""
    n = len(returns)
    if n < min_rows or returns.std() == 0:
        return {"state": np.full(n, k // 2), "duration": np.arange(1, n + 1), "p_down": np.zeros(n)}
    x = np.clip(returns, *np.quantile(returns, [0.01, 0.99]))[:, None]
    m = start_model(x, k)
    for _ in range(rounds):
        m = maximise(expect(x, m), 1e-8)
    rank = np.argsort(np.argsort(m["mean"][:, 0], kind="stable"), kind="stable")
    path = viterbi(log_density(x, m["mean"], m["cov"]), m["start"], m["move"])
    held = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, path[1:] != path[:-1]), np.arange(n), 0)) + 1
    return {"state": rank[path], "duration": held, "p_down": m["move"][path, int(np.argmin(m["mean"][:, 0]))]}


# --- many series at once ----------------------------------------------------------------------------


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series below each other, filled up with zeros at the end, and which places are rows."""
    n = np.array([len(r) for r in rows])
    live = np.arange(n.max()) < n[:, None]
    out = np.zeros(live.shape)
    out[live] = np.concatenate(rows)
    return out, live


def _fitted(x: np.ndarray, live: np.ndarray, start: list[dict], rounds: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """EM of one-dimensional models, one for each row of ``x``: a step of time is taken for all series at once. Models, and the log densities of the rows under them."""
    s, t, k = len(x), x.shape[1], len(start[0]["start"])
    m = {name: np.stack([one[name].reshape(shape) for one in start]) for name, shape in (("start", (k,)), ("move", (k, k)), ("mean", (k,)), ("cov", (k,)))}

    def densities() -> np.ndarray:
        root = np.sqrt(m["cov"])
        z = (x[:, :, None] - m["mean"][:, None, :]) / root[:, None, :]
        return -0.5 * z**2 - np.log(root)[:, None, :] - 0.5 * np.log(2 * np.pi)

    some = live[:, :, None]
    for _ in range(rounds):
        log_b = densities()
        b = np.exp(log_b - log_b.max(axis=2, keepdims=True))
        a, scale = np.empty((t, s, k)), np.ones((t, s))
        for i in range(t):
            now = (m["start"] if i == 0 else np.einsum("si,sij->sj", a[i - 1], m["move"])) * b[:, i]
            scale[i] = now.sum(axis=1) + 1e-300
            a[i] = now / scale[i][:, None]
        back, moves, post = np.ones((s, k)), np.zeros((s, k, k)), np.empty((t, s, k))
        post[-1] = a[-1]
        for i in range(t - 2, -1, -1):
            on = live[:, i + 1, None]  # the last row of a series has nothing behind it
            pull = np.where(on, b[:, i + 1] * back / scale[i + 1][:, None], 0.0)
            moves += a[i][:, :, None] * m["move"] * pull[:, None, :]
            back = np.where(on, np.einsum("sij,sj->si", m["move"], pull), 1.0)
            post[i] = a[i] * back
        post = np.where(some, post.transpose(1, 0, 2), 0.0)
        post = post / np.where(some, post.sum(axis=2, keepdims=True), 1.0)
        n = post.sum(axis=1) + 1e-9
        mean = np.einsum("stk,st->sk", post, x) / n
        first = post[:, 0] + 1e-3
        m = {"start": first / first.sum(axis=1, keepdims=True), "move": (moves + 1e-3) / (moves + 1e-3).sum(axis=2, keepdims=True), "mean": mean, "cov": np.einsum("stk,st->sk", post, x**2) / n - mean * mean + 1e-8}
    return m, densities()


def _viterbis(log_b: np.ndarray, live: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Most likely paths of many series; -1 beyond their ends."""
    s, t, k = log_b.shape
    score, back, log_move = np.log(start + 1e-300) + log_b[:, 0], np.zeros((t, s, k), int), np.log(move + 1e-300)
    for i in range(1, t):
        ways = score[:, :, None] + log_move
        back[i] = np.where(live[:, i, None], ways.argmax(axis=1), np.arange(k))
        score = np.where(live[:, i, None], ways.max(axis=1) + log_b[:, i], score)
    path, each = np.empty((s, t), int), np.arange(s)
    path[:, -1] = score.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = back[i, each, path[:, i]]
    return np.where(live, path, -1)


def hmm_regimes(returns: list[np.ndarray], k: int = 3, rounds: int = 20, min_rows: int = 20, cells: int = 2**16) -> list[dict[str, np.ndarray]]:
    """``hmm_regime`` of many series, fitted together: those of like length step through time at once, up to ``cells`` places (a longer series by itself)."""
    out: list[dict | None] = [hmm_regime(r, k, rounds, min_rows) if len(r) < min_rows or r.std() == 0 else None for r in returns]
    order = sorted((i for i, o in enumerate(out) if o is None), key=lambda i: len(returns[i]), reverse=True)
    while order:
        lot, order = order[: max(1, cells // len(returns[order[0]]))], order[max(1, cells // len(returns[order[0]])) :]
        clipped = [np.clip(returns[i], *np.quantile(returns[i], [0.01, 0.99])) for i in lot]
        x, live = _padded(clipped)
        m, log_b = _fitted(x, live, [start_model(c[:, None], k) for c in clipped], rounds)
        paths = _viterbis(log_b, live, m["start"], m["move"])
        rank = np.argsort(np.argsort(m["mean"], axis=1, kind="stable"), axis=1, kind="stable")
        for j, i in enumerate(lot):
            path = paths[j, : len(returns[i])]
            n = np.arange(len(path))
            held = n - np.maximum.accumulate(np.where(np.append(True, path[1:] != path[:-1]), n, 0)) + 1
            out[i] = {"state": rank[j][path], "duration": held, "p_down": m["move"][j][path, int(np.argmin(m["mean"][j]))]}
    return out
