"""Dense numerics on one group's data, in numpy; operators.dating and others run them per group."""

from __future__ import annotations

import math

import numpy as np

from cladeflow.functions.special import t_quantile


def descending_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on; each vector's largest component is positive."""
    vals, vecs = np.linalg.eigh((a + a.T) / 2)
    vals, vecs = vals[::-1], vecs[:, ::-1]
    sign = np.sign(vecs[np.abs(vecs).argmax(axis=0), np.arange(vecs.shape[1])])
    return vals, vecs * np.where(sign == 0, 1, sign)


def classical_mds(d: np.ndarray, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in k dimensions and all eigenvalues of the centred squared distances."""
    c = np.eye(len(d)) - 1 / len(d)
    vals, vecs = descending_eigen(-0.5 * c @ (d * d) @ c)
    out = np.zeros((len(d), k))
    m = min(k, len(d))
    out[:, :m] = vecs[:, :m] * np.sqrt(np.maximum(vals[:m], 0))
    return out, vals


def metricity(d: np.ndarray, k: int = 4) -> dict[str, float]:
    """How far distances are from Euclidean ones: share of negative spectrum, dimensions for 90 %, fit of k."""
    x, vals = classical_mds(d, k)
    pos = np.maximum(vals, 0)
    near = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(-1))
    iu = np.triu_indices(len(d), 1)
    r = np.corrcoef(d[iu], near[iu])[0, 1] if len(d) > 2 and d[iu].std() > 0 and near[iu].std() > 0 else np.nan
    return {"negative": float(np.abs(np.minimum(vals, 0)).sum() / max(np.abs(vals).sum(), 1e-300)), "dims90": int(np.searchsorted(np.cumsum(pos), 0.9 * pos.sum()) + 1), "fit": float(r)}


def adaptive_sigma(d: np.ndarray) -> float:
    """The 15th percentile of the positive distances, at least 0.005."""
    v = d[np.triu_indices(len(d), 1)]
    v = v[v > 0]
    return max(float(np.percentile(v, 15)), 0.005) if len(v) else 0.005


def normalised_laplacian(w: np.ndarray) -> np.ndarray:
    deg = w.sum(axis=1)
    s = 1 / np.sqrt(np.maximum(deg, 1e-12))
    return np.eye(len(w)) - s[:, None] * w * s[None, :]


def nystrom_embedding(to_landmarks: np.ndarray, landmarks: np.ndarray, k: int) -> np.ndarray:
    """Leading k eigenvectors of the normalised affinity of all rows, from their affinities to a few landmarks."""
    vals, vecs = np.linalg.eigh(landmarks)
    root = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-9))) @ vecs.T
    z = to_landmarks @ root
    deg = np.maximum(z @ z.sum(axis=0), 1e-12)
    u, _, _ = np.linalg.svd(z / np.sqrt(deg)[:, None], full_matrices=False)
    u = u[:, :k]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return u * np.where(sign == 0, 1, sign)


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Labels and inertia, seeds spread by distance."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d2 = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d2 / d2.sum())] if d2.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    label = np.zeros(len(x), int)
    for i in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(axis=1)
        if i and (new == label).all():
            break
        label = new
        for j in range(k):
            if (label == j).any():
                c[j] = x[label == j].mean(axis=0)
    return label, float(((x - c[label]) ** 2).sum())


def spectral_clusters(w: np.ndarray, most: int = 6, gap: float = 0.02) -> tuple[np.ndarray, int]:
    """Labels for the number of clusters at the largest eigengap, 1 if none exceeds `gap`."""
    vals, vecs = np.linalg.eigh(normalised_laplacian(w))
    most = min(most, len(w) - 1)
    gaps = np.diff(vals[: most + 1])
    k = int(gaps.argmax()) + 1 if len(gaps) and gaps.max() > gap else 1
    if k == 1:
        return np.zeros(len(w), int), 1
    u = vecs[:, :k]
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    return kmeans(u, k)[0], k


def clusters_of(w: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters in the leading vectors of the normalised affinity."""
    if k <= 1:
        return np.zeros(len(w), int)
    u = np.linalg.eigh(normalised_laplacian(w))[1][:, :k]
    return kmeans(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), k)[0]


def modularity_cut(w: np.ndarray, order: np.ndarray, min_size: int) -> tuple[int, float]:
    """(k, modularity) of the best cut of the nodes in that order into the first k and the rest, both with min_size nodes; (0, 0)
    if there is none. One pass over running sums of the ordered weights."""
    n = len(order)
    whole = w.sum()
    if n < 2 * min_size or whole <= 1e-12:
        return 0, 0.0
    a = w[np.ix_(order, order)]
    deg = a.sum(axis=1)
    k0 = np.cumsum(deg)
    inside = np.cumsum(2 * np.tril(a, -1).sum(axis=1) + np.diag(a))
    rest = whole - 2 * k0 + inside
    q = (inside - k0**2 / whole + rest - (whole - k0) ** 2 / whole) / whole
    q = q[min_size - 1 : n - min_size]
    best = int(q.argmax())
    return best + min_size, float(q[best])


def farthest_points(d: np.ndarray, k: int) -> list[int]:
    """Greedy picks, each the farthest from those before; starts at the row with the largest sum; ties to the first."""
    if not len(d):
        return []
    picks = [int(d.sum(axis=1).argmax())]
    near = d[picks[0]].copy()
    while len(picks) < min(k, len(d)):
        near[picks] = -1
        picks.append(int(near.argmax()))
        near = np.minimum(near, d[picks[-1]])
    return picks


def leader_bins(sim: np.ndarray, least: float) -> np.ndarray:
    """Bin of each row in order: the first earlier leader similar enough, else a new bin."""
    leaders: list[int] = []
    out = np.empty(len(sim), int)
    for i in range(len(sim)):
        hit = next((b for b, j in enumerate(leaders) if sim[i, j] >= least), None)
        if hit is None:
            hit = len(leaders)
            leaders.append(i)
        out[i] = hit
    return out


# clocks


def aicc(rss: float, n: int, k: int) -> float:
    return n * math.log(max(rss, 1e-300) / n) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)


def generalised_line(t: np.ndarray, y: np.ndarray, cov: np.ndarray) -> dict[str, float]:
    """Line under a covariance: slope, intercept, standard error, log likelihood (restricted)."""
    n = len(t)
    x = np.c_[np.ones(n), t]
    # distances need not be tree-like: negative directions of the covariance are held just above zero
    vals, vecs = np.linalg.eigh((cov + cov.T) / 2)
    vals = np.maximum(vals, 1e-8 * max(vals.max(), 1e-12))
    white = vecs.T / np.sqrt(vals)[:, None]
    xs, ys = white @ x, white @ y
    xtx = xs.T @ xs
    beta = np.linalg.solve(xtx, xs.T @ ys)
    rss = float(((ys - xs @ beta) ** 2).sum())
    s2 = rss / max(n - 2, 1)
    logdet = np.log(vals).sum()
    reml = -0.5 * ((n - 2) * math.log(max(s2, 1e-300)) + logdet + np.linalg.slogdet(xtx)[1])
    return {"intercept": float(beta[0]), "slope": float(beta[1]), "se": math.sqrt(max(s2 * np.linalg.inv(xtx)[1, 1], 0)), "s2": s2, "reml": float(reml), "rss": rss}


def golden(f, lo: float, hi: float, steps: int = 40) -> float:
    g = (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if f(a) > f(b) else (a, hi)
    return (lo + hi) / 2


def pagel_line(t: np.ndarray, y: np.ndarray, shared: np.ndarray) -> dict[str, float]:
    """Line under shared ancestry, off-diagonals scaled by lambda in [0, 1], lambda by restricted likelihood."""
    # scaled to a unit diagonal the covariances of all lambdas have the same directions: one decomposition serves the search
    scale = np.sqrt(np.maximum(np.diag(shared), 1e-12))
    vals, vecs = np.linalg.eigh((shared + shared.T) / 2 / scale[:, None] / scale[None, :])
    xs, ys = vecs.T @ (np.c_[np.ones(len(t)), t] / scale[:, None]), vecs.T @ (y / scale)
    n, logdet = len(t), 2 * np.log(scale).sum()

    def reml(lam: float) -> float:
        v = lam * vals + 1 - lam
        v = np.maximum(v, 1e-8 * max(v.max(), 1e-12))
        a, b = xs / np.sqrt(v)[:, None], ys / np.sqrt(v)
        xtx = a.T @ a
        rss = float(((b - a @ np.linalg.solve(xtx, a.T @ b)) ** 2).sum())
        return -0.5 * ((n - 2) * math.log(max(rss / max(n - 2, 1), 1e-300)) + np.log(v).sum() + logdet + np.linalg.slogdet(xtx)[1])

    lam = golden(reml, 0.0, 1.0)
    return generalised_line(t, y, lam * shared + (1 - lam) * np.diag(scale**2)) | {"lambda": lam}


def power_line(t: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """y = a + b (t - t0)^c with the exponent by golden section, from several starts t0 before the first sample."""
    span = max(t.max() - t.min(), 1e-9)
    best: dict[str, float] = {}
    for back in np.geomspace(0.01, 20.0, 28):
        u = (t - t.min()) / span + back

        def rss(c: float, u=u) -> tuple[float, np.ndarray]:
            x = np.c_[np.ones(len(u)), u**c]
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            return float(((y - x @ beta) ** 2).sum()), beta

        c = golden(lambda v: -rss(v)[0], 0.2, 3.0)
        r, beta = rss(c)
        if not best or r < best["rss"]:
            best = {"rss": r, "exponent": c, "origin": float(t.min() - back * span), "a": float(beta[0]), "b": float(beta[1])}
    return best


def restricted_spline(t: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Cubic spline that is linear outside its three knots (10th, 50th, 90th percentile), against the line by an F ratio."""
    k = np.percentile(t, [10, 50, 90])
    if k[2] - k[1] <= 0 or k[1] - k[0] <= 0:
        return {"rss": float(((y - y.mean()) ** 2).sum()), "f": 0.0}
    p = lambda a: np.maximum(t - a, 0) ** 3
    curve = (p(k[0]) - p(k[1]) * (k[2] - k[0]) / (k[2] - k[1]) + p(k[2]) * (k[1] - k[0]) / (k[2] - k[1])) / (k[2] - k[0]) ** 2
    fit = lambda x: float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
    line, full = fit(np.c_[np.ones(len(t)), t]), fit(np.c_[np.ones(len(t)), t, curve])
    return {"rss": full, "f": (line - full) / max(full / max(len(t) - 3, 1), 1e-300)}


def broken_line(t: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Two joined lines, the join at the sampled time with the least residuals."""
    best = {"rss": math.inf, "at": float("nan")}
    for a in np.unique(t)[1:-1]:
        x = np.c_[np.ones(len(t)), t, np.maximum(t - a, 0)]
        r = float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
        if r < best["rss"]:
            best = {"rss": r, "at": float(a)}
    return best


def wild_bootstrap(t: np.ndarray, y: np.ndarray, times: int = 2000, seed: int = 42) -> tuple[float, float]:
    """95 % interval of the zero crossing by sign-flipped residuals."""
    rng = np.random.default_rng(seed)
    x = np.c_[np.ones(len(t)), t]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    res = y - x @ beta
    signs = rng.choice([-1.0, 1.0], (times, len(t)))
    again = np.linalg.lstsq(x, (x @ beta + signs * res).T, rcond=None)[0]
    ok = again[1] > 1e-12
    at = -again[0][ok] / again[1][ok]
    return (float(np.percentile(at, 2.5)), float(np.percentile(at, 97.5))) if ok.any() else (math.nan, math.nan)


#: fixed values: tiers of communities
PAIR, SINGLE, OPEN = "Contemporaneous Acute Dyad", "Singleton Node", "Indeterminate"
ACTIVE, EMERGENT = "Active Outbreak Chain", "Emergent Seed Cluster"
EXTINCT, STATIONARY = "Endemic Extinct Lineage", "Stationary Chronic Compartment"
#: fixed values: rates and shares of explained variance that separate the tiers, years that count as recent
TIER_RATE, TIER_R2, FLAT_R2, RECENT_ORIGIN, RECENT_BOUND, LONG_SPAN = 1e-3, 0.15, 0.02, 6.0, 4.0, 5.0


def effective_size(pairs: np.ndarray, decay: float = 100.0) -> float:
    """n^2 over the sum of exp(-decay d), between 1 and n; pairs without a distance add nothing."""
    n = len(pairs)
    if n <= 2:
        return float(n)
    total = np.exp(-decay * pairs[np.isfinite(pairs)]).sum()
    return float(np.clip(n * n / total, 1, n)) if total > 0 else float(n)


def origin_set(rate: float, d0: float, se: float, se0: float, t_ref: float, df: float, level: float = 0.975) -> tuple[float, float, str]:
    """Confidence set of the time at which a line reaches zero, and its state: bounded (OK), or open because
    the rate is not told from zero."""
    if df < 1 or abs(rate) < 1e-12:
        return math.nan, math.nan, "UNIDENTIFIABLE_RATE"
    q = t_quantile(level, df)
    g = (q * se / rate) ** 2
    if g >= 1:
        return -math.inf, math.inf, "RATE_UNIDENTIFIABLE_G_GE_1"
    c = d0 / rate
    disc = c * c - (1 - g) * (d0 * d0 - (q * se0) ** 2) / rate**2
    if not disc >= 0:
        return -math.inf, math.inf, "COMPLEX_ROOTS"
    half = math.sqrt(disc)
    return t_ref - (c + half) / (1 - g), t_ref - (c - half) / (1 - g), "OK"


def community_clock(t: np.ndarray, d: np.ndarray, pairs: np.ndarray) -> dict:
    """Clock of one community: divergence from its earliest sample, effective size from the pair distances,
    confidence set of the origin, and its activity tier.

    Taxa without a distance to the earliest sample (NaN) are left out of the line. Without a line the origin is
    the earliest sample and the tier open; so is the origin of a line that does not rise. An upper bound
    is not later than the earliest sample. Active and emergent need a bounded set of the origin."""
    n = len(t)
    first = float(t.min()) if n else None
    out = {"n": n, "n_eff": float(n), "rate": 0.0, "se": 0.0, "r2": 0.0, "origin": first, "low": first, "high": first, "state": "OK", "tier": OPEN}
    if n < 3:
        return out | {"state": "TOO_SMALL", "tier": PAIR if n == 2 else SINGLE}
    ok = np.isfinite(d)
    if not ok.any():
        return out | {"state": "REGRESSION_FAILED"}
    x, y = t[ok], d[ok]
    stt = float(((x - x.mean()) ** 2).sum())
    if stt < 1e-12:
        return out | {"state": "ZERO_TIME_VAR"}
    eff = effective_size(pairs)
    df = max(eff - 2, 1)
    rate = float(((x - x.mean()) * (y - y.mean())).sum() / stt)
    tss = float(((y - y.mean()) ** 2).sum())
    s2 = max(tss - rate * rate * stt, 0) / df
    r2 = min(rate * rate * stt / tss, 1.0) if tss > 0 else 0.0
    low, high, state = origin_set(rate, float(y.mean()), math.sqrt(s2 / stt), math.sqrt(s2 / eff), float(x.mean()), df)
    if math.isfinite(high):
        high = min(high, first)
    last = float(t.max())
    origin = min(float(x.mean() - y.mean() / rate), first) if rate > 1e-12 else first
    recent = origin >= last - RECENT_ORIGIN or (math.isfinite(high) and high >= last - RECENT_BOUND)
    sure = state == "OK" and recent
    if sure and rate >= TIER_RATE and r2 >= TIER_R2:
        tier = ACTIVE
    elif sure and rate >= TIER_RATE / 2:
        tier = EMERGENT
    elif rate <= 0 or (last - first > LONG_SPAN and r2 < FLAT_R2):
        tier = EXTINCT
    else:
        tier = STATIONARY
    return out | {"n_eff": eff, "rate": rate, "se": math.sqrt(s2 / stt), "r2": r2, "origin": origin, "low": low, "high": high, "state": state, "tier": tier}


# trees


def neighbour_joining(d: np.ndarray, names: list[str]) -> list[tuple[int, int | None, float, str | None]]:
    """Nodes (node, parent, length, name) of the joined tree; negative branches count as 0. Ties join the first pair."""
    n = len(names)
    if n == 0:
        return []
    nodes: list[list] = [[i, None, 0.0, names[i]] for i in range(n)]
    live, m = list(range(n)), d.astype(float).copy()
    while len(live) > 2:
        k = len(live)
        r = m.sum(axis=1)
        q = (k - 2) * m - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), k)
        i, j = min(i, j), max(i, j)
        li = 0.5 * m[i, j] + (r[i] - r[j]) / (2 * (k - 2))
        new = len(nodes)
        nodes.append([new, None, 0.0, None])
        for x, length in ((i, li), (j, m[i, j] - li)):
            nodes[live[x]][1], nodes[live[x]][2] = new, max(float(length), 0.0)
        row = 0.5 * (m[i] + m[j] - m[i, j])
        keep = [x for x in range(k) if x not in (i, j)]
        m = np.block([[m[np.ix_(keep, keep)], row[keep][:, None]], [row[keep][None, :], np.zeros((1, 1))]])
        live = [live[x] for x in keep] + [new]
    if len(live) == 2:
        root = len(nodes)
        nodes.append([root, None, 0.0, None])
        for x in live:
            nodes[x][1], nodes[x][2] = root, float(m[0, 1]) / 2
    return [tuple(x) for x in nodes]


def reroot_midpoint(nodes: list[tuple]) -> list[tuple]:
    """The same tree rooted in the middle of its longest tip-to-tip path."""
    if len(nodes) < 3:
        return nodes
    adj: dict[int, list[tuple[int, float]]] = {x[0]: [] for x in nodes}
    name = {x[0]: x[3] for x in nodes}
    for v, p, length, _ in nodes:
        if p is not None:
            adj[v].append((p, length))
            adj[p].append((v, length))
    tips = [v for v in adj if name[v] is not None]

    def reach(s: int) -> dict[int, tuple[float, int | None]]:
        seen, todo = {s: (0.0, None)}, [s]
        while todo:
            v = todo.pop()
            for w, length in adj[v]:
                if w not in seen:
                    seen[w] = (seen[v][0] + length, v)
                    todo.append(w)
        return seen

    a = max(tips, key=lambda v, s=reach(tips[0]): s[v][0])
    far = reach(a)
    b = max(tips, key=lambda v: far[v][0])
    half, v = far[b][0] / 2, b
    while far[v][1] is not None and far[far[v][1]][0] > half:
        v = far[v][1]
    up = far[v][1]
    if up is None:
        return nodes
    root = max(adj) + 1
    out = [(root, None, 0.0, None), (v, root, far[v][0] - half, name[v]), (up, root, half - far[up][0], name[up])]
    todo = [(v, up), (up, v)]
    while todo:
        x, came = todo.pop()
        for w, length in adj[x]:
            if w != came:
                out.append((w, x, length, name[w]))
                todo.append((w, x))
    return out


def newick_text(nodes: list[tuple]) -> str:
    """Newick of a node list; children in order of their numbers."""
    kids: dict = {}
    for v, p, length, name in sorted(nodes):
        kids.setdefault(p, []).append((v, length, name))
    done: dict[int, str] = {}
    order, todo = [], [r for r in kids.get(None, [])]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += kids.get(x[0], [])
    for v, length, name in reversed(order):
        inner = "(" + ",".join(done[k[0]] for k in kids[v]) + ")" if v in kids else ""
        done[v] = f"{inner}{name or ''}:{length:.6g}"
    roots = kids.get(None, [])
    return done[roots[0][0]].rsplit(":", 1)[0] + ";" if roots else ";"


def root_to_tip(nodes: list[tuple]) -> dict[str, float]:
    length = {v: (p, le) for v, p, le, _ in nodes}

    def depth(v: int) -> float:
        s = 0.0
        while v is not None:
            p, le = length[v]
            s += le
            v = p
        return s

    return {name: depth(v) for v, _, _, name in nodes if name is not None}


# space, sampling, alignment


#: fixed values: kilometres of a degree, and the 95 % point of chi-square with two degrees of freedom
DEGREE_KM, CHI2_95 = 111.32, 5.991


def epicentre(lat: np.ndarray, lon: np.ndarray, cov: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Generalised least-squares centre of points under a covariance, with `ridge` on its diagonal, and its 95 % radius in
    kilometres. Weights keep their signs; the variance is pooled over both axes."""
    n = len(lat)
    inv = np.linalg.inv(cov + ridge * np.eye(n))
    mass = inv.sum()
    w = inv.sum(axis=1) / mass
    centre = np.array([w @ lat, w @ lon])
    off = np.stack([lat, lon], axis=1) - centre
    s2 = np.einsum("ik,ij,jk->", off, inv, off) / max(2 * n - 2, 1)
    return float(centre[0]), float(centre[1]), math.sqrt(max(s2 / mass, 0.0)) * DEGREE_KM * math.sqrt(CHI2_95)


def population_draws(n: int, edges: int, draws: int = 10_000, seed: int = 42) -> np.ndarray:
    """Active population under uncertain reproduction number, dispersion and clustering; seeded, sorted."""
    rng = np.random.default_rng(seed)
    r0, k = rng.uniform(1.2, 2, draws), rng.uniform(0.1, 0.5, draws)
    phi = rng.uniform(0, 0.4, draws)
    fano = 1 + 2 * edges / n * (1 + 1 / k)
    e = np.maximum(edges + np.sqrt(edges * fano) * rng.standard_normal(draws), 1)
    return np.sort(r0 * n * n * (1 - phi) / (2 * e))


def affine_align(score: np.ndarray, gap_open: float = -10.0, gap_more: float = -1.0) -> list[tuple[int, int]]:
    """Global alignment of rows to columns: matched (row, column) pairs, by affine-gap dynamic programming."""
    n, m = score.shape
    neg = -1e18
    best, left, up = (np.full((n + 1, m + 1), neg) for _ in range(3))
    best[0, 0] = 0
    ks = np.arange(1, m + 1)
    left[0, 1:] = gap_open + gap_more * (ks - 1)
    best[0, 1:] = left[0, 1:]
    for i in range(1, n + 1):
        up[i] = np.maximum(best[i - 1] + gap_open, up[i - 1] + gap_more)
        base = np.maximum(up[i], np.r_[neg, best[i - 1, :-1] + score[i - 1]])
        # a gap run along the row ends at j: the best start before it
        run = np.maximum.accumulate(base - gap_more * np.arange(m + 1))
        left[i, 1:] = run[:-1] + gap_open + gap_more * (ks - 1)
        best[i] = np.maximum(base, left[i])
    out, i, j = [], n, m
    while i > 0 and j > 0:
        if best[i, j] == best[i - 1, j - 1] + score[i - 1, j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i, j] == up[i, j]:
            while i > 0 and up[i, j] != best[i - 1, j] + gap_open and i > 1:
                i -= 1
            i -= 1
        else:
            k = j - 1
            while k > 0 and not np.isclose(left[i, j], best[i, k] + gap_open + gap_more * (j - k - 1), rtol=0, atol=1e-9):
                k -= 1
            j = k
    return out[::-1]


def tree_rotations(distance: np.ndarray, dim: int, base: float = 100.0) -> np.ndarray:
    """Cosine factors of rotary positions on a tree: mean over frequencies of cos(d / base^(2k/dim))."""
    f = base ** (-2 * np.arange(dim // 2) / dim)
    return np.cos(distance[..., None] * f).mean(axis=-1)


def binary_segments(x: np.ndarray, least: float, min_len: int = 5) -> list[tuple[int, int, float]]:
    """Changepoints by recursive splits where the standardised mean shift is largest and at least `least`:
    (first, last, mean) of the segments."""
    out, todo = [], [(0, len(x))]
    c = np.r_[0.0, np.cumsum(x)]
    sd = max(float(np.std(x)), 1e-12)
    while todo:
        a, b = todo.pop()
        n = b - a
        if n >= 2 * min_len:
            k = np.arange(a + min_len, b - min_len + 1)
            diff = np.abs((c[k] - c[a]) / (k - a) - (c[b] - c[k]) / (b - k)) * np.sqrt((k - a) * (b - k) / n) / sd
            at = int(diff.argmax())
            if diff[at] >= least:
                todo += [(a, int(k[at])), (int(k[at]), b)]
                continue
        if n:
            out.append((a, b - 1, float((c[b] - c[a]) / n)))
    return sorted(out)


def best_root(nodes: list[tuple], when: dict[str, float], most: int = 60) -> tuple[list[tuple], float, float]:
    """The branch (of at most `most` longest ones) whose middle as root leaves the least residuals of tip
    depth on date, among roots with a positive rate if there are any: (tree, rate, residual sum)."""
    adj: dict[int, list[tuple[int, float]]] = {x[0]: [] for x in nodes}
    name = {x[0]: x[3] for x in nodes}
    branches = []
    for v, p, length, _ in nodes:
        if p is not None:
            adj[v].append((p, length))
            adj[p].append((v, length))
            branches.append((length, v, p))
    best = None
    for length, v, p in sorted(branches, key=lambda b: (-b[0], b[1]))[:most]:
        root = max(adj) + 1
        out = [(root, None, 0.0, None), (v, root, length / 2, name[v]), (p, root, length / 2, name[p])]
        todo = [(v, p), (p, v)]
        while todo:
            x, came = todo.pop()
            for w, le in adj[x]:
                if w != came:
                    out.append((w, x, le, name[w]))
                    todo.append((w, x))
        depth = {k: d for k, d in root_to_tip(out).items() if k in when}
        t, y = np.array([when[k] for k in depth]), np.array(list(depth.values()))
        if len(t) < 3 or np.ptp(t) == 0:
            continue
        rate, icpt = np.polyfit(t, y, 1)
        rss = float(((y - icpt - rate * t) ** 2).sum())
        key = (rate <= 0, rss)
        if best is None or key < best[0]:
            best = (key, out, float(rate), rss)
    return (best[1], best[2], best[3]) if best else (nodes, float("nan"), float("nan"))


def node_dates(nodes: list[tuple], when: dict[str, float], rate: float, floor: float = 1e-4) -> dict[int, float]:
    """Dates of all nodes by weighted least squares of branch lengths on rate times elapsed time, tips
    with a date held fixed; a node is never dated after its earliest child."""
    index = {x[0]: k for k, x in enumerate(nodes)}
    a, b = [], []
    for v, p, length, name in nodes:
        row = np.zeros(len(nodes))
        if p is not None:
            w = 1 / math.sqrt(length + floor)
            row[index[v]], row[index[p]] = rate * w, -rate * w
            a.append(row)
            b.append(length * w)
        if name in when:
            row = np.zeros(len(nodes))
            row[index[v]] = 1e4
            a.append(row)
            b.append(1e4 * when[name])
    t = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0] if a else np.zeros(len(nodes))
    kids: dict = {}
    for v, p, *_ in nodes:
        kids.setdefault(p, []).append(v)
    order, todo = [], list(kids.get(None, []))
    while todo:
        v = todo.pop()
        order.append(v)
        todo += kids.get(v, [])
    out = {x[0]: float(t[index[x[0]]]) for x in nodes}
    for v in reversed(order):
        if v in kids:
            out[v] = min(out[v], *(out[k] for k in kids[v]))
    return out


def modularity_groups(w: np.ndarray, whole: float | None = None) -> np.ndarray:
    """Greedy modularity: the pair of groups whose union gains most is joined until none gains; labels from 0 by size. whole: the sum of
    all weights, if w is one component of a network."""
    m2 = whole if whole is not None else w.sum()
    n = len(w)
    if m2 <= 0:
        return np.arange(n)
    e, live = w / m2, [[i] for i in range(n)]
    a = e.sum(axis=1)
    while len(live) > 1:
        gain = 2 * (e - a[:, None] * a[None, :])
        np.fill_diagonal(gain, -np.inf)
        i, j = divmod(int(gain.argmax()), len(live))
        if gain[i, j] <= 1e-12:
            break
        i, j = min(i, j), max(i, j)
        e[i] += e[j]
        e[:, i] += e[:, j]
        keep = [k for k in range(len(live)) if k != j]
        live[i] += live[j]
        e, live = e[np.ix_(keep, keep)], [live[k] for k in keep]
        a = e.sum(axis=1)
    out = np.empty(n, int)
    for k, g in enumerate(sorted(live, key=lambda g: (-len(g), min(g)))):
        out[g] = k
    return out


def _affine_rows(queries: np.ndarray, lengths: np.ndarray, target: np.ndarray, match: float, mismatch: float, gap_open: float, gap_more: float, keep: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Global affine-gap scores of many queries (rows, padded) against one target at once, and, if kept, per query row what each
    cell came from: 0 match, 1 gap in the target, 2 gap in the query, +4 and +8 if those gaps are longer than one."""
    size, m = len(queries), len(target)
    ks = np.arange(m + 1)
    best = np.r_[0, gap_open + gap_more * (ks[1:] - 1)][None, :].repeat(size, axis=0)
    up = np.full((size, m + 1), -1e9)
    score = np.where(lengths == 0, best[:, m], 0.0)
    steps = []
    diag = np.full((size, m + 1), -1e9)
    for i in range(queries.shape[1]):
        opened, longer = best + gap_open, up + gap_more
        up = np.maximum(opened, longer)
        diag[:, 1:] = best[:, :-1] + np.where(queries[:, i, None] == target[None, :], match, mismatch)
        base = np.maximum(up, diag)
        run = np.maximum.accumulate(base - gap_more * ks, axis=1)
        best = base.copy()
        left = run[:, :-1] + gap_open + gap_more * (ks[1:] - 1)
        np.maximum(base[:, 1:], left, out=best[:, 1:])
        if keep:
            how = np.where(best == diag, 0, np.where(best == up, 1, 2)) + np.where(longer > opened, 4, 0)
            how[:, 1:] += np.where(left > base[:, :-1] + gap_open, 8, 0)
            steps.append(how.astype(np.uint8))
        ends = lengths == i + 1
        score[ends] = best[ends, m]
    return score, steps


def affine_align_many(queries: list[np.ndarray], target: np.ndarray, match: float, mismatch: float, gap_open: float, gap_more: float, paths: bool) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores of the global alignments of queries to one target and, if asked for, their matched (query, target) places.
    Scores are whole numbers, so that ties are exact: a match comes before a gap in the target, that before one in the query."""
    lengths = np.array([len(q) for q in queries], np.int64)
    padded = np.full((len(queries), int(lengths.max(initial=0))), -1, np.int32)
    for k, q in enumerate(queries):
        padded[k, : len(q)] = q
    score, steps = _affine_rows(padded, lengths, target, match, mismatch, gap_open, gap_more, paths)
    out: list[list[tuple[int, int]]] = []
    for k in range(len(queries) if paths else 0):
        i, j, pairs = int(lengths[k]), len(target), []
        while i > 0 and j > 0:
            how = int(steps[i - 1][k, j])
            if how & 3 == 0:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif how & 3 == 1:
                while steps[i - 1][k, j] & 4 and i > 1:
                    i -= 1
                i -= 1
            else:
                while steps[i - 1][k, j] & 8 and j > 1:
                    j -= 1
                j -= 1
        out.append(pairs[::-1])
    return score, out
