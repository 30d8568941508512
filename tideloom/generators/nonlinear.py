"""Nonlinear stochastic (E) and map (F) generators."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

from tideloom.generators import kit as K
from tideloom.generators.registry import register

BURN = 500


def _recursion(step, e, x0=(0.0,)):
    """Path of x[t] = step(history newest first, e[t])."""
    h = list(x0)
    out = np.empty(len(e))
    for t, v in enumerate(e):
        out[t] = step(h, v)
        h = [out[t], *h[:-1]]
    return out


@register("E", "setar", 12, 21, regime_switching="yes")
def setar(i, rng, T, S):
    regimes, delay = 2 + i % 2, S.integer("delay", 1, 3)
    cuts = np.sort(rng.uniform(-1, 1, regimes - 1))
    phi, level = rng.uniform(-0.8, 0.9, regimes), np.linspace(-1.2, 1.2, regimes) * S.draw("gap", 0.3, 1.5)
    x = _recursion(lambda h, e: level[k := int(np.searchsorted(cuts, h[delay - 1]))] + phi[k] * h[0] + 0.6 * e, rng.standard_normal(T + BURN), (0.0,) * 3)
    return x[-T:], {"delay": delay, "regimes": regimes}


@register("E", "expar", 6, 6)
def expar(i, rng, T, S):
    a, b, c = S.draw("a", -0.6, 0.6), S.draw("b", -1.5, 1.5), -0.4
    return _recursion(lambda h, e: (a + b * np.exp(-h[0] ** 2)) * h[0] + c * h[1] + 0.5 * e, rng.standard_normal(T + BURN), (0.1, 0.0))[-T:], {"a": a, "b": b}


@register("E", "bilinear", 6, 6)
def bilinear(i, rng, T, S):
    c = S.draw("c", 0.3, 1.2)
    e = rng.standard_normal(T + 2)
    return e[2:] + c * e[1:-1] * e[:-2], {"c": c}


@register("E", "random-coef-ar", 4, 5, heteroskedastic="partly")
def random_coef(i, rng, T, S):
    phi, s = S.draw("phi", -0.6, 0.6), S.draw("s", 0.1, 0.6)
    p = phi + s * rng.standard_normal(T + BURN)
    return _recursion(lambda h, v: v[0] * h[0] + v[1], list(zip(p, rng.standard_normal(T + BURN))))[-T:], {"phi": phi, "s": s}


@register("E", "garch", 12, 19, heteroskedastic="yes")
def garch(i, rng, T, S):
    kind = ("arch", "garch", "gjr", "egarch")[i % 4]
    a, total = S.draw("alpha", 0.05, 0.3), S.draw("persistence", 0.6, 0.97)
    b = 0.0 if kind == "arch" else max(0.0, total - a)
    z = rng.standard_normal(T + BURN) if i % 8 < 4 else rng.standard_t(6, T + BURN) / np.sqrt(1.5)
    h, x = 1.0, np.empty(T + BURN)
    for t, v in enumerate(z):
        x[t] = np.sqrt(h) * v
        if kind == "egarch":
            h = np.exp(np.clip(0.95 * np.log(h) + a * (abs(v) - 0.8) - 0.1 * v, -20, 20))
        else:
            h = (1 - a - b) + a * x[t] ** 2 * (1.5 if kind == "gjr" and v < 0 else 0.5 if kind == "gjr" else 1) + b * h
    return x[-T:], {"kind": kind, "alpha": a, "beta": b}


@register("E", "stoch-vol", 6, 8, heteroskedastic="yes")
def stoch_vol(i, rng, T, S):
    phi, s = S.draw("phi", 0.7, 0.97), S.draw("s", 0.1, 0.4)
    return np.exp(K.ar_filter(s * rng.standard_normal(T + BURN), [phi]) / 2)[-T:] * rng.standard_normal(T), {"phi": phi}


@register("E", "markov-switching-ar", 8, 10, regime_switching="yes")
def markov_switching(i, rng, T, S):
    k, dwell = 2 + i % 3, S.draw("dwell", 10, 80, log=True)
    s = K.markov(rng, K.sticky(rng, k, dwell), T + BURN)
    what = rng.random(3) < 0.6
    phi = rng.uniform(-0.7, 0.9, k) if what[0] else np.full(k, 0.5)
    mu = rng.uniform(-2, 2, k) if what[1] or not what.any() else np.zeros(k)
    sd = rng.uniform(0.3, 2, k) if what[2] else np.ones(k)
    return _recursion(lambda h, v: mu[v[0]] + phi[v[0]] * h[0] + sd[v[0]] * v[1], list(zip(s, rng.standard_normal(T + BURN))))[-T:], {"regimes": k, "corr_time": dwell}


@register("E", "hmm", 6, 8, regime_switching="yes")
def hmm(i, rng, T, S):
    kind, dwell = ("gauss", "cyclic", "categorical")[i % (2 if S.stationary else 3)], S.draw("dwell", 4, 50, log=True)
    k = {"gauss": 2, "cyclic": 3, "categorical": 3 + i % 3}[kind]
    s = K.markov(rng, K.sticky(rng, k, dwell, cyclic=kind == "cyclic"), T)
    if kind == "categorical":  # every state emits symbols by a distribution of its own
        shares = rng.dirichlet(np.ones(k) * 0.5, k).cumsum(1)
        return (rng.random(T)[:, None] > shares[s]).sum(1).clip(0, k - 1).astype(float), {"states": k, "kind": kind, "discrete_valued": "yes"}
    return rng.uniform(-3, 3, k)[s] + rng.uniform(0.3, 1.2, k)[s] * rng.standard_normal(T), {"states": k, "kind": kind}


@register("E", "stochastic-map", 12, 12)
def stochastic_map(i, rng, T, S):
    kind = "holmes" if i == 15 else ("logistic", "tent", "henon", "ricker")[i % 4]
    s, e = S.draw("s", 0.01 if S.stationary else 0.001, 0.1, log=True), rng.standard_normal((T + BURN, 2))
    x, y = 0.3 + 0.1 * rng.random(), 0.1
    out = np.empty(T + BURN)
    for t in range(T + BURN):
        if kind == "logistic":
            x = min(max(3.8 * x * (1 - x) + s * e[t, 0], 1e-6), 1 - 1e-6)
        elif kind == "tent":
            x = min(max(1.9 * min(x, 1 - x) + s * e[t, 0], 1e-6), 1 - 1e-6)
        elif kind == "henon":
            x, y = 1 - 1.35 * x * x + y + s * e[t, 0], 0.3 * x
            x, y = (x, y) if abs(x) < 2 else (0.1, 0.1)  # noise may carry it out of the basin
        elif kind == "ricker":
            x = x * np.exp(2.9 * (1 - x) + s * e[t, 0])
        else:
            x, y = y, -0.15 * x + 2.75 * y - y**3 + s * e[t, 0]
        if not abs(x) < 1e3:
            return np.full(T, np.nan), {}
        out[t] = x
    return out[-T:], {"kind": kind, "noise_sigma": s, "chaotic": "partly"}


@register("E", "star", 8, 14, regime_switching="partly")
def star(i, rng, T, S):
    kind, g = ("lstar", "estar", "sin", "tanh")[i % 4], S.draw("gamma", 0.5, 8, log=True)
    a, b = S.draw("a", -0.6, 0.9), S.draw("b", -0.9, 0.6)
    f = {"lstar": lambda x: a * x + (b - a) * x / (1 + np.exp(-g * x)), "estar": lambda x: a * x + (b - a) * x * (1 - np.exp(-g * x * x)), "sin": lambda x: 1.5 * np.sin(g * x / 2), "tanh": lambda x: 2 * b * np.tanh(g * x)}[kind]
    return _recursion(lambda h, e: f(h[0]) + 0.5 * e, rng.standard_normal(T + BURN))[-T:], {"kind": kind, "gamma": g}


@register("E", "volterra", 4, 4)
def volterra(i, rng, T, S):
    e, c = rng.standard_normal(T + 3), rng.uniform(-0.6, 0.6, 6)
    a, b, d = e[2:-1], e[1:-2], e[:-3]
    return e[3:] + c[0] * a + c[1] * b + c[2] * d + c[3] * a * b + c[4] * a * a + c[5] * b * d, {"c": c.tolist()}


@register("E", "count", 8, 0, discrete_valued="yes")
def count(i, rng, T, S):
    kind, a, mu = ("inar", "poisson-ar", "nb-ingarch")[i % 3], S.draw("a", 0.2, 0.8), S.draw("mu", 2, 20, log=True)
    x, lam, out = int(mu), mu, np.empty(T + BURN)
    for t in range(T + BURN):
        if kind == "inar":
            x = rng.binomial(x, a) + rng.poisson(mu * (1 - a))
        else:
            lam = mu * (1 - a) + a * (0.6 * x + 0.4 * lam)
            x = rng.poisson(lam) if kind == "poisson-ar" else rng.negative_binomial(4, 4 / (4 + lam))
        out[t] = x
    return out[-T:], {"kind": kind, "rate": mu}


@register("E", "bistable-map", 4, 5, regime_switching="yes")
def bistable(i, rng, T, S):
    s = S.draw("s", 0.15, 0.5)
    x = _recursion(lambda h, e: h[0] + 0.4 * (h[0] - h[0] ** 3) + s * e, np.clip(rng.standard_normal(T + BURN), -3, 3), (0.5,))[-T:]
    return x, {"crossings": int((np.diff(np.sign(x)) != 0).sum())}


@register("E", "latent-ar-observed", 4, 0, discrete_valued="yes")
def latent(i, rng, T, S):
    phi, k = S.draw("phi", 0.5, 0.95), 2 + i % 4
    x = K.ar_filter(rng.standard_normal(T + BURN), [phi])[-T:]
    return np.searchsorted(np.quantile(x, np.arange(1, k) / k), x).astype(float), {"phi": phi, "levels": k}


@register("E", "cubic-crisis", 0, 2)
def cubic_crisis(i, rng, T, S):
    a, s = S.draw("a", 2.5, 2.59), S.draw("s", 0.005, 0.05)
    x = _recursion(lambda h, e: a * h[0] - h[0] ** 3 + s * e if abs(h[0]) < 5 else np.nan, rng.standard_normal(T + BURN), (0.4,))
    return x[-T:], {"a": a}


@register("E", "kesten", 0, 2, heavy_tailed="yes", bursty="partly")
def kesten(i, rng, T, S):
    mu, s = S.draw("mu", -0.6, -0.3), S.draw("s", 0.3, 0.5)
    return _recursion(lambda h, v: v[0] * h[0] + v[1], list(zip(rng.lognormal(mu, s, T + BURN), rng.exponential(1, T + BURN))))[-T:], {"tail_index": -2 * mu / s**2}


# ---- F: maps ---------------------------------------------------------------------------------------------

_DET = {"deterministic": "yes", "chaotic": "yes", "time_reversible": "no"}


def _lyapunov(slope: np.ndarray) -> float:
    return float(np.mean(np.log(np.maximum(np.abs(slope), 1e-12))))


def _finish(x, rng, S, **info):
    """Periodic orbits are tagged as such; the noise dial comes last."""
    if np.unique(np.round(x, 9)).size < 10:
        info |= {"periodic": "yes", "chaotic": "no"}
    x, sigma = K.noise_dial(rng, S, x)
    return x, info | {"noise_sigma": sigma}


@register("F", "logistic", 8, 5, **_DET)
def logistic(i, rng, T, S):
    for attempt in range(40):
        r = S.draw("r", 3.5, 4) if attempt == 0 else rng.uniform(3.57, 4)
        x = K.iterate(lambda x: r * x * (1 - x), [0.1 + 0.8 * rng.random()], T)[:, 0]
        lam = _lyapunov(r * (1 - 2 * x))
        if lam > 0.01 or not S.stationary:  # periodic windows belong to the full profile
            break
    return _finish(x, rng, S, r=r, lyapunov=lam)


@register("F", "classic-1d", 6, 11, **_DET)
def classic(i, rng, T, S):
    kind = ("tent", "sine", "cubic", "chebyshev")[i % 4]
    p = S.draw("p", 0, 1)
    f, low, high = {"tent": (lambda x: (1.6 + 0.39 * p) * min(x, 1 - x), 0, 1), "sine": (lambda x: (0.92 + 0.08 * p) * np.sin(np.pi * x), 0, 1), "cubic": (lambda x: (2.4 + 0.19 * p) * x - x**3, -1, 1), "chebyshev": (lambda x: np.cos((2 + 3 * p) * np.arccos(np.clip(x, -1, 1))), -1, 1)}[kind]
    return _finish(K.iterate(f, [rng.uniform(low + 0.1, high - 0.1)], T)[:, 0], rng, S, kind=kind)


@register("F", "circle-map", 6, 9, deterministic="yes", quasiperiodic="partly")
def circle(i, rng, T, S):
    for attempt in range(40):
        w, k = (S.draw("omega", 0.05, 0.95), S.draw("k", 1.05 if S.stationary else 0.3, 2.5)) if attempt == 0 else (rng.uniform(0.05, 0.95), rng.uniform(1.05, 2.5))
        orbit = K.iterate(lambda x: (x + w - k / (2 * np.pi) * np.sin(2 * np.pi * x)) % 1.0, [rng.random()], T)[:, 0]
        if not S.stationary or _lyapunov(1 - k * np.cos(2 * np.pi * orbit)) > 0.01:  # locked and drifting orbits belong to the full profile
            break
    return _finish(np.sin(2 * np.pi * orbit), rng, S, omega=w, k=k, chaotic="yes" if k > 1 else "no")


@register("F", "pomeau-manneville", 6, 8, bursty="partly", **_DET)
def pomeau(i, rng, T, S):
    z = S.draw("z", 1.5, 2.0 if S.stationary else 2.5)  # beyond 2 laminar phases last as long as the record
    return _finish(K.iterate(lambda x: (x + x**z) % 1.0 or 0.1, [rng.random()], T)[:, 0], rng, S, z=z)


@register("F", "shift-gauss", 4, 4, **_DET)
def shift_gauss(i, rng, T, S):
    if i % 2 == 0:  # exact doubling: bits of a long random fraction
        bits = rng.integers(0, 2, T + 60)
        x = np.array([float(Fraction(int("".join(map(str, bits[t : t + 53])), 2), 2**53)) for t in range(T)])
        return _finish(x, rng, S, kind="shift", lyapunov=np.log(2))
    a, b = S.draw("a", 5, 8), S.draw("b", -0.6, -0.4)
    return _finish(K.iterate(lambda x: np.exp(-a * x * x) + b, [0.1], T)[:, 0], rng, S, kind="gauss")


@register("F", "piecewise-impact", 3, 3, **_DET)
def impact(i, rng, T, S):
    for _ in range(40):
        a, rho = rng.uniform(0.55, 0.85), rng.uniform(0.02, 0.2)
        x = K.iterate(lambda x: a * x + rho if x <= 0 else a * x + rho - np.sqrt(x), [0.1], T)[:, 0]
        lam = _lyapunov(np.where(x <= 0, a, a - 0.5 / np.sqrt(np.maximum(x, 1e-9))))
        if lam > 0.02:
            return _finish(x, rng, S, a=a, lyapunov=lam)
    return np.full(T, np.nan), {}  # no chaotic orbit found: the gate asks for another attempt


@register("F", "map-sweep", 16, 16, **_DET)
def sweep(i, rng, T, S):
    p, kind = S.draw("p", 0, 1), ("henon", "lozi", "ikeda", "standard", "zaslavskii", "cat", "burgers", "coupled-logistic")[i % 8]
    if S.stationary and kind == "zaslavskii":  # settles on a short orbit
        kind = "ikeda"

    def ikeda(x, y):
        t = 0.4 - 6 / (1 + x * x + y * y)
        return 1 + (0.8 + 0.1 * p) * (x * np.cos(t) - y * np.sin(t)), (0.8 + 0.1 * p) * (x * np.sin(t) + y * np.cos(t))

    def standard(x, y):
        y = (y + (2 + 4 * p) * np.sin(x)) % (2 * np.pi)
        return (x + y) % (2 * np.pi), y

    def zaslavskii(x, y):
        y2 = np.exp(-3) * (y + 9 * np.cos(2 * np.pi * x))
        return (x + 5 * (1 + (1 - np.exp(-3)) / 3 * y) + 9 * 5 * (1 - np.exp(-3)) / 3 * 0.1 * np.cos(2 * np.pi * x)) % 1.0, y2

    def coupled(x, y):
        e = 0.02 + 0.1 * p
        f, g = 3.9 * x * (1 - x), 3.82 * y * (1 - y)
        return (1 - e) * f + e * g, (1 - e) * g + e * f

    steps = {
        "henon": (lambda x, y: (1 - (1.3 + 0.1 * p) * x * x + y, 0.3 * x), (0.1, 0.1)), "lozi": (lambda x, y: (1 - (1.6 + 0.15 * p) * abs(x) + y, 0.4 * x), (0.1, 0.1)), "ikeda": (ikeda, (0.1, 0.1)),
        "standard": (standard, (rng.random() * 6, rng.random() * 6)), "zaslavskii": (zaslavskii, (0.1, 0.1)), "cat": (lambda x, y: ((x + y) % 1.0, (x + 2 * y) % 1.0), (rng.random(), rng.random())),
        "burgers": (lambda x, y: (0.75 * x - y * y, (1.7 + 0.05 * p) * y + x * y), (-0.1, 0.1)), "coupled-logistic": (coupled, (0.3, 0.6)),
    }
    f, start = steps[kind]
    x = K.iterate(f, start, T)[:, 0]
    if kind == "standard" and i % 16 > 8 and not S.stationary:  # the unwrapped momentum diffuses
        return _finish(np.cumsum((2 + 4 * p) * np.sin(x)), rng, S, kind=kind, stationary="no", nonstationary_kind="stochastic-trend")
    return _finish(np.sin(x) if kind == "standard" and S.stationary else x, rng, S, kind=kind)


def _automaton(rule: int, T: int, width: int, start: np.ndarray) -> np.ndarray:
    table = (rule >> np.arange(8)) & 1
    rows, c = np.empty((T, width), int), start
    for t in range(T):
        rows[t] = c
        c = table[4 * np.roll(c, 1) + 2 * c + np.roll(c, -1)]
    return rows


@register("F", "aperiodic", 10, 0, deterministic="yes", discrete_valued="yes")
def aperiodic(i, rng, T, S):
    kind = ("thue-morse", "fibonacci", "rudin-shapiro", "cut-project", "rule30", "rule110", "pi", "sqrt2", "collatz", "period-doubling")[i % 10]
    t = np.arange(T) + int(rng.integers(0, 1000))
    golden = (5**0.5 - 1) / 2
    if kind == "thue-morse":
        x = [int(v).bit_count() % 2 for v in t]
    elif kind in ("fibonacci", "cut-project"):
        g = golden if kind == "fibonacci" else 2**0.5 - 1
        x = np.floor((t + 2) * g) - np.floor((t + 1) * g)
    elif kind == "rudin-shapiro":
        x = [(int(v) & (int(v) >> 1)).bit_count() % 2 for v in t]
    elif kind in ("rule30", "rule110"):
        start = np.zeros(2 * T + 1, int)
        start[T] = 1
        x = _automaton(30 if kind == "rule30" else 110, T, 2 * T + 1, start)[:, T - 5]
    elif kind == "pi":  # Machin's arctangents in integers
        one = 10 ** (T + 1010)
        inverse = lambda n: sum((-1) ** k * (one // n ** (2 * k + 1)) // (2 * k + 1) for k in range(int((T + 1010) / (2 * np.log10(n))) + 1))
        x = [int(c) for c in str(4 * (4 * inverse(5) - inverse(239)))[t[0] : t[0] + T]]
    elif kind == "sqrt2":
        from math import isqrt

        x = [int(c) for c in bin(isqrt(2 << (2 * (T + 1010))))[2:][t[0] : t[0] + T]]
    elif kind == "collatz":
        x = []
        for v in t + 1:
            n, steps = int(v), 0
            while n != 1:
                n, steps = (n // 2 if n % 2 == 0 else 3 * n + 1), steps + 1
            x.append(steps)
    else:
        x = [((int(v) + 1) & -(int(v) + 1)).bit_length() % 2 for v in t]
    return np.asarray(x, float), {"kind": kind}


@register("F", "aperiodic-real", 0, 2, deterministic="yes")
def aperiodic_real(i, rng, T, S):
    start = rng.integers(0, 2, 601)
    rows = _automaton((30, 110)[i % 2], T + 200, 601, start)[200:]
    return rows.mean(1) + 1e-6 * np.cumsum(rows[:, 0] - 0.5) / T, {"rule": (30, 110)[i % 2]}


@register("F", "rulkov", 0, 3, bursty="yes", **_DET)
def rulkov(i, rng, T, S):
    a, s = S.draw("alpha", 4.1, 4.6), S.draw("sigma", -1.2, -0.8)
    return _finish(K.iterate(lambda x, y: (a / (1 + x * x) + y, y - 0.002 * (x - s)), [-1.0, -3.0], T, 4000)[:, 0], rng, S, alpha=a)


@register("F", "sna", 0, 2, deterministic="yes", quasiperiodic="partly")
def strange_nonchaotic(i, rng, T, S):
    s, w = S.draw("s", 1.1, 2), (5**0.5 - 1) / 2
    return _finish(K.iterate(lambda x, q: (2 * s * np.tanh(x) * np.cos(2 * np.pi * q), (q + w) % 1.0), [0.5, rng.random()], T)[:, 0], rng, S, s=s)
