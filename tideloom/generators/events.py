"""Event (J), nonstationary (K), structured (L) and observation (M) generators."""

from __future__ import annotations

import numpy as np

from tideloom.generators import kit as K
from tideloom.generators.flows import lorenz, rossler
from tideloom.generators.registry import load, register

_COUNT = {"discrete_valued": "yes", "event_like": "yes"}


def _rate(x: np.ndarray, S, rng) -> tuple[np.ndarray, dict]:
    """Counts as a kernel-smoothed rate with two percent of noise."""
    width = S.draw("width", 2, 8)
    y = K.smooth(x, width)
    return y + 0.02 * y.std() * rng.standard_normal(len(y)), {"width": width, "discrete_valued": "no"}


@register("J", "poisson", 6, 0, **_COUNT)
def poisson(i, rng, T, S):
    mu, t = S.draw("rate", 0.1, 10, log=True), np.arange(T) / T
    lam = mu * (np.ones(T), 1 + 0.9 * np.sin(2 * np.pi * 6 * t), 0.2 + 1.6 * t)[i % 3]
    return rng.poisson(lam).astype(float), {"rate": mu, "stationary": "yes" if i % 3 == 0 else "no"}


@register("J", "renewal", 8, 9, bursty="partly", event_like="yes")
def renewal(i, rng, T, S):
    kind, shape = ("gamma", "lognormal", "weibull", "pareto")[i % 4], S.draw("shape", 0.4, 4, log=True)
    gap = {"gamma": lambda n: rng.gamma(shape, 1 / shape, n), "lognormal": lambda n: rng.lognormal(0, 1 / shape**0.5, n), "weibull": lambda n: rng.weibull(max(shape, 0.5), n), "pareto": lambda n: rng.pareto(1.5 + shape, n)}[kind]
    if S.stationary or i % 2 == 1:  # intervals
        return gap(T), {"kind": kind, "shape": shape, "event_like": "no"}
    return K.bin_events(K.renewal(rng, lambda n: 4 * gap(n), T), T), {"kind": kind, "shape": shape, "discrete_valued": "yes"}


def _hawkes(rng, T, mu, branching, decay, power=False):
    """Branching form: immigrants and their offspring at kernel-distributed delays."""
    level = rng.uniform(-T / 2, T, rng.poisson(mu * 1.5 * T))
    out = [level]
    while len(level):
        kids = rng.poisson(branching, len(level))
        delay = decay * (rng.random(kids.sum()) ** (-1 / 1.5) - 1) if power else rng.exponential(decay, kids.sum())
        level = np.repeat(level, kids) + delay
        level = level[level < T]
        out.append(level)
    times = np.sort(np.concatenate(out))
    return times[times >= 0]


@register("J", "hawkes", 8, 9, bursty="yes", event_like="yes")
def hawkes(i, rng, T, S):
    n, tau = S.draw("branching", 0.3, 0.85), S.draw("decay", 2, 10 if S.stationary else 50)
    mean = S.draw("rate", *((0.2, 1.0) if S.stationary else (0.05, 0.5)), log=True)
    times = _hawkes(rng, 4 * T, mean * (1 - n), n, tau, i % 2 == 1)
    info = {"branching": n, "corr_time": tau, "rate": mean}
    if not S.stationary and i % 4 == 3 and len(times) > T:
        return np.diff(times)[-T:], info | {"event_like": "no"}
    x = K.bin_events(times, 4 * T)[-T:]
    if not S.stationary:
        return x, info | {"discrete_valued": "yes"}
    y, more = _rate(x, S, rng)
    return y, more | info


def _cox(i, rng, T, S):
    tau = S.draw("tau", 5, 40, log=True)
    z = K.ar_filter(rng.standard_normal(T + 500) * (1 - np.exp(-2 / tau)) ** 0.5, [np.exp(-1 / tau)])[-T:]
    return rng.poisson(2 * np.exp(0.8 * z) if i % 2 == 0 else 4 * np.abs(z)).astype(float), {"corr_time": tau}


@register("J", "cox", 5, 0, bursty="partly", **_COUNT)
def cox(i, rng, T, S):
    return _cox(i, rng, T, S)


@register("J", "markov-chain", 6, 0, discrete_valued="yes", regime_switching="yes")
def markov_chain(i, rng, T, S):
    k, dwell = 2 + i % 5, S.draw("dwell", 2, 40, log=True)
    return K.markov(rng, K.sticky(rng, k, dwell, cyclic=i % 2 == 1), T).astype(float), {"states": k, "corr_time": dwell}


@register("J", "telegraph", 4, 0, discrete_valued="yes", regime_switching="yes")
def telegraph(i, rng, T, S):
    p = S.draw("rate", 0.03, 0.3, log=True)
    return np.cumprod(np.where(rng.random(T) < p, -1.0, 1.0)), {"rate": p}


@register("J", "spike-signs", 4, 5, event_like="yes")
def spike_signs(i, rng, T, S):
    x, s = 0.2 * K.ar_filter(rng.standard_normal(T), [0.5]), [1, 1, -1]
    p = S.draw("rate", 0.02, 0.1)
    for t in np.flatnonzero(rng.random(T) < p):
        s.append(s[-1] * s[-2] * s[-3] if rng.random() < 0.9 else -s[-1])
        x[t] += 3 * s[-1]
    return x, {"rate": p}


@register("J", "queue-branching", 5, 0, discrete_valued="yes")
def queue(i, rng, T, S):
    kind, load_ = ("queue", "branching", "birth-death")[i % 3], S.draw("load", 0.5, 0.8)
    x, out = 3, np.empty(T)
    for t in range(T):
        if kind == "queue":
            x = max(0, x + rng.poisson(load_) - rng.poisson(1))
        elif kind == "branching":
            x = rng.poisson(load_ * x) + rng.poisson(3)
        else:
            x = max(0, x + rng.binomial(1, 0.5) * (1 if rng.random() < load_ * 10 / (10 * load_ + x) else -1))
        out[t] = x
    return out, {"kind": kind, "load": load_}


@register("J", "random-walk-lattice", 4, 0, discrete_valued="yes", stationary="no")
def lattice(i, rng, T, S):
    step = rng.choice([-1, 1], T)
    if i % 4 == 0:
        return np.cumsum(step).astype(float), {"kind": "line"}
    if i % 4 == 1:
        return np.hypot(np.cumsum(step * (rng.random(T) < 0.5)), np.cumsum(rng.choice([-1, 1], T) * (rng.random(T) < 0.5))), {"kind": "plane"}
    return _bounded(i, rng, T)


def _bounded(i, rng, T):
    if i % 2 == 0:
        w = np.cumsum(rng.choice([-1, 1], T))
        return np.abs((w % 80) - 40).astype(float), {"kind": "reflected"}
    n = 30
    links = [[(v - 1) % n, (v + 1) % n, int(rng.integers(0, n))] for v in range(n)]
    at, out = 0, np.empty(T)
    for t in range(T):
        at = links[at][int(rng.integers(0, 3))]
        out[t] = at
    return out, {"kind": "graph"}


@register("J", "symbolic", 4, 0, discrete_valued="yes", deterministic="partly")
def symbolic(i, rng, T, S):
    if i % 3 == 2:
        return (K.flow(lorenz(), (1, 1, 20), T, 0.01, 12) > 0).astype(float), {"kind": "lorenz"}
    f = (lambda x: 3.9 * x * (1 - x)) if i % 3 == 0 else (lambda x: 1.99 * min(x, 1 - x))
    return (K.iterate(f, [0.1 + 0.5 * rng.random()], T)[:, 0] > 0.5).astype(float), {"kind": ("logistic", "tent")[i % 3]}


def _compound(rng, T, tail, mu):
    n = rng.poisson(mu, T)
    return np.bincount(np.repeat(np.arange(T), n), rng.pareto(tail, n.sum()) + 1, T)[:T]


@register("J", "compound-poisson", 4, 0, heavy_tailed="yes", event_like="yes")
def compound(i, rng, T, S):
    tail = S.draw("tail", 1.5, 3)
    x = _compound(rng, T, tail, 0.5)
    return (x if i % 2 == 0 else np.cumsum(x)), {"tail_index": tail, "stationary": "yes" if i % 2 == 0 else "no"}


@register("J", "poisson-stationary", 0, 0, **_COUNT)
def poisson_stationary(i, rng, T, S):
    mu = S.draw("rate", 0.5, 10, log=True)
    return rng.poisson(mu, T).astype(float), {"rate": mu}


@register("J", "lattice-bounded", 0, 0, discrete_valued="yes")
def lattice_bounded(i, rng, T, S):
    return _bounded(i, rng, T)


@register("J", "compound-poisson-increments", 0, 2, heavy_tailed="yes", event_like="yes")
def compound_increments(i, rng, T, S):
    tail = S.draw("tail", 2.2, 3.5)
    return _compound(rng, T, tail, 1.0), {"tail_index": tail}


@register("J", "poisson-smoothed", 0, 6, event_like="yes")
def poisson_smoothed(i, rng, T, S):
    mu = S.draw("rate", 0.1, 3, log=True)
    y, info = _rate(rng.poisson(mu, T).astype(float), S, rng)
    return y, info | {"rate": mu}


@register("J", "cox-smoothed", 0, 6, event_like="yes", bursty="partly")
def cox_smoothed(i, rng, T, S):
    x, info = _cox(i, rng, T, S)
    y, more = _rate(x, S, rng)
    return y, info | more


@register("J", "markov-chain-emitted", 0, 7, regime_switching="yes")
def markov_emitted(i, rng, T, S):
    k, dwell = 2 + i % 4, S.draw("dwell", 2, 30, log=True)
    s = K.markov(rng, K.sticky(rng, k, dwell, cyclic=i % 2 == 1), T)
    return rng.uniform(-3, 3, k)[s] + 0.4 * rng.standard_normal(T), {"states": k, "corr_time": dwell}


@register("J", "telegraph-noisy", 0, 4, regime_switching="yes")
def telegraph_noisy(i, rng, T, S):
    x, info = telegraph(i, rng, T, S)
    return x + S.draw("noise", 0.1, 0.5) * rng.standard_normal(T), info


# ---- K: nonstationary ------------------------------------------------------------------------------------


def _non(kind: str) -> dict[str, str]:
    return {"stationary": "no", "nonstationary_kind": kind}


def _ar1(rng, T, phi):
    return K.ar_filter(rng.standard_normal(T + 300), [phi])[-T:]


@register("K", "random-walk", 8, 0, **_non("stochastic-trend"))
def random_walk(i, rng, T, S):
    e = rng.standard_normal(T)
    return (np.cumsum(e), np.cumsum(K.ar_filter(e, [0.5])), K.ar_filter(e, [0.999]))[i % 3], {"kind": ("walk", "arima", "near-unit")[i % 3]}


@register("K", "trend", 8, 0, **_non("trend"))
def trend(i, rng, T, S):
    t, size = np.linspace(0, 1, T), S.draw("size", 3, 15)
    return size * (t, t**2, np.exp(3 * t) / 20, 1 / (1 + np.exp(-12 * (t - 0.5))))[i % 4] + _ar1(rng, T, S.draw("phi", 0, 0.8)), {"shape": i % 4}


@register("K", "structural-break", 8, 0, regime_switching="partly", **_non("break"))
def structural_break(i, rng, T, S):
    cuts = np.sort(rng.choice(np.arange(T // 10, T - T // 10), 1 + i % 5, replace=False))
    seg = np.searchsorted(cuts, np.arange(T), "right")
    k = len(cuts) + 1
    mu, sd, phi = rng.uniform(-4, 4, k), rng.uniform(0.4, 3, k), rng.uniform(-0.5, 0.9, k)
    x, y = np.empty(T), 0.0
    for t in range(T):
        y = phi[seg[t]] * y + rng.standard_normal()
        x[t] = mu[seg[t]] + sd[seg[t]] * y
    return x, {"breaks": cuts.tolist()}


@register("K", "drifting-parameter", 8, 0, **_non("parameter"))
def drifting(i, rng, T, S):
    kind = i % 3
    if kind == 1:
        w = np.linspace(0, 1, T)
        return (1 - w) * K.power_noise(rng, 0, T) + w * K.power_noise(rng, 1.5, T), {"kind": "tilt", "tvp": w}
    period = np.linspace(*S.choice("sweep", ((6, 40), (40, 6))), T)
    r = 0.97 if kind == 2 else 0.9
    a, b, out = 0.0, 0.0, np.empty(T)
    for t in range(T):
        a, b = 2 * r * np.cos(2 * np.pi / period[t]) * a - r * r * b + rng.standard_normal(), a
        out[t] = a
    return out, {"kind": ("ar2", "tilt", "resonator")[kind], "tvp": period}


def _ramp_map(f, low, high, T, x0, rng, s=0.0):
    p, x, out = np.linspace(low, high, T), x0, np.empty(T, type(x0))
    for t in range(T):
        x = f(x, p[t]) + s * rng.standard_normal()
        out[t] = x
    return out, p


@register("K", "bifurcation-ramp", 12, 0, **_non("bifurcation"))
def bifurcation(i, rng, T, S):
    kind, s = ("logistic", "pitchfork", "hopf", "saddle-node")[i % 4], S.draw("s", 0.02, 0.15)
    if kind == "logistic":
        x, p = _ramp_map(lambda x, r: r * x * (1 - x), 2.8, 4.0 - 0.1 * S.draw("end", 0, 1), T, 0.4, rng)
    elif kind == "pitchfork":
        x, p = _ramp_map(lambda x, m: x + 0.2 * (m * x - x**3), -1, 1, T, 0.0, rng, s)
    elif kind == "hopf":
        x, p = _ramp_map(lambda z, m: z + 0.1 * ((m + 2j) * z - abs(z) ** 2 * z), -0.5, 1, T, 0.1 + 0j, rng, s)
    else:
        x, p = _ramp_map(lambda x, m: np.clip(x + 0.1 * (m + x - x**3), -3, 3), -0.6, 0.7, T, -1.2, rng, s)
    return np.real(x), {"kind": kind, "tvp": p}



@register("K", "heteroskedastic-bursts", 6, 0, heteroskedastic="yes", bursty="yes", **_non("variance"))
def hetero_bursts(i, rng, T, S):
    sd = np.repeat(rng.choice([0.3, 1, 4], T // 50 + 1), 50)[:T] if i % 2 == 0 else np.exp(np.cumsum(0.08 * rng.standard_normal(T)))
    return np.clip(sd, 1e-3, 1e3) * _ar1(rng, T, S.draw("phi", 0, 0.7)), {"kind": i % 2}


@register("K", "explosive", 4, 0, **_non("explosive"))
def explosive(i, rng, T, S):
    phi, x, out = S.draw("phi", 1.01, 1.06), 0.0, np.empty(T)
    for t in range(T):
        x = phi * x + rng.standard_normal()
        x = 0.0 if abs(x) > 60 else x
        out[t] = x
    return out, {"phi": phi}


@register("K", "brownian-variants", 4, 0, **_non("stochastic-trend"))
def brownian(i, rng, T, S):
    w, t = np.cumsum(rng.standard_normal(T)), np.arange(1, T + 1)
    return (w - t / T * w[-1], np.abs(w), w + 0.1 * t, w + np.cumsum((rng.random(T) < 0.01) * rng.normal(0, 10, T)))[i % 4], {"kind": ("bridge", "reflected", "drift", "jumps")[i % 4]}


@register("K", "seasonal-trend", 5, 0, oscillatory="yes", **_non("trend"))
def seasonal_trend(i, rng, T, S):
    period, t = S.draw("period", 12, 60), np.arange(T)
    level, season = 5 + 10 * t / T, np.sin(2 * np.pi * t / period)
    return (level * (1 + 0.4 * season) if i % 2 else level + 2 * season) + 0.5 * _ar1(rng, T, 0.4), {"period_samples": period}


@register("K", "switched-system", 4, 0, deterministic="yes", chaotic="yes", regime_switching="yes", **_non("regime"))
def switched(i, rng, T, S):
    parts, left, k = [], T, i
    while left > 0:
        n = min(left, int(rng.integers(150, 400)))
        f, start, dt = ((lorenz(), (1, 1, 20 + rng.random()), 0.01), (rossler(), (1, 1 + rng.random(), 0), 0.05))[k % 2]
        parts.append(K.zscore(K.flow(f, start, n, dt, 20)))
        left, k = left - n, k + 1
    return np.concatenate(parts), {"segments": len(parts)}


@register("K", "transient", 5, 0, **_non("transient"))
def transient(i, rng, T, S):
    t, tau = np.arange(T), S.draw("tau", T / 20, T / 4)
    x = (lambda: 5 * np.exp(-t / tau), lambda: 5 * np.exp(-t / tau) * np.cos(2 * np.pi * t / 30), lambda: K.zscore(K.rk4(lorenz(r=22), (1, 1, 1), T, 0.02)[:, 0]) * 3, lambda: 4 * (1 - np.exp(-np.maximum(t - T / 4, 0) / tau)))[i % 4]()
    return x + 0.2 * rng.standard_normal(T), {"corr_time": tau}


@register("K", "pinup", 10, 0, deterministic="partly", **_non("parameter"))
def pinup(i, rng, T, S):
    shape = (lambda u: u, lambda u: 0.5 - 0.5 * np.cos(2 * np.pi * u), lambda u: (u > 0.5) * 1.0, lambda u: 0.5 + 0.5 * np.sin(6 * np.pi * u), lambda u: 1 - u)[i % 5]
    u = shape(np.linspace(0, 1, T))
    if i % 2 == 0:
        r, x, out = 3.6 + 0.39 * u, 0.3, np.empty(T)
        for t in range(T):
            x = r[t] * x * (1 - x)
            out[t] = x
        return out, {"kind": "logistic", "tvp": r}
    r, state, out = 28 + 20 * u, np.array([1.0, 1, 20]), np.empty(T)
    for t in range(T):
        state = K.rk4(lorenz(r=r[t]), state, 5, 0.01)[-1]
        out[t] = state[0]
    return out, {"kind": "lorenz", "tvp": r}


# ---- L: structured ---------------------------------------------------------------------------------------


@register("L", "longlag-comb", 6, 6)
def longlag(i, rng, T, S):
    lag, n = S.integer("lag", 40, 150), T + 600
    e = rng.standard_normal(n)
    x = e.copy()
    for t in range(lag, n):
        x[t] = e[t] + (0.7 * x[t - lag] if i % 2 == 0 else 0.5 * (e[t - lag] ** 2 - 1))
    return K.ar_filter(x, [0.3])[-T:], {"lag": lag, "kind": "linear" if i % 2 == 0 else "quadratic"}


@register("L", "cyclostationary-switch", 6, 6, oscillatory="partly")
def cyclo(i, rng, T, S):
    period, e = S.integer("period", 10, 60), rng.standard_normal(T + 300)
    x = np.zeros(T + 300)
    for t in range(1, T + 300):
        x[t] = (0.9 if (t // (period // 2)) % 2 else -0.6) * x[t - 1] + e[t]
    return x[-T:], {"period_samples": period}


@register("L", "replay-recurrence", 4, 4)
def replay(i, rng, T, S):
    e, n = rng.standard_normal(T + 300), S.integer("segment", 20, 60)
    for at in range(4 * n, T + 300 - n, 3 * n):
        source = int(rng.integers(0, at - n))
        e[at : at + n] = e[source : source + n]
    return K.ar_filter(e, [S.draw("phi", 0, 0.6)])[-T:], {"segment": n}


@register("L", "pac", 5, 5, oscillatory="yes")
def phase_amplitude(i, rng, T, S):
    slow, fast = S.draw("slow", 40, 120), S.draw("fast", 5, 12)
    if S.stationary and i == 4:  # slow waves and spindles
        slow, fast = S.draw("wave", 100, 140), S.draw("spindle", 7, 9)
    jitter = lambda p: 2 * np.pi * np.cumsum((1 + 0.2 * K.smooth(rng.standard_normal(T), 5)) / p)
    a = jitter(slow)
    x = np.sin(a) + 0.7 * (1 + np.cos(a)) * np.sin(jitter(fast)) + 0.1 * rng.standard_normal(T)
    return K.rank_remap(x, rng.standard_normal(T)), {"period_samples": slow}


@register("L", "qpc", 5, 5, oscillatory="yes")
def quadratic_phase(i, rng, T, S):
    tau = S.draw("tau", 50, 200)
    ou = lambda: K.ar_filter(rng.standard_normal(T + 500), [np.exp(-1 / tau)])[-T:]
    t, f1, f2 = np.arange(T), 0.043, 0.077
    a, b = (ou() + 1j * ou()) * np.exp(2j * np.pi * f1 * t), (ou() + 1j * ou()) * np.exp(2j * np.pi * f2 * t)
    third = a * b / max(np.abs(a).mean(), 1e-9) if i % 2 == 0 else (ou() + 1j * ou()) * np.exp(2j * np.pi * (f1 + f2) * t)
    return (a + b + third).real, {"coupled": i % 2 == 0}


@register("L", "coupled-systems", 8, 8, deterministic="yes", chaotic="yes")
def coupled(i, rng, T, S):
    kind, c = ("lorenz-rossler", "rossler-pair", "logistic-pair", "lattice", "delayed")[i % 5], S.draw("c", 0.02, 0.3, log=True)
    if kind == "lorenz-rossler":
        f, g = lorenz(), rossler()
        return K.flow(lambda x, t: np.r_[f(x[:3], t), 6 * (np.asarray(g(x[3:], t)) + (0, c * x[1], 0))], (1, 1, 20, 1, 1, 0), T, 0.005, 25, 4), {"kind": kind, "c": c}
    if kind == "rossler-pair":
        f, g = rossler(), rossler(c=6.2)
        return K.flow(lambda x, t: np.r_[f(x[:3], t), np.asarray(g(x[3:], t)) + (c * (x[0] - x[3]), 0, 0)], (1, 1, 0, 1, 2, 0), T, 0.04, 20, 3), {"kind": kind, "c": c}
    if kind == "logistic-pair":
        return K.iterate(lambda x, y: ((1 - c) * 3.9 * x * (1 - x) + c * 3.8 * y * (1 - y), 3.8 * y * (1 - y)), (0.3, 0.6), T)[:, 0], {"kind": kind, "c": c}
    if kind == "lattice":
        x, out = rng.random(32), np.empty(T)
        for t in range(T + 200):
            y = 3.9 * x * (1 - x)
            x = (1 - c) * y + c / 2 * (np.roll(y, 1) + np.roll(y, -1))
            if t >= 200:
                out[t - 200] = x[0]
        return out, {"kind": kind, "c": c}
    h = list(rng.random(20))
    for _ in range(T + 200):
        h.append((1 - c) * 3.8 * h[-1] * (1 - h[-1]) + c * h[-15])
    return np.array(h[-T:]), {"kind": kind, "c": c}


@register("L", "mixture", 6, 6)
def mixture(i, rng, T, S):
    w, t = S.draw("w", 0.2, 0.8), np.arange(T)
    chaos = lambda f, s, dt: K.zscore(K.flow(f, s, T, dt, 20))
    a, b = (
        (lambda: (chaos(lorenz(), (1, 1, 20), 0.01), K.zscore(_ar1(rng, T, 0.8)))), (lambda: (chaos(rossler(), (1, 1, 0), 0.05), rng.standard_normal(T))),
        (lambda: (chaos(rossler(), (1, 1, 0), 0.05), np.sin(2 * np.pi * t / 37))), (lambda: (K.zscore(_ar1(rng, T, 0.6)), np.cumprod(np.where(rng.random(T) < 0.03, -1.0, 1.0)))),
    )[i % 4]()
    return w * a + (1 - w) * b, {"w": w, "kind": i % 4}


@register("L", "on-off", 0, 3, bursty="yes", deterministic="yes", chaotic="yes")
def on_off(i, rng, T, S):
    a, z, x, out = S.draw("a", 2.72, 2.85), 0.1 + 0.8 * rng.random(), 0.1, np.empty(T + 500)
    for t in range(T + 500):
        z = min(max(4 * z * (1 - z), 1e-12), 1 - 1e-12)
        u = 2 / np.pi * np.arcsin(z**0.5)
        x = max(a * u * x * (1 - x), 1e-12)
        out[t] = x
    return out[-T:], {"a": a}


# ---- M: observation of another series --------------------------------------------------------------------

_BASES = ("B.ar1", "B.ar2", "B.arma", "C.ar-skew", "E.setar", "E.garch", "F.logistic", "G.canonical-sweep", "H.quasiperiodic", "I.ou", "I.double-well", "J.hawkes")


def _base(i, rng, T, S, names=_BASES):
    """A series of another family, drawn by name, and its index."""
    name = names[int(rng.integers(0, len(names)))]
    index = int(rng.integers(0, 8))
    from tideloom.generators.kit import Strata

    x, _ = load()[name].gen(index, rng, T, Strata(name, index, 8, S.stationary))
    return np.asarray(x, float), {"base": f"{name}/{index}"}


@register("M", "quantised", 6, 0, discrete_valued="yes")
def quantised(i, rng, T, S):
    x, info = _base(i, rng, T, S)
    k = S.integer("levels", 2, 12)
    return np.searchsorted(np.quantile(x, np.arange(1, k) / k), x).astype(float), info | {"levels": k}


@register("M", "clipped", 4, 4)
def clipped(i, rng, T, S):
    x, info = _base(i, rng, T, S)
    c = S.draw("c", 0.7, 1.8)
    return np.clip(x, x.mean() - c * x.std(), x.mean() + c * x.std()), info | {"c": c}


@register("M", "missing-data", 4, 4)
def missing(i, rng, T, S):
    x, info = _base(i, rng, T, S)
    there = rng.random(T) >= S.draw("share", 0.05, 0.4)
    there[0] = there[-1] = True
    at = np.flatnonzero(there)
    return (x[np.maximum.accumulate(np.where(there, np.arange(T), 0))] if i % 2 == 0 else np.interp(np.arange(T), at, x[at])), info | {"fill": "hold" if i % 2 == 0 else "line"}


@register("M", "irregular-sampling", 3, 3)
def irregular(i, rng, T, S):
    x, info = _base(i, rng, 3 * T, S)
    at = np.sort(rng.uniform(0, 3 * T - 1, T)) if i % 2 == 0 else np.clip(3 * np.arange(T) + rng.normal(0, 1, T), 0, 3 * T - 1)
    return np.interp(at, np.arange(3 * T), x), info


@register("M", "aliased", 4, 4, deterministic="yes", chaotic="yes")
def aliased(i, rng, T, S):
    f, s, dt = ((lorenz(), (1, 1, 20), 0.01), (rossler(), (1, 1, 0), 0.05))[i % 2]
    p = S.draw("points", 2.5, 6)
    return K.flow(f, s, T, dt, p), {"points": p}


@register("M", "oversampled", 3, 3, deterministic="yes", chaotic="yes")
def oversampled(i, rng, T, S):
    f, s, dt = ((lorenz(), (1, 1, 20), 0.01), (rossler(), (1, 1, 0), 0.05))[i % 2]
    p = S.draw("points", *((40, 70) if S.stationary else (150, 400)))
    return K.flow(f, s, T, dt, p), {"points": p}


@register("M", "nonlinear-readout", 5, 5)
def readout(i, rng, T, S):
    x, info = _base(i, rng, T + 1, S)
    z = K.zscore(x)
    if i % 5 == 3 and not S.stationary:
        return np.sign(z[1:]), info | {"kind": "sign", "discrete_valued": "yes"}
    return (z[1:] ** 2, np.abs(z[1:]), np.exp(z[1:] / 2), z[1:] ** 3, z[1:] * z[:-1])[i % 5] + 1e-9 * rng.standard_normal(T), info | {"kind": i % 5}


@register("M", "outliers", 4, 4, heavy_tailed="partly")
def outliers(i, rng, T, S):
    x, info = _base(i, rng, T, S)
    p = S.draw("rate", 0.005, 0.05, log=True)
    return x + (rng.random(T) < p) * rng.choice([-1, 1], T) * rng.uniform(4, 8, T) * x.std(), info | {"rate": p}


@register("M", "integrated", 3, 0, stationary="no", nonstationary_kind="stochastic-trend")
def integrated(i, rng, T, S):
    x, info = _base(i, rng, T, S)
    return np.cumsum(x - x.mean()), info


@register("M", "heavy-noise", 4, 7)
def heavy_noise(i, rng, T, S):
    x, info = _base(i, rng, T, S)
    snr = S.draw("snr", -6, 0)
    return x + x.std() * 10 ** (-snr / 20) * rng.standard_normal(T), info | {"snr_db": snr}


@register("M", "downsampled", 0, 6)
def downsampled(i, rng, T, S):
    k = S.integer("k", 2, 5)
    x, info = _base(i, rng, k * T, S)
    low = K.butterworth(8, None, 0.4 / k)
    return low(x)[::k][:T], info | {"k": k}
