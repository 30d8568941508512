"""Flow (G), oscillatory (H) and stochastic differential equation (I) generators."""

from __future__ import annotations

import numpy as np

from tideloom.generators import kit as K
from tideloom.generators.registry import register

_DET = {"deterministic": "yes", "continuous_time": "yes", "time_reversible": "no"}
_SDE = {"continuous_time": "yes"}

#: Generators of the survey that need a catalogue of systems which is not available here.
BLOCKED = ("F.dysts-map", "G.dysts-flow", "G.dysts-flow-coarse", "G.dysts-flow-extra", "G.blinking-rotlet")


def lorenz(s=10.0, r=28.0, b=8 / 3):
    return lambda x, t: (s * (x[1] - x[0]), x[0] * (r - x[2]) - x[1], x[0] * x[1] - b * x[2])


def rossler(a=0.2, b=0.2, c=5.7):
    return lambda x, t: (-x[1] - x[2], x[0] + a * x[1], b + x[2] * (x[0] - c))


def chua(a=15.6, b=28.0):
    f = lambda v: -0.714 * v - 0.2145 * (abs(v + 1) - abs(v - 1))
    return lambda x, t: (a * (x[1] - x[0] - f(x[0])), x[0] - x[1] + x[2], -b * x[1])


def van_der_pol(mu):
    return lambda x, t: (x[1], mu * (1 - x[0] ** 2) * x[1] - x[0])


def stuart_landau(mu, w):
    return lambda x, t: ((mu - x[0] ** 2 - x[1] ** 2) * x[0] - w * x[1], (mu - x[0] ** 2 - x[1] ** 2) * x[1] + w * x[0])


def _dial(x, rng, S, **info):
    x, sigma = K.noise_dial(rng, S, x)
    return x, info | {"noise_sigma": sigma}


_DDES = {
    "mackey-glass": (lambda x, y, t: 0.2 * y / (1 + np.abs(y) ** 10) - 0.1 * x, 0.9, (17, 40)),
    "ikeda": (lambda x, y, t: -x + 6 * np.sin(y), 0.5, (2, 6)),
    "hutchinson": (lambda x, y, t: 1.8 * x * (1 - y), 0.5, (1, 1.3)),
    "sine": (lambda x, y, t: np.sin(y) - 0.1 * x, 0.5, (3, 8)),
    "ucar": (lambda x, y, t: y - y**3, 0.5, (1.3, 1.6)),
    "band-pass": (lambda x, y, t: np.stack([-x[0] - 0.1 * x[1] + 5 * np.cos(y[0] + 0.8) ** 2, x[0]]), (0.5, 0.0), (6, 12)),
}


def _delay(kind, S, rng, T):
    f, start, (low, high) = _DDES[kind]
    tau = S.draw("tau", low, high)
    dt = tau / 60
    x = K.dde(f, start, tau, 6 * T, dt, burn=6000)[:, 0]
    step = np.clip(K.dominant_period(x) / S.draw("points", 12, 40), 1, 5.9)
    return np.interp(np.arange(T) * step, np.arange(len(x)), x), {"kind": kind, "delay": tau}


@register("G", "dde", 15, 0, chaotic="partly", **_DET)
def dde(i, rng, T, S):
    x, info = _delay(("mackey-glass", "ikeda", "hutchinson", "sine")[i % 4], S, rng, T)
    return _dial(x, rng, S, **info)


@register("G", "dde-stationary", 0, 15, chaotic="partly", **_DET)
def dde_stationary(i, rng, T, S):
    x, info = _delay(("mackey-glass", "ikeda", "sine", "ucar", "band-pass")[i % 5], S, rng, T)
    return _dial(x, rng, S, **info)


_CANON = (
    (lorenz(), (1, 1, 20), 0.01, 0), (lorenz(r=45), (1, 1, 30), 0.01, 0), (lorenz(r=60, s=16, b=4), (1, 1, 30), 0.008, 2),
    (rossler(), (1, 1, 0), 0.05, 0), (rossler(c=9), (1, 1, 0), 0.04, 0), (rossler(a=0.3, c=8), (1, 1, 0), 0.04, 1),
    (chua(), (0.7, 0, 0), 0.02, 0), (lambda x, t: (x[1], x[2], -0.6 * x[2] - x[1] + abs(x[0]) - 1), (0.1, 0, 0), 0.05, 0),
    (lambda x, t: (x[1], -0.15 * x[1] + x[0] - x[0] ** 3 + 0.3 * np.cos(t)), (0.5, 0), 0.05, 0),
)


#: In the stationary profile other regimes stand for those with periodic windows.
_SETTLED = {
    1: (lorenz(r=130), (1, 1, 20), 0.006, 0), 2: (lambda x, t: (35 * (x[1] - x[0]), -7 * x[0] - x[0] * x[2] + 28 * x[1], x[0] * x[1] - 3 * x[2]), (-10, 0, 37), 0.005, 0),
    3: (rossler(a=0.3, b=0.1, c=14.0), (1, 1, 0), 0.03, 0),
}


@register("G", "canonical-sweep", 9, 9, chaotic="yes", **_DET)
def canonical(i, rng, T, S):
    f, start, dt, column = (_SETTLED if S.stationary else {}).get(i % 9, _CANON[i % 9])
    x = K.flow(f, np.array(start, float) + 0.1 * rng.random(len(start)), T, dt, S.draw("points", 8, 40, log=True), column)
    return _dial(x, rng, S, regime=i % 9)


@register("G", "billiard", 0, 2, chaotic="yes", deterministic="yes")
def billiard(i, rng, T, S):
    """Stadium: straight walls y = +-1 for |x| <= a, half circles at both ends."""
    a = S.draw("a", 0.5, 1.5)
    x, y, angle = 0.1, 0.2, rng.uniform(0.2, 1.3)
    vx, vy, out = np.cos(angle), np.sin(angle), np.empty(T)
    for t in range(T):
        best = np.inf
        if vy:
            s = ((1 if vy > 0 else -1) - y) / vy
            if s > 1e-9 and abs(x + s * vx) <= a:
                best, normal = s, (0.0, 1.0)
        for c in (-a, a):
            b, q = (x - c) * vx + y * vy, (x - c) ** 2 + y * y - 1
            disc = b * b - q
            if disc > 0:
                s = -b + np.sqrt(disc)
                px = x + s * vx
                if 1e-9 < s < best and (px - c) * np.sign(c) >= -1e-9:
                    best, normal = s, (px - c, y + s * vy)
        if not np.isfinite(best):
            best, normal = 0.1, (0.0, 1.0)
        x, y = x + best * vx, y + best * vy
        n = np.array(normal) / (np.hypot(*normal) or 1)
        d = vx * n[0] + vy * n[1]
        vx, vy = vx - 2 * d * n[0], vy - 2 * d * n[1]
        out[t] = x
    return out, {"a": a}


@register("G", "bouncing-ball", 0, 2, chaotic="yes", deterministic="yes")
def bouncing(i, rng, T, S):
    """Ball on a vibrating table: phases of successive impacts by bisection."""
    amp, loss = S.draw("amp", 2.0, 2.8), 0.8  # the table outruns gravity, so that the ball never sticks
    table, speed = lambda t: amp * np.sin(t), lambda t: amp * np.cos(t)
    t, v, out = 0.3, 2.0, np.empty(T + 200)
    for k in range(T + 200):
        z0 = table(t)
        high = lambda s: z0 + v * s - 0.5 * s * s - table(t + s)  # noqa: B023, E731
        lo, step = 1e-4, 0.05
        hi = lo + step
        while high(hi) > 0 and hi < 60:
            lo, hi = hi, hi + step
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if high(mid) > 0 else (lo, mid)
        s = (lo + hi) / 2
        v, t = (1 + loss) * speed(t + s) - loss * (v - s), t + s
        v = max(v, speed(t) + 1e-3)
        out[k] = np.sin(t)
    return out[-T:] + 1e-6 * rng.standard_normal(T), {"amp": amp}


# ---- H: oscillatory --------------------------------------------------------------------------------------

_OSC = {"oscillatory": "yes", "deterministic": "yes", "continuous_time": "yes"}


@register("H", "sinusoid", 5, 3, periodic="yes", **_OSC)
def sinusoid(i, rng, T, S):
    period = S.draw("period", 2.2, 60 if S.stationary else 300, log=True)
    return _dial(np.sin(2 * np.pi * (np.arange(T) / period + rng.random())), rng, S, period_samples=period)


@register("H", "harmonic", 7, 5, periodic="yes", **_OSC)
def harmonic(i, rng, T, S):
    kind, period = (("saw", "random") if S.stationary else ("square", "saw", "triangle", "pulse", "random"))[i % (2 if S.stationary else 5)], S.draw("period", 8, 120, log=True)
    k = np.arange(1, 8)
    amp = {"square": (k % 2) / k, "saw": 1 / k, "triangle": (k % 2) * (-1.0) ** ((k - 1) // 2) / k**2, "pulse": np.ones(7), "random": rng.random(7) / k}[kind]
    shift = rng.random(7) if kind == "random" else np.zeros(7)
    phase = 2 * np.pi * (np.outer(np.arange(T) / period + rng.random(), k) + shift)
    return _dial(np.sin(phase) @ amp, rng, S, kind=kind, period_samples=period)


@register("H", "quasiperiodic", 7, 7, quasiperiodic="yes", **_OSC)
def quasiperiodic(i, rng, T, S):
    period, ratios = S.draw("period", 8, 60, log=True), (1, 2**0.5, (1 + 5**0.5) / 2 * 2)[: 2 + i % 2]
    return _dial(sum(rng.uniform(0.5, 1) * np.sin(2 * np.pi * (r * np.arange(T) / period + rng.random())) for r in ratios), rng, S, period_samples=period)


def _modulated(kind, T, S, rng):
    t, period, slow = np.arange(T), S.draw("period", 8, 40, log=True), S.draw("slow", 60, 300, log=True)
    m = np.sin(2 * np.pi * (t / slow + rng.random()))
    if kind == "am":
        return (1 + 0.8 * m) * np.sin(2 * np.pi * t / period), period
    if kind == "fm":
        return np.sin(2 * np.pi * np.cumsum((1 + 0.4 * m) / period)), period
    if kind == "chirp":
        return np.sin(2 * np.pi * np.cumsum(np.linspace(0.3, 2, T) / period)), period
    return np.sin(2 * np.pi * t / period) + np.sin(2 * np.pi * t * (1 / period + 1 / slow)), period


@register("H", "modulated", 7, 0, quasiperiodic="partly", **_OSC)
def modulated(i, rng, T, S):
    kind = ("am", "fm", "chirp", "beats")[i % 4]
    x, period = _modulated(kind, T, S, rng)
    return _dial(x, rng, S, kind=kind, period_samples=period, stationary="no" if kind == "chirp" else "yes")


@register("H", "modulated-stationary", 0, 6, quasiperiodic="partly", **_OSC)
def modulated_stationary(i, rng, T, S):
    kind = ("am", "fm", "beats")[i % 3]
    x, period = _modulated(kind, T, S, rng)
    return _dial(x, rng, S, kind=kind, period_samples=period)


def brusselator(a, b):
    return lambda x, t: (a + x[0] ** 2 * x[1] - (b + 1) * x[0], b * x[0] - x[0] ** 2 * x[1])


def fitzhugh(current=0.5):
    return lambda x, t: (x[0] - x[0] ** 3 / 3 - x[1] + current, 0.08 * (x[0] + 0.7 - 0.8 * x[1]))


@register("H", "limit-cycle", 10, 5, periodic="yes", **_OSC)
def limit_cycle(i, rng, T, S):
    kind, p = ("vdp", "stuart-landau", "brusselator", "fitzhugh")[i % 4], S.draw("p", 0, 1)
    f, dt = {"vdp": (van_der_pol(0.3 + 6 * p), 0.02), "stuart-landau": (stuart_landau(1, 1 + p), 0.05), "brusselator": (brusselator(1, 2.3 + 1.5 * p), 0.03), "fitzhugh": (fitzhugh(0.4 + 0.8 * p), 0.1)}[kind]
    return _dial(K.flow(f, (0.5, 0.6), T, dt, S.draw("points", 12, 60, log=True)), rng, S, kind=kind)


@register("H", "period-doubled", 5, 0, periodic="yes", **_OSC)
def period_doubled(i, rng, T, S):
    kind = ("p2", "p4", "p8", "rossler", "lorenz")[i % 5]
    if kind[0] == "p":
        x = K.iterate(lambda x: {"p2": 3.3, "p4": 3.5, "p8": 3.555}[kind] * x * (1 - x), [0.3], T)[:, 0]
        x = x + S.draw("noise", 0.01, 0.2) * x.std() * rng.standard_normal(T)
        return x, {"kind": kind}
    f, dt, start = (rossler(a=0.1, b=0.1, c=6), 0.05, (1, 1, 0)) if kind == "rossler" else (lorenz(r=350), 0.002, (1, 1, 300))
    return _dial(K.flow(f, start, T, dt, S.draw("points", 15, 50)), rng, S, kind=kind)


@register("H", "period-doubled-flows", 0, 2, periodic="yes", **_OSC)
def period_doubled_flows(i, rng, T, S):
    f, dt, start = (rossler(a=0.1, b=0.1, c=8.5), 0.04, (1, 1, 0)) if i % 2 == 0 else (lorenz(r=350), 0.002, (1, 1, 300))
    return _dial(K.flow(f, start, T, dt, S.draw("points", 15, 50), 2), rng, S)


@register("H", "cycle-shapes", 0, 4, periodic="yes", **_OSC)
def cycle_shapes(i, rng, T, S):
    kind = ("bursting", "rayleigh", "lotka-volterra", "pendulum")[i % 4]
    f, dt, start = {
        "bursting": (lambda x, t: (x[1] - x[0] ** 3 + 3 * x[0] ** 2 - x[2] + 2, 1 - 5 * x[0] ** 2 - x[1], 0.006 * (4 * (x[0] + 1.6) - x[2])), 0.05, (-1, 0, 2)),
        "rayleigh": (lambda x, t: (x[1], 3 * (1 - x[1] ** 2 / 3) * x[1] - x[0]), 0.02, (0.5, 0.5)),
        "lotka-volterra": (lambda x, t: (x[0] * (1 - x[1]), x[1] * (x[0] - 1)), 0.02, (0.3, 0.4)),
        "pendulum": (lambda x, t: (x[1], -np.sin(x[0])), 0.05, (3.0, 0.0)),
    }[kind]
    return _dial(K.flow(f, start, T, dt, S.draw("points", 15, 60)), rng, S, kind=kind)


# ---- I: stochastic differential equations ----------------------------------------------------------------


@register("I", "ou", 12, 16, linear="yes", gaussian="yes", time_reversible="yes", **_SDE)
def ou(i, rng, T, S):
    tau = S.draw("tau", 1, 30, log=True)
    return K.sde(rng, lambda x, t: -x / tau, (2 / tau) ** 0.5, (0,), T, 0.1, 10, 200)[:, 0], {"corr_time": tau}


@register("I", "double-well", 12, 20, regime_switching="yes", **_SDE)
def double_well(i, rng, T, S):
    s = S.draw("s", 0.45, 1)
    x = K.sde(rng, lambda x, t: x - x**3, s, (1,), T, 0.05, 10, 100)[:, 0]
    return x, {"s": s, "hops": int((np.diff(np.sign(x)) != 0).sum())}


@register("I", "near-critical", 12, 18, **_SDE)
def near_critical(i, rng, T, S):
    kind, m = ("fold", "pitchfork", "transcritical", "hopf", "cusp")[i % 5], S.draw("distance", 0.05, 1, log=True)
    f, d = {"fold": (lambda x, t: m - (x - m**0.5 - 1) ** 2 - 2 * m**0.5 * (x - m**0.5 - 1) - m, 1), "pitchfork": (lambda x, t: -m * x - x**3, 1), "transcritical": (lambda x, t: -m * x - np.abs(x) * x, 1),
            "hopf": (lambda x, t: np.array([-m * x[0] - x[1] - x[0] * (x @ x), -m * x[1] + x[0] - x[1] * (x @ x)]), 2), "cusp": (lambda x, t: 0.1 + m * x - x**3, 1)}[kind]
    return K.sde(rng, f, 0.1, np.full(d, 0.1 if kind != "fold" else 1.0), T, 0.1, 5, 100)[:, 0], {"kind": kind, "distance": m}


@register("I", "noisy-limit-cycle", 10, 8, oscillatory="yes", **_SDE)
def noisy_cycle(i, rng, T, S):
    kind, s = (("vdp", "relaxation") if S.stationary else ("vdp", "stuart-landau", "lienard"))[i % (2 if S.stationary else 3)], S.draw("s", 0.3 if S.stationary else 0.2, 1.0, log=True)
    f = {"vdp": van_der_pol(rng.uniform(0.3, 3)), "relaxation": van_der_pol(rng.uniform(2, 5)), "lienard": lambda x, t: (x[1], -(x[0] ** 2 - 0.8) * x[1] - x[0] ** 3), "stuart-landau": stuart_landau(1.0, 1.5)}[kind]
    return K.sde(rng, f, s, (0.5, 0.5), T, 0.02, 12, 100)[:, 0], {"kind": kind, "s": s}


@register("I", "noisy-chaos", 8, 14, chaotic="partly", **_SDE)
def noisy_chaos(i, rng, T, S):
    kind, s = ("lorenz", "rossler", "chua")[i % 3], S.draw("s", *((0.1, 0.5) if S.stationary else (0.03, 0.3)), log=True)
    f, start, dt, every, g = {"lorenz": (lorenz(), (1, 1, 20), 0.005, 15, 3), "rossler": (rossler(), (1, 1, 0), 0.01, 30, 0.3), "chua": (chua(), (0.7, 0, 0), 0.005, 30, 0.05)}[kind]
    return K.sde(rng, f, s * g, start, T, dt, every, 100)[:, 0], {"kind": kind, "s": s}


@register("I", "stochastic-resonance", 6, 12, regime_switching="yes", **_SDE)
def resonance(i, rng, T, S):
    period, s = S.draw("period", 40, 200), S.draw("s", 0.4, 0.8)
    every = 20 if S.stationary else 10  # coarser sampling: twice the hops in a record
    return K.sde(rng, lambda x, t: x - x**3 + 0.3 * np.sin(2 * np.pi * t / (period * 0.5)), s, (1,), T, 0.05, every, 100)[:, 0], {"period_samples": period * 10 / every, "s": s}


@register("I", "excitable-fhn", 8, 8, event_like="yes", **_SDE)
def excitable(i, rng, T, S):
    if S.stationary and i >= 5:  # rotator past a saddle-node on the circle
        s, b = rng.uniform(0.25, 0.35), S.draw("b", 1.03, 1.1)
        x = -np.cos(K.sde(rng, lambda x, t: 1 - b * np.sin(x), s, (0,), T, 0.02, 25, 80)[:, 0])
    else:
        s, current = (S.draw("s", 0.15, 0.4, log=True), S.draw("current", 0, 0.32)) if S.stationary else (S.draw("s", 0.12, 0.5, log=True), 0.35)
        x = K.sde(rng, fitzhugh(current), (s * 0.5, s * 0.1), (-1, -0.5), T, 0.1, 15, 100)[:, 0]
    return x, {"s": s, "spikes": int(((x[1:] > 0) & (x[:-1] <= 0)).sum())}


@register("I", "multiplicative-coloured", 4, 5, heteroskedastic="partly", **_SDE)
def multiplicative(i, rng, T, S):
    s = S.draw("s", 0.3, 0.8)
    if i % 2 == 0:
        return K.sde(rng, lambda x, t: 0.1 - 0.5 * x, lambda x, t: s * np.sqrt(0.1 + x**2), (0,), T, 0.05, 10, 100)[:, 0], {"s": s}
    return K.sde(rng, lambda x, t: (-0.3 * x[0] + x[1] - 0.2 * x[0] ** 3, -x[1] / 3), (0.0, s), (0, 0), T, 0.05, 10, 100)[:, 0], {"s": s}


@register("I", "heteroclinic", 0, 3, oscillatory="partly", regime_switching="yes", **_SDE)
def heteroclinic(i, rng, T, S):
    s, x, out = S.draw("s", 1e-4, 1e-2, log=True), np.array([0.6, 0.3, 0.1]), np.empty(T)
    for k in range(10 * (T + 100)):
        x = np.abs(x + 0.1 * x * (1 - x - 1.6 * np.roll(x, -1) - 0.7 * np.roll(x, 1)) + 0.3 * s * rng.standard_normal(3))
        if k % 10 == 9 and k // 10 >= 100:
            out[k // 10 - 100] = x[0]
    return out, {"s": s}
