"""Noise (A), linear Gaussian (B), linear non-Gaussian (C) and long-memory (D) generators."""

from __future__ import annotations

import numpy as np

from tideloom.generators import kit as K
from tideloom.generators.registry import register

BURN = 1000


def _best(draw, cdf, tries: int = 12) -> np.ndarray:
    """Of several draws the one whose empirical distribution is nearest to the cdf."""

    def distance(x: np.ndarray) -> float:
        p, n = cdf(np.sort(x)), len(x)
        i = np.arange(1, n + 1)
        return float(np.maximum(i / n - p, p - (i - 1) / n).max())

    return min((draw() for _ in range(tries)), key=distance)


def _normal_cdf(x):
    from math import erf

    return 0.5 * (1 + np.array([erf(v / 2**0.5) for v in x]))


@register("A", "gaussian", 3, 4, gaussian="yes", linear="yes", time_reversible="yes")
def gaussian(i, rng, T, S):
    return _best(lambda: rng.standard_normal(T), _normal_cdf), {}


@register("A", "uniform", 2, 3, time_reversible="yes")
def uniform(i, rng, T, S):
    return _best(lambda: rng.uniform(-1, 1, T), lambda x: (x + 1) / 2), {}


@register("A", "laplace", 2, 2, heavy_tailed="partly", time_reversible="yes")
def laplace(i, rng, T, S):
    return _best(lambda: rng.laplace(0, 1, T), lambda x: np.where(x < 0, np.exp(x) / 2, 1 - np.exp(-x) / 2)), {}


@register("A", "student-t", 4, 4, heavy_tailed="yes", time_reversible="yes")
def student(i, rng, T, S):
    nu = ((3.0, 4.0, 5.0, 7.0) if S.stationary else (1.5, 2.0, 3.0, 5.0))[i % 4]
    return rng.standard_t(nu, T), {"tail_index": nu}


@register("A", "alpha-stable", 5, 0, heavy_tailed="yes", time_reversible="yes")
def alpha_stable(i, rng, T, S):
    a, b = S.draw("alpha", 1.1, 1.95), S.draw("beta", -1, 1)
    return K.stable(rng, a, b, T), {"tail_index": a, "beta": b}


@register("A", "skewed", 5, 6, time_reversible="yes")
def skewed(i, rng, T, S):
    kind = S.choice("kind", ("gamma", "lognormal", "chi2"))
    shape = S.draw("shape", 0.6, 4, log=True)
    x = {"gamma": lambda: rng.gamma(shape, 1, T), "lognormal": lambda: rng.lognormal(0, 0.25 + shape / 5, T), "chi2": lambda: rng.chisquare(1 + int(2 * shape), T)}[kind]()
    return x, {"kind": kind, "shape": shape}


@register("A", "bimodal", 3, 3, time_reversible="yes")
def bimodal(i, rng, T, S):
    w, gap = S.draw("weight", 0.25, 0.75), S.draw("gap", 3, 7)
    return np.where(rng.random(T) < w, -gap / 2, gap / 2) + rng.standard_normal(T), {"weight": w, "gap": gap}


@register("A", "discrete", 4, 0, discrete_valued="yes", time_reversible="yes")
def discrete(i, rng, T, S):
    kind = ("bernoulli", "poisson", "categorical", "integer")[i % 4]
    p = S.draw("p", 0.1, 0.9)
    x = {"bernoulli": lambda: rng.random(T) < p, "poisson": lambda: rng.poisson(10 * p, T), "categorical": lambda: rng.choice(5, T, p=rng.dirichlet(np.ones(5))), "integer": lambda: rng.integers(0, 10, T)}[kind]()
    return np.asarray(x, float), {"kind": kind}


@register("A", "exponential-pareto", 2, 2, heavy_tailed="partly", time_reversible="yes")
def exponential_pareto(i, rng, T, S):
    if i % 2 == 0:
        return rng.exponential(1, T), {"kind": "exponential"}
    a = S.draw("tail", 2.2 if S.stationary else 1.2, 4, log=True)
    return rng.random(T) ** (-1 / a), {"kind": "pareto", "tail_index": a}


@register("A", "heavy-finite", 0, 6, heavy_tailed="yes", time_reversible="yes")
def heavy_finite(i, rng, T, S):
    if i % 2 == 0:
        nu = S.draw("nu", 3, 6)
        return rng.standard_t(nu, T), {"tail_index": nu}
    return rng.standard_normal(T) * np.where(rng.random(T) < S.draw("share", 0.02, 0.1), 5, 1), {"kind": "mixture"}


# ---- B: linear Gaussian ----------------------------------------------------------------------------------

_LIN = {"linear": "yes", "gaussian": "yes", "time_reversible": "yes"}


@register("B", "ar1", 10, 11, **_LIN)
def ar1(i, rng, T, S):
    phi = S.draw("phi", -0.95, 0.95)
    return K.ar_filter(rng.standard_normal(T + 2 * BURN), [phi])[-T:], {"phi": phi}


@register("B", "ar2", 14, 16, **_LIN)
def ar2(i, rng, T, S):
    if i % 2 == 0:
        period, radius = S.draw("period", 4, 60, log=True), S.draw("radius", 0.7, 0.985)
        return K.ar_filter(rng.standard_normal(T + 2 * BURN), K.ar2_of(period, radius))[-T:], {"period_samples": period, "radius": radius, "oscillatory": "yes"}
    a, b = S.draw("a", -0.9, 0.9), S.draw("b", -0.9, 0.9)
    return K.ar_filter(rng.standard_normal(T + 2 * BURN), [a + b, -a * b])[-T:], {"roots": [a, b]}


@register("B", "arp", 10, 11, **_LIN)
def arp(i, rng, T, S):
    phi = K.stable_ar(rng, S.integer("p", 3, 12))
    return K.ar_filter(rng.standard_normal(T + 2 * BURN), phi)[-T:], {"phis": phi.tolist()}


@register("B", "maq", 8, 9, **_LIN)
def maq(i, rng, T, S):
    q, decay = S.integer("q", 1, 20), S.draw("decay", 0.5, 0.95)
    theta = decay ** np.arange(1, q + 1) * rng.choice([-1, 1], q)
    return K.ma_filter(rng.standard_normal(T + BURN), theta)[-T:], {"q": q, "decay": decay}


@register("B", "arma", 10, 12, **_LIN)
def arma(i, rng, T, S):
    phi, theta = K.stable_ar(rng, S.integer("p", 1, 4)), rng.uniform(-0.9, 0.9, S.integer("q", 1, 4))
    return K.ar_filter(K.ma_filter(rng.standard_normal(T + 2 * BURN), theta), phi)[-T:], {"phis": phi.tolist(), "thetas": theta.tolist()}


@register("B", "seasonal-arma", 8, 9, oscillatory="yes", **_LIN)
def seasonal(i, rng, T, S):
    s, a, b = S.integer("season", 4, 50), S.draw("phi", 0.1, 0.8), S.draw("seasonal", 0.5, 0.92)
    phi = np.zeros(s + 1)
    phi[0], phi[s - 1], phi[s] = a, phi[s - 1] + b, -a * b
    return K.ar_filter(rng.standard_normal(T + 3 * BURN), phi)[-T:], {"period_samples": s, "phi": a}


@register("B", "narrowband", 8, 9, oscillatory="yes", **_LIN)
def narrowband(i, rng, T, S):
    f, width = S.draw("f", 0.02, 0.3, log=True), S.draw("width", 0.1, 0.5)
    return K.butterworth(2, f * (1 - width / 2), f * (1 + width / 2))(rng.standard_normal(T + 2 * BURN))[BURN : BURN + T], {"period_samples": 1 / f}


@register("B", "lowhigh-pass", 4, 4, **_LIN)
def lowhigh(i, rng, T, S):
    f, order = S.draw("f", 0.05, 0.3), S.integer("order", 2, 8)
    band = K.butterworth(order, None, f) if i % 2 == 0 else K.butterworth(order, f, None)
    return band(rng.standard_normal(T + 2 * BURN))[BURN : BURN + T], {"cutoff": f, "order": order}


@register("B", "random-spectrum", 4, 4, **_LIN)
def random_spectrum(i, rng, T, S):
    grid = np.linspace(np.log(1e-3), np.log(0.5), 160)
    scale, size = S.draw("scale", 0.3, 1.2), S.draw("size", 1, 2.5)
    cov = size**2 * np.exp(-0.5 * ((grid[:, None] - grid) / scale) ** 2) + 1e-6 * np.eye(160)
    log_psd = np.linalg.cholesky(cov) @ rng.standard_normal(160)
    f = np.fft.rfftfreq(4 * T)
    amp = np.exp(np.interp(np.log(np.maximum(f, 1e-3)), grid, log_psd) / 2)
    amp[0] = 0
    return K.zscore(np.fft.irfft(amp * np.exp(2j * np.pi * rng.random(len(f))))[:T]), {"scale": scale}


# ---- C: linear, not Gaussian -----------------------------------------------------------------------------


@register("C", "ar-skew", 8, 10, linear="yes")
def ar_skew(i, rng, T, S):
    phi, shape = K.stable_ar(rng, S.integer("p", 1, 3)), S.draw("shape", 0.3, 3, log=True)
    return K.ar_filter(K.skewed(rng, T + 2 * BURN, shape), phi)[-T:], {"shape": shape, "phis": phi.tolist()}


@register("C", "arma-heavy", 8, 9, linear="yes", heavy_tailed="yes")
def arma_heavy(i, rng, T, S):
    phi, n = K.stable_ar(rng, S.integer("p", 1, 3), 0.8), T + 2 * BURN
    if S.stationary or i % 2 == 0:  # Student's t, of finite variance where the record must look stationary
        a = S.draw("nu", 3, 6) if S.stationary else S.draw("nu", 1.5, 4)
        e = rng.standard_t(a, n)
    else:
        a = S.draw("alpha", 1.2, 1.9)
        e = K.stable(rng, a, 0, n)
    return K.ar_filter(e, phi)[-T:], {"tail_index": a, "phis": phi.tolist()}


@register("C", "ma-asym-skew", 6, 7, linear="yes", time_reversible="no")
def ma_asym(i, rng, T, S):
    q = S.integer("q", 3, 20)
    return np.convolve(K.skewed(rng, T + BURN, S.draw("shape", 0.3, 2)), np.linspace(1, 0, q + 1)[:-1], "same")[-T:], {"q": q}


@register("C", "levy-ou", 8, 9, linear="yes", bursty="partly")
def levy_ou(i, rng, T, S):
    n, rate, tau = T + 2 * BURN, S.draw("rate", 0.02, 0.3, log=True), S.draw("tau", 2, 30, log=True)
    x = K.ar_filter((rng.random(n) < rate) * rng.exponential(1, n), [np.exp(-1 / tau)])[-T:]
    return (x + 0.05 * x.std() * rng.standard_normal(T) if i % 4 < 2 else x), {"rate": rate, "corr_time": tau}


@register("C", "ar-bounded", 8, 8, linear="yes")
def ar_bounded(i, rng, T, S):
    phi = S.draw("phi", -0.9, 0.9)
    e = rng.choice([-1.0, 1.0], T + 2 * BURN) if i % 2 == 0 else rng.uniform(-1, 1, T + 2 * BURN)
    return K.ar_filter(e, [phi])[-T:], {"phi": phi}


@register("C", "shot-noise", 8, 9, linear="yes", event_like="yes", bursty="partly")
def shot_noise(i, rng, T, S):
    width, rate = S.draw("width", 1.5, 6, log=True), S.draw("rate", 0.05, 0.3, log=True)
    t = np.arange(int(8 * width) + 2)
    pulse = {0: np.exp(-t / width), 1: t / width * np.exp(1 - t / width), 2: np.exp(-0.5 * ((t - 4 * width) / width) ** 2), 3: (t < width) * 1.0}[i % (3 if S.stationary else 4)]
    x = np.convolve((rng.random(T + 2 * BURN) < rate) * rng.exponential(1, T + 2 * BURN), pulse)[BURN : BURN + T]
    return x + 1e-3 * x.std() * rng.standard_normal(T), {"rate": rate, "width": width, "kind": ("exponential", "alpha", "gaussian", "rectangle")[i % (3 if S.stationary else 4)]}


# ---- D: long memory --------------------------------------------------------------------------------------

_LONG = {"long_memory": "yes", "gaussian": "yes", "linear": "yes", "time_reversible": "yes"}
_WALK = {"stationary": "no", "nonstationary_kind": "stochastic-trend", "long_memory": "yes"}


@register("D", "fgn", 12, 14, **_LONG)
def fgn(i, rng, T, S):
    h = S.draw("h", 0.02, 0.9)
    return K.fgn(rng, h, T), {"hurst": h}


@register("D", "fbm", 10, 0, **_WALK)
def fbm(i, rng, T, S):
    h = S.draw("h", 0.1, 0.9)
    return np.cumsum(K.fgn(rng, h, T)), {"hurst": h}


@register("D", "arfima", 12, 14, **_LONG)
def arfima(i, rng, T, S):
    d = S.draw("d", -0.4, 0.4)
    x = K.frac_diff(rng.standard_normal(T + 4 * BURN), d)
    phi = S.draw("phi", -0.6, 0.6) if i % 2 else 0.0
    return K.ar_filter(x, [phi])[-T:], {"hurst": d + 0.5, "phi": phi}


@register("D", "one-over-f", 8, 0, long_memory="yes")
def one_over_f(i, rng, T, S):
    beta = S.draw("beta", 0, 3)
    return K.power_noise(rng, beta, T), {"beta": beta, "stationary": "yes" if beta < 1 else "no", "nonstationary_kind": "none" if beta < 1 else "stochastic-trend"}


@register("D", "mrw", 10, 12, long_memory="partly", multifractal="yes", heteroskedastic="yes")
def mrw(i, rng, T, S):
    n, lam = 8 * T, S.draw("lambda", 0.1, 0.35)
    lag = np.arange(n)
    cov = lam**2 * np.maximum(np.log(T / (1 + lag)), 0)
    eig = np.maximum(np.fft.fft(np.r_[cov, cov[-2:0:-1]]).real, 0)
    w = np.fft.fft(np.sqrt(eig / len(eig)) * (rng.standard_normal(len(eig)) + 1j * rng.standard_normal(len(eig)))).real[:n]
    at = int(rng.integers(0, n - T))
    return (K.fgn(rng, 0.5 + 0.2 * S.draw("h", 0, 1), n) * np.exp(w - w.var()))[at : at + T], {"lambda": lam}


@register("D", "discrete-cascade", 8, 10, multifractal="yes", heteroskedastic="yes")
def cascade(i, rng, T, S):
    depth = int(np.ceil(np.log2(T))) + 1
    p, m = S.draw("p", 0.55, 0.75), np.ones(1)
    for _ in range(depth):
        w = np.where(rng.random(len(m)) < 0.5, p, 1 - p) * 2 if i % 2 == 0 else np.exp(-0.3) * (1 + 0.6 * p) ** rng.poisson(0.5, len(m))
        v = 2 - w if i % 2 == 0 else np.exp(-0.3) * (1 + 0.6 * p) ** rng.poisson(0.5, len(m))
        m = np.stack([m * w, m * v], 1).ravel()
    return K.fgn(rng, S.draw("h", 0.5, 0.8), T) * np.sqrt(np.maximum(m[:T], 1e-6)), {"p": p}


@register("D", "lmsv", 4, 4, long_memory="partly", heteroskedastic="yes")
def lmsv(i, rng, T, S):
    s, h = S.draw("s", 0.4, 1), S.draw("h", 0.6, 0.9)
    return rng.standard_normal(T) * np.exp(s * K.fgn(rng, h, T)), {"hurst": h, "s": s}


@register("D", "levy-flight", 6, 0, heavy_tailed="yes", **_WALK)
def levy_flight(i, rng, T, S):
    a = S.draw("alpha", 1.2, 1.95)
    return np.cumsum(K.stable(rng, a, 0, T)), {"tail_index": a}


@register("D", "mbm", 4, 0, **_WALK)
def mbm(i, rng, T, S):
    grid = np.linspace(0.15, 0.85, 7)
    seeds = rng.integers(0, 2**32)
    paths = np.array([K.fgn(np.random.Generator(np.random.PCG64(seeds)), h, T) for h in grid])
    h = np.linspace(*((0.2, 0.8) if i % 2 == 0 else (0.8, 0.2)), T)
    at = np.clip((h - grid[0]) / (grid[1] - grid[0]), 0, 5.999)
    low = at.astype(int)
    t = np.arange(T)
    return np.cumsum((1 - at + low) * paths[low, t] + (at - low) * paths[low + 1, t]), {"tvp": h}


@register("D", "one-over-f-stationary", 0, 8, **_LONG)
def one_over_f_stationary(i, rng, T, S):
    beta = S.draw("beta", 0, 0.95)
    return K.power_noise(rng, beta, T), {"beta": beta}
