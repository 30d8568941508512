"""Models of natural and social systems (N)."""

from __future__ import annotations

import numpy as np

from tideloom.generators import kit as K
from tideloom.generators.registry import register


def _tags(domain: str, **more: str) -> dict[str, str]:
    return {"domain": domain, **more}


# ---- ecology ---------------------------------------------------------------------------------------------


@register("N", "predator-prey-ssa", 3, 3, **_tags("ecology", oscillatory="yes"))
def predator_prey(i, rng, T, S):
    size = S.draw("size", *((200, 400) if S.stationary else (50, 400)), log=True)
    if i % 2 == 0:
        rates = lambda x, t: np.array([x[0], x[0] * x[1] / size, x[1], 1.0])
    else:
        rates = lambda x, t: np.array([x[0] * max(0, 1 - x[0] / (3 * size)) + 1, 1.5 * x[0] * x[1] / (size + x[0]), 0.5 * x[1], 0.5])
    x = K.gillespie(rng, (size, size), rates, np.array([[1, 0], [-1, 1], [0, -1], [1, 1]]), T, 0.25 if S.stationary else 0.1, 50)[:, 0]
    return np.log1p(x) + 1e-3 * rng.standard_normal(T), {"size": size}


@register("N", "blowflies-ricker", 4, 4, **_tags("ecology", oscillatory="yes"))
def blowflies(i, rng, T, S):
    if i % 2 == 0:
        if S.stationary:  # large, sharp-peaked cycles; the longer delay doubles the peaks
            birth, death, delay, span = (S.draw("birth", 6, 12), 0.175, 15.0, 1.0) if i == 0 else (rng.uniform(25, 35), 0.25, 20.0, 1.5)
            x = K.dde(lambda x, y, t: birth * y * np.exp(-y) - death * x, 1.0, delay, T * 10, span / 10, 4000)[::10, 0][:T]
            return x * (1 + 0.02 * rng.standard_normal(T)), {"birth": birth}
        r = S.draw("r", 1.7, 2.3)
        return K.dde(lambda x, y, t: r * x * (1 - y), 0.5, 1.0, T, 0.08, 2000)[:, 0] * np.exp(0.02 * rng.standard_normal(T)), {"r": r}
    r, x, out = S.draw("r", 2.2, 3), 1.0, np.empty(T)
    for t in range(T):
        x = x * np.exp(r * (1 - x) + 0.1 * rng.standard_normal())
        out[t] = x
    return out, {"r": r}


@register("N", "sir-seir", 4, 6, **_tags("ecology", oscillatory="yes", event_like="partly"))
def epidemic(i, rng, T, S):
    """Seasonal chain-binomial epidemic with births and imports; cases per report."""
    n, r0 = 20000, S.draw("r0", 4, 15)
    exposed = i % 2 == 1
    s, e, inf, out = int(n / r0), 5, 20, np.empty(T)
    per, days = (2 if S.stationary else 1), 7
    for t in range(-130 if S.stationary else 0, T):
        cases = 0
        for k in range(per * days):
            season = 1 + 0.2 * np.cos(2 * np.pi * ((t * per * days + k) / 365))
            new = rng.binomial(s, 1 - np.exp(-r0 * season * inf / (8 * n))) if s else 0
            infectious = rng.binomial(e, 1 / 6) if exposed else new
            out_ = rng.binomial(inf, 1 / 8)
            s = s - new + rng.poisson(n / (50 * 365) * 8)
            e = e + new - infectious if exposed else 0
            inf = inf + infectious - out_ + (rng.random() < 0.05)
            s, cases = min(s, n), cases + infectious
        if t >= 0:
            out[t] = cases
    return np.sqrt(out) + 1e-3 * rng.standard_normal(T), {"r0": r0, "seir": exposed}


@register("N", "logistic-extinction", 1, 0, **_tags("ecology", discrete_valued="yes"))
def extinction(i, rng, T, S):
    x, out = 20, np.empty(T)
    for t in range(T):
        x = max(0, x + rng.poisson(0.3 * x) - rng.poisson(0.3 * x * x / 25 + 0.02 * x))
        x = int(rng.poisson(3)) if x == 0 and rng.random() < 0.1 else x
        out[t] = x
    return out, {}


# ---- geophysics ------------------------------------------------------------------------------------------


@register("N", "rainfall-pulse", 4, 6, **_tags("geophysics", event_like="yes", bursty="yes"))
def rainfall(i, rng, T, S):
    """Storms by a Poisson process, cells clustered behind each, rectangular intensities summed by hour or day."""
    per = 1 if i % 2 == 0 else 24
    hours = T * per
    storms = np.sort(rng.uniform(0, hours, rng.poisson(S.draw("rate", 0.01, 0.05) * hours)))
    cells = rng.poisson(4, len(storms)) + 1
    start = np.repeat(storms, cells) + rng.exponential(6, cells.sum())
    stop, depth = start + rng.exponential(3, len(start)), rng.exponential(1, len(start))
    edge = np.arange(hours + 1)
    total = np.zeros(hours)
    for a, b, d in zip(start, stop, depth):
        lo, hi = int(a), min(int(b) + 1, hours)
        if lo < hours:
            total[lo:hi] += d * np.maximum(np.minimum(b, edge[lo + 1 : hi + 1]) - np.maximum(a, edge[lo:hi]), 0)
    x = total.reshape(T, per).sum(1)
    return x + 1e-6 * rng.random(T), {"hours": per}


def _weather(rng, T, season):
    wet, out = False, np.zeros(T)
    for t in range(T):
        swing = 0.15 * np.sin(2 * np.pi * t / 365) if season else 0
        wet = rng.random() < (0.65 if wet else 0.25) + swing
        out[t] = rng.gamma(0.8, 6) if wet else 0.0
    return out


@register("N", "richardson-weather", 3, 0, **_tags("geophysics", event_like="yes"))
def weather(i, rng, T, S):
    return _weather(rng, T, i % 2 == 1) + 1e-6 * rng.random(T), {}


@register("N", "richardson-weather-stationary", 0, 3, **_tags("geophysics", event_like="yes"))
def weather_stationary(i, rng, T, S):
    return K.smooth(_weather(rng, T, False), 1.0) + 1e-6 * rng.random(T), {}


def _river(rng, T, S, season):
    rain, k = _weather(rng, T + 500, season), S.draw("k", 0.5, 0.9)
    x = rain
    for _ in range(3):
        x = K.ar_filter((1 - k) * x, [k])
    return (x + K.ar_filter(0.02 * rain, [0.99]))[-T:], {"k": k}


@register("N", "river-discharge", 3, 0, **_tags("geophysics", bursty="partly"))
def river(i, rng, T, S):
    return _river(rng, T, S, True)


@register("N", "river-discharge-stationary", 0, 3, **_tags("geophysics", bursty="partly"))
def river_stationary(i, rng, T, S):
    return _river(rng, T, S, False)


@register("N", "stick-slip", 0, 2, **_tags("geophysics", event_like="yes"))
def stick_slip(i, rng, T, S):
    x, limit, out = 0.0, 1.0, np.empty(T)
    for t in range(T):
        x += 0.05 + 0.01 * rng.standard_normal()
        if x > limit:
            x, limit = x - rng.uniform(0.3, 1) * limit, rng.uniform(0.7, 1.3)
        out[t] = x
    return out, {}


def _aftershocks(rng, T, mu):
    """Epidemic aftershock cascade, generation by generation: (times, magnitudes)."""
    t = rng.uniform(-T, T, rng.poisson(2 * mu * T))
    m = rng.exponential(1 / 2.3, len(t))
    times, mags = [t], [m]
    while len(t):
        kids = rng.poisson(np.minimum(0.25 * np.exp(1.5 * m), 200))
        delay = 0.5 * (rng.random(kids.sum()) ** (-1 / 0.3) - 1)
        t = np.repeat(t, kids) + delay
        t = t[t < T][:20000]
        m = rng.exponential(1 / 2.3, len(t))
        times.append(t)
        mags.append(m)
    t, m = np.concatenate(times), np.concatenate(mags)
    order = np.argsort(t)
    return t[order][t[order] >= 0], m[order][t[order] >= 0]


@register("N", "etas", 4, 5, **_tags("geophysics", event_like="yes", bursty="yes"))
def etas(i, rng, T, S):
    mu = S.draw("mu", 0.5, 1.5)
    t, _ = _aftershocks(rng, 4 * T, mu)
    gap = np.diff(t)
    if (S.stationary or i % 2 == 1) and len(gap) >= T:
        return np.log(np.maximum(gap[-T:], 1e-9)), {"rate": mu, "event_like": "no"}
    return K.bin_events(t, 4 * T)[-T:] + 1e-6 * rng.random(T), {"rate": mu}


@register("N", "soc-avalanche", 1, 0, **_tags("geophysics", event_like="yes", heavy_tailed="yes"))
def sandpile(i, rng, T, S):
    n = 24
    z, out = rng.integers(0, 4, (n, n)), np.empty(T)
    for t in range(T):
        z[tuple(rng.integers(0, n, 2))] += 1
        size = 0
        while (over := z >= 4).any():
            size += int(over.sum())
            z = z - 4 * over
            z[1:] += over[:-1]
            z[:-1] += over[1:]
            z[:, 1:] += over[:, :-1]
            z[:, :-1] += over[:, 1:]
        out[t] = size
    return out, {}


@register("N", "barnes-sunspot", 1, 1, **_tags("geophysics", oscillatory="yes"))
def sunspot(i, rng, T, S):
    period = 22 if S.stationary else 132  # half-years, or months, of an eleven-year cycle
    z = 2 * K.zscore(K.ar_filter(K.ma_filter(rng.standard_normal(T + 3000), [-0.5, 0.2]), K.ar2_of(period, 0.93 if S.stationary else 0.985))[-T:])
    return z**2 + 0.03 * z**3, {"period_samples": period}


@register("N", "climate-model", 4, 4, **_tags("geophysics"))
def climate(i, rng, T, S):
    kind, p = ("hasselmann", "enso", "stommel", "daisyworld")[i % 4], S.draw("p", 0, 1)
    if kind == "hasselmann":
        return K.ar_filter(rng.standard_normal(T + 500), [0.8 + 0.18 * p])[-T:], {"kind": kind}
    if kind == "enso":
        if S.stationary:  # weather noise drives the delayed oscillator
            lag, step, noise, steps = 20, 0.1, rng.uniform(0.15, 0.4), 7 * (T + 100)
            w = noise * step**0.5 * rng.standard_normal(steps)
            y = np.full(steps + lag, 0.5)
            for t in range(lag, steps + lag - 1):
                y[t + 1] = y[t] + step * (y[t] - y[t] ** 3 - (0.6 + 0.35 * p) * y[t - lag]) + w[t - lag]
            return y[-7 * T :: 7][:T], {"kind": kind}
        x = K.dde(lambda x, y, t: x - x**3 - (0.75 + 0.1 * p) * y, 0.5, 6.0, T, 0.1, 2000)[:, 0]
        return x + 0.05 * rng.standard_normal(T), {"kind": kind}
    if kind == "stommel":
        return K.sde(rng, lambda x, t: 0.95 + 0.1 * p - x * (1 + 6 * (1 - x) ** 2), 0.15, (0.5,), T, 0.05, 10, 100)[:, 0], {"kind": kind}
    growth = lambda heat: np.maximum(1 - 0.003265 * (22.5 - heat) ** 2, 0)
    w = np.array([0.3, 0.3])
    out = np.empty(T)
    for t in range(T):
        sun = 1 + 0.1 * np.sin(2 * np.pi * t / 150) + 0.02 * rng.standard_normal()
        albedo = 0.75 * w[0] + 0.25 * w[1] + 0.5 * (1 - w.sum())
        mean = (917 * sun * (1 - albedo) / 5.67e-8) ** 0.25 - 273
        local = mean + 20 * (albedo - np.array([0.75, 0.25]))
        w = np.clip(w + 0.3 * w * ((1 - w.sum()) * growth(local) - 0.3), 0.01, 0.98)
        out[t] = mean
    return out, {"kind": kind}


@register("N", "turbulence", 2, 2, **_tags("geophysics", multifractal="partly"))
def turbulence(i, rng, T, S):
    if i % 2 == 0:  # shell model, integrating factor for the viscous part
        n, k, nu, dt = 14, 2.0 ** np.arange(14) * 0.0625 * 2, 1e-5, 2e-3
        u, out = (rng.standard_normal(n) + 1j * rng.standard_normal(n)) * 0.1 * k ** (-1 / 3), np.empty(T)
        damp = np.exp(-nu * k**2 * dt)
        wide, force = np.zeros(n + 4, complex), 5e-3 * (1 + 1j) * (np.arange(n) == 0)

        def slope(u):
            wide[2:-2] = u
            up1, up2, dn1, dn2 = wide[3:-1], wide[4:], wide[1:-3], wide[:-4]
            return 1j * k * (up2 * up1.conj() - 0.25 * up1 * dn1.conj() + 0.125 * dn1 * dn2) + force

        every = 120 if S.stationary else 20  # coarser sampling: more turnovers in a record
        for t in range(every * (T + 100)):
            mid = u + dt / 2 * slope(u)
            u = (u + dt * slope(mid)) * damp
            u = np.where(np.abs(u) < 10, u, 0.1)
            if t % every == every - 1 and t // every >= 100:
                out[t // every - 100] = u[6 if S.stationary else 4].real
        return out, {"kind": "shell"}
    n = 256
    u, wave, out = np.zeros(n), np.fft.rfftfreq(n, 1 / n), np.empty(T)
    for t in range(T + 100):
        force = sum(rng.standard_normal() * np.sin(m * 2 * np.pi * np.arange(n) / n + rng.uniform(0, 6.28)) for m in (1, 2, 3))
        for _ in range(10 if S.stationary else 4):
            half = np.fft.irfft(np.fft.rfft(u**2 / 2) * 1j * wave * (wave < n / 3), n)
            u = np.fft.irfft(np.fft.rfft(u + 0.004 * (force - half)) / (1 + 0.004 * 0.02 * wave**2), n)
        if t >= 100:
            out[t - 100] = u[10]
    return out, {"kind": "burgers"}


# ---- physics and economics -------------------------------------------------------------------------------


@register("N", "onoff-traffic", 3, 3, **_tags("engineering", long_memory="yes"))
def onoff(i, rng, T, S):
    tail, total = S.draw("tail", 1.5, 1.9), np.zeros(T)
    for _ in range(int(rng.integers(150, 400) if S.stationary else rng.integers(20, 100))):
        t, on, height = -float(rng.uniform(0, 200)), rng.random() < 0.5, rng.uniform(0.5, 1.5) if S.stationary else 1.0
        while t < T:
            d = (2 if S.stationary else 5) * (rng.pareto(tail) + 1)
            if on and t + d > 0:
                lo, hi = int(max(t, 0)), int(min(t + d, T - 1))
                total[lo : hi + 1] += height
            t, on = t + d, not on
    return total + 0.1 * rng.standard_normal(T), {"tail_index": tail, "hurst": (3 - tail) / 2}


def _resonate(x, freqs, radius):
    for f in freqs:
        x = K.ar_filter(x, K.ar2_of(1 / f, radius))
    return x


@register("N", "speech", 3, 3, **_tags("engineering", oscillatory="yes"))
def speech(i, rng, T, S):
    pitch, out, at = S.draw("pitch", 40, 90), [], 0
    vowels = ((0.07, 0.12), (0.03, 0.23), (0.05, 0.09), (0.06, 0.18))
    while at < T:
        n = min(200, T - at) if T - at >= 100 else T - at
        x = np.zeros(n + 300)
        gaps = np.cumsum(rng.normal(pitch, 0.03 * pitch, (n + 300) // int(pitch * 0.5) + 2)).astype(int)
        x[gaps[(gaps >= 0) & (gaps < n + 300)]] = 1
        seg = _resonate(x, vowels[int(rng.integers(0, 4))], 0.97)[-n:]
        out.append(seg / (seg.std() or 1) * rng.uniform(0.6, 1))
        at += n
    x = np.concatenate(out)[:T]
    return x + 0.01 * x.std() * rng.standard_normal(T), {"period_samples": pitch}


@register("N", "bearing-vibration", 2, 2, **_tags("engineering", event_like="partly"))
def bearing(i, rng, T, S):
    gap = S.draw("gap", 20, 60)
    x = K.bin_events(K.renewal(rng, lambda n: gap * (1 + 0.02 * rng.standard_normal(n)), T + 200), T + 200) * (1 + 0.2 * rng.standard_normal(T + 200))
    y = _resonate(x, (0.2,), 0.93)[-T:]
    return y + 0.3 * y.std() * rng.standard_normal(T), {"period_samples": gap}


@register("N", "collective", 3, 3, **_tags("physics"))
def collective(i, rng, T, S):
    if i % 2 == 0:
        n, k = 60, S.draw("k", 0.8, 2)
        w, th, out = rng.standard_cauchy(n).clip(-5, 5) * 0.5, rng.uniform(0, 6.28, n), np.empty(T)
        for t in range(4 * (T + 100)):
            z = np.exp(1j * th).mean()
            th = th + 0.1 * (w + k * abs(z) * np.sin(np.angle(z) - th)) + 0.05 * rng.standard_normal(n)
            if t % 4 == 3 and t // 4 >= 100:
                out[t // 4 - 100] = abs(z)
        return out, {"kind": "kuramoto", "k": k}
    n, beta = 24, S.draw("beta", 0.36, 0.42)
    s, out = rng.choice([-1, 1], (n, n)), np.empty(T)
    board = np.indices((n, n)).sum(0) % 2
    for t in range(T + 100):
        for colour in (0, 1):
            h = np.roll(s, 1, 0) + np.roll(s, -1, 0) + np.roll(s, 1, 1) + np.roll(s, -1, 1)
            s = np.where((board == colour) & (rng.random((n, n)) < np.exp(-2 * beta * s * h)), -s, s)
        if t >= 100:
            out[t - 100] = s.mean()
    return out, {"kind": "ising", "beta": beta}


@register("N", "laser-feedback", 2, 2, **_tags("physics", chaotic="yes"))
def laser(i, rng, T, S):
    kappa, tau = S.draw("kappa", 0.05, 0.2), 40.0

    def f(x, y, t):
        e, n, old = x[0] + 1j * x[1], x[2], y[0] + 1j * y[1]
        de = (1 + 4j) * n * e + kappa * old
        return np.array([de.real, de.imag, (0.5 - n - (1 + 2 * n) * abs(e) ** 2) / 100])

    x = K.dde(f, (0.5, 0.1, 0.0), tau, 5 * T, 0.2, 5000)
    return (x[:, 0] ** 2 + x[:, 1] ** 2)[::5][:T] + 1e-6 * rng.standard_normal(T), {"kappa": kappa}


@register("N", "oregonator", 2, 2, **_tags("physics", oscillatory="yes", deterministic="yes"))
def oregonator(i, rng, T, S):
    """Stiff kinetics by the implicit Euler rule with Newton steps."""
    q, eps, f = 0.002, 0.04, S.draw("f", 0.7, 1.0)
    x, out, dt = np.array([0.1, 0.1]), np.empty(T), 0.01
    rate = lambda x: np.array([(x[0] * (1 - x[0]) - f * x[1] * (x[0] - q) / (x[0] + q)) / eps, x[0] - x[1]])
    for t in range(8 * (T + 100)):
        y = x.copy()
        for _ in range(6):
            d = (y[0] + q) ** 2
            J = np.array([[(1 - 2 * y[0] - 2 * f * y[1] * q / d) / eps, -f * (y[0] - q) / (y[0] + q) / eps], [1, -1]])
            step = np.linalg.solve(np.eye(2) - dt * J, y - x - dt * rate(y))
            y = np.maximum(y - step, q / 2)
            if np.abs(step).max() < 1e-9:
                break
        x = y
        if t % 8 == 7 and t // 8 >= 100:
            out[t // 8 - 100] = x[0]
    x = np.log(out)
    return x + 0.02 * x.std() * rng.standard_normal(T), {"f": f}


@register("N", "nagel-schreckenberg", 1, 0, **_tags("engineering", discrete_valued="yes"))
def traffic(i, rng, T, S):
    length, n = 200, 45
    pos, v, out = np.sort(rng.choice(length, n, replace=False)), np.zeros(n, int), np.empty(T)
    for t in range(5 * T):
        gap = (np.roll(pos, -1) - pos - 1) % length
        v = np.minimum(np.minimum(v + 1, 5), gap)
        v = np.maximum(v - (rng.random(n) < 0.25), 0)
        passed = ((pos + v) >= length).sum()
        pos = (pos + v) % length
        out[t // 5] = passed + (out[t // 5] if t % 5 else 0)
    return out, {}


@register("N", "finance-sde", 2, 0, **_tags("economics", heteroskedastic="partly", stationary="no", nonstationary_kind="stochastic-trend"))
def finance(i, rng, T, S):
    if i % 2 == 0:
        return 100 * np.exp(np.cumsum(0.0002 + 0.012 * rng.standard_normal(T))), {"kind": "gbm"}
    v, x, out = 0.04, np.log(100), np.empty(T)
    for t in range(T):
        a, b = rng.standard_normal(2)
        x += -v / 2 / 250 + np.sqrt(v / 250) * a
        v = abs(v + 3 * (0.04 - v) / 250 + 0.4 * np.sqrt(v / 250) * (-0.7 * a + 0.71 * b))
        out[t] = np.exp(x)
    return out, {"kind": "heston"}


def _herd(rng, T, n, sweeps, eps):
    k, out = n // 2, np.empty(T)
    for t in range(T + 50):
        for _ in range(sweeps):
            up = rng.binomial(n - k, min(1, eps + 0.5 * k / n))
            down = rng.binomial(k, min(1, eps + 0.5 * (n - k) / n))
            k = int(np.clip(k + up - down, 0, n))
        if t >= 50:
            out[t - 50] = k / n
    return out


@register("N", "agent-market", 3, 0, **_tags("economics"))
def market(i, rng, T, S):
    if i % 2 == 0:
        return _herd(rng, T, 100, 1, 0.01) + 1e-3 * rng.standard_normal(T), {"kind": "herd"}
    price, bids, asks, out = 100.0, [99.0], [101.0], np.empty(T)
    for t in range(T):
        for _ in range(10):
            side, level = rng.random() < 0.5, price + rng.normal(0, 2)
            if side:
                if level >= min(asks, default=np.inf):
                    price = min(asks)
                    asks.remove(price)
                else:
                    bids.append(level)
            elif level <= max(bids, default=-np.inf):
                price = max(bids)
                bids.remove(price)
            else:
                asks.append(level)
        bids, asks = bids[-60:], asks[-60:]
        out[t] = price
    return np.diff(out, prepend=100.0) + 1e-6 * rng.standard_normal(T), {"kind": "book"}


@register("N", "kirman", 0, 3, **_tags("economics"))
def kirman(i, rng, T, S):
    eps = S.draw("eps", 0.01, 0.05)
    return _herd(rng, T, 300, 3, eps), {"eps": eps}


# ---- physiology ------------------------------------------------------------------------------------------


def _beats(rng, T, S):
    """Intervals of an integral pulse-frequency model with respiratory and slow modulation."""
    dt = 0.02
    t = np.arange(0, 1.3 * T, dt)
    slow = K.smooth(rng.standard_normal(len(t) // 50 + 1), 10)
    m = 1.1 * (1 + 0.08 * np.sin(2 * np.pi * S.draw("breath", 0.2, 0.35) * t) + 0.06 * np.sin(2 * np.pi * 0.1 * t + 1) + 0.3 * np.interp(t, np.arange(len(slow)) * 50 * dt, slow))
    phase = np.cumsum(np.maximum(m, 0.2)) * dt
    return np.diff(np.interp(np.arange(1, T + 2), phase, t))


@register("N", "rr-ipfm", 6, 9, **_tags("physiology", oscillatory="partly"))
def rr(i, rng, T, S):
    return _beats(rng, T, S) + 0.003 * rng.standard_normal(T), {}


@register("N", "rr-ectopic", 3, 3, **_tags("physiology", event_like="partly"))
def rr_ectopic(i, rng, T, S):
    x = _beats(rng, T, S)
    p = S.draw("rate", 0.01, 0.08)
    hit = rng.random(T) < p
    early = rng.uniform(0.25, 0.4, T)
    return x - hit * early * x + np.r_[0, (hit * early * x)[:-1]], {"rate": p}


@register("N", "rr-af", 3, 3, **_tags("physiology"))
def rr_af(i, rng, T, S):
    rate, rest, out = S.draw("rate", 5, 9), 0.25, np.empty(T)
    for t in range(T):
        refractory = rest + 0.08 * rng.random() + 0.05 * (out[t - 1] if t else 0.6)
        out[t] = refractory + rng.exponential(1 / rate) + rng.exponential(1 / rate) * (rng.random() < 0.4)
    return out, {"rate": rate}


@register("N", "deboer", 3, 3, **_tags("physiology", oscillatory="yes"))
def deboer(i, rng, T, S):
    """Beat-to-beat pressure and interval with a fast and a delayed reflex."""
    fast, late = S.draw("fast", 4, 10), S.draw("late", 1, 3)
    sp, rr_, out = [120.0] * 6, [0.8] * 6, np.empty(T + 100)
    for t in range(T + 100):
        breath = 3 * np.sin(2 * np.pi * 0.3 * sum(rr_[-1:]) * t)
        s = 120 + 0.5 * (sp[-1] - 120) - 10 * (rr_[-1] - 0.8) - 0.3 * (np.mean(sp[-5:-1]) - 120) + breath + rng.standard_normal()
        r = 0.8 + fast * 1e-3 * (s - 120) + late * 1e-3 * (np.mean(sp[-5:-1]) - 120) + 0.01 * rng.standard_normal()
        sp, rr_ = [*sp[1:], s], [*rr_[1:], float(np.clip(r, 0.3, 2))]
        out[t] = rr_[-1]
    return out[-T:], {"fast": fast}


@register("N", "ecgsyn", 4, 4, **_tags("physiology", oscillatory="yes"))
def ecg(i, rng, T, S):
    """Waves as Gaussians in the phase of each beat."""
    per, t = S.draw("points", 40, 90), 0.0
    centre, width, height = np.array([-1.2, -0.26, 0, 0.26, 1.75]), np.array([0.25, 0.1, 0.1, 0.1, 0.4]), np.array([0.15, -0.12, 1, -0.2, 0.3])
    theta = np.empty(T)
    speed = 2 * np.pi / per
    for k in range(T):
        t += speed * (1 + 0.05 * np.sin(2 * np.pi * k / (4 * per)) + 0.02 * rng.standard_normal())
        theta[k] = (t + np.pi) % (2 * np.pi) - np.pi
    x = (height * np.exp(-0.5 * ((theta[:, None] - centre) / width) ** 2)).sum(1)
    return x + 0.02 * rng.standard_normal(T), {"period_samples": per}


@register("N", "periodic-breathing", 3, 3, **_tags("physiology", oscillatory="yes"))
def breathing(i, rng, T, S):
    gain, step = S.draw("gain", 1, 2.5), 0.25
    v = K.dde(lambda x, y, t: 1 - x * 1.2 * np.maximum(y, 0) ** (2 * gain) / (1 + np.maximum(y, 0) ** (2 * gain)), 0.8, 3.0, T, step / 3, 2000)[:, 0]
    breath = np.sin(2 * np.pi * np.arange(T) / 8)
    if S.stationary:  # rate and depth vary from breath to breath
        breath = np.sin(np.cumsum(2 * np.pi / 8 * (1 + 0.1 * rng.standard_normal(T)))) * (1 + 0.08 * rng.standard_normal(T))
    return np.maximum(v - v.min() + 0.1, 0) * breath + 0.02 * rng.standard_normal(T), {"gain": gain}


@register("N", "neural-mass", 8, 11, **_tags("physiology", oscillatory="partly"))
def neural_mass(i, rng, T, S):
    kind, p = ("jansen-rit", "wilson-cowan", "epileptor")[i % 3], S.draw("p", 0, 1)
    if kind == "wilson-cowan":
        sig = lambda v: 1 / (1 + np.exp(-v))
        f = lambda x, t: (-x[0] + sig(13 * x[0] - 12 * x[1] - 2 + 2 * p), (-x[1] + sig(12 * x[0] - 3 * x[1] - 4)) / 1.5)
        return K.sde(rng, f, 0.03, (0.1, 0.1), T, 0.05, 6, 100)[:, 0], {"kind": kind}
    if kind == "jansen-rit":
        sig = lambda v: 5 / (1 + np.exp(0.56 * (6 - v)))

        def f(x, t):
            return np.array([x[3], x[4], x[5], 325 * sig(x[1] - x[2]) - 200 * x[3] - 1e4 * x[0], 325 * (120 + 200 * p + 108 * sig(135 * x[0])) - 200 * x[4] - 1e4 * x[1], 1100 * 33.75 * sig(33.75 * x[0]) - 100 * x[5] - 2500 * x[2]])

        x = K.sde(rng, f, (0, 0, 0, 0, 3000, 0), np.zeros(6), T, 0.001, 8, 100)
        return x[:, 1] - x[:, 2], {"kind": kind}

    def f(x, t):
        a = x[0] ** 3 - 3 * x[0] ** 2 if x[0] < 0 else (x[3] - 0.6 * (x[2] - 4) ** 2) * x[0]
        b = 0.0 if x[3] < -0.25 else 6 * (x[3] + 0.25)
        return np.array([x[1] - a - x[2] + 3.1, 1 - 5 * x[0] ** 2 - x[1], (4 * (x[0] + (2.08 if S.stationary and i == 8 else 1.6 + 0.3 * p)) - x[2]) / 300, -x[4] + x[3] - x[3] ** 3 + 0.45 + 0.01 * x[0] - 0.3 * (x[2] - 3.5), (-x[4] + b) / 10])

    dt, every = (0.05, 150) if S.stationary else (0.02, 15)  # many seizures in a record, or one
    return K.sde(rng, f, (0.05, 0.05, 0, 0.1, 0.1), (-1.6, -10, 3, 0, 0), T, dt, every, 100)[:, 0], {"kind": kind}


@register("N", "neuron", 8, 10, **_tags("physiology", event_like="yes"))
def neuron(i, rng, T, S):
    kind, drive = ("izhikevich", "morris-lecar", "hindmarsh-rose", "hodgkin-huxley")[i % 4], S.draw("drive", 0, 1)
    if kind == "izhikevich":
        v, u, out = -65.0, -13.0, np.empty(T)
        for t in range(T):
            for _ in range(4):
                v += 0.25 * (0.04 * v * v + 5 * v + 140 - u + 6 + 8 * drive) + 1.0 * rng.standard_normal()
                u += 0.25 * 0.02 * (0.2 * v - u)
                if v >= 30:
                    v, u = -65.0 + 10 * (i % 8 > 3), u + 6
            out[t] = min(v, 30)
        return out, {"kind": kind}
    if kind == "hindmarsh-rose":
        f = lambda x, t: (x[1] - x[0] ** 3 + 3 * x[0] ** 2 - x[2] + 2.5 + drive, 1 - 5 * x[0] ** 2 - x[1], 0.006 * (4 * (x[0] + 1.6) - x[2]))
        return K.sde(rng, f, (0.05, 0, 0), (-1, 0, 2), T, 0.05, 24 if S.stationary else 10, 100)[:, 0], {"kind": kind}
    if kind == "morris-lecar":
        f = lambda x, t: ((80 + 30 * drive - 2 * (x[0] + 60) - 4 * (0.5 + 0.5 * np.tanh((x[0] + 1.2) / 18)) * (x[0] - 120) - 8 * x[1] * (x[0] + 84)) / 20, 0.04 * np.cosh((x[0] - 2) / 60) * (0.5 + 0.5 * np.tanh((x[0] - 2) / 30) - x[1]))
        return K.sde(rng, f, (1.0, 0), (-40, 0.1), T, 0.2, 12 if S.stationary else 5, 100)[:, 0], {"kind": kind}

    def f(x, t):
        v, m, h, n = x
        a = lambda top, scale, u: top * scale * (1 - abs(u) / 2 if abs(u) < 1e-6 else u / (1 - np.exp(-u)))
        return np.array([
            6 + 8 * drive - 120 * m**3 * h * (v - 50) - 36 * n**4 * (v + 77) - 0.3 * (v + 54.4),
            a(0.1, 10, (v + 40) / 10) * (1 - m) - 4 * np.exp(-(v + 65) / 18) * m,
            0.07 * np.exp(-(v + 65) / 20) * (1 - h) - h / (1 + np.exp(-(v + 35) / 10)),
            a(0.01, 10, (v + 55) / 10) * (1 - n) - 0.125 * np.exp(-(v + 65) / 80) * n,
        ])

    return K.sde(rng, f, (1.0, 0, 0, 0), (-65, 0.05, 0.6, 0.3), T, 0.02, 50 if S.stationary else 20, 20)[:, 0], {"kind": kind}


@register("N", "glucose-insulin", 3, 3, **_tags("physiology", oscillatory="partly"))
def glucose(i, rng, T, S):
    delay, meals = S.draw("delay", 5, 30), np.zeros(20 * T)
    every = 288
    for m in range(0, 20 * T, every // 3):
        at = m + int(rng.integers(0, 30))
        k = np.arange(max(min(120, 20 * T - at), 0))
        meals[at : at + len(k)] += rng.uniform(0.5, 1.5) * k / 20 * np.exp(1 - k / 20)
    weak = 0.5 if S.stationary and i == 1 else 1.0  # insulin resistance: large, slow excursions
    f = lambda x, y, t: np.array([-0.03 * weak * x[0] - 0.02 * weak * x[1] * (x[0] + 1) + 0.15 * meals[min(int(t), len(meals) - 1)], -0.05 * x[1] + 0.06 * max(y[0], 0)])
    x = K.dde(f, (1.0, 0.5), delay, 4 * T, 1.0, 0)[::4, 0]
    return x + 0.02 * x.std() * rng.standard_normal(T), {"delay": delay}


@register("N", "circadian-hormone", 4, 4, **_tags("physiology", oscillatory="yes"))
def circadian(i, rng, T, S):
    if i % 2 == 0:
        s = S.draw("s", 0.02, 0.1)
        w = 2 * np.pi / 24
        f = lambda x, t: (w * (x[1] + 0.13 * (x[0] / 3 + 4 / 3 * x[0] ** 3 - 256 / 105 * x[0] ** 7)), -w * x[0])
        return K.sde(rng, f, s * 0.5, (1, 0), T, 0.1, 10, 100)[:, 0], {"period_samples": 24}
    n = T + 200
    rate = 0.08 * (1 + 0.7 * np.sin(2 * np.pi * np.arange(n) / 96))
    pulses = (rng.random(n) < rate) * rng.lognormal(0, 0.4, n)
    return np.convolve(pulses, np.exp(-np.arange(60) / 8))[:n][-T:] + 0.05 * rng.standard_normal(T), {"period_samples": 96}


@register("N", "gene-cell", 6, 6, **_tags("physiology", oscillatory="yes"))
def gene(i, rng, T, S):
    kinds = ("expression-ssa", "expression-ssa", "expression-ssa", "expression-ssa", "calcium", "calcium") if S.stationary else ("goodwin", "repressilator", "expression-ssa", "expression-ssa", "calcium", "calcium")
    kind, p = kinds[i % 6], S.draw("p", 0, 1)
    if kind == "goodwin":
        x = K.flow(lambda x, t: (1 / (1 + x[2] ** (10 + 4 * p)) - 0.1 * x[0], x[0] - 0.1 * x[1], 0.1 * x[1] - 0.1 * x[2]), (0.5, 1, 1), T, 0.5, 25)
    elif kind == "repressilator":
        x = K.flow(lambda x, t: np.r_[-x[:3] + (40 + 40 * p) / (1 + np.roll(x[3:], 1) ** 2) + 0.2, -1.0 * (x[3:] - x[:3])], (1, 2, 3, 1, 2, 3), T, 0.05, 25)
    elif kind == "expression-ssa":
        rates = lambda x, t: np.array([0.1 * (1 - x[0]), 0.1 * x[0], 4 * x[0] + 0.2, 0.3 * x[1]])
        x = K.gillespie(rng, (0, 0), rates, np.array([[1, 0], [-1, 0], [0, 1], [0, -1]]), T, 0.5, 50)[:, 1]
        if S.stationary:  # protein made from the messages, and diluted
            x = K.ar_filter(2.0 * np.r_[np.full(60, x.mean()), x], [0.8])[-T:]
        return x + 0.05 * rng.standard_normal(T), {"kind": kind}
    else:
        f = lambda x, t: (1 + 7.3 * (0.25 + 0.4 * p) - 65 * x[0] ** 2 / (1 + x[0] ** 2) + 500 * x[1] ** 2 / (4 + x[1] ** 2) * x[0] ** 4 / (0.6561 + x[0] ** 4) + x[1] - 10 * x[0], 65 * x[0] ** 2 / (1 + x[0] ** 2) - 500 * x[1] ** 2 / (4 + x[1] ** 2) * x[0] ** 4 / (0.6561 + x[0] ** 4) - x[1])
        x = K.flow(f, (0.3, 1.5), T, 0.002, 40)
    return x + 0.02 * x.std() * rng.standard_normal(T), {"kind": kind}


@register("N", "gait-emg-tremor", 4, 4, **_tags("physiology"))
def gait(i, rng, T, S):
    kind = ("gait", "emg", "tremor")[i % 3]
    if kind == "gait":
        return 1.05 + 0.02 * K.zscore(K.fgn(rng, S.draw("h", 0.6, 0.9), T)), {"kind": kind}
    if kind == "emg":
        gate = 0.2 + (np.sin(2 * np.pi * np.arange(T) / S.draw("burst", 40, 120)) > 0)
        return gate * rng.standard_normal(T), {"kind": kind, "bursty": "yes"}
    return K.ar_filter(rng.standard_normal(T + 300), K.ar2_of(S.draw("period", 8, 20), 0.98))[-T:], {"kind": kind, "oscillatory": "yes"}
