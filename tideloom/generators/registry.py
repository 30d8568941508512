"""Registry of generators: classes, quotas, tags and the record that each series carries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tideloom.generators.kit import Strata, stream

PROFILES = ("full", "stationary1000")
CLASSES = "ABCDEFGHIJKLMN"
#: Names under which a profile is also known.
ALIASES = {"1000x1000": "stationary1000"}
#: Series that each class of a profile shall have.
DECLARED = {
    "full": dict(A=30, B=76, C=46, D=74, E=100, F=81, G=150, H=41, I=72, J=58, K=82, L=40, M=40, N=110),
    "stationary1000": dict(A=30, B=85, C=52, D=62, E=122, F=81, G=181, H=32, I=104, J=48, K=0, L=43, M=40, N=120),
}
#: Tag columns, their values, and the ground-truth numbers a series may carry.
TAGS = (
    "stationary", "linear", "gaussian", "deterministic", "chaotic", "periodic", "quasiperiodic", "long_memory", "heavy_tailed", "multifractal",
    "heteroskedastic", "regime_switching", "discrete_valued", "event_like", "bursty", "oscillatory", "time_reversible", "continuous_time", "nonstationary_kind", "domain",
)
VALUES = ("yes", "no", "partly", "na")
NUMERICS = ("lyapunov", "hurst", "period_samples", "tail_index", "noise_sigma", "phi", "dimension", "snr_db", "burstiness", "rate", "corr_time")
DEFAULTS = {t: "no" for t in TAGS} | {"stationary": "yes", "time_reversible": "na", "nonstationary_kind": "none", "domain": "abstract"}


@dataclass(frozen=True)
class Generator:
    """gen(i, rng, T, S) -> (x, info); info holds tags, numerics, parameters and vectors of length T."""

    cls: str
    key: str
    gen: Callable[[int, np.random.Generator, int, Strata], tuple[np.ndarray, dict]]
    quota: dict[str, int]
    tags: dict[str, str] = field(default_factory=dict)
    order: int = 0

    @property
    def name(self) -> str:
        return f"{self.cls}.{self.key}"


GENERATORS: dict[str, Generator] = {}


def canonical(profile: str) -> str:
    """A profile's own name; unknown ones raise KeyError."""
    name = ALIASES.get(profile, profile)
    if name not in PROFILES:
        raise KeyError(profile)
    return name


def register(cls: str, key: str, full: int, stationary1000: int, /, **tags: str) -> Callable:
    """Registers a generator; unknown classes, tags or values and names in use raise."""

    def put(gen: Callable) -> Callable:
        if cls not in CLASSES:
            raise ValueError(f"unknown class {cls}")
        for tag, value in tags.items():
            if tag not in TAGS or (tag not in ("domain", "nonstationary_kind") and value not in VALUES):
                raise ValueError(f"unknown tag {tag}={value}")
        made = Generator(cls, key, gen, dict(zip(PROFILES, (full, stationary1000))), tags, len(GENERATORS))
        if made.name in GENERATORS:
            raise KeyError(made.name)
        GENERATORS[made.name] = made
        return gen

    return put


def load() -> dict[str, Generator]:
    """All generators."""
    from tideloom.generators import events, flows, linear, natural, nonlinear  # noqa: F401

    return GENERATORS


def gate(x: np.ndarray, discrete: bool) -> str | None:
    """The first reason against a series, None if it passes."""
    if x.ndim != 1:
        return "not one-dimensional"
    if not np.isfinite(x).all():
        return "non-finite"
    if len(x) and np.abs(x).max() > 1e12:
        return "overflow"
    if x.std() == 0:
        return "constant"
    if np.unique(x).size < (2 if discrete else 10):
        return "few values"
    return None


def profile_gate(x: np.ndarray, tags: dict[str, str], cls: str) -> str | None:
    """The further rules of the stationary profile, None if the series passes.

    Real values only; no periodic maps and flows; and, unless tagged nonstationary, little
    drift of mean and variance over five windows: events and bursts may vary in variance,
    settled deterministic systems less than others.
    """
    if tags["discrete_valued"] == "yes" or np.unique(x).size < 100:
        return "not real-valued"
    if cls in "FG" and tags["periodic"] == "yes":
        return "periodic orbit"
    if tags["stationary"] == "no":
        return None
    parts = x[: len(x) // 5 * 5].reshape(5, -1)
    mean, deviation = parts.mean(1), parts.std(1)
    if mean.std() > 0.5 * x.std():
        return "mean drifts"
    if "yes" in (tags["bursty"], tags["event_like"]):
        return None
    share, ratio = (0.3, 6.0) if cls in "FGHL" and tags["deterministic"] in ("yes", "partly") else (0.5, 20.0)
    if deviation.std() > share * x.std() or deviation.max() ** 2 > ratio * max(deviation.min() ** 2, 1e-12):
        return "variance drifts"
    return None


def generate(name: str, index: int, T: int = 1000, profile: str = "full", manual: int = 0, attempts: int = 8) -> dict:
    """One series and its record; a failing attempt is drawn again under its own name.

    Attempts must have T samples and pass `gate` and, in the stationary profile, `profile_gate`.

    A pure function of its arguments: order, partitions and hosts do not matter.
    """
    profile = canonical(profile)
    made = load()[name]
    from tideloom.generators.reversible import time_reversible

    n = made.quota[profile] or max(made.quota.values()) or 1
    reason = None
    for attempt in range(attempts):
        base = (made.cls, made.key, index, *(("manual", manual) if manual else ()), *(("retry", attempt) if attempt else ()))
        with np.errstate(all="ignore"):
            x, info = made.gen(index, stream(*base), T, Strata(name, index, n, profile == "stationary1000", attempt))
        x = np.asarray(x, float)
        tags = DEFAULTS | made.tags | {k: v for k, v in info.items() if k in TAGS}
        reason = f"length {len(x)}" if len(x) != T else gate(x, tags["discrete_valued"] == "yes")
        if reason is None and profile == "stationary1000":
            reason = profile_gate(x, tags, made.cls)
        if reason is None:
            if profile == "stationary1000":
                tags["time_reversible"] = time_reversible(name, tags, info)
            vectors = {k: v for k, v in info.items() if isinstance(v, np.ndarray) and v.shape == (T,)}
            numbers = {k: float(v) for k, v in info.items() if k in NUMERICS}
            rest = {k: v for k, v in info.items() if k not in TAGS and k not in NUMERICS and k not in vectors}
            return {"x": x, "tags": tags, "numerics": numbers, "params": rest, "vectors": vectors, "attempt": attempt, "seed_name": "/".join(map(str, base))}
    raise RuntimeError(f"{name}[{index}]: {reason}")
