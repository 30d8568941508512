"""Time reversibility of the stationary profile's series, from theory by family and variant."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

# Families whose every series has one answer.
ALWAYS = {
    # one-dimensional diffusions, birth-death chains, independent draws, and signs times a reversible volatility
    "yes": ("D.lmsv", "D.mrw", "E.stoch-vol", "I.double-well", "J.compound-poisson-increments", "N.kirman"),
    # linear with other than Gaussian noise, volatility after shocks, nonlinear or random coefficients, dissipative cycles
    "no": ("C.ar-bounded", "C.arma-heavy", "E.garch", "E.random-coef-ar", "E.markov-switching-ar", "E.bistable-map", "E.stochastic-map", "F.aperiodic-real", "H.limit-cycle", "H.period-doubled-flows"),
    "na": ("D.discrete-cascade", "I.stochastic-resonance", "N.rr-af"),
}
# Families whose answer hangs on a parameter: its name, answers by value, the answer else (None: the series' own tag).
BY_VARIANT: dict[str, tuple[str, dict, str | None]] = {
    "H.harmonic": ("kind", {"random": "no", "saw": "no"}, None),
    "H.cycle-shapes": ("kind", {"pendulum": "yes"}, "no"),
    "J.markov-chain-emitted": ("states", {2: "yes"}, "no"),
    "L.longlag-comb": ("kind", {"linear": "yes"}, "no"),
    "L.mixture": ("kind", {3: "yes"}, "no"),
    "N.climate-model": ("kind", {"hasselmann": "yes", "stommel": "na"}, "no"),
    "N.collective": ("kind", {"ising": "yes"}, "no"),
    "M.missing-data": ("fill", {"hold": "no"}, None),
}


def time_reversible(name: str, tags: Mapping[str, str], params: Mapping[str, object]) -> str:
    """yes, no or na for a series of the family `name` (class and key)."""
    for answer, names in ALWAYS.items():
        if name in names:
            return answer
    if name in BY_VARIANT:
        parameter, answers, other = BY_VARIANT[name]
        return answers.get(params.get(parameter), other or tags["time_reversible"])
    if name == "C.shot-noise":
        if params.get("kind") != "gaussian":
            return "no"
        # the pulse is symmetric in time only where its centre falls on the middle of the sampling grid
        width = float(params["width"])
        pulse = np.exp(-0.5 * ((np.arange(int(8 * width) + 2) - 4 * width) / width) ** 2)
        return "yes" if np.allclose(pulse, pulse[::-1], rtol=1e-3, atol=1e-6) else "no"
    if name == "M.downsampled":  # a symmetric filter keeps what holds for the base
        base = str(params.get("base", "")).partition("/")[0]
        return next((answer for answer, names in ALWAYS.items() if base in names), tags["time_reversible"])
    return tags["time_reversible"]
