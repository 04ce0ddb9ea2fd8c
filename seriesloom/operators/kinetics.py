"""Point kinetics with six delayed groups, integrated by fourth-order Runge-Kutta steps.

A scenario is a row; scenarios run side by side, one group each.  In a step the reactivity is held, so
the system is linear and the four stages are one matrix polynomial, which is built again only when the
reactivity changes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Delayed fractions, decay constants (1/s) and generation time (s) of thermal U-235.
BETA = (0.000247, 0.0013845, 0.001222, 0.0026455, 0.0008320, 0.0001690)
LAMBDA = (0.0124, 0.0305, 0.111, 0.301, 1.14, 3.01)
GENERATION = 2e-5


def equilibrium(n0: float = 1.0) -> np.ndarray:
    """(n, c1..c6) at rest with power n0."""
    return np.array([n0, *(b / (GENERATION * la) * n0 for b, la in zip(BETA, LAMBDA, strict=True))])


def system(rho: float) -> np.ndarray:
    """d(state)/dt = system(rho) @ state."""
    a = np.zeros((7, 7))
    a[0, 0] = (rho - sum(BETA)) / GENERATION
    a[0, 1:] = LAMBDA
    a[1:, 0] = np.array(BETA) / GENERATION
    a[range(1, 7), range(1, 7)] = -np.array(LAMBDA)
    return a


def step_matrix(rho: float, dt: float) -> np.ndarray:
    """One Runge-Kutta step of a linear system."""
    h = dt * system(rho)
    return np.eye(7) + h @ (np.eye(7) + h @ (np.eye(7) + h @ (np.eye(7) + h / 4) / 3) / 2)


def ramp_at(t: float, start: float, end: float, final: float) -> float:
    return 0.0 if t < start else final if t >= end else final * (t - start) / (end - start)


def simulate(reactivity, t_end: float, dt: float, feedback: float = 0.0, cooling: float = 0.1) -> list[tuple[float, float]]:
    """(t, n) from 0 on while t < t_end, time being added up; `reactivity` is a function of time.

    With `feedback` each unit of temperature takes that much reactivity; the temperature follows power
    above the start and is cooled at the given rate (an extension)."""
    state, t, temperature = equilibrium(), 0.0, 0.0
    out, held, m = [(0.0, 1.0)], None, None
    while t < t_end:
        rho = reactivity(t) - feedback * temperature
        if rho != held:
            held, m = rho, step_matrix(rho, dt)
        temperature += dt * ((state[0] - 1.0) - cooling * temperature)
        state = m @ state
        t += dt
        out.append((t, float(state[0])))
    return out


def simulations(scenarios: DataFrame, t_end: float = 60.0, dt: float = 0.001, stride: int = 100) -> DataFrame:
    """scenario, point, t, power (relative to the start) of each row (scenario, start, end, final,
    feedback), every stride-th point."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for r in part.itertuples():
            points = simulate(lambda t, r=r: ramp_at(t, r.start, r.end, r.final), t_end, dt, r.feedback)[::stride]
            t, n = zip(*points, strict=True)
            frames.append(pd.DataFrame({"scenario": r.scenario, "point": range(len(points)), "t": t, "power": n}))
        return pd.concat(frames)

    return scenarios.groupBy("scenario").applyInPandas(run, "scenario string, point long, t double, power double")
