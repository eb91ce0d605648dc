"""Excitation kernels as sums of decaying exponentials ``g(t) = sum_k a_k exp(-beta_k t)``.

A kernel is the pair of vectors (a, beta) with unit mass, ``sum(a / beta) = 1``; how strongly events
excite (``n``) is fitted separately. Any user kernel enters as a table of components.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: decay-rate grid of the power-law sum and the rate that takes the missing mass
RATE_LOW, RATE_HIGH = 1e-4, 1e4
COMPONENTS = 60
TAIL_RATE = 1e-5
MASS_TOLERANCE = 1e-12

MAX_COMPONENTS = 10_000


@dataclass(frozen=True)
class Kernel:
    kernel_id: str
    a: tuple[float, ...]
    beta: tuple[float, ...]

    @property
    def mass(self) -> float:
        return float(np.sum(np.asarray(self.a) / np.asarray(self.beta)))


def exponential(beta: float) -> Kernel:
    return Kernel(f"exp({beta:g})", (float(beta),), (float(beta),))


def _rate_mixture(eps: float, c: float, beta: np.ndarray, log_width: float) -> np.ndarray:
    """Weights of the decay rates ``beta`` for the power law ``eps c^eps / (t + c)^(1 + eps)``.

    The power law is the integral over u = ln(beta) of ``exp(-beta t)`` times a Gamma density in ``c beta`` of
    shape ``1 + eps``, times ``eps / c``; each node stands for ``log_width`` of u.
    """
    x = c * beta
    log_density = (1.0 + eps) * np.log(x) - x - math.lgamma(1.0 + eps)
    return eps / c * log_width * np.exp(log_density)


def power_law(eps: float, c: float, components: int = COMPONENTS, *, signed_tail: bool = True) -> Kernel:
    """Power-law decay as ``components`` rates in the middle of log-even cells, brought to unit mass by a slow one.

    ``signed_tail=False`` adds the slow component only when mass is missing, never to take some away.
    """
    cell = math.log(RATE_HIGH / RATE_LOW) / components
    beta = RATE_LOW * np.exp(cell * (np.arange(components) + 0.5))
    a = _rate_mixture(eps, c, beta, 2.0 * math.sinh(cell / 2.0))  # a cell is that wide, in units of its middle
    lack = 1.0 - math.fsum(a / beta)
    parts = list(zip(a.tolist(), beta.tolist()))
    if lack > MASS_TOLERANCE or (signed_tail and lack < -MASS_TOLERANCE):
        parts.append((lack * TAIL_RATE, TAIL_RATE))
    return Kernel(f"pow({eps:g},{c:g})", *zip(*parts))


def fine_power_law(eps: float, c: float, *, step: float = 0.25, slowest: float = 1e-18) -> Kernel:
    """Power-law decay to about 1e-12, by the trapezoid rule in the logarithm of the rate.

    Makes the exact intensity and compensator linear in the number of events instead of quadratic.
    Rates below ``slowest`` are left out: they add nothing over any realistic time span, but the mass
    then falls short of 1 by what only acts after such a span.
    """
    beta = np.exp(np.arange(math.log(slowest), math.log(60.0 / c), step))
    return Kernel(f"fine({eps:g},{c:g})", tuple(_rate_mixture(eps, c, beta, step).tolist()), tuple(beta.tolist()))


def kernel_table(spark: SparkSession, kernels: Sequence[Kernel]) -> DataFrame:
    """``kernel(kernel_id, comp, a, beta)``."""
    rows = [
        (k.kernel_id, i, float(a), float(b))
        for k in kernels
        for i, (a, b) in enumerate(zip(k.a, k.beta))
    ]
    return spark.createDataFrame(rows, "kernel_id string, comp int, a double, beta double")


def kernels_from_table(table: DataFrame, *, tolerance: float = 1e-6) -> list[Kernel]:
    """Kernels from a component table of checked size; a kernel without unit mass is refused."""
    if table.limit(MAX_COMPONENTS + 1).count() > MAX_COMPONENTS:
        raise ValueError(f"a kernel table holds at most {MAX_COMPONENTS} components")
    packed = table.groupBy("kernel_id").agg(
        F.array_sort(F.collect_list(F.struct("comp", "a", "beta"))).alias("c")
    )
    kernels = []
    for row in packed.orderBy("kernel_id").collect():
        k = Kernel(row.kernel_id, tuple(r.a for r in row.c), tuple(r.beta for r in row.c))
        if not abs(k.mass - 1.0) <= tolerance:
            raise ValueError(f"kernel {k.kernel_id} has mass {k.mass}, expected 1")
        kernels.append(k)
    return kernels
