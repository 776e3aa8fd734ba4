"""The usual order of preprocessing, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..frames import Stack
from ..operators import pixelwise as P


@dataclass
class Preprocessing:
    """Cut, Raman units, inner filter effect, median, Raman band, Rayleigh bands, Gaussian; what is None is left out.

    The order matters: fills read pixels that were filtered before.
    """

    cut: tuple[float, float, float, float] | None = None
    raman_units: dict | None = None
    absorbance: DataFrame | None = None
    absorbance_axis: Sequence[float] = ()
    median: tuple[int, int] | None = None
    raman: dict | None = None
    rayleigh: dict | None = None
    gaussian: dict | None = None
    steps: list[str] = field(default_factory=list, init=False)

    def __call__(self, stack: Stack) -> Stack:
        plan = [
            ("cut", self.cut, lambda s: P.cutting(s, *self.cut)),
            ("raman_units", self.raman_units, lambda s: P.raman_normalization(s, **self.raman_units)),
            ("absorbance", self.absorbance, lambda s: P.ife_correction(s, self.absorbance, self.absorbance_axis)),
            ("median", self.median, lambda s: P.median_filter(s, self.median)),
            ("raman", self.raman, lambda s: P.raman_scattering_removal(s, **self.raman)),
            ("rayleigh", self.rayleigh, lambda s: P.rayleigh_scattering_removal(s, **self.rayleigh)),
            ("gaussian", self.gaussian, lambda s: P.gaussian_filter(s, **self.gaussian)),
        ]
        self.steps = [name for name, asked, _ in plan if asked is not None]
        for _, asked, step in plan:
            if asked is not None:
                stack = step(stack)
        return stack
