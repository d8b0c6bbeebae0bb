"""Parameters of a clustering run."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BORDER_MODES = ("standard", "visit_order")
MERGES = ("auto", "distributed", "driver")


@dataclass(frozen=True)
class Params:
    """Radius, density and grid of a run.

    Distances are compared in single precision's terms: the radius is a 32-bit number,
    its square is rounded to 32 bits, and both are then used as doubles.

    ``border_mode`` says which cluster a border point joins: ``standard`` the one whose
    smallest core id is least; ``visit_order`` the one a sequential scan in id order
    would give it, which can also be none. ``merge`` says where components are found: in
    DataFrames (``distributed``), by a union-find on the ``driver``, which refuses more edges
    than it has room for, or (``auto``) there if the edges, counted first, are few.
    """

    eps: float = 0.03
    min_pts: int = 50
    cell_factor: float = 3.0
    buffer_factor: float = 1.0
    border_mode: str = "standard"
    merge: str = "auto"

    def __post_init__(self) -> None:
        if not (np.isfinite(self.eps) and self.eps32 > 0):
            raise ValueError("eps is a positive number")
        if int(self.min_pts) != self.min_pts or self.min_pts < 1:
            raise ValueError("min_pts is a whole number from 1 on")
        if not self.cell_factor >= self.buffer_factor >= 1:
            raise ValueError("cell_factor >= buffer_factor >= 1: only adjacent cells hold copies, and a copy's neighbourhood must be whole")
        if self.border_mode not in BORDER_MODES:
            raise ValueError(f"border_mode is one of {BORDER_MODES}")
        if self.merge not in MERGES:
            raise ValueError(f"merge is one of {MERGES}")

    @property
    def eps32(self) -> float:
        return float(np.float32(self.eps))

    @property
    def eps2(self) -> float:
        """The squared radius."""
        e = np.float32(self.eps)
        return float(np.float32(e * e))

    @property
    def cell_size(self) -> float:
        return float(np.float32(np.float32(self.eps) * np.float32(self.cell_factor)))

    @property
    def buffer(self) -> float:
        return float(np.float32(np.float32(self.eps) * np.float32(self.buffer_factor)))
