"""Tables that the library works on, and its options."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

POINTS = "id long, x double, y double, z double"
FACES = "f long, a long, b long, c long"
EDGES = "i long, j long"
COO = "i long, j long, v double"
VECTOR = "i long, col int, v double"
WEIGHTS = "i long, j long, w double"
TIMING = "experiment string, metric string, value double"
CONVERGENCE = "solve_id string, iter int, ms double, residue double"


class Sampling(Enum):
    FASTDISK = "fastdisk"
    MIS = "mis"
    POISSONDISK = "poissondisk"
    FPS = "fps"
    RANDOM = "random"


class Weighting(Enum):
    BARYCENTRIC = "barycentric"
    UNIFORM = "uniform"
    INVDIST = "invdist"


class Hierarchy(Enum):
    OURS = "ours"
    SIG06 = "sig06"
    ABLATION = "ablation"
    DECIMATION = "decimation"


@dataclass(frozen=True)
class Options:
    """Options of a hierarchy and of a solve, with the customary defaults."""

    ratio: float = 8.0
    lower_bound: int = 1000
    most_levels: int = 10
    sampling: Sampling = Sampling.FASTDISK
    sample_order: str = "id"  # or "hashed": fast disks and independent sets in few rounds
    weighting: Weighting = Weighting.BARYCENTRIC
    hierarchy: Hierarchy = Hierarchy.OURS
    check_voronoi: bool = True
    nested: bool = False
    compat_truncate: bool = False
    ablation_points: int = 3
    ablation_random: bool = False
    decimation_ratio: float = 0.25
    decimation_coarsest: int = 500
    cycle: str = "V"
    pre: int = 2
    post: int = 2
    max_iter: int = 100
    tolerance: float = 1e-4
    criterion: int = 2
    omega: float = 2.0 / 3.0
    smoother: str = "jacobi"  # or "colored": Gauss-Seidel by colors
    seed: int = 42
