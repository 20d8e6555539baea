"""Parameters of candidate generation and matching, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass

RECALL_KS = (1, 2, 3, 5, 8, 10, 15, 20, 30, 50, 75, 100, 150, 200)
BAND_EDGES = (0.0, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.5, 10.0)
CUTOFFS = (0.6, 0.8, 1.0, 1.2, 1.4, 1.6)
MISSES = 5000


@dataclass(frozen=True)
class BlockParams:
    k: int = 15
    k_both: int = 10
    k_noaddr: int = 5
    k_group: tuple[int, int, int, int] = (5, 10, 10, 15)
    max_df: int = 100_000
    max_df_trig: int = 20_000
    alpha: tuple[float, ...] = (1.0, 0.5, 0.5, 1.0, 0.3, 0.5)
    tau: float = 1.6
    val_only: bool = False
    val_mod: int = 10
    limit: int | None = None


@dataclass(frozen=True)
class MatchParams:
    gate: float = 1.4
    cap_name: int = 14
    cap_addr: int = 20
    rounds: int = 60
    step: float = 0.05
    depth: int = 5
    min_leaf: int = 20
    subsample: float = 0.8
    feature_share: str = "0.9"
    seed: int = 7


def sweep(first: float, last: float, step: float) -> list[float]:
    """first, first + step, ... up to last, with two decimals."""
    return [round(first + i * step, 10) for i in range(int(round((last - first) / step)) + 1)]


NAIVE_TAUS = sweep(0.6, 3.0, 0.08)
MODEL_TAUS = sweep(0.02, 0.98, 0.01)
BASELINE_TAUS = sweep(0.5, 4.0, 0.02)
DEFAULT_TAUS = sweep(0.05, 0.95, 0.01)
