"""Parameters of training jobs, with the original's defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product


@dataclass(frozen=True)
class Params:
    input: str = ""
    job_name: str = ""
    n_features: int = -1
    n_users: int = -1
    n_items: int = -1
    n_workers_per_node: int = 1
    n_iters: int = 10
    batch_size: int = 100
    alpha: float = 1e-4
    learning_rate: float = 2.0
    lam: float = 1e-4
    beta: float = 0.02
    rank: int = 10
    straggler_probability: float = 0.0
    straggler_percent: float = 100.0
    refresh_rate: int = 5
    scheduler: bool = True
    transient: bool = False
    permanent: bool = False
    prefetch: bool = False
    holdout: bool = False
    test_rows: int = 10_000

    def checked(self, *needed: str) -> Params:
        """Itself; raises where input is empty or a needed size is negative."""
        if not self.input:
            raise ValueError("input is empty")
        for name in needed:
            if getattr(self, name) < 0:
                raise ValueError(f"{name} isn't set")
        return self


def sweep(base: Params, **grid: list) -> list[Params]:
    """A job per combination of the grid's values, each with a name of its own."""
    out = []
    for values in product(*grid.values()):
        chosen = dict(zip(grid, values))
        out.append(replace(base, **chosen, job_name="_".join(f"{k}{v}" for k, v in chosen.items())))
    return out
