"""Settings with their defaults, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class RecommenderSettings:
    features: int = 30
    lambda_: float = 0.1
    alpha: float = 1.0
    max_iterations: int = 30
    convergence_threshold: float = 0.001
    reconstruct_r: bool = False
    loss_ignores_unspecified: bool = False
    decay_factor: float = 1.0
    decay_zero_threshold: float = 0.0
    how_many: int = 10
    lsh_sample_ratio: float = 1.0
    lsh_hashes: int = 20
    known_items: bool = True


@dataclass(frozen=True)
class ClusterSettings:
    ks: tuple[int, ...] = (2, 5, 10)
    replications: int = 3
    folds: int = 2
    sketch_iterations: int = 5
    sketch_points: int = 100
    init: str = "plus_plus"
    update: str = "minibatch"
    minibatch_size: int = 100
    iterations: int = 100
    evaluate: str = "threshold"
    threshold: float = 0.5
    fixed_k: int | None = None
    seed: int = 1729


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 20
    feature_fraction: float = 0.5
    min_node_size: int = 2
    min_gain_nats: float = 0.0001
    sample_rate: float = 1.0
    max_split_candidates: int = 8
    max_depth: int = 64
    seed: int = 1729


@dataclass(frozen=True)
class GenerationSettings:
    keep: int = 10
    time_threshold_minutes: int = -1
    data_threshold_mb: int = -1


@dataclass(frozen=True)
class InboundSettings:
    """Column roles: ids and ignored columns leave both typed sets.

    Exactly one of ``numeric`` and ``categorical`` is given; the other is what
    remains.  Columns may be named or numbered.
    """

    columns: tuple[str, ...]
    numeric: tuple = None  # type: ignore[assignment]
    categorical: tuple = None  # type: ignore[assignment]
    ids: tuple = ()
    ignored: tuple = ()
    target: Any = None
    delimiter: str = ","
    roles: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if (self.numeric is None) == (self.categorical is None):
            raise ValueError("give either numeric or categorical columns")
        named = lambda cs: [self.name(c) for c in cs]
        out = set(named(self.ids)) | set(named(self.ignored))
        given = set(named(self.numeric if self.numeric is not None else self.categorical)) - out
        rest = [c for c in self.columns if c not in given and c not in out]
        mine = [c for c in self.columns if c in given]
        numeric, categorical = (mine, rest) if self.numeric is not None else (rest, mine)
        self.roles.update(numeric=numeric, categorical=categorical, ids=named(self.ids), ignored=sorted(out, key=self.columns.index), target=None if self.target is None else self.name(self.target))

    def name(self, column: int | str) -> str:
        return self.columns[column] if isinstance(column, int) else column


def overlay(defaults: Any, changes: dict[str, Any]) -> Any:
    """The defaults with a user's changes; unknown names are errors."""
    known = {f.name for f in fields(defaults)}
    if extra := set(changes) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return replace(defaults, **changes)
