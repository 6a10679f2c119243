"""Rows of text to the vectors a clustering was built on."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class RowVectors:
    """A model's transforms by column, for single rows; the same numbers as ``standardize``."""

    columns: list[str]
    numeric: dict[str, dict[str, float]]
    categorical: dict[str, list[str]]
    kinds: dict[str, str] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def _number(self, column: str, text: str) -> float | None:
        try:
            x = float(text)
        except ValueError:
            return None
        s, kind = self.numeric[column], self.kinds.get(column, "none")
        if math.isnan(x):
            return None
        if kind == "z" and s["stddev"]:
            x = (x - s["mean"]) / s["stddev"]
        elif kind == "linear" and s["max"] != s["min"]:
            x = (x - s["min"]) / (s["max"] - s["min"])
        elif kind == "log":
            if x <= 0:
                return None
            x = math.log(x)
        return x * self.scales.get(column, 1.0)

    def vector(self, fields: list[str]) -> list[float] | None:
        """None where a number or category is missing; an unseen category is all zeros."""
        out: list[float] = []
        for c, text in zip(self.columns, fields):
            if c in self.numeric:
                x = self._number(c, text)
                if x is None:
                    return None
                out.append(x)
            elif c in self.categorical:
                if text == "":
                    return None
                out += [self.scales.get(c, 1.0) if level == text else 0.0 for level in self.categorical[c]]
        return out

    def sparse(self) -> bool:
        """Whether vectors have more than twice as many places as the row has fields."""
        places = len(self.numeric) + sum(map(len, self.categorical.values()))
        return places > 2 * (len(self.numeric) + len(self.categorical))
