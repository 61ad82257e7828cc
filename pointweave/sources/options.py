"""Parameters from ``key : value`` files and command-line flags, checked all together."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


def read_config(text: str) -> dict[str, str]:
    """``key : value`` lines; # starts a comment, white space is ignored, lines of another shape are skipped."""
    out = {}
    for line in text.splitlines():
        parts = ["".join(p.split()) for p in line.partition("#")[0].split(":")]
        parts = [p for p in parts if p]
        if len(parts) == 2:
            out[parts[0]] = parts[1]
    return out


def read_flags(words: Iterable[str]) -> dict[str, str]:
    """``-k v`` and ``--key v``; a flag without a value means 1. A negative number is a value."""
    out: dict[str, str] = {}
    key = None
    for word in words:
        if word.startswith("-") and not word[1:2].isdigit() and word.strip("-"):
            key = word.lstrip("-")
            out[key] = "1"
        elif key is not None:
            out[key], key = word, None
    return out


@dataclass(frozen=True)
class CodingOptions:
    step: float = 1.0
    qp: int = 0
    slices: int = 1
    layers: int = 0
    reach: int = 128
    before: int = 0
    smallest: int = 0

    def __post_init__(self):
        bounds = {"qp": (0, 63), "slices": (1, 1 << 20), "layers": (0, 64), "reach": (1, 1 << 16), "before": (0, 21), "smallest": (0, 21)}
        faults = [f"{k} is not between {a} and {b}" for k, (a, b) in bounds.items() if not a <= getattr(self, k) <= b]
        if not self.step > 0:
            faults.insert(0, "step is not positive")
        if faults:
            raise ValueError("; ".join(faults))

    @classmethod
    def read(cls, text: str = "", words: Iterable[str] = ()) -> CodingOptions:
        """Flags go before the file; unknown keys are warned of and ignored."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        given = read_config(text) | read_flags(words)
        for key in sorted(set(given) - set(kinds)):
            warnings.warn(f"unknown parameter {key}", stacklevel=2)
        return cls(**{k: kinds[k](v) for k, v in given.items() if k in kinds})


def measurable(points: DataFrame) -> set[str]:
    """Which distortions a cloud allows: geometry always, color and reflectance if it has their columns. Raises without coordinates or rows."""
    missing = [c for c in "xyz" if c not in points.columns]
    if missing:
        raise ValueError(f"a cloud needs the columns {missing}")
    if points.isEmpty():
        raise ValueError("a cloud needs points")
    have = set(points.columns)
    return {"geometry"} | ({"color"} if {"r", "g", "b"} <= have else set()) | ({"reflectance"} if "refl" in have else set())
