"""Settings of chunk algorithms: frozen dataclasses made from mappings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import MISSING, dataclass, fields
from typing import Any, TypeVar

import numpy as np

T = TypeVar("T")


def settings(kind: type[T], values: Mapping[str, Any]) -> T:
    """``kind(**values)``; unknown and missing keys are an error that names them."""
    known = {f.name: f for f in fields(kind)}
    unknown = sorted(set(values) - set(known))
    missing = sorted(n for n, f in known.items() if n not in values and f.default is MISSING and f.default_factory is MISSING)
    if unknown or missing:
        raise ValueError("; ".join(f"{what} keys: {', '.join(names)}" for what, names in (("unknown", unknown), ("missing", missing)) if names))
    return kind(**values)


@dataclass(frozen=True)
class Threshold:
    """A callable for ``arrays.segment``: voxels above ``level`` get ``label``."""

    level: int
    label: int = 1

    def __call__(self, image: np.ndarray) -> np.ndarray:
        return np.where(image > self.level, self.label, 0).astype(np.uint32)
