"""Settings of runs, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

from ..plans.rules import TYPES


@dataclass(frozen=True)
class ExtractionConfig:
    """least_confidence: fields below it get a warning. as_of: the day against which dates are judged."""

    as_of: str
    least_confidence: float = 55.0
    language: str = "por+eng"
    on_error: str = "fail"

    def __post_init__(self) -> None:
        if not 0 <= self.least_confidence <= 100:
            raise ValueError("least_confidence must be from 0 to 100")
        if self.on_error not in ("fail", "collect"):
            raise ValueError("on_error must be fail or collect")


@dataclass(frozen=True)
class AugmentationConfig:
    seed: int = 42
    total_factor: int = 1
    classes: tuple[str, ...] = TYPES
    copy_originals: bool = True
    overwrite: bool = False
    jpeg_quality: int = 92
    most_documents: int | None = None
    extensions: tuple[str, ...] = ("jpg", "jpeg", "png")
    least_box: float = 2.0

    def __post_init__(self) -> None:
        if self.total_factor < 1:
            raise ValueError("total_factor must be at least 1")
        if not 40 <= self.jpeg_quality <= 100:
            raise ValueError("jpeg_quality must be from 40 to 100")
        if self.most_documents is not None and self.most_documents < 1:
            raise ValueError("most_documents must be at least 1")
        object.__setattr__(self, "extensions", tuple(x.lower().lstrip(".") for x in self.extensions))

    @property
    def variants(self) -> int:
        """Variants of each document; with originals they are total_factor times as many images more."""
        return self.total_factor
