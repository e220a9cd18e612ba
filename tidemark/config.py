"""Settings of the pipeline."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field
from pathlib import Path

def setup_logging(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The engine's log, on the console and, if a path is given, in that file; calling it again adds nothing."""
    log = logging.getLogger("tidemark")
    log.setLevel(level)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    held = {type(h) for h in log.handlers}
    for handler in [logging.StreamHandler()] + ([logging.FileHandler(path, delay=True)] if path else []):
        if type(handler) not in held:
            handler.setFormatter(form)
            log.addHandler(handler)
    return log


# Weights of the seven dimensions, and thresholds.
WEIGHTS = {"intensity": 0.15, "semantic": 0.20, "diversity": 0.15, "sentiment": 0.15, "maturity": 0.15, "future": 0.10, "commitment": 0.10}
# An older name of a setting in saved files.
LEGACY = {"fortune500_csv": "company_metadata_csv"}


@dataclass(frozen=True)
class Config:
    input_folder: str = "input_pdfs"
    output_folder: str = "RESULT"
    company_metadata_csv: str | None = None
    filter_traditional_robotics: bool = True
    filter_traditional_rpa: bool = True
    semantic_threshold: float = 0.60
    semantic_strict_threshold: float = 0.68
    deduplication_threshold: float = 0.85
    min_text_length: int = 100
    sentences_around: int = 2
    max_context: int = 2000
    window: int = 2000
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    def __post_init__(self) -> None:
        if set(self.weights) != set(WEIGHTS) or abs(sum(self.weights.values()) - 1) > 1e-6:
            raise ValueError("the seven weights must sum to 1")

    def save(self, path: str) -> None:
        """Writes the settings as JSON."""
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> Config | None:
        """The saved settings, under these names or an older one; None where the file is missing or invalid, unknown names are
        ignored."""
        try:
            held = json.loads(Path(path).read_text())
            known = {k: v for k, v in held.items() if k in cls.__dataclass_fields__}
            return cls(**{new: held[old] for old, new in LEGACY.items() if old in held and new not in held} | known)
        except (OSError, ValueError, TypeError, AttributeError):
            return None
