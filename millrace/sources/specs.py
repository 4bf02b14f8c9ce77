"""Source specifications: DATASET[::CONFIG[::SPLIT[::FIELD]]], mixtures of paths, run replays."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Source:
    """A dataset, optionally a configuration of it, a split and the field that holds the text."""

    dataset: str
    config: str | None = None
    split: str = "train"
    text_field: str = "text"

    @property
    def label(self) -> str:
        return f"{self.dataset}::{self.config}" if self.config else self.dataset


def parse_source(text: str) -> Source:
    """One to four parts; an empty part takes its default; an empty dataset or a fifth part is an error."""
    parts = text.split("::")
    if not parts[0].strip() or len(parts) > 4:
        raise ValueError(f"no source: {text!r}")
    dataset, config, split, field = (parts + [""] * 3)[:4]
    return Source(dataset, config or None, split or "train", field or "text")


def resolve_sources(specs: list[str] | None, default: str) -> list[Source]:
    return [parse_source(s) for s in (specs or [default])]


def weights_and_paths(items: list[str]) -> tuple[list[float] | None, list[str]]:
    """A single path, or weights and paths in turn."""
    if len(items) == 1:
        return None, list(items)
    if len(items) % 2:
        raise ValueError("weights and paths must alternate")
    return [float(w) for w in items[::2]], [p.strip() for p in items[1::2]]


def replay(recorded: dict, overrides: dict) -> dict:
    """A run's recorded settings with the given ones laid over; each source reads with its own seed, seed + index.

    A run over JSON lines needs a separate evaluation file.
    """
    out = recorded | {k: v for k, v in overrides.items() if v is not None}
    if out.get("jsonl") and not overrides.get("jsonl"):
        raise ValueError("a run over JSON lines needs a separate evaluation file")
    return out | {"seeds": [out.get("seed", 0) + i for i in range(len(out.get("sources", [])))]}
