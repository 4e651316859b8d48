"""Defaults of a process, and names of one's own for matrices."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from .plans import kernels
from .schema import WrongInput


@dataclass
class Settings:
    """method: "inverse", "solve" or "auto"; dense_labels: labels up to which one task holds a square; names: own name -> matrix."""

    method: str = "inverse"
    dense_labels: int = kernels.DENSE_LABELS
    names: dict[str, str] = field(default_factory=dict)

    def matrix(self, name: str) -> str:
        """The matrix that a name stands for."""
        return self.names.get(name, name)


current = Settings()


def set_method(method: str) -> None:
    if method not in ("inverse", "solve", "auto"):
        raise WrongInput(f"no method is called {method!r}")
    current.method = method


def set_dense_labels(labels: int) -> None:
    """Squares of more labels are inverted and solved on tiles."""
    if labels < 1:
        raise WrongInput("at least one label")
    current.dense_labels = kernels.DENSE_LABELS = labels


def set_names(names: Mapping[str, str]) -> None:
    """Names of one's own; each must stand for one matrix and none may hide another matrix."""
    if len(set(names.values())) < len(names):
        raise WrongInput("names must stand for one matrix each")
    current.names = dict(names)


def reset() -> None:
    fresh = Settings(dense_labels=4_000)
    current.method, current.names = fresh.method, {}
    set_dense_labels(fresh.dense_labels)
