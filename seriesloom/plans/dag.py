"""The plan of a run: models by family, jobs and their order."""

from __future__ import annotations

from dataclasses import dataclass

from ..models import registered
from .config import RunConfig


@dataclass(frozen=True)
class FamilyJob:
    family: str
    models: tuple[str, ...]


@dataclass(frozen=True)
class RunDag:
    jobs: tuple[FamilyJob, ...]
    ensemble: bool

    @property
    def families(self) -> list[str]:
        return [j.family for j in self.jobs]

    def nodes(self) -> list[tuple[str, tuple[str, ...]]]:
        """(node, what it waits for); the ensemble waits for all families."""
        out = [(f, ()) for f in self.families]
        return [*out, ("ensemble", tuple(self.families))] if self.ensemble else out


def by_runtime(cfg: RunConfig) -> tuple[list[str], list[str]]:
    """(python models, native models)."""
    native = [m for m in cfg.models if registered()[m].family == "native"]
    return [m for m in cfg.models if m not in native], native


def plan_dag(cfg: RunConfig) -> RunDag:
    groups: dict[str, list[str]] = {}
    for m in cfg.models:
        if m not in registered():
            from ..errors import ConfigError

            raise ConfigError(f"no model {m!r}")
        groups.setdefault(registered()[m].family, []).append(m)
    return RunDag(tuple(FamilyJob(f, tuple(ms)) for f, ms in groups.items()), cfg.ensemble.enabled)


def combined_status(outcomes: dict[str, str]) -> str:
    """COMPLETED if all are, FAILED if all are, else PARTIAL."""
    found = set(outcomes.values())
    return found.pop() if len(found) == 1 else "PARTIAL"
