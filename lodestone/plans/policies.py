"""Policies of measurement, assurance, search and orchestration, checked before anything runs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


class PolicyError(ValueError):
    pass


def _need(condition: bool, name: str) -> None:
    if not condition:
        raise PolicyError(name)


@dataclass(frozen=True)
class WorkloadPolicy:
    workload_id: str
    warmups: int
    repetitions: int
    minimum_included: int
    weight: float = 1.0
    tolerance_ppm: int = 20_000
    minimum_improvement_ppm: int = 50_000
    max_range_ppm: int = 100_000
    outlier_deviation: int | None = None


@dataclass(frozen=True)
class MeasurementPolicy:
    workloads: tuple[WorkloadPolicy, ...]
    max_workloads: int
    max_samples: int
    condition: dict[str, str] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def validate(self) -> int:
        """The number of samples a plan takes; unique workloads, finite weights, everything within the budgets."""
        _need(0 < len(self.workloads) <= self.max_workloads, "workloads")
        _need(all(self.condition.values()), "condition")
        _need(all(math.isfinite(w) and w >= 0 for w in self.weights.values()), "weights")
        for w in self.workloads:
            _need(bool(w.workload_id) and w.warmups >= 0 and w.repetitions >= 1 and 1 <= w.minimum_included <= w.repetitions, "workload")
            _need(math.isfinite(w.weight) and w.weight > 0 and (w.outlier_deviation is None or w.outlier_deviation >= 0), "workload")
        _need(len({w.workload_id for w in self.workloads}) == len(self.workloads), "duplicate workload")
        samples = sum(2 * (w.warmups + w.repetitions) for w in self.workloads)
        _need(samples <= self.max_samples, "samples")
        return samples


@dataclass(frozen=True)
class Gate:
    gate_id: str
    profile_id: str
    stage: str = "fast"
    required: bool = True


@dataclass(frozen=True)
class AssurancePolicy:
    gates: tuple[Gate, ...]
    required_profiles: tuple[str, ...]

    def validate(self) -> None:
        """Unique gates of known stages; every required profile has a required gate."""
        _need(bool(self.gates) and all(g.gate_id and g.stage in ("fast", "finalist") for g in self.gates), "gates")
        _need(len({g.gate_id for g in self.gates}) == len(self.gates), "duplicate gate")
        covered = {g.profile_id for g in self.gates if g.required}
        for p in self.required_profiles:
            _need(p in covered, f"profile {p}")


@dataclass(frozen=True)
class SearchPolicy:
    population: int
    generations: int
    max_operations: int
    max_records: int
    repair_passes: int
    initial_operations: int
    enabled_mutations: tuple[str, ...]

    def validate(self) -> None:
        _need(self.population >= 1 and self.generations >= 0, "population")
        _need(1 <= self.max_operations and 1 <= self.repair_passes, "bounds")
        _need(0 <= self.initial_operations <= self.max_records, "initial operations")
        _need(bool(self.enabled_mutations) and set(self.enabled_mutations) <= {"add", "remove", "parameterize", "replace", "reorder"}, "mutations")


@dataclass(frozen=True)
class OrchestrationPolicy:
    identity: str
    workers: int
    candidates: tuple[int, ...]
    cpu_ms: int
    memory_bytes: int

    def validate(self) -> None:
        """Bounds above zero, candidates in ascending population order without repeats."""
        _need(bool(self.identity) and self.workers >= 1 and self.cpu_ms > 0 and self.memory_bytes > 0, "resources")
        _need(bool(self.candidates) and all(a < b for a, b in zip(self.candidates, self.candidates[1:])), "candidate order")
