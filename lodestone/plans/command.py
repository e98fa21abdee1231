"""Command plans: the fixed commands, the providers they need, and the ordered checks of a request."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Flag, auto

from pyspark.sql import DataFrame, SparkSession


# The capabilities, commands, roles and what each needs.
class Capability(Flag):
    SYNTAX_TREES = auto()
    COMPILATION_DATABASE = auto()
    DIRECT_ARGUMENTS = auto()
    FILESYSTEM_ISOLATION = auto()
    NETWORK_ISOLATION = auto()
    DESCENDANT_CLEANUP = auto()
    RESOURCE_LIMITS = auto()
    ASYNC_JOBS = auto()


_ISOLATED = Capability.DIRECT_ARGUMENTS | Capability.FILESYSTEM_ISOLATION | Capability.NETWORK_ISOLATION | Capability.DESCENDANT_CLEANUP
_EXECUTION = _ISOLATED | Capability.RESOURCE_LIMITS


@dataclass(frozen=True)
class Command:
    name: str
    requires_manifest: bool
    requires_input: bool
    requires_evidence: bool
    allows_checkpoint: bool


COMMANDS = {
    "analyze": Command("analyze", True, True, False, False),
    "evolve": Command("evolve", True, True, True, True),
    "replay": Command("replay", True, True, True, True),
    "report": Command("report", False, False, True, False),
}
#: Role -> what its provider must be able to do.
PROVIDERS = {
    "analysis": Capability.SYNTAX_TREES | Capability.COMPILATION_DATABASE | _ISOLATED,
    "syntax-tree": Capability.SYNTAX_TREES | _ISOLATED,
    "execution": _EXECUTION,
    "evaluation": _EXECUTION | Capability.SYNTAX_TREES | Capability.COMPILATION_DATABASE | Capability.ASYNC_JOBS,
}
NEEDS = {"analyze": ("analysis", "execution"), "evolve": ("analysis", "syntax-tree", "execution", "evaluation"), "replay": ("analysis", "syntax-tree", "execution", "evaluation"), "report": ()}


@dataclass(frozen=True)
class Provider:
    role: str
    identity: str
    version: int
    capabilities: Capability
    available: bool = True


@dataclass(frozen=True)
class Request:
    operation: str
    output_path: str
    manifest_path: str | None = None
    manifest_valid: bool = False
    input_path: str | None = None
    evidence_path: str | None = None
    overwrite_output: bool = False
    resume: bool = False
    checkpoint_path: str | None = None
    replay_identity: str | None = None
    provider_policy: str | None = None
    providers: tuple[Provider, ...] = field(default=())
    schema_version: int = 1


def _path(p: str | None) -> bool:
    return bool(p) and "\0" not in p and len(p.encode()) <= 4096


def plan(request: Request) -> tuple[str, dict | None]:
    """(status, plan): the first check that fails names the status; 'success' has the immutable plan."""
    if request.schema_version != 1:
        return "schema", None
    command = COMMANDS.get(request.operation)
    if command is None:
        return "operation", None
    if not _path(request.output_path):
        return "path", None
    if command.requires_manifest:
        if not _path(request.manifest_path):
            return "path", None
        if not request.manifest_valid:
            return "manifest", None
    if command.requires_input and not _path(request.input_path):
        return "path", None
    if command.requires_evidence and not _path(request.evidence_path):
        return "path", None
    if request.overwrite_output:
        return "output-policy", None
    if request.resume:
        if not command.allows_checkpoint or not _path(request.checkpoint_path):
            return "checkpoint", None
    elif request.checkpoint_path:
        return "checkpoint", None
    if command.name == "replay" and not request.replay_identity:
        return "replay-identity", None
    chosen = {}
    for role in NEEDS[command.name]:
        if not request.provider_policy:
            return "provider-policy", None
        found = next((p for p in request.providers if p.role == role), None)
        if found is None or not found.identity or found.version != 1:
            return "provider-identity", None
        if not found.available:
            return "provider-unavailable", None
        if found.capabilities & PROVIDERS[role] != PROVIDERS[role]:
            return "provider-capability", None
        chosen[role] = found.identity
    paths = {k: getattr(request, f"{k}_path") for k in ("manifest", "input", "evidence", "output", "checkpoint")}
    return "success", {"operation": command.name, "providers": chosen, "resume": request.resume, **paths}


def registry(spark: SparkSession) -> DataFrame:
    """The provider roles and their capability masks as rows."""
    return spark.createDataFrame([(role, mask.value) for role, mask in PROVIDERS.items()], "role string, capabilities long")
