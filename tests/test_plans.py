"""Ordered checks of command requests and policies."""

import pytest

from lodestone.plans import command as c
from lodestone.plans import policies as p


def request(**change):
    base = {"operation": "evolve", "output_path": "o", "manifest_path": "m", "manifest_valid": True, "input_path": "i", "evidence_path": "e", "provider_policy": "p", "providers": tuple(c.Provider(r, f"{r}-1", 1, mask) for r, mask in c.PROVIDERS.items())}
    return c.Request(**(base | change))


@pytest.mark.parametrize(
    "change, status",
    [
        ({}, "success"),
        ({"schema_version": 2, "operation": "x"}, "schema"),
        ({"operation": "x"}, "operation"),
        ({"output_path": ""}, "path"),
        ({"manifest_valid": False}, "manifest"),
        ({"overwrite_output": True}, "output-policy"),
        ({"resume": True}, "checkpoint"),
        ({"checkpoint_path": "k"}, "checkpoint"),
        ({"operation": "replay"}, "replay-identity"),
        ({"provider_policy": None}, "provider-policy"),
        ({"providers": ()}, "provider-identity"),
        ({"providers": tuple(c.Provider(r, "x", 1, m, False) for r, m in c.PROVIDERS.items())}, "provider-unavailable"),
        ({"providers": tuple(c.Provider(r, "x", 1, c.Capability.SYNTAX_TREES) for r in c.PROVIDERS)}, "provider-capability"),
    ],
)
def test_command_status(change, status):
    assert c.plan(request(**change))[0] == status


def test_measurement_policy():
    w = p.WorkloadPolicy("a", 2, 5, 3)
    assert p.MeasurementPolicy((w,), 4, 14).validate() == 14
    for bad in (p.MeasurementPolicy((w, w), 4, 99), p.MeasurementPolicy((w,), 4, 13), p.MeasurementPolicy((), 4, 13)):
        with pytest.raises(p.PolicyError):
            bad.validate()


def test_other_policies():
    p.AssurancePolicy((p.Gate("g", "x"),), ("x",)).validate()
    p.SearchPolicy(4, 2, 3, 5, 4, 2, ("add",)).validate()
    p.OrchestrationPolicy("o", 2, (1, 2), 5, 5).validate()
    for bad in (p.AssurancePolicy((p.Gate("g", "x", required=False),), ("x",)), p.SearchPolicy(4, 2, 3, 1, 4, 2, ("add",)), p.OrchestrationPolicy("o", 2, (2, 1), 5, 5)):
        with pytest.raises(p.PolicyError):
            bad.validate()
