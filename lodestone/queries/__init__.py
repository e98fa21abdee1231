"""The operators applied to the driver tables; importing this package fills the catalog."""

from . import identity, measurement, model, models, pipeline_facts, population, random, recorded, source, storage  # noqa: F401
