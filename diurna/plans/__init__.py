"""Named queries over the driver tables, wired from the operators."""

from .registry import REGISTRY, Entry, register  # noqa: F401


def load_all():
    """Import every query module so the registry is complete."""
    from . import q_audit, q_io, q_ml, q_models, q_profile, q_rollup  # noqa: F401
    return REGISTRY
