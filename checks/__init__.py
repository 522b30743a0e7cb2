"""The registered queries on the given tables and their SQL counterparts."""

from checks import incidents, models, profiles, tables  # noqa: F401
from checks.registry import REGISTRY

__all__ = ["REGISTRY"]
