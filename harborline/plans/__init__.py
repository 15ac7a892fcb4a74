from harborline.plans import (  # noqa: F401
    encryption,
    expressions,
    governance,
    lake,
    relational,
    sources,
    streams,
    telemetry,
)
from harborline.plans.registry import QUERIES

__all__ = ["QUERIES"]
