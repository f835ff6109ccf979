"""All registered queries; importing a module adds its queries to the registry."""

from docmill.workload import (  # noqa: F401
    chunking,
    files_and_streams,
    filtering,
    flows,
    indexes,
    indexing,
    retrieval,
    scrutiny,
    textual,
)
from docmill.workload.registry import ORACLES, QUERIES  # noqa: F401
