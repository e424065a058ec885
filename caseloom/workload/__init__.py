"""All named queries; importing the modules registers them."""

from caseloom.workload import (  # noqa: F401
    case_queries,
    catalog_queries,
    log_queries,
    match_queries,
    page_queries,
    stream_queries,
    text_queries,
)
from caseloom.workload.registry import ORACLES, QUERIES  # noqa: F401
