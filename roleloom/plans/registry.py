"""All registered queries: importing this module loads every plan module."""

from . import q_alerts, q_dates, q_enrich, q_lifecycle, q_matching, q_resolution, q_search, q_sources, q_streams, q_text  # noqa: F401
from .core import ORACLES, QUERIES, Tables, register  # noqa: F401
