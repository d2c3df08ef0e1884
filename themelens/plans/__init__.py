"""Query catalogue: importing this package registers every query and oracle."""

from . import q_clustered, q_derived, q_harvest, q_reports, q_text, q_themes, q_vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
