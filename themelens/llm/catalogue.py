"""Importing this module registers the queries of every operator here."""

from . import (  # noqa: F401
    licenses, lines, minhash, packing, pieces, pii, quality, simhash, spelling, substrings, token_files, topk, whitening,
)
from .common import ORACLES, QUERIES  # noqa: F401
