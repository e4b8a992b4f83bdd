"""All of the engine's own queries with their oracles."""

from __future__ import annotations

from .plans import base, captures, discrete, extra, memory, more, scalar, streams, vectors, writing  # noqa: F401  registering

FLAGSHIP = "L1_recall"
QUERIES = base.QUERIES
ORACLES = base.ORACLES
