"""All queries of the library by name."""

from __future__ import annotations

from loomscribe.plans import base, corpus, exchange, learning, more, stats, streams  # noqa: F401

QUERIES = base.QUERIES
ORACLE = base.ORACLE
FLAGSHIP = corpus.f12_drop_cascade
