"""Operators for training data at scale. ``QUERIES`` and ``ORACLES`` are as in ``docloom.plans``."""

from docloom.llm import decontam, fim, idfile, jaccard, knn, licenses, lines, merkle, packing, quality, sharding, toxicity, warc

MODULES = (sharding, warc, lines, licenses, jaccard, quality, decontam, idfile, knn, packing, toxicity, merkle, fim)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
