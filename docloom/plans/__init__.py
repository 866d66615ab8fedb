"""Named queries over the supplied tables, each with the DuckDB SQL that must give the same rows.

Every query reads whole tables. ``QUERIES`` maps a name to ``(spark, folder) -> DataFrame``; ``ORACLES``
maps it to SQL.
"""

from docloom.plans import files, grid, grouping, ingest, markup, relational, search, services, streams

MODULES = (relational, search, markup, services, grouping, ingest, grid, files, streams)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
