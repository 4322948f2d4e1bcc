"""What __spark_entry__ registers of this folder."""

from __future__ import annotations

from keelson.llm import oracles, queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op")}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
