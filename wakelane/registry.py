"""All queries of the engine over the given tables, with the SQL that must agree."""

from __future__ import annotations

from importlib import import_module

#: Modules of wakelane.plans, each with QUERIES (name -> (spark, sf_dir) -> DataFrame) and ORACLES (name -> SQL).
PLANS = ("signals", "tables", "learning", "statistics", "domains", "models")
FLAGSHIP = "c12_time_freq_features"

QUERIES, ORACLES = {}, {}
for _plan in PLANS:
    _module = import_module(f"wakelane.plans.{_plan}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
