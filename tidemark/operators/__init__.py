"""All operators by name, as used by the fluent ``TemporalFrame``."""

from __future__ import annotations

import inspect

from tidemark.operators import aggregate, group, join, lifetime, pattern, ranked, relational, sequence, signal

MODULES = (lifetime, aggregate, join, relational, group, signal, pattern, sequence)
REGISTRY = {name: f for module in MODULES for name, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and not name.startswith("_")}
REGISTRY["snapshot_ranked"] = ranked.snapshot_ranked
