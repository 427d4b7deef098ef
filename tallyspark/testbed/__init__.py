"""Projects the TPC-H-like test tables onto telemetry tables and registers every query."""

from importlib import import_module

MODULES = ("q_ledger", "q_waste", "q_simulate", "q_outcomes", "q_causal", "q_fleet", "q_sources", "q_streaming")


def registered():
    """The registry with every query module loaded."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
