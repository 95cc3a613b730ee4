"""Text-attributed graph analytics expressed with Spark DataFrames.

The names in _HOME are the public interface. They load on first use, so that workers which need one module import only that one.
"""

import importlib

__version__ = "0.2.0"

_HOME = {
    "datasets": ("load_many", "load_parts", "normalise_records", "validate"),
    "hooks": ("BIASES", "GENERATORS", "METRICS", "TEXT_MAPPINGS", "compute_labels", "evaluate", "map_batches", "map_rows"),
    "positions": ("global_index", "running_sum"),
    "probes": ("probe_examples", "probe_graphs"),
    "prose": ("prose_graphs",),
    "relational": ("Catalog", "TableSpec", "allocate", "candidate_order", "drop_orphans", "fkey_edges", "reachable", "temporal_neighbours"),
    "structure": ("k_hop_pairs", "laplacian_features", "magnetic_features", "random_walk", "shortest_paths"),
    "textgraph": ("TextGraphs",),
}
_MODULES = {name: module for module, names in _HOME.items() for name in names}
__all__ = sorted(_MODULES)  # noqa: PLE0605


def __getattr__(name: str):
    if name in _MODULES:
        return getattr(importlib.import_module(f"graphloom.operators.{_MODULES[name]}"), name)
    raise AttributeError(f"module 'graphloom' has no attribute {name!r}")


def __dir__() -> list[str]:
    return [*globals(), *_MODULES]
