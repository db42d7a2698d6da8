"""Task graphs around lazy DataFrames, and questions as parameterised templates."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

from ..operators import finance, graph, telecom


def run_tasks(tasks: dict[str, tuple[list[str], Callable]]) -> dict[str, DataFrame]:
    """{name: (names it needs, function of them)}: in dependency order, by name where free. Shared results are cached."""
    uses: dict[str, int] = {}
    for deps, _ in tasks.values():
        for d in deps:
            if d not in tasks:
                raise KeyError(f"unknown task {d}")
            uses[d] = uses.get(d, 0) + 1
    order, done = TopologicalSorter({k: v[0] for k, v in tasks.items()}), {}
    order.prepare()
    while order.is_active():
        for name in sorted(order.get_ready()):
            deps, f = tasks[name]
            out = f(*(done[d] for d in deps))
            done[name] = out.cache() if uses.get(name, 0) > 1 else out
            order.done(name)
    return done


TEMPLATES: dict[str, Callable[..., DataFrame]] = {
    "who shares a device": telecom.sims_per_device,
    "who was at all scenes": telecom.tower_intersection,
    "who met whom": telecom.colocated,
    "where did the money go": finance.trace,
    "who stays below the limit": finance.structuring,
    "who is central": graph.pagerank,
    "how far from": graph.k_hop,
}


def ask(question: str, **params) -> DataFrame:
    """A question of the closed list; any other is refused."""
    if question not in TEMPLATES:
        raise LookupError(f"no template for {question!r}; known: {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[question](**params)
