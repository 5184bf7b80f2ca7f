"""Fixpoints of supersteps."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from .barrier import barrier, drop_barrier
from .graph import Graph

log = logging.getLogger("vertexflow")


@dataclass
class Run:
    """The graph that an iteration ended with. passes: executed supersteps; iterations: those before the one that ended it."""

    graph: Graph
    passes: int = 0
    converged: bool = False
    steps: list[dict] = field(default_factory=list)

    @property
    def measure(self):
        """What the last test measured; None before the first step."""
        return self.steps[-1]["measure"] if self.steps else None

    @property
    def iterations(self) -> int:
        return self.passes - 1 if self.converged and self.passes else self.passes


def iterate(graph: Graph, step: Callable[[Graph, object], Graph], done: Callable[[Graph], tuple[bool, object]], max_passes: int | None = None) -> Run:
    """Applies step until done(graph) says so, or max_passes times. Each step's vertex state passes a barrier.

    step gets the last measure, too (None at first), for instance the size of the frontier.

    done gets the written state, so that its test reads it and computes nothing again; it returns (stop, measure).
    """
    run = Run(graph)
    while max_passes is None or run.passes < max_passes:
        began = time.perf_counter()
        old = run.graph.vertices
        new = step(run.graph, run.measure)
        run.graph = new.with_vertices(barrier(new.vertices))
        if run.passes:
            drop_barrier(old)  # a state that this loop wrote; only the last one stays
        run.passes += 1
        stop, measure = done(run.graph)
        run.steps.append({"pass": run.passes, "measure": measure, "seconds": time.perf_counter() - began})
        log.debug("pass %d: %s", run.passes, run.steps[-1])
        if stop:
            run.converged = True
            break
    return run
