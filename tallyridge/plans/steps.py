"""Which steps a calculation still has to take: a graph of steps, and the results that are given.

A given result is neither made nor are the steps that lead to it alone. What is left comes in an order in which each step finds its inputs.
Steps without inputs cannot be taken: they have to be given, or not be needed.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NothingToStartFrom(ValueError):
    """An input that no step makes is needed and not given."""


class Steps:
    """``made_of``: the inputs of each step, by name; names that only occur as inputs have none."""

    def __init__(self, made_of: dict[str, tuple[str, ...]]):
        names = {*made_of, *(x for inputs in made_of.values() for x in inputs)}
        self.made_of = {k: tuple(made_of.get(k, ())) for k in sorted(names)}
        self.order  # noqa: B018  a cycle shows at once

    @cached_property
    def depth(self) -> dict[str, int]:
        """Steps on the longest way from what has no inputs."""
        depth: dict[str, int] = {}

        def of(step: str, above: tuple[str, ...]) -> int:
            if step in above:
                raise ValueError(f"steps that need one another: {' <- '.join((*above, step))}")
            if step not in depth:
                depth[step] = max((of(x, (*above, step)) + 1 for x in self.made_of[step]), default=0)
            return depth[step]

        for step in self.made_of:
            of(step, ())
        return depth

    @cached_property
    def order(self) -> list[str]:
        """All steps, inputs first; those of one depth by name."""
        return sorted(self.made_of, key=lambda s: (self.depth[s], s))

    def known(self, names: Iterable[str]) -> set[str]:
        if unknown := sorted(set(names) - set(self.made_of)):
            raise ValueError(f"no such steps: {', '.join(unknown)}")
        return set(names)

    def missing(self, outputs: Iterable[str], given: Iterable[str] = ()) -> list[str]:
        """The steps to take for ``outputs``, in order."""
        given, needed = self.known(given), set()
        open_ = list(self.known(outputs))
        while open_:
            step = open_.pop()
            if step not in given and step not in needed:
                needed.add(step)
                open_ += self.made_of[step]
        if absent := sorted(s for s in needed if not self.made_of[s]):
            raise NothingToStartFrom(f"give {' and '.join(absent)}, or what is made of it")
        return [s for s in self.order if s in needed]

    def missing_of_each(self, samples: DataFrame, outputs: Iterable[str], given: str = "given") -> DataFrame:
        """The same for a table of samples with an array of the names given: its columns with ``step``, ``place`` (from 0) and ``startable``, a row for each step to take.

        Null arrays are empty, unknown names count for nothing; a sample with nothing to do has no row. Where the sample has nothing to start
        from, ``startable`` is false in all its rows, those for the absent inputs included.
        """
        outputs = self.known(outputs)
        names = F.array_compact(F.coalesce(given, F.array().cast("array<string>")))
        after = {s: [t for t in self.made_of if s in self.made_of[t]] for s in self.made_of}
        rows = samples
        for step in reversed(self.order):
            wanted = reduce(or_, (F.col(f"__need_{t}") for t in after[step]), F.lit(step in outputs))
            rows = rows.withColumn(f"__need_{step}", wanted & ~F.array_contains(names, step))
        steps = F.array_compact(F.array(*(F.when(F.col(f"__need_{s}"), F.lit(s)) for s in self.order)))
        startable = ~reduce(or_, (F.col(f"__need_{s}") for s in self.order if not self.made_of[s]))
        listed = rows.select(*samples.columns, startable.alias("startable"), steps.alias("__steps"))
        return listed.select(*samples.columns, "startable", F.posexplode("__steps").alias("place", "step"))


#: From reads to what is called, as a user sees it.
CALLING = Steps(
    {
        "cuts": ("reads",), "total": ("cuts",), "smoothed": ("cuts", "total"), "density": ("smoothed",), "fit_params": ("cuts", "total"),
        "pvalues": ("fit_params", "cuts"), "fdrs": ("pvalues",), "calls": ("fdrs", "smoothed", "total"),
    }
)
