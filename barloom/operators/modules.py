"""Feature modules: named operators on DataFrames, with rules for their output and a check that they look at no later row."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators.signal import NUMERIC
from barloom.sources.sinks import materialize

Frames = Mapping[str, DataFrame]
#: Values after a cut-off are multiplied by this to see what changes before it.
DISTURBANCE = 1.137
BARS = "bars"


def disturbed(df: DataFrame, cut, *, factor: float = DISTURBANCE) -> DataFrame:
    """``df`` with the numbers of rows dated after ``cut`` multiplied."""
    later = F.to_date("date") > F.lit(cut)
    return df.withColumns({c: F.when(later, F.col(c) * factor).otherwise(F.col(c)) for c in NUMERIC if c in df.columns})


def cut_dates(frames: Frames, check_points: int) -> list:
    """Dates at equal steps of the common calendar, the last one left out (one row per day is looked at)."""
    if check_points < 1:
        raise ValueError("check_points must be positive")
    days = reduce(DataFrame.union, [f.select(F.to_date("date").alias("date")) for f in frames.values()]).distinct()
    calendar = [r["date"] for r in days.orderBy("date").collect()]
    if len(calendar) < 2:
        raise ValueError("a causality check needs two dates or more")
    places = np.linspace(0, len(calendar) - 2, num=min(check_points, len(calendar) - 1), dtype=int)
    return [calendar[i] for i in np.unique(places)]


def frames_causality(
    frames: Frames,
    op: Callable[[Frames], DataFrame],
    features: Sequence[str],
    *,
    check_points: int = 3,
    tolerance: float = 1e-10,
    keys: Sequence[str] = ("symbol", "date"),
) -> DataFrame:
    """(feature, violations): rows up to a cut-off that change when the rows after it change in every input.

    All inputs are disturbed after the same dates, so series that meet in a join are disturbed together. The untouched run
    and one run for each cut-off are compared by one aggregation on ``keys``; a row that comes or goes counts too.
    """
    held = {name: materialize(df, "probe") for name, df in frames.items()}
    wanted = [F.col(c).cast("double").alias(c) for c in features]
    runs = [op(held).select(*keys, F.lit(-1).alias("_run"), *wanted)]
    cuts = cut_dates(held, check_points)
    for i, cut in enumerate(cuts):
        changed = op({name: disturbed(df, cut) for name, df in held.items()})
        runs.append(changed.where(F.to_date("date") <= F.lit(cut)).select(*keys, F.lit(i).alias("_run"), *wanted))
    run = F.col("_run")
    base = {c: F.max(F.when(run < 0, F.col(c))).alias(f"_b_{c}") for c in features}
    seen = {c: F.collect_list(F.when(run >= 0, F.struct(F.col(c).alias("v")))).alias(f"_v_{c}") for c in features}
    asked = sum(((F.to_date("date") <= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    keyed = reduce(DataFrame.unionByName, runs).groupBy(*keys).agg(F.count_if(run < 0).alias("_there"), *base.values(), *seen.values())
    keyed = keyed.withColumn("_asked", asked * F.col("_there"))

    def differs(c: str) -> Column:
        b = F.col(f"_b_{c}")
        same = lambda s: (s["v"].isNull() & b.isNull()) | F.coalesce(F.abs(s["v"] - b) <= tolerance + tolerance * F.abs(b), F.lit(False))
        return F.size(F.filter(f"_v_{c}", lambda s: ~same(s))) + F.abs(F.col("_asked") - F.size(f"_v_{c}"))

    wide = keyed.agg(*[F.coalesce(F.sum(differs(c)), F.lit(0)).alias(c) for c in features])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("violations")) for c in features])))


@dataclass(frozen=True)
class Module:
    """A feature module: ``compute`` adds ``outputs`` to the bars, from any of the frames and by any DataFrame operators.

    ``rules`` name what must hold for every row of the output (NULL is no violation).
    """

    name: str
    tier: int
    outputs: tuple[str, ...]
    compute: Callable[[Frames], DataFrame]
    rules: Mapping[str, Column] = field(default_factory=dict)
    config: dict = field(default_factory=dict)


def from_feature(feature: ft.Feature, rules: Mapping[str, Column] | None = None) -> Module:
    """A built-in feature as a module."""
    return Module(feature.name, feature.tier, feature.outputs, lambda frames: ft.compute_features(frames[BARS], [feature]), rules or {}, feature.config)


class ModuleRegistry:
    """Modules by name, in the order in which they run."""

    def __init__(self, modules: Sequence[Module] = ()):
        self.modules: dict[str, Module] = {}
        for m in modules:
            self.register(m)

    def register(self, module: Module) -> None:
        taken = {c for m in self.modules.values() for c in m.outputs}
        if module.name in self.modules or taken & set(module.outputs):
            raise ValueError(f"module {module.name} or its outputs are registered already")
        self.modules[module.name] = module

    def chosen(self, *, tiers: Sequence[int] | None = None, names: Sequence[str] | None = None) -> list[Module]:
        return [m for m in self.modules.values() if (tiers is None or m.tier in tiers) and (names is None or m.name in names)]

    def compute(self, frames: Frames, **chosen) -> DataFrame:
        """The bars with the outputs of the chosen modules; each module sees those of the modules before it."""
        frames = dict(frames)
        for m in self.chosen(**chosen):
            before = frames[BARS].columns
            frames[BARS] = m.compute(frames).select(*before, *m.outputs)
        return frames[BARS]

    def validate(self, frames: Frames, **chosen) -> DataFrame:
        """(module, tier, rule, failures): rows that break a rule of their module, all in one pass over the output."""
        rules = [(m, name, F.count_if(~rule).alias(f"{m.name}/{name}")) for m in self.chosen(**chosen) for name, rule in m.rules.items()]
        if not rules:
            raise ValueError("no module has a rule")
        counts = self.compute(frames, **chosen).agg(*[c for *_, c in rules])
        cells = [
            F.struct(F.lit(m.name).alias("module"), F.lit(m.tier).alias("tier"), F.lit(name).alias("rule"), F.col(f"`{m.name}/{name}`").alias("failures"))
            for m, name, _ in rules
        ]
        return counts.select(F.inline(F.array(*cells)))

    def causality(self, frames: Frames, *, check_points: int = 3, tolerance: float = 1e-10, **chosen) -> DataFrame:
        """(module, feature, violations) of all outputs, from the same disturbed runs."""
        owner = {c: m.name for m in self.chosen(**chosen) for c in m.outputs}
        found = frames_causality(frames, lambda f: self.compute(f, **chosen), list(owner), check_points=check_points, tolerance=tolerance)
        name = F.element_at(F.create_map(*[F.lit(x) for pair in owner.items() for x in pair]), F.col("feature"))
        return found.select(name.alias("module"), "feature", "violations")
