"""A linked session: one base table, a current subset, and its projections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bucketing as B
from ..operators import selection as S
from ..operators.bitmaps import BitmapIndex, bitmaps_of, narrowed, selected_rows
from ..operators.frames import counted
from ..operators.sketches import LevelSketches
from ..scratch import stored

BUDGET = 10_000
#: After so many selections the subset is written out, which cuts its lineage.
CUT_EVERY = 4


@dataclass(frozen=True)
class Projection:
    """Rows or buckets of a subset; ``level`` is the bucket column, None for raw rows.

    Buckets are numbered anew from 0, in the order of their first rows, whose numbers are ``row_id``.
    """

    rows: DataFrame
    level: str | None
    group: str | None


def project(df: DataFrame, family: str, max_rows: int = BUDGET, group: str | None = "DATA_TYPE", sketches: LevelSketches | None = None) -> Projection:
    """Drop rows without the family's inputs, choose the level, from sketches of ``df`` if given, collapse."""
    usable = B.drop_missing(df, family)
    if sketches is not None:
        level = sketches.level(family, max_rows, df)
    else:
        level = {"geo": B.optimal_geo_level, "time": B.optimal_temporal_level, "semantic": B.optimal_semantic_level}[family](usable, max_rows)
    return Projection(usable if level is None else stored(B.renumbered(B.bucket_by_column(usable, level, group)), "session-view"), level, group)


@dataclass
class LinkedSession:
    """``base`` must hold a ``df_id``; ``families`` are the projections kept in step.

    The base is stored once with its bucket columns, of which each later step reads only its own. With
    times in it, levels are sketched once by hour and group; as long as all selections are of time
    buckets of an hour or more, levels of the subset are chosen from these sketches. With ``bitmaps``, for
    ids from 0 on, the subset is a bitmap of row numbers: a level that is picked from is indexed once, a
    selection is an AND or AND NOT, and however many there are, the subset is one join with the base.
    """

    base: DataFrame
    families: tuple[str, ...] = ("geo", "time")
    max_rows: int = BUDGET
    group: str | None = "DATA_TYPE"
    bitmaps: bool = False
    subset: DataFrame = field(init=False)
    projections: dict[str, Projection] = field(init=False, default_factory=dict)
    _events: int = field(init=False, default=0)
    _base_sketches: LevelSketches | None = field(init=False, default=None)
    _sketches: LevelSketches | None = field(init=False, default=None)
    _indexes: dict[str, BitmapIndex] = field(init=False, default_factory=dict)
    _selection: DataFrame | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        self.base = stored(B.add_bucketed_columns(self.base), "session-base")
        if "TIMESTAMP_UTC" in self.base.columns:
            self._base_sketches = LevelSketches.of(self.base, self.families, self.group)
        self.reset()

    def reset(self) -> None:
        self.subset, self._events, self._sketches = self.base, 0, self._base_sketches
        self._selection = None
        self._project()

    def _project(self) -> None:
        self.projections = {f: project(self.subset, f, self.max_rows, self.group, self._sketches) for f in self.families}

    def apply_filter(self, family: str, ids: list[int], operator: str = "intersection") -> None:
        """Keep (``intersection``) or remove (``subtraction``) the rows behind these points of a projection."""
        if operator not in ("intersection", "subtraction"):
            raise ValueError(operator)
        view = self.projections[family]
        keep = operator == "intersection"
        if not ids:
            self.subset = self.subset.limit(0) if keep else self.subset
            self._sketches = None if keep else self._sketches
        elif view.level is None:
            chosen = self.base.sparkSession.createDataFrame([(i,) for i in ids], "df_id long")
            self.subset = (S.filter_to_ids if keep else S.subtract_ids)(self.subset, chosen)
            self._sketches = None
        else:
            picked = S.pick(view.rows, ids)
            rows = B.drop_missing(self.subset, family) if keep else self.subset
            self.subset = (S.filter_to_buckets if keep else S.subtract_buckets)(rows, picked, view.level, view.group)
            if self._sketches is not None and self._sketches.can_follow(view.level, view.group):
                self._sketches = (self._sketches.kept if keep else self._sketches.without)(picked, view.level, view.group)
            else:
                self._sketches = None
        if self.bitmaps and ids:
            if self._selection is None:
                self._selection = stored(bitmaps_of(self.base), "session-bitmaps")
            if view.level is None:
                other = bitmaps_of(chosen)
            else:
                if view.level not in self._indexes:
                    self._indexes[view.level] = BitmapIndex.of(self.base, view.level, view.group)
                other = self._indexes[view.level].picked(picked)
            self._selection = narrowed(self._selection, other, keep)
            self.subset = selected_rows(self.base, self._selection)
        elif self.bitmaps and keep:
            self._selection = self.subset.select("df_id").transform(bitmaps_of)
        self._events += 1
        if not self.bitmaps and self._events % CUT_EVERY == 0:
            self.subset = stored(self.subset, "session-subset")
        self._project()

    def summary(self) -> dict:
        """Counts of all and current rows, columns, and level and points of each projection."""
        shown = {f: {"level": p.level, "points": p.rows.count(), "rows": p.rows.agg(F.sum(counted(p.rows))).first()[0] or 0} for f, p in self.projections.items()}
        return {"all_rows": self.base.count(), "rows": self.subset.count(), "columns": self.base.columns, "projections": shown}
