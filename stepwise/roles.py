"""Column roles.

The operators never hard-code column names.  A :class:`Roles` instance says
which column of a frame plays which part:

* ``entity``     stable key of the observed thing
* ``epoch``      outer period; windows never cross it
* ``step``       ordered slice inside an epoch (two rows may share a step)
* ``seq``        unique tie-break inside a step
* ``side`` / ``other_side`` / ``is_home``  two-sided match context
* ``segment``    one model per segment
* ``target``     the value to predict
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    entity: str = "entity"
    epoch: str = "epoch"
    step: str = "step"
    seq: str = "seq"
    segment: str | None = "segment"
    target: str | None = "target"
    side: str | None = None
    other_side: str | None = None
    is_home: str | None = None
    fixture: str | None = None

    def with_(self, **kw) -> "Roles":
        return replace(self, **kw)

    @property
    def group(self) -> list[str]:
        """Window partition: one entity inside one epoch."""
        return [self.entity, self.epoch]

    @property
    def order(self) -> list[str]:
        return [self.step, self.seq]

    def window(self) -> WindowSpec:
        """The shared window spec; every lagged feature reuses this one sort."""
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def order_struct(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])
