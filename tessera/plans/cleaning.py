"""The cleaning wizard as an explicit, ordered list of steps.

Each step is a ``DataFrame -> DataFrame`` function applied with
``df.transform``.  The whole plan stays lazy; after ``checkpoint_every``
steps the intermediate result is checkpointed to the session's shared
checkpoint folder, which cuts the lineage (each step's statistics job
would otherwise re-run every earlier step) and survives executor loss.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessera.operators import clean as C
from tessera.operators import select as P

Step = Callable[[DataFrame], DataFrame]


@dataclass
class CleaningPlan:
    steps: list[tuple[str, Step]] = field(default_factory=list)
    checkpoint_every: int = 0

    def add(self, name: str, step: Step) -> "CleaningPlan":
        self.steps.append((name, step))
        return self

    # Wizard step 1
    def missing(self, method: str = "impute") -> "CleaningPlan":
        fn = {"impute": C.impute_mean_mode, "drop_rows": P.drop_missing_rows,
              "drop_columns": P.drop_missing_columns}[method]
        return self.add(f"missing:{method}", fn)

    # Wizard step 2
    def outliers(self, col: str, method: str = "none", k: float = 3.0) -> "CleaningPlan":
        if method == "none":
            return self
        fn = {"remove": lambda d: P.remove_outliers(d, col, k),
              "cap": lambda d: P.cap_outliers(d, col, k)}[method]
        return self.add(f"outliers:{method}:{col}", fn)

    # Wizard step 3
    def encode(self, method: str = "label", cols: list[str] | None = None) -> "CleaningPlan":
        fn = {"label": lambda d: C.label_encode(d, cols),
              "one_hot": lambda d: C.one_hot(d, cols)}[method]
        return self.add(f"encode:{method}", fn)

    # Wizard step 4
    def transform(self, col: str, method: str = "none") -> "CleaningPlan":
        if method == "none":
            return self
        fn = {"log": lambda d: C.log_transform(d, col),
              "standard": lambda d: C.standard_scale(d, col),
              "minmax": lambda d: C.minmax_scale(d, col)}[method]
        return self.add(f"transform:{method}:{col}", fn)

    def apply(self, df: DataFrame) -> DataFrame:
        out = df
        for i, (_, step) in enumerate(self.steps, start=1):
            out = out.transform(step)
            if self.checkpoint_every and i % self.checkpoint_every == 0 and i < len(self.steps):
                out = out.checkpoint(eager=True)
        return out


def clean(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    return plan.apply(df)
