"""Segment definitions: label, predicate and report order kept in one object.

A segmentation is an ordered list of (label, predicate) rules plus a default
label.  The label column is a ``CASE`` chain (first match wins); the order
column is derived from the same list, so a report sorts in logical order
(Low before High) rather than alphabetically, and adding a segment touches
one place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


@dataclass(frozen=True)
class Segmentation:
    name: str                                   # output label column
    source: str                                 # column the predicates read
    rules: tuple[tuple[str, Predicate], ...]    # (label, predicate), first match wins
    default: str                                # label when no rule matches (incl. NULL)

    @property
    def labels(self) -> list[str]:
        return [label for label, _ in self.rules] + [self.default]

    @property
    def order_name(self) -> str:
        return f"{self.name}_order"

    def label(self, source: Column | None = None) -> Column:
        x = F.col(self.source) if source is None else source
        expr = None
        for label, pred in self.rules:
            expr = F.when(pred(x), F.lit(label)) if expr is None else expr.when(pred(x), F.lit(label))
        return expr.otherwise(F.lit(self.default)) if expr is not None else F.lit(self.default)

    def order(self, label_col: Column | str | None = None, extra: dict[str, int] | None = None) -> Column:
        """Integer position of a label (1-based); ``extra`` adds e.g. a Total row."""
        lab = F.col(self.name) if label_col is None else (
            F.col(label_col) if isinstance(label_col, str) else label_col)
        mapping = {label: i + 1 for i, label in enumerate(self.labels)}
        if extra:
            mapping.update(extra)
        expr = None
        for label, pos in mapping.items():
            cond = lab == F.lit(label)
            expr = F.when(cond, F.lit(pos)) if expr is None else expr.when(cond, F.lit(pos))
        return expr.cast("bigint")

    def with_label(self, df, *, with_order: bool = False):
        out = df.withColumn(self.name, self.label())
        if with_order:
            out = out.withColumn(self.order_name, self.order())
        return out


# The report labels and edges of the two segmentations, in
# report order.  Debt ratio: Low < 0.35 <= Medium < 1.00 <= High <= 5.00 <
# Extreme/Artifact, NULL -> Unknown.  Age: Young < 30, Mid-Career 30-49,
# Senior 50-69, everything else (70+) Retired.
RATIO_BUCKETS = Segmentation(
    name="debt_bucket",
    source="debt_ratio",
    rules=(
        ("Low", lambda x: x < 0.35),
        ("Medium", lambda x: (x >= 0.35) & (x < 1.00)),
        ("High", lambda x: (x >= 1.00) & (x <= 5.00)),
        ("Extreme/Artifact", lambda x: x > 5.00),
    ),
    default="Unknown",
)

AGE_BANDS = Segmentation(
    name="age_band",
    source="age",
    rules=(
        ("Young", lambda x: x < 30),
        ("Mid-Career", lambda x: x.between(30, 49)),
        ("Senior", lambda x: x.between(50, 69)),
    ),
    default="Retired",
)

# The inclusive (BETWEEN-style) edges of the first version of the
# ratio buckets, whose holes the gap audit counts.  (label, low, low included,
# high, high included); None is unbounded.
LEGACY_RATIO_EDGES = (
    ("Low", None, False, 0.35, False),
    ("Medium", 0.35, True, 0.99, True),
    ("High", 1.00, True, 5.00, True),
    ("Extreme/Artifact", 5.00, False, None, False),
)
