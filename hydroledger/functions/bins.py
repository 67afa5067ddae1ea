"""Half-open bins for map layers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bins:
    """Labels for the intervals between ``edges``.

    ``labels`` has one label per interval: (0, e1), [e1, e2), ..., [en, inf).
    ``zero`` names the class of zero and missing values; ``None`` leaves them
    unlabelled.  Negative values are never labelled.
    """

    edges: Sequence[float]
    labels: Sequence[str]
    zero: str | None = "0"

    def __post_init__(self):
        if len(self.labels) != len(self.edges) + 1:
            raise ValueError("one label per interval is needed")

    def label(self, x: Column) -> Column:
        lows = [None, *self.edges]
        highs = [*self.edges, None]
        out = F.when(x.isNull() | (x == 0), F.lit(self.zero))
        for low, high, label in zip(lows, highs, self.labels, strict=True):
            inside = (x > 0) if low is None else (x >= F.lit(float(low)))
            if high is not None:
                inside = inside & (x < F.lit(float(high)))
            out = out.when(inside, F.lit(label))
        return out


# Class edges and labels of the published maps.
BLUE_FLOW = Bins(
    (1e-6, 1e-4, 1e-2), ("0-10^-6", "10^-6-10^-4", "10^-4-10^-2", ">10^-2"), zero=None
)
CROP_SCARCITY = Bins(
    (500, 1000, 2000, 3000, 5000),
    ("0-500", "500-1000", "1000-2000", "2000-3000", "3000-5000", "> 5000"),
)
HERD_SCARCITY = Bins((10000, 50000, 100000), ("0-10k", "10-50k", "50-100k", ">100k"))
CROP_WATER = Bins((1000, 2000, 3000), ("0-1000", "1000-2000", "2000-3000", "> 3000"))
CROP_BLUE = Bins(
    (100, 250, 500, 1000), ("0-100", "100-250", "250-500", "500-1000", ">1000")
)
HERD_BLUE = Bins((250, 500, 1000), ("0-250", "250-500", "500-1000", "> 1000"))
HERD_PASTURE = Bins(
    (1000, 5000, 10000, 20000),
    ("0-1000", "1000-5000", "5000-10,000", "10,000-20,000", "> 20,000"),
)
