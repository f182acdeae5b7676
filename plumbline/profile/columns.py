"""Column classes of a dataset under profile."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Columns:
    """Names by class, each in schema order; dates are neither numeric nor categorical."""

    order: tuple[str, ...]
    integral: tuple[str, ...]
    fractional: tuple[str, ...]
    categorical: tuple[str, ...]
    other: tuple[str, ...]
    dtypes: dict[str, str] = field(hash=False)

    @property
    def numeric(self) -> tuple[str, ...]:
        wanted = set(self.integral) | set(self.fractional)
        return tuple(c for c in self.order if c in wanted)

    def is_numeric(self, name: str) -> bool:
        return name in self.integral or name in self.fractional


def classify(df: DataFrame) -> Columns:
    fields = df.schema.fields

    def names(*kinds):
        return tuple(f.name for f in fields if isinstance(f.dataType, kinds))

    integral, fractional = names(*INTEGRAL), names(*FRACTIONAL)
    categorical = names(T.StringType, T.BooleanType)
    known = set(integral) | set(fractional) | set(categorical)
    return Columns(
        order=tuple(f.name for f in fields),
        integral=integral,
        fractional=fractional,
        categorical=categorical,
        other=tuple(f.name for f in fields if f.name not in known),
        dtypes={f.name: f.dataType.simpleString() for f in fields},
    )


def normalize(df: DataFrame) -> DataFrame:
    """NaN becomes NULL before anything is counted."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns]
    )
