"""Schema drift: casts that apply to a whole column or not at all, and typed defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.functions.scalars import clean_double
from ledgerloom.schema import TRANSACTION, TYPE_NAMES

_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4}


def resolve(dtype: str | T.DataType) -> tuple[T.DataType, object]:
    """Target type and default value of a type name; an unknown name defaults to NULL."""
    if isinstance(dtype, T.DataType):
        return dtype, next((d for t, d in TYPE_NAMES.values() if t == dtype), None)
    if dtype in TYPE_NAMES:
        return TYPE_NAMES[dtype]
    try:
        return T.DataType.fromDDL(dtype), None
    except Exception:
        return T.StringType(), None


def typed_default(dtype: str | T.DataType):
    target, value = resolve(dtype)
    return F.lit(value).cast(target)


def _always_casts(source: T.DataType, target: T.DataType) -> bool:
    """Casts that no value can fail, decided without looking at the data."""
    if source == target or isinstance(target, T.StringType):
        return True
    if type(source) in _WIDTH:
        if type(target) in _WIDTH:
            return _WIDTH[type(source)] <= _WIDTH[type(target)]
        return isinstance(target, T.DoubleType)
    return isinstance(source, T.FloatType) and isinstance(target, T.DoubleType)


def evolve(df: DataFrame, expected: dict[str, str | T.DataType], fill_defaults: bool = True) -> DataFrame:
    """Bring ``df`` to the expected columns.

    A missing column gets its typed default (or an error), a present one is cast when every
    value can be cast and is left alone otherwise; further columns stay. Doubtful casts are
    decided by one aggregate over only those columns.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in expected if c not in present]
    if missing and not fill_defaults:
        raise ValueError(f"missing expected columns: {missing}")

    targets = {c: resolve(t)[0] for c, t in expected.items() if c in present}
    doubtful = [c for c, t in targets.items() if not _always_casts(present[c], t)]
    refused: set[str] = set()
    if doubtful:
        bad = df.agg(*[
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(targets[c]).isNull()).alias(c)
            for c in doubtful
        ]).first()
        refused = {c for c in doubtful if bad[c] > 0}

    changes = {c: typed_default(expected[c]) for c in missing}
    changes.update({
        c: F.col(c).try_cast(t) for c, t in targets.items()
        if c not in refused and present[c] != t
    })
    return df.withColumns(changes) if changes else df


def normalize(df: DataFrame, schema: T.StructType = TRANSACTION) -> DataFrame:
    """Known columns in schema order, cast where the whole column allows it, NaN as NULL."""
    known = [f for f in schema.fields if f.name in df.columns]
    cast = evolve(df, {f.name: f.dataType for f in known})
    doubles = {n for n, t in cast.dtypes if t == "double"}
    return cast.select(*[
        clean_double(f.name).alias(f.name) if f.name in doubles else F.col(f.name)
        for f in known
    ])
