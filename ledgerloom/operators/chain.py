"""The standard transformation chain."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.functions.scalars import add_amount_columns, add_time_parts, only_confirmed
from ledgerloom.operators.chunks import ROWS_PER_CHUNK, ChunkPlan, plan_chunks
from ledgerloom.operators.dedup import deduplicate, total_order
from ledgerloom.operators.rolling import rolling_rows
from ledgerloom.operators.sliding import rolling_range
from ledgerloom.schema import ENTITY
from ledgerloom.session import stage


def transform_chain(df: DataFrame, frame: str = "rows", per: list[str] | None = None,
                    plan: ChunkPlan | None = None, rows_per_chunk: int = ROWS_PER_CHUNK, across: bool = False) -> DataFrame:
    """Deduplicate by hash, keep confirmed rows, add time, amount and rolling columns.

    Duplicates go first, so a later failed copy hides an earlier confirmed one. ``frame`` is
    ``rows`` (last w rows) or ``range`` (true time frames). ``per`` adds columns that separate
    independent runs, such as backfill windows; with ``across`` they separate duplicates only,
    and frames reach over them. Group sizes are measured on the input, ahead
    of the deduplication shuffle: both steps only remove rows, so that is an upper bound.
    """
    if frame not in ("rows", "range"):
        raise ValueError(f"frame must be 'rows' or 'range', not {frame!r}")
    per = per or []
    group = [ENTITY] if across else [ENTITY, *per]
    plan = plan or plan_chunks(df, group, total_order(df), rows_per_chunk)
    out = deduplicate(df, ["transaction_hash", *per])
    out = only_confirmed(out)
    out = add_time_parts(out)
    out = add_amount_columns(out)
    if plan.cuts is not None:
        out = stage(out, "chain")  # the chunked windows scan these rows more than once
    roll = rolling_rows if frame == "rows" else rolling_range
    return roll(out, group, plan=plan)
