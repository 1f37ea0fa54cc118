"""Skew-proof ordered windows over long per-key series.

``Window.partitionBy(location).orderBy(ts)`` sends a whole location to one
task; with a handful of locations (or one location holding a third of the
rows) that is a few giant tasks.  Here each series is cut into chunks of a
fixed number of rows instead:

1. ``with_group_rank`` numbers every row inside its series through a
   range-partitioned sort (balanced by sampling, whatever the key skew);
2. chunk = rank div ``chunk_rows``; the last ``lookback`` rows of every chunk
   are copied into the next chunk as read-only *halo* rows;
3. ordered windows run per (key, chunk) and see at least ``lookback``
   preceding rows of the series, so lags and row frames up to ``lookback``
   are exact; halo rows are dropped afterwards.

Every window partition holds at most ``chunk_rows + lookback`` rows and the
duplication overhead is ``lookback / chunk_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ordering import with_group_rank

DEFAULT_CHUNK_ROWS = 4096
POS = "series_pos"
LEN = "series_len"
_CHUNK = "_chunk"
_HALO = "_halo"


def series_frame(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str],
                 lookback: int, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Rank rows per key (0-based ``series_pos``, plus the series length
    ``series_len``) and add halo copies.

    ``order_cols`` must be unique within a key (end with an id column).
    """
    if lookback >= chunk_rows:
        raise ValueError("lookback must be smaller than chunk_rows")
    ranked = with_group_rank(df, key_cols, order_cols, POS, size_col=LEN)
    chunk = F.floor(F.col(POS) / chunk_rows)
    base = ranked.withColumns({_CHUNK: chunk, _HALO: F.lit(False)})
    if lookback <= 0:
        return base
    halo = (ranked.where(F.col(POS) % chunk_rows >= chunk_rows - lookback)
                  .withColumns({_CHUNK: chunk + 1, _HALO: F.lit(True)}))
    return base.unionByName(halo)


def series_window(key_cols: Sequence[str]) -> WindowSpec:
    """Ordered window over one chunk of a series (use with ``series_frame``)."""
    return Window.partitionBy(*key_cols, _CHUNK).orderBy(POS)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(_HALO)).drop(_CHUNK, _HALO)

