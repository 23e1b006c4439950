"""Folds over rows in order, one key after the other, in constant memory.

Rows are shuffled by key and sorted inside their partition; the fold streams over
the Arrow batches and keeps only its own state, never the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], make_fold: Callable[[], object], out: Sequence[str],
    schema: str,
) -> DataFrame:
    """Feed each key's rows in ``order`` to a fold with ``step(row)`` and ``finish()``.

    Both yield tuples of the ``out`` columns; the key columns are put in front.
    """
    keys = list(keys)
    columns = df.columns
    key_at = [columns.index(k) for k in keys]
    names = [*keys, *out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fold = None, None
        for batch in batches:
            produced = []
            for row in batch.itertuples(index=False, name=None):
                key = tuple(row[i] for i in key_at)
                if key != current:
                    if fold is not None:
                        produced.extend((*current, *r) for r in fold.finish())
                    current, fold = key, make_fold()
                produced.extend((*key, *r) for r in fold.step(row))
            if produced:
                yield pd.DataFrame(produced, columns=names)
        if fold is not None:
            last = [(*current, *r) for r in fold.finish()]
            if last:
                yield pd.DataFrame(last, columns=names)

    return (
        df.repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(run, schema=schema)
    )
