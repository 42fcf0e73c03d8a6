"""Choices that depend on what was chosen before: budgets and packings, one group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def within_budget(sizes: Iterable[int], required: Iterable[bool], budget: int) -> list[bool]:
    """Required rows always; of the others, in order, each that still fits: one that does not is skipped, not a stop."""
    rows = list(zip(sizes, required, strict=True))
    used, kept = 0, [False] * len(rows)
    for k in sorted(range(len(rows)), key=lambda k: not rows[k][1]):
        size, must = rows[k]
        if must or used + size <= budget:
            kept[k], used = True, used + size
    return kept


def paced(needs: Iterable[int], budget: int, episodes: int, slack_share: float = 0.02) -> list[bool]:
    """Sources are granted while one slot stays for each episode to come, with a slack of 3 or 2 percent."""
    slack, left, out = max(3, int(budget * slack_share)), budget, []
    for done, need in enumerate(needs):
        fits = need <= left - max(0, episodes - done - 1) + slack and need <= left
        left -= need if fits else 0
        out.append(fits)
    return out


def grounded_order(rows: list[tuple[str, set[str]]], seen: set[str]) -> list[str]:
    """Next comes the first row half of whose title words were seen; its words are then seen too."""
    left, out = list(rows), []
    while left:
        k = next((k for k, (_, words) in enumerate(left) if 2 * len(words & seen) >= len(words)), 0)
        key, words = left.pop(k)
        out.append(key)
        seen = seen | words
    return out


def capped_share(flags: Iterable[bool], share: float, free: int = 10) -> list[bool]:
    """Rows in order; a flagged one is kept only while flagged rows stay within a share of what is kept."""
    kept = flagged = 0
    out = []
    for flag in flags:
        fits = not flag or kept < free or flagged + 1 <= share * (kept + 1)
        out.append(fits)
        kept, flagged = kept + fits, flagged + (fits and flag)
    return out


def by_group(df: DataFrame, key: str, order: str, choose: Callable[[list], list[bool]], columns: list[str]) -> DataFrame:
    """Rows of each group that ``choose`` keeps, given the rows' ``columns`` in order; (key, order) names a row.

    Only the columns that decide are gathered, as one list per group, and many groups go to Python in one batch. A group
    is one decision and must fit in a task.
    """
    lists = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("rows"))

    def decide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kept = []
            for rows in batch.column("rows").to_pylist():
                flags = choose([tuple(r[c] for c in columns) for r in rows])
                kept.append([r[order] for r, keep in zip(rows, flags, strict=True) if keep])
            of = batch.schema.field("rows").type.value_type.field(order).type
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(kept, pa.list_(of))], names=[key, "kept"])

    schema = T.StructType([df.schema[key], T.StructField("kept", T.ArrayType(df.schema[order].dataType))])
    found = lists.mapInArrow(decide, schema).select(key, F.explode("kept").alias(order))
    return df.join(found, [key, order], "left_semi")
