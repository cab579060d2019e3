"""Streaming operators.

Counters and the best-so-far choice are plain streaming aggregations: they combine on the map side and keep one
small row per key. Reassembly, gate and marker need the order of rows; their per-key state is a few numbers and
the text of the open fragment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


def stream_counters(sdf: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Clear and protected rows per key, whatever the micro-batches; for update mode."""
    on = F.coalesce(flag, F.lit(False))
    return sdf.groupBy(*keys).agg(F.count_if(~on).alias("clear"), F.count_if(on).alias("protected_rows"))


def stream_first_acceptable(
    sdf: DataFrame, keys: list[str], order: list[str], ok: Column, score: str, payload: list[str]
) -> DataFrame:
    """First acceptable row, else the highest score (ties to the earliest); for update mode.

    The choice is the minimum of one struct, so a key that has its acceptable row does not change any more.
    """
    good = F.coalesce(ok, F.lit(False))
    rank = F.struct(
        (~good).alias("not_ok"),
        F.struct(*[F.when(good, F.col(c)).alias(c) for c in order]).alias("at"),
        F.col(score).isNull().alias("no_score"),
        (-F.col(score)).alias("score"),
        F.struct(*order).alias("tie"),
        F.struct(*payload).alias("row"),
    )
    return sdf.groupBy(*keys).agg(F.min(rank).alias("_m")).select(*keys, "_m.row.*")


def _sorter(order: list[str]):
    """A function that gives a key's rows of one micro-batch sorted.

    State functions travel to the executors by value with all they refer to, so they refer to nothing of this package.
    """

    def in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        found = list(batches)
        rows = found[0].reset_index(drop=True) if len(found) == 1 else pd.concat(found, ignore_index=True)
        at = [rows[c].to_numpy() for c in order]
        if any(a.dtype.kind not in "iufM" for a in at):
            return rows.sort_values(order, kind="stable", ignore_index=True)
        # Numbers and times: the same order, without what pandas spends on a frame of few rows.
        if len(at) == 1 and (at[0][1:] >= at[0][:-1]).all():
            return rows
        return rows.take(np.lexsort(at[::-1])).reset_index(drop=True)

    return in_order


def _keyed(sdf: DataFrame, keys: list[str], fn, out: StructType, state: StructType) -> DataFrame:
    return sdf.groupBy(*keys).applyInPandasWithState(fn, out, state, "append", GroupStateTimeout.NoTimeout)


def stream_reassemble(
    sdf: DataFrame, keys: list[str], order: list[str], is_first: str, is_last: str, part: str, separator: str = "",
    max_length: int | None = None, stated: str | None = None, broken: str | None = None,
) -> DataFrame:
    """Fragments from a first part and its continuations, across micro-batches.

    A fragment is complete at its last part or at the length ``stated`` in its first row, or closed by the next
    first one; an open one stays in the state. Rows are passed over from a ``broken`` row on until the next first
    part; what came before it is kept. With ``max_length``, a fragment that grows longer is given up where it does so: a row
    with neither ``parts`` nor ``text`` stands for it.
    """
    key_fields = [sdf.schema[k] for k in keys]
    out = StructType(
        [*key_fields, StructField("fragment", LongType()), StructField("parts", LongType()),
         StructField("text", StringType()), StructField("complete", BooleanType())]
    )
    state = StructType(
        [StructField("fragment", LongType()), StructField("parts", LongType()), StructField("text", StringType()),
         StructField("goal", LongType()), StructField("open", BooleanType()), StructField("skip", BooleanType())]
    )
    in_order = _sorter(order)

    def flags(rows: pd.DataFrame, name: str | None) -> list[bool]:
        return [False] * len(rows) if name is None else [bool(v) and v == v for v in rows[name].tolist()]  # null is NaN or None

    def push(key, batches, held: GroupState):
        # Keys have few rows: a pass over plain lists, as whole-frame operations cost milliseconds a key.
        fragment, parts, text, goal, opened, skip = held.get if held.exists else (0, 0, "", 0, False, False)
        rows = in_order(batches)
        texts = [v if isinstance(v, str) else "" for v in rows[part].tolist()]
        goals = [int(v) if v is not None and v == v else 0 for v in rows[stated].tolist()] if stated is not None else [0] * len(texts)
        pieces, length = [text] if opened else [], len(text)
        done = []
        for first, wrong, last, piece, size in zip(flags(rows, is_first), flags(rows, broken), flags(rows, is_last), texts, goals, strict=True):
            if wrong:
                skip = True
                continue
            if first:
                if opened:
                    done.append((fragment, parts, separator.join(pieces), False))
                fragment, parts, pieces, length, goal, opened, skip = fragment + 1, 0, [], 0, size, True, False
            elif skip or not opened:
                continue
            else:
                length += len(separator)
            parts += 1
            pieces.append(piece)
            length += len(piece)
            full = 0 < goal <= length
            if not full and max_length is not None and length > max_length:
                done.append((fragment, None, None, False))
                opened = False
            elif full or last:
                whole = separator.join(pieces)
                done.append((fragment, parts, whole[:goal] if goal > 0 else whole, True))
                opened = False
        held.update((fragment, parts, separator.join(pieces), goal, True, skip) if opened else (fragment, 0, "", 0, False, skip))
        if done:
            numbers, counts, whole, complete = zip(*done, strict=True)
            result = {k: [v] * len(done) for k, v in zip(keys, key, strict=True)}
            result |= {"fragment": numbers, "parts": pd.array(counts, "Int64"), "text": pd.Series(whole, dtype=object), "complete": complete}
            yield pd.DataFrame(result)

    return _keyed(sdf, keys, push, out, state)


def stream_start_gate(sdf: DataFrame, keys: list[str], order: list[str], t: str, at: str) -> DataFrame:
    """Rows from the first with ``t >= at`` on; the gate stays open, also for rows without a time."""
    names = sdf.columns
    state = StructType([StructField("open", BooleanType())])
    in_order = _sorter(order)

    def push(key, batches, held: GroupState):
        if held.exists and held.get[0]:
            # Open since an earlier micro-batch: nothing to sort or to hold.
            for rows in batches:
                yield rows[names]
            return
        rows = in_order(batches)
        seen = (rows[t] >= rows[at]).fillna(False).cummax()
        held.update((bool(seen.iloc[-1]),))
        if seen.any():
            yield rows[seen][names]

    return _keyed(sdf, keys, push, sdf.schema, state)


def stream_until_marker(
    sdf: DataFrame, keys: list[str], order: list[str], first: str, end: str, size: str | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Rows from the first opening row to its end marker; a second opening or the size cap also ends the set."""
    names = sdf.columns
    state = StructType(
        [StructField("open", BooleanType()), StructField("done", BooleanType()), StructField("size", LongType())]
    )

    in_order = _sorter(order)

    def push(key, batches, held: GroupState):
        opened, done, used = held.get if held.exists else (False, False, 0)
        if done:
            return
        rows = in_order(batches)
        opens = rows[first].fillna(False).astype(bool)
        start = 0 if opened else int(opens.idxmax()) if opens.any() else len(rows)
        rows, opens = rows.iloc[start:], opens.iloc[start:]
        stop = opens.copy()
        stop.iloc[: 0 if opened else 1] = False
        total = used + (rows[size].fillna(0) if size is not None else pd.Series(0, rows.index)).cumsum()
        if cap is not None:
            stop |= total > cap
        # A row that stops the set is not part of it, one that ends it is.
        out_at = int(stop.to_numpy().argmax()) if stop.any() else len(rows)
        ends = (rows[end].fillna(False).astype(bool) & ~opens).to_numpy()[:out_at]
        end_at = int(ends.argmax()) + 1 if ends.any() else out_at
        kept = rows.iloc[:end_at]
        held.update((bool(opened or len(rows)), bool(stop.any() or ends.any()), int(total.iloc[end_at - 1]) if end_at else int(used)))
        if len(kept):
            yield kept[names]

    return _keyed(sdf, keys, push, sdf.schema, state)
