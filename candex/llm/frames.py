"""Column names that do not clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def one_row_each(rows: DataFrame, kept: DataFrame, match: list[tuple[Column, str]], repeats: str) -> DataFrame:
    """The rows whose values equal, null to null, a row of ``kept``; where that row's ``repeats`` is above 1, one of them.

    ``match`` pairs expressions on ``rows`` with columns of ``kept``, which together are unique there. Which one of the rows
    stays is told by a hash of all its columns. Only rows that repeat are shuffled, at most one of a kind from each task.
    """
    names = unused(rows, *[f"kept{i}" for i in range(len(match))], "spare", "place")
    *names, spare, place = names
    wanted = kept.select(*[F.col(c).alias(n) for (_, c), n in zip(match, names, strict=True)], (F.col(repeats) > 1).alias(spare))
    same = [value.eqNullSafe(F.col(n)) for (value, _), n in zip(match, names, strict=True)]
    on = same[0]
    for more in same[1:]:
        on = on & more
    found = rows.join(wanted, on)
    single = found.where(~F.col(spare)).drop(*names, spare)
    hashed = [c for c in rows.columns if not any(k in rows.schema[c].dataType.simpleString() for k in ("map<", "variant"))]
    order = W.partitionBy(*names).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    several = found.where(F.col(spare)).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return single.unionByName(several.drop(*names, spare, place))
