"""Change counting along an order, folded level by level so that no key is held by one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_counts(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[str],
    tracks: dict[str, Sequence[str]],
    extras: dict[str, tuple[str, str]] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Per key: for each track the number of rows that differ from the previous row having that track.

    A track is a list of columns that are null together. ``levels`` are chunk columns, coarse to fine, that never
    decrease along ``order``: the window runs inside the finest chunk, then each level only compares the last value
    of one chunk with the first of the next. ``extras`` are further aggregates, name to (merge function, SQL text);
    they are evaluated after the shuffle, so only their input columns travel. ``tasks`` sets how many tasks order the rows:
    a chunk's summary is wide, and keys with few rows leave almost as many summaries as rows.
    """
    extras = extras or {}
    columns = list(dict.fromkeys(c for cols in tracks.values() for c in cols))
    rows, part, step_order, remaining = df, [*keys, *levels], list(order), list(levels)
    first, last = {c: c for c in columns}, {c: c for c in columns}
    counted = {t: "0" for t in tracks}
    merged = extras
    while True:
        if tasks:
            rows = rows.repartition(tasks, *part)
        spec = f"PARTITION BY {', '.join(part)} ORDER BY {', '.join(step_order)}"
        seen = rows.selectExpr(
            "*",
            *[
                f"last({last[c]}, true) OVER ({spec} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _p_{c}"
                for c in columns
            ],
            f"lead(1) OVER ({spec}) IS NULL AS _end",
        )

        def crossed(cols: Sequence[str]) -> str:
            differs = " OR ".join(f"_p_{c} != {first[c]}" for c in cols)
            return f"if(_p_{cols[0]} IS NOT NULL AND {first[cols[0]]} IS NOT NULL AND ({differs}), 1, 0)"

        aggregates = [
            *[f"max(if(_p_{c} IS NULL, {first[c]}, NULL)) AS _f_{c}" for c in columns],
            *[f"max(if(_end, coalesce({last[c]}, _p_{c}), NULL)) AS _l_{c}" for c in columns],
            *[f"sum({counted[t]} + {crossed(cols)}) AS _n_{t}" for t, cols in tracks.items()],
            *[f"{kind}({text}) AS {name}" for name, (kind, text) in merged.items()],
        ]
        rows = seen.groupBy(*part).agg(*[F.expr(a) for a in aggregates])
        if not remaining:
            break
        step_order = [remaining.pop()]
        part = [*keys, *remaining]
        first, last = {c: f"_f_{c}" for c in columns}, {c: f"_l_{c}" for c in columns}
        counted = {t: f"_n_{t}" for t in tracks}
        merged = {name: (kind, name) for name, (kind, _) in extras.items()}
    return rows.selectExpr(*keys, *[f"_n_{t} AS {t}" for t in tracks], *extras)

