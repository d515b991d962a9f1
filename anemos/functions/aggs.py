"""Aggregates by name, as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Aggregate = str | Callable[[Column], Column]

NAMED: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}

#: What a period without rows holds.
EMPTY = {"sum": 0.0, "prod": 1.0, "count": 0}


def aggregate(method: Aggregate, column: Column) -> Column:
    """method by name, or a function from a column to an aggregate column, such as lambda c: F.avg(c) + 2 * F.stddev_samp(c)."""
    if callable(method):
        return method(column)
    if method not in NAMED:
        raise ValueError(f"aggregation {method!r} isn't one of {', '.join(NAMED)}")
    return NAMED[method](column)


def python_aggregate(function: Callable, result: str = "double") -> Callable[[Column], Column]:
    """A Python function from a pandas Series to one value, as an aggregate that average_by_period, distributions and tables take for `method`, such as
    python_aggregate(lambda v: v.mean() + 2 * v.std()). Nulls are left out before it is called; a group without values gives null.

    When to use which: a Column callable, if functions of Spark can say it, runs in the JVM with partial aggregation. This one gathers each group's values in one task, so it
    is for groups whose values fit there (a period, a bin of a site). fold() is for functions of values that can be taken piece by piece: it holds one state a group."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def call(groups):
        return pd.Series([function(pd.Series(v)) if v is not None and len(v) else None for v in groups])

    call.__annotations__ = {"groups": pd.Series, "return": pd.Series}
    udf = pandas_udf(call, result)
    return lambda c: udf(F.collect_list(c))  # so that other aggregates may stand beside it


def fold(df: DataFrame, keys: list[str], column: str, initial: Callable, update: Callable, merge: Callable, finish: Callable, result: str = "double", most: int = 100_000) -> DataFrame:
    """(keys, value): a Python aggregate in partial states, for groups of any size. initial() makes a state, update(state, Series) takes some of a group's values (nulls left out), merge(a, b) joins
    two states, finish(state) gives the value. Rows are dealt by key, groups too large for one task to several, and sorted there, so that update() gets what a batch has of a group at once
    and is called about as often as there are groups and batches. A task keeps at most `most` states and hands them over pickled; a group's states are joined at last."""
    import pickle

    import numpy as np
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    kept = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

    def partial(batches):
        states: dict = {}

        def handed() -> pd.DataFrame:
            out = pd.DataFrame(list(states), columns=keys)
            out["state"] = [pickle.dumps(s) for s in states.values()]
            states.clear()
            return out

        for rows in batches:
            if not len(rows):
                continue
            group = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            values, some = rows["value"].iloc[order], rows["value"].notna().to_numpy()[order]
            group = group[order]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            named = rows[keys].iloc[order[starts]].astype(object)
            named = named.where(named.notna(), None)
            for key, lo, hi in zip(named.itertuples(index=False, name=None), starts, [*starts[1:], len(group)]):
                part = values.iloc[lo:hi]
                states[key] = update(states[key] if key in states else initial(), part if some[lo:hi].all() else part[some[lo:hi]])
            if len(states) > most:
                yield handed()
        yield handed()

    def join(gathered: pd.Series) -> pd.Series:
        out = []
        for states in gathered:
            whole = None
            for i, s in enumerate(states):
                s = pickle.loads(s)
                whole = merge(whole, s) if i else s
            out.append(finish(whole))
        return pd.Series(out, dtype=object)

    join.__annotations__ = {"gathered": pd.Series, "return": pd.Series}
    dealt = df.select(*keys, F.col(column).alias("value")).hint("rebalance", *keys).sortWithinPartitions(*keys)
    states = dealt.mapInPandas(partial, f"{kept}, state binary")
    return states.groupBy(*keys).agg(F.collect_list("state").alias("__states")).select(*keys, pandas_udf(join, result)("__states").alias("value"))


def quantile(p: float) -> Callable[[Column], Column]:
    """An exact quantile as an aggregate beside others. It holds a group's distinct values in one buffer; operators.quantile.group_quantiles finds the same without."""
    return lambda c: F.percentile(c, F.lit(float(p)))
