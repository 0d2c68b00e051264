"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _beta_sql(a: str, b: str, x: str) -> str:
    """The regularised incomplete beta function in DuckDB, by its continued fraction from the end."""
    term = f"1 + (m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))) / (1 - (({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))) / r)"
    inner = f"list_reduce(list_concat([CAST(1 AS DOUBLE)], CAST(range(250, 0, -1) AS DOUBLE[])), lambda r, m: {term})"
    return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} / (1 - ({a} + {b}) * {x} / ({a} + 1) / {inner})"


def t_p_sql(t: str, dof: str) -> str:
    """SQL of the two-sided p of Student's t, t not 0."""
    a, x, rest = f"({dof} / 2)", f"({dof} / ({dof} + {t} * {t}))", f"({t} * {t} / ({dof} + {t} * {t}))"
    half = "CAST(0.5 AS DOUBLE)"
    return f"CASE WHEN {x} < ({a} + 1) / ({a} + 2.5) THEN {_beta_sql(a, half, x)} ELSE 1 - ({_beta_sql(half, a, rest)}) END"
