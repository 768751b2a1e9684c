"""Number cleaning, scaling and rounding as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(col: Column, kind: str = "bigint") -> Column:
    """Whole number in the text, else null ('12.0', '1e3' and '' are null)."""
    return col.try_cast(kind)


def safe_float(col: Column) -> Column:
    """Real number in the text, else null.

    Spark's cast also takes a Java type suffix ('1.5d', '1.5f'), which is no number here.
    """
    text = F.trim(col.cast("string"))
    plain = ~F.substring(text, -1, 1).isin("d", "D", "f", "F") | F.upper(text).endswith("INF")
    return F.when(plain, text.try_cast("double"))


def clean_number(column: str, text: bool, factor: float | None = None) -> Column:
    """Feature value of a column: unreadable, null, NaN and infinite numbers become 0.0.

    One SQL text per feature, as wide records have dozens of them. ``factor`` converts units.
    """
    number = _number_sql(column, text, factor)
    # A number minus itself is 0 only if the number is finite.
    return F.expr(f"CASE WHEN {number} - {number} = 0.0D THEN {number} ELSE 0.0D END")


def raw_number(column: str, text: bool, factor: float | None = None) -> Column:
    """The number in a column, in converted units, without the cleaning."""
    return F.expr(_number_sql(column, text, factor))


def _number_sql(column: str, text: bool, factor: float | None) -> str:
    name = "`" + column.replace("`", "``") + "`"
    if text:
        text_value = f"CAST({name} AS STRING)"
        last = f"substring(rtrim({text_value}), -1, 1)"
        plain = f"{last} NOT IN ('d', 'D', 'f', 'F') OR upper(rtrim({text_value})) LIKE '%INF'"
        number = f"CASE WHEN {plain} THEN try_cast({text_value} AS DOUBLE) END"
    else:
        number = f"CAST({name} AS DOUBLE)"
    return f"({number} * {factor!r}D)" if factor else f"({number})"


def signed_log1p(col: Column) -> Column:
    return F.signum(col) * F.log1p(F.abs(col))


def clip(col: Column, low: float = -3.0, high: float = 3.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def double_array(values: Sequence[float]) -> Column:
    """Constant array; one expression to parse instead of a call per number."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def scale_state(state: Column, mean: Column, scale: Column) -> Column:
    """Signed log, standardise and clip one state vector, in double precision."""
    logged = F.transform(state, lambda x: signed_log1p(x))
    centred = F.zip_with(logged, mean, lambda x, m: x - m)
    return F.zip_with(centred, scale, lambda x, s: clip(F.try_divide(x, s)))


def as_float32(state: Column) -> Column:
    """The scorer's input precision."""
    return state.cast("array<float>")


def sigmoid(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def max_keep_first(first: Column, second: Column) -> Column:
    """Larger of two numbers; a NaN or null second value leaves the first."""
    return F.greatest(first, F.nanvl(F.coalesce(second, first), first))


def mean_squared_error(left: Column, right: Column) -> Column:
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(left)


def first_argmax(values: Column) -> Column:
    """Index of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
