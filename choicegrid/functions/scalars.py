"""Column functions that built-ins only give in combination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind (Unicode)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: How a number is written: digits in which single underscores may stand, a point, an exponent; or a word for one that isn't finite.
_DIGITS = r"\d(?:_?\d)*"
NUMBER = rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"


def number(text: Column) -> Column:
    """Text as a double, null where it isn't a number; suffixes such as `d` or `f` don't make one."""
    said = strip(text)
    return F.when(said.rlike(NUMBER), F.replace(said, F.lit("_"), F.lit("")).try_cast("double"))


def is_option(value: Column) -> Column:
    """Whether a recorded code is an answer: not empty, not a missing marker, not a negative number."""
    text = strip(value.cast("string"))
    missing = F.lower(text).isin("", "nan", "none")
    return F.coalesce(~missing & F.coalesce(number(text) >= 0, F.lit(True)), F.lit(False))


def canonical_code(value: Column, numeric: bool = False) -> Column:
    """A code as text; whole numbers lose their decimals and exponent, and what isn't an answer is null.

    numeric: value is a double, whose text need not be read.
    """
    text = value.cast("string") if numeric else strip(value.cast("string"))

    def written(x: Column) -> Column:
        # a number beyond 38 digits keeps its text
        return F.when(x % 1 == 0, F.coalesce(x.try_cast("decimal(38,0)").cast("string"), text))

    if numeric:
        return F.when((value >= 0) & ~F.isnan(value), F.coalesce(written(value), text))
    return F.when(is_option(value), F.coalesce(bound(number(text), written), text))


def is_numeric(text: Column) -> Column:
    return number(text).isNotNull()


def finite(value: Column, what: str) -> Column:
    """value; a null, NaN or infinite one fails the query."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{what} must be finite")).cast("double")).otherwise(value)


def missing_as_null(value: Column) -> Column:
    """NaN becomes null, which aggregates skip."""
    return F.when(F.isnan(value), None).otherwise(value)


def first_prefix(text: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The name of the first listed (prefix, name) that text starts with, else null."""
    return F.coalesce(*(F.when(text.startswith(p), F.lit(name)) for p, name in prefixes), F.lit(None).cast("string"))


def family(experiment: Column) -> Column:
    """What precedes the first slash."""
    return F.substring_index(experiment, "/", 1)


def table_folder(experiment: Column, renamed: dict[str, str]) -> Column:
    """Folder of an experiment's table: its family under the name that the tables use, and its own name without `.csv`.

    renamed says how families are called in experiments: table name to experiment name.
    """
    back = {v: k for k, v in renamed.items()}
    head = family(experiment)
    known = F.coalesce(*(F.when(head == new, F.lit(old)) for new, old in back.items()), head) if back else head
    rest = F.when(F.instr(experiment, "/") > 0, F.substr(experiment, F.length(head) + 2)).otherwise("")
    return F.concat(known, F.lit("/"), F.regexp_replace(rest, r"\.csv$", ""))


def short_name(experiment: Column) -> Column:
    """An experiment as reports name it: `/exp` is ` e`, `.csv` goes."""
    return F.replace(F.replace(experiment, F.lit("/exp"), F.lit(" e")), F.lit(".csv"), F.lit(""))


def bucket_of_ten(rank: Column, length: Column) -> Column:
    """Tenth of a sequence that a zero-based rank lies in; the last one takes what the division leaves."""
    return F.least(F.floor(rank * 10 / length), F.lit(9)).cast("int")


def digest(*columns: Column) -> Column:
    """SHA-256 over the values with their lengths, so that neighbours can't run into each other; nulls differ from ''."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)
