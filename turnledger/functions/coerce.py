"""Lenient readings of one JSON log line held as a VARIANT.

Every field of a log line is optional and may carry any JSON type. These expressions
turn a field into a usable value or null; none of them fails on bad input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# White space and line terminators stripped from both ends of a line.
BLANKS = (
    " \t\n\u000b\u000c\r\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Numeric timestamps above this are milliseconds.
MILLISECONDS_FROM = 100_000_000_000
# ISO dates and date-times.
ISO_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
# Two more spellings: "Thu, 15 Jan 2026 10:00:00 GMT", and dates with slashes.
HTTP_TIMESTAMP = r"^[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT$"
SLASHED_TIMESTAMP = r"^\d{4}/\d{1,2}/\d{1,2}( \d{2}:\d{2}:\d{2})?$"
# Seconds of the years 1 to 9999; what lies outside is no time.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799
# A JSON number above this cannot be an exact count.
MAX_COUNT = 2**53
# ----------------------------------------------------------------------------

# Lines are read whole: no limit on the length of a string or on nesting.
_STRICT_JSON = {
    "maxStringLen": str(2**31 - 1),
    "maxNestingDepth": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
    "allowNonNumericNumbers": "false",
    "allowSingleQuotes": "false",
}


def stripped(line: Column) -> Column:
    # Trimming decodes every character; a line of the usual shape has nothing to trim.
    return F.when(_looks_like_object(line), line).otherwise(F.btrim(line, F.lit(BLANKS)))


def _looks_like_object(line: Column) -> Column:
    return line.startswith("{") & line.endswith("}")


def parse_line(line: Column, names: Sequence[str]) -> Column:
    """The line as a one-element array of its fields ``names``, each a VARIANT; null unless it is
    exactly one object.

    The brackets make trailing text after the object an error. Other fields are checked, not kept.
    """
    wrapped = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<{_variants(names)}>", _STRICT_JSON)
    return F.when(_looks_like_object(line), wrapped)


def is_single(parsed: Column) -> Column:
    """True for a parsed line without a second array element."""
    return F.coalesce(F.size(parsed) == 1, F.lit(False))


def members(value: str, names: Sequence[str]) -> Column:
    """The fields ``names`` of a VARIANT object, each a VARIANT; null for anything else.

    One pass over the object. A path that is not there costs a lookup by path an exception.
    """
    return F.expr(f"try_variant_get({value}, '$', '{_variants(names)}')")


def _variants(names: Sequence[str]) -> str:
    return "struct<" + ", ".join(f"`{name}`: variant" for name in names) + ">"


# The readings below take the name of a VARIANT column that ``with_readings`` has prepared: its
# kind, number and text are columns of their own. Spelled out in every reading they would be
# evaluated some dozens of times a line, in a method too long for the JVM to compile.


def _kind(value: str) -> str:
    return f"{value}_kind"


def _number(value: str) -> str:
    return f"{value}_number"


def _text(value: str) -> str:
    return f"{value}_text"


def with_readings(lines: DataFrame, values: Sequence[str]) -> DataFrame:
    """Add what the readings of the VARIANT columns ``values`` share, each computed once a line."""
    kinds = lines.select("*", *[F.expr(f"schema_of_variant({v})").alias(_kind(v)) for v in values])
    shared = kinds.select("*", *[F.expr(sql(v)).alias(name(v)) for v in values for sql, name in _SHARED])
    return shared.withColumns({_text(v): F.nullif(F.col(_text(v)), F.lit("")) for v in values})


def _number_sql(value: str) -> str:
    # BIGINT, DOUBLE, FLOAT and any DECIMAL.
    return (
        f"CASE WHEN left({_kind(value)}, 3) IN ('BIG', 'DOU', 'FLO', 'DEC') "
        f"THEN try_variant_get({value}, '$', 'double') END"
    )


def _text_sql(value: str) -> str:
    return f"CASE WHEN {_kind(value)} = 'STRING' THEN try_variant_get({value}, '$', 'string') END"


_SHARED = ((_number_sql, _number), (_text_sql, _text))


def is_object(value: str) -> Column:
    # The kind of an object spells out all its fields.
    return F.expr(f"try_variant_get({value}, '$', 'struct<>') IS NOT NULL")


def as_string(value: str) -> Column:
    """A non-empty JSON string; numbers and booleans are not strings."""
    return F.col(_text(value))


def as_true(value: str) -> Column:
    """True only for the JSON literal ``true``."""
    return F.expr(
        f"coalesce({_kind(value)} = 'BOOLEAN' AND try_variant_get({value}, '$', 'boolean'), false)"
    )


def as_count(value: str) -> Column:
    """A finite, non-negative JSON number rounded down; null above ``MAX_COUNT``, which
    makes the line malformed; anything else counts as zero."""
    number = _number(value)
    return F.expr(
        f"CASE WHEN {number} >= 0 AND {number} < double('Infinity') "
        f"THEN if({number} <= {MAX_COUNT}, floor({number}), NULL) ELSE 0L END"
    )


def as_timestamp(value: str) -> Column:
    """Unix seconds of a date string or an epoch number in seconds or milliseconds; null
    outside the years 1 to 9999."""
    number, text = _number(value), _text(value)
    seconds = f"if({number} > {MILLISECONDS_FROM}, {number} / 1000, {number})"
    return F.expr(
        f"CASE WHEN {seconds} BETWEEN {FIRST_SECOND} AND {LAST_SECOND} "
        f"THEN cast(floor({seconds}) AS bigint) "
        f"WHEN {text} RLIKE r'{ISO_TIMESTAMP}' THEN unix_seconds(try_cast({text} AS timestamp)) "
        f"WHEN {text} RLIKE r'{HTTP_TIMESTAMP}' "
        f"THEN unix_seconds(try_to_timestamp(substring({text}, 6), 'd MMM yyyy HH:mm:ss zzz')) "
        f"WHEN {text} RLIKE r'{SLASHED_TIMESTAMP}' THEN unix_seconds(coalesce("
        f"try_to_timestamp({text}, 'yyyy/M/d HH:mm:ss'), try_to_timestamp({text}, 'yyyy/M/d'))) END"
    )


def first_non_null(*values: Column) -> Column:
    """The first value that is neither absent nor JSON ``null``."""
    return F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in values])
