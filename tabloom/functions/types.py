"""Logical types of columns: how they are recognised and which number or text stands for a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, STRING, DATETIME, SSN = "Integer", "Float", "String", "DateTime", "SocialSecurityNumber"
NUMERICAL = (INTEGER, FLOAT, DATETIME, SSN)

# Names that are words, not dates.
DAYS_AND_MONTHS = (
    "mon", "monday", "tue", "tuesday", "wed", "wednesday", "thu", "thursday", "fri", "friday", "sat", "saturday", "sun", "sunday",
    "jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august",
    "sep", "sept", "september", "oct", "october", "nov", "november", "dec", "december",
)
# Months by the letters that tell them apart, and the first year of two digits that is 19xx.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
CENTURY = 69

_SEP, _NAME = "[-/. ]", "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_LEAD = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]? +)?"
_TIME = "(?:[t ,] *([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:[.,][0-9]{1,6})?)[0-9]*)? *(am|pm)? *(?:z|utc|gmt|([+-][0-9]{2}):?([0-9]{2}))?)?"
#: How a date may be written, in lower case: its pattern, and where in that year, month and day are. A time may follow.
DATE_FORMS = (
    (f"([0-9]{{4}}){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{1,2}})", (1, 2, 3)),
    (f"([0-9]{{1,2}}){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{4}}|[0-9]{{2}})", (3, 1, 2)),
    (f"([0-9]{{1,2}})(?:st|nd|rd|th)?[-/. ,]*{_NAME}[-/. ,]*([0-9]{{4}}|[0-9]{{2}})", (3, 2, 1)),
    (f"{_NAME}[-/. ]*([0-9]{{1,2}})(?:st|nd|rd|th)?[-/. ,]+([0-9]{{4}})", (3, 1, 2)),
    (f"([0-9]{{4}})[-/. ,]*{_NAME}[-/. ,]*([0-9]{{1,2}})", (1, 2, 3)),
)


def _moment(parts: Column) -> Column:
    """The time that (year, month, day, hour, minute, second, half, hours and minutes of the zone) tell, as texts; null if there is none."""

    def number(k: int) -> Column:
        return F.when(F.length(F.get(parts, k)) > 0, F.get(parts, k).cast("int"))  # digits, or nothing: a failing cast is slow

    name, year = F.get(parts, 1), number(0)
    digits = name.rlike("^[0-9]+$")
    year = F.when(F.length(F.get(parts, 0)) == 4, year).when(year < CENTURY, year + 2000).otherwise(year + 1900)
    month = F.when(digits, name.cast("int")).otherwise(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int"))
    swapped = digits & (month > 12)  # the month comes first unless it cannot
    month, day = F.when(swapped, number(2)).otherwise(month), F.when(swapped, month).otherwise(number(2))
    hour, half = F.coalesce(number(3), F.lit(0)), F.get(parts, 6)
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    second = F.when(F.length(F.get(parts, 5)) > 0, F.replace(F.get(parts, 5), F.lit(","), F.lit(".")).cast("decimal(8,6)")).otherwise(F.lit(0).cast("decimal(8,6)"))
    east = number(7) * 60 + F.when(F.get(parts, 7).startswith("-"), -number(8)).otherwise(number(8))
    local = F.try_make_timestamp(year, month, day, hour, F.coalesce(number(4), F.lit(0)), second)
    return F.when(east.isNull(), local).otherwise(F.timestamp_micros(F.unix_micros(local) - F.coalesce(east, F.lit(0)).cast("bigint") * 60_000_000))


def parsed_date(x: Column) -> Column:
    """The time of a text that is a date in one of the forms, else null.

    A text is parsed only where the pattern of a form matches it as a whole.
    """
    def parts(low: Column) -> Column:
        found = []
        for form, (y, m, d) in DATE_FORMS:
            whole = f"^{_LEAD}{form}{_TIME}$"
            order = "|".join(f"${k}" for k in (y, m, d, 4, 5, 6, 7, 8, 9))
            found.append(F.when(low.rlike(whole), F.split(F.regexp_replace(low, whole, order), "[|]", -1)))
        return F.coalesce(*found)

    # As arguments of lambdas the text and its parts are computed once each.
    split = F.transform(F.array(F.lower(F.trim(x))), parts)
    return F.get(F.transform(split, lambda p: F.when(p.isNotNull(), _moment(p))), 0)


def is_datetime(x: Column) -> Column:
    """Whether a text is a date; null for null."""
    dated = F.coalesce(F.when(x.rlike("[0-9]"), parsed_date(x).isNotNull()), F.lit(False))
    return F.when(x.isNotNull(), ~F.lower(x).isin(*DAYS_AND_MONTHS) & dated)


def ssn_number(x: Column) -> Column:
    """The number of a social security number, without dashes; null if it is none."""
    digits = F.replace(x, F.lit("-"), F.lit(""))
    return F.when(digits.rlike("^[0-9]{1,18}$"), digits.cast("bigint"))


def is_ssn(x: Column) -> Column:
    return F.coalesce(ssn_number(x).between(1, 999_999_999), F.lit(False))


def ssn_text(number: Column) -> Column:
    nine = F.lpad(number.cast("string"), 9, "0")
    return F.concat(F.substring(nine, 1, 3), F.lit("-"), F.substring(nine, 4, 2), F.lit("-"), F.substring(nine, 6, 4))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def reject_nested(schema: T.StructType) -> None:
    """Tables are flat: nested and binary columns are an error."""
    bad = [f.name for f in schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if bad:
        raise TypeError(f"columns must be flat; these are not: {', '.join(bad)}")


def as_text(x: Column, kind: T.DataType) -> Column:
    """The text of a value where it is a category: whole doubles print like integers' text would not."""
    return x.cast("string")


def as_number(x: Column, kind: T.DataType, logical: str) -> Column:
    """The number that domains, histograms and codes of a column are made of; of a String its length."""
    if logical == STRING:
        return F.char_length(x.cast("string")).cast("bigint")
    if logical == SSN:
        return ssn_number(x) if isinstance(kind, T.StringType) else x.cast("bigint")
    if logical == DATETIME:
        if isinstance(kind, T.StringType):
            return F.unix_timestamp(parsed_date(x)).cast("bigint")
        return F.unix_timestamp(x.cast("timestamp")).cast("bigint") if is_time(kind) else x.cast("bigint")
    return x.cast("bigint") if logical == INTEGER else x.cast("double")
