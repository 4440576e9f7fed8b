"""Review dates in Spanish and English, absolute forms only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from guestlens.functions.binding import bind
from guestlens.functions.text import strip

# Prefixes put before a date by the review pages.
DATE_PREFIXES = ["comentó el:", "reviewed:"]

# Month and weekday names in Spanish and English.
SPANISH_MONTHS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
ENGLISH_MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
WEEKDAYS = [
    "lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
]


def month_numbers() -> dict[str, int]:
    """Month names, their three-letter forms, and the usual longer short forms."""
    numbers = {"sept": 9, "set": 9, "setiembre": 9}
    for names in (SPANISH_MONTHS, ENGLISH_MONTHS):
        for number, name in enumerate(names, start=1):
            numbers[name] = number
            numbers[name[:3]] = number
    return numbers


_WEEKDAY = rf"^(?:{'|'.join(WEEKDAYS)}),?\s+"
# A time of day after the date is allowed and ignored.
_TIME = r"(?:,?[t\s]\s*(?:at\s+|a\s+las\s+)?\d{1,2}:\d{2}.*)?$"
_YEAR = r"(\d{4}|\d{2})"
_DAY_FIRST = rf"^(\d{{1,2}})(?:st|nd|rd|th)?[\s\-]+(?:de\s+)?(\p{{L}}+)\.?,?[\s\-]+(?:del?\s+)?{_YEAR}{_TIME}"
_MONTH_FIRST = rf"^(\p{{L}}+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TIME}"
_ISO = rf"^(\d{{4}})[/.\-](\d{{1,2}})[/.\-](\d{{1,2}}){_TIME}"
_NUMERIC = rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-]{_YEAR}{_TIME}"

_SEPARATOR = "\u0001"  # cannot be typed into a date text


def _joined(*groups: int) -> str:
    return _SEPARATOR.join(f"${g}" for g in groups)


def parse_review_date(raw: Column) -> Column:
    """Date of a review text, null when blank or in no accepted form.

    Accepted: `3 de octubre de 2023`, `20 Oct 23`, `October 20, 2023`, `2023-10-20`,
    `2023/10/20`, `20/10/2023` (day first; month first only when the day-first reading is
    no date), each with or without a time of day. Years of two digits lie within 1969 to
    2068, as in POSIX.
    """
    text = F.lower(raw)
    for prefix in DATE_PREFIXES:
        text = F.replace(text, F.lit(prefix), F.lit(""))
    text = F.regexp_replace(strip(text), _WEEKDAY, "")
    # Every form is rewritten to year, month, day, so each pattern runs once per row.
    ordered = F.regexp_replace(text, _DAY_FIRST, _joined(3, 2, 1))
    ordered = F.regexp_replace(ordered, _MONTH_FIRST, _joined(3, 1, 2))
    ordered = F.regexp_replace(ordered, _ISO, _joined(1, 2, 3))
    ordered = F.regexp_replace(ordered, _NUMERIC, _joined(3, 2, 1) + _SEPARATOR + "numeric")
    listed = ",".join(f"{name}:{number}" for name, number in month_numbers().items())
    months = F.str_to_map(F.lit(listed), F.lit(","), F.lit(":"))  # folds to a constant

    def resolve(parts: Column) -> Column:
        year, middle, last = (F.get(parts, F.lit(i)) for i in range(3))
        short = year.try_cast("int") + F.when(year.try_cast("int") < 69, 2000).otherwise(1900)
        year = F.when(F.length(year) == 2, short.cast("string")).otherwise(year)
        month = F.coalesce(F.try_element_at(months, middle), middle)
        found = F.try_to_date(F.concat_ws("-", year, month, last), "y-M-d")
        swapped = F.when(F.size(parts) == 4, F.try_to_date(F.concat_ws("-", year, last, middle), "y-M-d"))
        return F.when(F.size(parts) >= 3, F.coalesce(found, swapped))

    return bind(F.split(ordered, _SEPARATOR), resolve)


def month_end(date: Column) -> Column:
    return F.last_day(date)
