"""Review scores and the compound sentiment derived from them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCORE_VALUE = r"(\d+(\.\d+)?)"
_SCORE_TEXT = r"(\d+[.,]?\d*)"


def extract_score(raw: Column) -> Column:
    """First number in a text, as text, decimal comma turned into a point; else '0'."""
    found = F.regexp_extract(F.replace(raw, F.lit(","), F.lit(".")), _SCORE_TEXT, 1)
    return F.coalesce(F.when(found != "", found), F.lit("0"))


def _to_ten(number: Column) -> Column:
    """Scores in (10, 100] are on a 100 scale; anything above 100 passes unchanged."""
    return F.when((number > 10) & (number <= 100), number / 10).otherwise(number)


def normalize_score(text: Column) -> Column:
    """First unsigned number in a score text on the 10-point scale; null if there is none."""
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), _SCORE_VALUE, 1)
    return _to_ten(found.try_cast("double"))


def normalize_score_number(value: Column) -> Column:
    """The same rule for a numeric column: large doubles must not pass through text,
    where Spark would write them with an exponent. NaN is no number: null."""
    return _to_ten(F.nanvl(F.abs(value.cast("double")), F.lit(None).cast("double")))


def compound_sentiment(positive: Column, negative: Column) -> Column:
    return positive - negative


def compound_proxy(score: Column) -> Column:
    """Score on the 10-point scale mapped to about [-1, 1]; a missing score counts as 5."""
    return (F.coalesce(score, F.lit(5.0)) - 5) / 5
