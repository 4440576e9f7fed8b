"""Text cleaning and tokenising."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it plus the four ASCII separators FS, GS, RS, US.
# (?U) is needed because Java's \s is ASCII otherwise.
_BLANK = r"[\s\x1c-\x1f]"
_BLANK_RUN = rf"(?U){_BLANK}+"

# The same characters one by one.
_BLANKS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000])
)

# Letters, digits or underscores; apostrophes allowed after the first.
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"


def null_to_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim any Unicode white space, unlike `trim`, which only knows the space."""
    return F.trim(col, F.lit(_BLANKS))


def clean_text(col: Column) -> Column:
    """Lower case, white-space runs become one space, edges trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.lower(null_to_empty(col)), _BLANK_RUN, " "))


def full_review_text(title: Column, positive: Column, negative: Column) -> Column:
    """Title, positive and negative joined by single spaces; nulls count as ''."""
    return strip(F.concat_ws(" ", *(null_to_empty(c) for c in (title, positive, negative))))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


def body_fallback(positive: Column, negative: Column, body: Column) -> Column:
    """The positive text; the generic body when positive and negative are both empty."""
    empty = (null_to_empty(positive) == "") & (null_to_empty(negative) == "")
    return F.when(empty & (null_to_empty(body) != ""), body).otherwise(positive)


def has_empty_body(positive: Column, negative: Column) -> Column:
    """Both texts null or ''. A blank such as ' ' counts as text."""
    return (null_to_empty(positive) == "") & (null_to_empty(negative) == "")
