"""Content hash of a review."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed order of the hashed fields. Score and hotel name are not part of the identity.
HASHED_COLUMNS = ["hotel_url", "date", "title", "positive", "negative"]


def review_hash(*cols: Column) -> Column:
    """Hex MD5 over the fields joined without separator; a null field reads `None`."""
    fields = cols or tuple(F.col(c) for c in HASHED_COLUMNS)
    return F.md5(F.concat(*(F.coalesce(c, F.lit("None")) for c in fields)))
