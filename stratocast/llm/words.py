"""Text helpers shared by the operators of this package (JVM expressions)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# what separates words of letters, digits and everything outside ASCII
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty string.

    ``lower`` also changes letters outside ASCII, so it is used only where a
    text has as many bytes as characters.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """Lower-cased words of a text in order (null: none).

    Splitting is linear in the text; ``regexp_extract_all`` copies the whole
    text for each match.
    """
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")
