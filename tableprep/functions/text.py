"""Text normalisation as one nested expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns the results depend on.
WHITESPACE_RUN = r"\s+"
UNWANTED_CHARACTERS = r"[^a-zA-Z0-9\s/:.-]"

# Unicode whitespace plus the four separator controls that Python also strips.
UNICODE_SPACE = r"[\s\x1c-\x1f]"


def normalize_text(
    column: Column, unicode_ws: bool = False, squeeze_after: bool = False
) -> Column:
    """Lower-case, trim, collapse whitespace, then remove special characters.

    Special characters go last, so ``"a & b"`` keeps two spaces and ``"&&&"``
    becomes the empty string. ``squeeze_after`` collapses and trims once more.
    ``unicode_ws`` trims and collapses every Unicode space instead of the
    ASCII ones (where trimming touches the space character only).
    """
    text = F.lower(column)
    if unicode_ws:
        text = F.regexp_replace(text, f"(?U)^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")
        text = F.regexp_replace(text, f"(?U){UNICODE_SPACE}+", " ")
    else:
        text = F.regexp_replace(F.trim(text), WHITESPACE_RUN, " ")
    text = F.regexp_replace(text, UNWANTED_CHARACTERS, "")
    if squeeze_after:
        text = F.trim(F.regexp_replace(text, WHITESPACE_RUN, " "))
    return text
