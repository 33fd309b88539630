"""Column expressions."""

from tableprep.functions.missing import finite, is_missing, is_valid, present
from tableprep.functions.names import quoted
from tableprep.functions.text import normalize_text

__all__ = ["finite", "is_missing", "is_valid", "normalize_text", "present", "quoted"]
