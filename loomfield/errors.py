"""Stable error and warning codes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

# The codes that callers match on.
ERRORS = (
    "INPUT_PATH_REQUIRED",
    "INPUT_NOT_FOUND",
    "INPUT_NOT_FILE",
    "UNSUPPORTED_EXTENSION",
    "INPUT_UNREADABLE",
    "INVALID_XLSX",
    "ENCRYPTED_OR_PROTECTED_WORKBOOK",
    "OUTPUT_PARENT_UNWRITABLE",
    "OUTPUT_COLLISION_RAW_MISMATCH",
    "OUTPUT_COLLISION_INVALID_STATE",
    "RAW_ARCHIVE_COPY_FAILED",
    "RAW_ARCHIVE_HASH_MISMATCH",
    "UNSUPPORTED_WORKBOOK_FEATURE",
    "RISKY_WORKBOOK_FEATURE",
    "UNCERTAIN_HEADER",
    "REPORT_GENERATION_FAILED",
    "LOG_GENERATION_FAILED",
    "POST_WRITE_VALIDATION_FAILED",
    "ATOMIC_PUBLISH_FAILED",
    "REPLAY_RAW_INPUT_MISSING",
    "INTERNAL_ERROR",
    "INVALID_INPUT",
    "API_ERROR",
    "TIMEOUT",
    "UNKNOWN_INTENT",
    "SKILL_FAILURE",
    "MISSING_COLUMN",
    "MALFORMED_ROW",
    "UNKNOWN_THEME",
)
WARNINGS = ("MERGED_CELLS_REVIEW", "FORMULAS_PRESERVED", "IDENTIFIER_PRESERVED", "MIXED_TYPES_REVIEW", "OUTLIERS_FLAGGED_NOT_MODIFIED", "MISSING_VALUES_NOT_IMPUTED", "NO_CROSS_SHEET_JOIN", "UNCERTAIN_HEADER", "UNSUPPORTED_FEATURE_REVIEW")


class EngineError(Exception):
    """code: one of ERRORS; source: what was read or written."""

    def __init__(self, code: str, message: str = "", source: str | None = None):
        if code not in ERRORS:
            raise ValueError(f"unknown code {code}")
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.message, self.source = code, message, source

    def envelope(self) -> dict:
        return {"status": "error", "error": {"code": self.code, "message": self.message, "source": self.source}}


@contextmanager
def failing_as(code: str, source: str | None = None) -> Iterator[None]:
    """What fails inside without a code of its own fails with this one."""
    try:
        yield
    except EngineError:
        raise
    except Exception as e:
        raise EngineError(code, str(e), source) from e


def success(**fields: object) -> dict:
    return {"status": "success", **fields}
