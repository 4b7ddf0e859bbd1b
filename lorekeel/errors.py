"""Typed errors: every failure carries one of the protocol's codes."""

from __future__ import annotations

#: Fixed values of the result protocol.
ERROR_CODES = frozenset(
    """AMBIGUOUS_FOLDER CONFIGURATION_REQUIRED DUPLICATE_ALIAS DUPLICATE_FOLDER_ID EXTRACTION_FAILED
    EXTRACTION_LIMIT_EXCEEDED FOLDER_NOT_FOUND INDEX_MODEL_MISMATCH INDEX_ROLLBACK_FAILED INDEX_STALE
    INDEX_WRITE_FAILED INVALID_ALIAS INVALID_ARGUMENTS INVALID_ARTIFACT INVALID_DESCRIPTOR INVALID_EXTRACTION
    INVALID_FOLDER_ID INVALID_FOLDER_URL INVALID_INDEX_INPUT INVALID_INVENTORY INVALID_JOURNAL INVALID_REQUEST
    INVALID_SCHEDULE_RECORD INVALID_STATE INVALID_STATE_ROOT INVALID_STRUCTURED_CONTENT INVENTORY_INCOMPLETE
    NO_RELEVANT_EVIDENCE OCR_FAILED SCHEDULE_IDENTITY_MISMATCH STATE_READ_FAILED STATE_WRITE_FAILED
    UNEXPECTED_ERROR UNSAFE_PATH UNSUPPORTED_FORMAT UNSUPPORTED_SCHEMA""".split()
)
#: Codes that leave a file unindexed without stopping the run.
DEGRADING = frozenset({"UNSUPPORTED_FORMAT", "EXTRACTION_LIMIT_EXCEEDED"})
RESULT_STATUSES = frozenset(
    """SYNC_OK_CHANGED SYNC_OK_NO_CHANGES PARTIAL_INDEX INDEX_STALE CONFIGURATION_REQUIRED INVENTORY_INCOMPLETE
    NO_RELEVANT_EVIDENCE CONNECTOR_UNAVAILABLE CONNECTOR_AUTH_REQUIRED NOT_SCHEDULED OK""".split()
)


class CorpusError(Exception):
    """A typed failure; ``code`` is one of ERROR_CODES."""

    def __init__(self, message: str, code: str):
        if code not in ERROR_CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(message)
        self.code = code
