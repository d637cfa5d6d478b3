"""Stable error codes: [FW-CCDDD] SYMBOL: message."""

from __future__ import annotations

#: Symbols and their codes.
CODES = {
    "INVALID_SQL": "01001", "INVALID_PARAMETER": "01002", "UNSUPPORTED_QUERY": "01003", "FEATURE_NOT_AVAILABLE": "01004", "OBJECT_NOT_FOUND": "02001", "OBJECT_ALREADY_EXISTS": "02002",
    "CATALOG_CONFLICT": "02003", "MODEL_NOT_RESOLVED": "03001", "MODEL_RUNTIME_FAILED": "03002", "MEDIA_DECODE_FAILED": "04001", "SOURCE_FAILED": "04002", "SINK_FAILED": "05001",
    "FUNCTION_FAILED": "06001", "RESOURCE_EXHAUSTED": "07001", "CANCELLED": "07002", "INTERNAL": "09001",
}


class EngineError(Exception):
    """An error with a stable symbol."""

    def __init__(self, symbol: str, message: str):
        self.symbol, self.code = symbol, CODES[symbol]
        super().__init__(f"[FW-{self.code}] {symbol}: {message}")
