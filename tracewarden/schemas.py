"""Schemas of the persisted tables."""

from __future__ import annotations

# One record per API call. Bodies of unknown shape are kept as JSON text and parsed on use.
CAPTURE = """
    timestamp string, sessionId string, method string, path string, source string,
    provider string, apiFormat string, targetUrl string,
    requestHeaders map<string,string>, requestBody variant, requestBytes long,
    responseStatus int, responseHeaders map<string,string>, responseBody string,
    responseIsStreaming boolean, responseBytes long,
    timings struct<send_ms: long, wait_ms: long, receive_ms: long, total_ms: long>
"""

# Engine-side names of the same record, flat.
CAPTURE_COLUMNS = {
    "timestamp": "ts",
    "sessionId": "session_id",
    "method": "method",
    "path": "path",
    "source": "source",
    "provider": "provider",
    "apiFormat": "api_format",
    "targetUrl": "target_url",
    "requestHeaders": "request_headers",
    "requestBytes": "request_bytes",
    "responseStatus": "response_status",
    "responseHeaders": "response_headers",
    "responseBody": "response_body",
    "responseIsStreaming": "response_is_streaming",
    "responseBytes": "response_bytes",
}
TIMINGS = ("send_ms", "wait_ms", "receive_ms", "total_ms")
