"""Routing constants."""

from __future__ import annotations

# First path segments that belong to an API, never to a source tag.
API_SEGMENTS = (
    "v1", "v1beta", "v1alpha", "v1internal", "responses", "chat",
    "models", "embeddings", "backend-api", "api", "codex",
)

# Header names that are never kept, compared in lower case.
SENSITIVE_HEADERS = (
    "authorization", "x-api-key", "cookie", "set-cookie", "x-target-url",
    "proxy-authorization", "x-auth-token", "x-forwarded-authorization",
    "www-authenticate", "proxy-authenticate", "x-goog-api-key",
)

# Default upstream per provider.
UPSTREAMS = {
    "openai": "https://api.openai.com",
    "anthropic": "https://api.anthropic.com",
    "chatgpt": "https://chatgpt.com",
    "gemini": "https://generativelanguage.googleapis.com",
    "gemini_code_assist": "https://cloudcode-pa.googleapis.com",
    "vertex": "https://us-central1-aiplatform.googleapis.com",
}

LOOPBACK_PEERS = ("127.0.0.1", "::1", "::ffff:127.0.0.1")
