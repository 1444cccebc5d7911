"""Context limits and prices per model key.

The first key found inside a model name wins, so the order is part of the data.
"""

from __future__ import annotations

# Fixed values: (key, context limit, USD per million input tokens, USD per million output tokens).
MODELS = (
    ("claude-opus-4.6", 1000000, 5.0, 25.0),
    ("claude-opus-4.5", 200000, 5.0, 25.0),
    ("claude-opus-4.1", 200000, 15.0, 75.0),
    ("claude-opus-4", 200000, 15.0, 75.0),
    ("claude-sonnet-4.6", 1000000, 3.0, 15.0),
    ("claude-sonnet-4.5", 1000000, 3.0, 15.0),
    ("claude-sonnet-4", 1000000, 3.0, 15.0),
    ("claude-haiku-4.5", 200000, 1.0, 5.0),
    ("claude-haiku-4", 200000, 0.8, 4.0),
    ("claude-3-7-sonnet", 200000, 3.0, 15.0),
    ("claude-3-5-sonnet", 200000, 3.0, 15.0),
    ("claude-3-5-haiku", 200000, 0.8, 4.0),
    ("claude-3-haiku", 200000, 0.25, 1.25),
    ("claude-3-opus", 200000, 15.0, 75.0),
    ("gpt-5.2-pro", 272000, 21.0, 168.0),
    ("gpt-5.2-codex", 272000, 1.75, 14.0),
    ("gpt-5.2-chat", 128000, 1.75, 14.0),
    ("gpt-5.2", 272000, 1.75, 14.0),
    ("gpt-5.1-codex-max", 272000, 1.25, 10.0),
    ("gpt-5.1-codex-mini", 272000, 0.25, 2.0),
    ("gpt-5.1-codex", 272000, 1.25, 10.0),
    ("gpt-5.1-chat", 128000, 1.25, 10.0),
    ("gpt-5.1", 272000, 1.25, 10.0),
    ("gpt-5.3-codex", 272000, 1.75, 14.0),
    ("gpt-5-pro", 128000, 15.0, 120.0),
    ("gpt-5-codex", 272000, 1.25, 10.0),
    ("gpt-5-chat", 128000, 1.25, 10.0),
    ("gpt-5-mini", 272000, 0.25, 2.0),
    ("gpt-5-nano", 272000, 0.05, 0.4),
    ("gpt-5", 272000, 1.25, 10.0),
    ("gpt-4.1-mini", 1047576, 0.4, 1.6),
    ("gpt-4.1-nano", 1047576, 0.1, 0.4),
    ("gpt-4.1", 1047576, 2.0, 8.0),
    ("gpt-4o-mini", 128000, 0.15, 0.6),
    ("gpt-4o", 128000, 2.5, 10.0),
    ("gpt-4-turbo", 128000, 10.0, 30.0),
    ("gpt-4", 8192, 30.0, 60.0),
    ("gpt-3.5-turbo", 16385, 0.5, 1.5),
    ("o4-mini-deep-research", 200000, 2.0, 8.0),
    ("o4-mini-high", 200000, 1.1, 4.4),
    ("o4-mini", 200000, 1.1, 4.4),
    ("o3-deep-research", 200000, 10.0, 40.0),
    ("o3-pro", 200000, 20.0, 80.0),
    ("o3-mini-high", 200000, 1.1, 4.4),
    ("o3-mini", 200000, 1.1, 4.4),
    ("o3", 200000, 2.0, 8.0),
    ("o1-pro", 200000, 150.0, 600.0),
    ("o1-mini", 128000, 1.1, 4.4),
    ("o1", 200000, 15.0, 60.0),
    ("gemini-3.1-pro-preview", 1048576, 2.0, 12.0),
    ("gemini-3-pro-preview", 1048576, 2.0, 12.0),
    ("gemini-3-flash-preview", 1048576, 0.5, 3.0),
    ("gemini-2.5-pro-preview", 1048576, 1.25, 10.0),
    ("gemini-2.5-pro", 1048576, 1.25, 10.0),
    ("gemini-2.5-flash-lite", 1048576, 0.1, 0.4),
    ("gemini-2.5-flash", 1048576, 0.3, 2.5),
    ("gemini-2.0-flash-lite", 1048576, 0.075, 0.3),
    ("gemini-2.0-flash", 1048576, 0.1, 0.4),
    ("gemini-1.5-pro", 2097152, 1.25, 5.0),
    ("gemini-1.5-flash", 1048576, 0.075, 0.3),
    ("minimax-m2.5", 1000000, 0.8, 8.0),
    ("minimax-m2.5-fast", 1000000, 0.4, 4.0),
)

# Key prefix -> (cache read, cache write) as a share of the input price.
CACHE_SHARES = (("claude-", 0.1, 1.25), ("gemini-", 0.25, 0.0))

DEFAULT_CONTEXT_LIMIT = 128000
