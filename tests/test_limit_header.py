"""The token limit follows the provider's answers."""

from __future__ import annotations

import pytest

from riffle.operators import providers


@pytest.mark.parametrize(("headers", "tasks", "limit"), [
    ({"X-RateLimit-Limit-Tokens": "6000"}, 1, 6000), ({"x-ratelimit-limit-tokens": "6000"}, 4, 1500),
    ({}, 1, 900), ({"x-ratelimit-limit-tokens": "soon"}, 1, 900), ({"x-ratelimit-limit-tokens": "0"}, 1, 900),
])
def test_chat_learns_the_limit(headers, tasks, limit):
    lim = providers.Limiter(900, tasks=tasks, sleep=lambda s: None)
    chat = providers.Chat(lambda p: (200, headers, '{"summary": "s", "relevance": 1, "category": "rumor", "language": "en"}'), "m", lim)
    chat.answer("t", "b", "en", "g", "media")
    assert lim.limit == limit
