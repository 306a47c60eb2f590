"""Keys and tokens of any length are redacted whole."""

import random

import pytest

from tidemark.llm import pii


def token(n):
    r = random.Random(n)
    body = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(n))
    return f"eyJhbGciOiJIUzI1NiJ9.{body[: n // 2]}.{body[n // 2 :]}"


@pytest.mark.parametrize("n", [40, 180, 200, 300, 1000, 5000])
def test_nothing_of_a_long_token_stays(n):
    text = f'send it with token = "{token(n)}" and go on'
    (_, spans), *_ = pii.all_spans([text], pii.trained())
    assert pii.redact(text, spans) == 'send it with token = "[SECRET]" and go on'


def test_a_long_run_is_read_once():
    assert len(pii.candidates("a1" * 500_000)) <= 1
