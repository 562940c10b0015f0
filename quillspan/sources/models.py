"""Language models behind an HTTP endpoint, as functions for the executors.

A client is a function ``complete(system, user) -> (text, input tokens, output tokens)``; it raises RuntimeError where
no usable answer comes, which ``operators.notes.extract`` turns into an error on the row. Nothing is opened before the
first call, so a client can be built on the driver and sent to the tasks.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request


def _post(url: str, payload: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read().decode())
    except (urllib.error.URLError, TimeoutError, ValueError) as e:
        raise RuntimeError(f"no answer from {url}: {e}") from e


def chat_completions(endpoint: str, model: str = "local-model", max_tokens: int = 16_000, timeout: float = 600.0):
    """A client of an endpoint in the chat-completions style."""

    def complete(system: str, user: str) -> tuple[str, int, int]:
        talk = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = _post(f"{endpoint.rstrip('/')}/chat/completions", {"model": model, "messages": talk, "temperature": 0.0, "max_tokens": max_tokens, "stream": False}, {}, timeout)
        try:
            text = body["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise RuntimeError(f"unexpected answer: {json.dumps(body)[:500]}") from e
        use = body.get("usage") or {}
        return text, int(use.get("prompt_tokens", 0)), int(use.get("completion_tokens", 0))

    return complete


def messages_api(endpoint: str, model: str, key_variable: str, headers: dict[str, str] | None = None, max_tokens: int = 16_000, timeout: float = 600.0, temperature: float | None = 0.0):
    """A client of an endpoint in the messages style; the key is read from the task's environment at the call."""

    def complete(system: str, user: str) -> tuple[str, int, int]:
        key = os.environ.get(key_variable)
        if not key:
            raise RuntimeError(f"the environment variable {key_variable} is not set")
        payload = {"model": model, "max_tokens": max_tokens, "system": system, "messages": [{"role": "user", "content": user}]}
        payload |= {} if temperature is None else {"temperature": temperature}
        body = _post(f"{endpoint.rstrip('/')}/messages", payload, {"x-api-key": key} | (headers or {}), timeout)
        if not isinstance(body.get("content"), list):
            raise RuntimeError(f"unexpected answer: {json.dumps(body)[:500]}")
        use = body.get("usage") or {}
        text = "".join(b.get("text", "") for b in body["content"] if isinstance(b, dict) and b.get("type") == "text")
        return text, int(use.get("input_tokens", 0)), int(use.get("output_tokens", 0))

    return complete


def build(provider: str, **settings):
    """The client of a provider by name: ``local`` or ``hosted``."""
    makers = {"local": chat_completions, "hosted": messages_api}
    if provider not in makers:
        raise RuntimeError(f"unknown provider: {provider}")
    return makers[provider](**settings)
