"""Clients of model services over HTTP, for predict.run(make_backend=...): a request by service kind, and the text of its answer.

Where a service is, and the key it asks for, are parameters; nothing here knows an address or reads the environment.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

Post = Callable[[str, dict, dict, float], dict]


@dataclass(frozen=True)
class Kind:
    """How one kind of service is asked: path, body and headers of a request, and where its answer has the text."""

    path: str
    body: Callable[[str, dict], dict]
    headers: Callable[[str], dict]
    text: Callable[[dict], str]


def _said(prompt: str) -> list[dict]:
    return [{"role": "user", "content": prompt}]


# The public request forms of the four kinds.
KINDS = {
    "openai": Kind(
        "/v1/chat/completions",
        lambda prompt, s: {"model": s["name"], "messages": _said(prompt), "temperature": s["temperature"], "max_tokens": s["max_tokens"]},
        lambda key: {"Authorization": f"Bearer {key}"},
        lambda got: got["choices"][0]["message"]["content"] or "",
    ),
    "anthropic": Kind(
        "/v1/messages",
        lambda prompt, s: {"model": s["name"], "messages": _said(prompt), "temperature": s["temperature"], "max_tokens": s["max_tokens"]},
        lambda key: {"x-api-key": key, "anthropic-version": "2023-06-01"},
        lambda got: "".join(part.get("text", "") for part in got["content"]),
    ),
    "ollama": Kind(
        "/api/generate",
        lambda prompt, s: {"model": s["name"], "prompt": prompt, "stream": False, "options": {"temperature": s["temperature"], "num_predict": s["max_tokens"]}},
        lambda key: {},
        lambda got: got.get("response", ""),
    ),
    "llama_cpp": Kind(
        "/completion",
        lambda prompt, s: {"prompt": prompt, "temperature": s["temperature"], "n_predict": s["max_tokens"]},
        lambda key: {},
        lambda got: got.get("content", ""),
    ),
}


def post_json(url: str, body: dict, headers: dict, timeout: float) -> dict:
    """Sends JSON and reads JSON; an HTTP error says its status, by which rate limits are known."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as got:
            return json.loads(got.read())
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.read()[:500].decode(errors='replace')}") from e


def client(settings: dict, base_url: str, api_key: str | None = None, timeout: float = 120.0, post: Post = post_json) -> Callable[[], Callable[[str], str]]:
    """What predict.run() takes as make_backend: a function, called once a partition, that gives a function of a prompt.

    settings: name, backend, temperature and max_tokens, as predict.model_settings() gives them.
    """
    if settings["backend"] not in KINDS:
        raise ValueError(f"unknown backend {settings['backend']!r}; there are {', '.join(KINDS)}")
    kind = KINDS[settings["backend"]]
    headers = kind.headers(api_key or "")
    if headers and not api_key:
        raise ValueError(f"{settings['backend']} needs a key")

    def make() -> Callable[[str], str]:
        return lambda prompt: kind.text(post(base_url.rstrip("/") + kind.path, kind.body(prompt, settings), headers, timeout))

    return make
