"""A summariser over HTTP: one prompt in, one text out, every way to fail with an error of its own."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass


class CompletionError(RuntimeError):
    """No text came back."""


class TransportError(CompletionError):
    """The service wasn't reached."""


class NotJson(CompletionError):
    """The service answered with something else than JSON."""


class ServiceError(CompletionError):
    """The service reported an error."""


class Refused(CompletionError):
    """The model declined."""


class EmptyAnswer(CompletionError):
    """The answer holds no text."""


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> bytes:
    request = urllib.request.Request(url, body, headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        return e.read()


@dataclass(frozen=True)
class Completion:
    """A callable that sends a prompt to a messages endpoint and returns the text of the answer."""

    url: str
    key: str
    model: str
    key_header: str = "x-api-key"
    headers: tuple[tuple[str, str], ...] = ()
    max_tokens: int = 4096
    timeout: float = 120
    send: Callable[[str, bytes, dict[str, str], float], bytes] = post

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("the key for the summariser is not set")

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}]}
        try:
            raw = self.send(self.url, json.dumps(body).encode(), {"content-type": "application/json", self.key_header: self.key, **dict(self.headers)}, self.timeout)
        except OSError as e:
            raise TransportError(str(e)) from e
        try:
            answer = json.loads(raw)
        except ValueError as e:
            raise NotJson(raw[:200].decode(errors="replace")) from e
        if not isinstance(answer, dict):
            raise NotJson(raw[:200].decode(errors="replace"))
        if error := answer.get("error"):
            raise ServiceError(str(error.get("message", error) if isinstance(error, dict) else error))
        if answer.get("stop_reason") == "refusal":
            raise Refused("the model declined")
        text = "".join(p.get("text", "") for p in answer.get("content") or [] if p.get("type") == "text")
        if not text.strip():
            raise EmptyAnswer("the answer holds no text")
        return text
