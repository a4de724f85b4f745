"""Summaries of files by language-model services, as a registry of providers.

A provider makes a summarizer of (path, text) from a run's settings. Those here speak the public HTTP
interfaces of three services with the standard library alone; keys and addresses come from the
environment of the executors. A request is tried again after a pause where the service is busy or not
reached; what fails in the end, and a provider that isn't known, gives the file's first line.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Protocol

from .. import config

#: Turns (path, text) into a summary.
Summarizer = Callable[[str, str], str | None]
#: Letters of a file that are sent, and letters of a first line that stands for a summary.
SENT, SHOWN = 8000, 120


class Provider(Protocol):
    def __call__(self, settings: config.Config) -> Summarizer: ...


class ProviderError(Exception):
    """A service that gave no summary."""


def first_line(path: str, text: str | None, plain: bool = False) -> str | None:
    """What stands for a summary where there is none. ``plain``: as in SQL, where lines end with a line feed
    and no other sign, only spaces and tabs are blank, and a text without such a line has no summary."""
    lines, blanks = ((text or "").split("\n"), " \t") if plain else ((text or "").splitlines(), None)
    line = next((x for x in (x.strip(blanks) for x in lines) if x), None if plain else "empty file")
    return None if line is None else f"{path}: {line[:SHOWN]}"


def prompt(path: str, text: str) -> str:
    return f"In two to four short lines, say what this file does.\nFile: {path}\n\n{text[:SENT]}"


@dataclass(frozen=True)
class Service:
    """A chat service: where it is, what a request has, and where its answer stands."""

    model: str
    address: str
    address_variable: str
    key_variable: str
    headers: Callable[[str], dict[str, str]]
    body: Callable[[str, str, int], dict[str, Any]]
    answer: Callable[[dict[str, Any]], str]
    attempts: int = 3
    pause: float = 1.0
    timeout: float = 30.0

    def __call__(self, settings: config.Config) -> Summarizer:
        def summarize(path: str, text: str) -> str:
            url = os.environ.get(self.address_variable, "").rstrip("/") or self.address
            body = json.dumps(self.body(settings.llm_model or self.model, prompt(path, text), settings.llm_max_tokens)).encode()
            headers = {"content-type": "application/json"} | self.headers(os.environ.get(self.key_variable, ""))
            return self._answer(urllib.request.Request(url, body, headers))

        return summarize

    def _answer(self, request: urllib.request.Request) -> str:
        for left in reversed(range(self.attempts)):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as got:
                    return self.answer(json.load(got)).strip()
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or not left:
                    raise ProviderError(f"{e.code} {e.reason}") from e
            except (OSError, ValueError, KeyError, IndexError, TypeError) as e:
                if not left:
                    raise ProviderError(str(e)) from e
            time.sleep(self.pause * (self.attempts - left))
        raise ProviderError("no attempt")


def _chat(model: str, text: str, most: int) -> dict[str, Any]:
    return {"model": model, "max_tokens": most, "temperature": 0, "messages": [{"role": "user", "content": text}]}


#: Makers of summarizers by name; more can be added. Default models and public addresses.
PROVIDERS: dict[str, Provider] = {
    "openai": Service("gpt-4o-mini", "https://api.openai.com/v1/chat/completions", "OPENAI_BASE_URL", "OPENAI_API_KEY", lambda k: {"authorization": f"Bearer {k}"}, _chat, lambda x: x["choices"][0]["message"]["content"]),
    "anthropic": Service("claude-3-5-haiku-latest", "https://api.anthropic.com/v1/messages", "ANTHROPIC_BASE_URL", "ANTHROPIC_API_KEY", lambda k: {"x-api-key": k, "anthropic-version": "2023-06-01"}, _chat, lambda x: x["content"][0]["text"]),
    "ollama": Service("llama3.1:8b", "http://localhost:11434/api/chat", "OLLAMA_BASE_URL", "OLLAMA_API_KEY", lambda k: {}, lambda m, t, n: {"model": m, "stream": False, "options": {"num_predict": n}, "messages": [{"role": "user", "content": t}]}, lambda x: x["message"]["content"]),
}


def summarizer(settings: config.Config, instead: Summarizer = first_line) -> Summarizer:
    """The run's provider, with the first line (``instead``) in place of what fails, and of an unknown one."""
    maker = PROVIDERS.get(settings.llm_provider)
    own = maker(settings) if maker else None

    def summarize(path: str, text: str) -> str:
        try:
            return (own(path, text) if own else "") or instead(path, text)
        except Exception:  # noqa: BLE001  a provider's failure ends no run
            return instead(path, text)

    return summarize


#: Requests that a task has under way at once.
AT_ONCE = 4


def together(summarize: Summarizer, paths: Iterable[str], texts: Iterable[str], at_once: int = AT_ONCE) -> list[str]:
    """A batch's summaries in its order, so many at once."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(summarize, paths, texts))
