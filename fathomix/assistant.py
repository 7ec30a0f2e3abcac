"""A local language model that may rewrite a query and reorder results. All it says is checked before it counts."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from urllib.parse import urlsplit

from fathomix.config import LanguageModel, Security
from fathomix.guard import OutboundBlocked, is_local

Ask = Callable[[str], str]

PARSE = """Turn a search over files into JSON, nothing else. Keys: query (words to look for), type (null, text, pdf, image, audio, video or archive), path_glob (null or a glob), since (null or YYYY-MM-DD).
Search: {query}"""
RERANK = """Order the files by how well they answer a search. Answer in JSON, nothing else: {{"order": [numbers, best first], "explanations": {{"number": "a short reason"}}}}.
Search: {query}
Files:
{files}"""


def local_model(settings: LanguageModel, security: Security) -> Ask | None:
    """A function from prompt to completion, by the HTTP interface of a model server on this machine; None if switched off."""
    if not settings.enabled or not settings.model:
        return None
    if security.local_only and not is_local(urlsplit(settings.base_url).hostname or "", security.allowed_hosts):
        raise OutboundBlocked(f"the model server must be on this machine: {settings.base_url}")

    def ask(prompt: str) -> str:
        body = json.dumps({"model": settings.model, "prompt": prompt, "stream": False}).encode()
        request = urllib.request.Request(f"{settings.base_url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=settings.timeout_s) as answer:
            return str(json.loads(answer.read()).get("response", ""))

    return ask


def or_nothing(ask: Ask, prompt: str) -> str:
    """What a model says; nothing, if it fails: a search must not fail with it."""
    try:
        return ask(prompt)
    except (OSError, ValueError):
        return ""
