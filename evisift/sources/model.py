"""The language model: a client for chat completions and the stage that calls it.

A client is a callable from messages to (content, usage). It is made once in each
task; one with an attribute ``concurrency`` is called by that many threads at once.
Replies should be written before they are used again: a task that runs again asks
again, unless there is a ledger.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from evisift.sources.config import ModelSettings
from evisift.sources.ledger import Ledger, digest, kept

Messages = list[dict[str, str]]
Reply = tuple[str, dict[str, int]]
Client = Callable[[Messages], Reply]
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def http_client(settings: ModelSettings, concurrency: int = 4, tries: int = 5, pause: float = 1.0) -> Client:
    """Posts to an endpoint for chat completions, in JSON mode. Missing usage counts as 0. Where the endpoint is busy or failing (429, 5xx, no connection) it is asked again, up to ``tries`` times, after ``pause`` seconds that double, or as long as it says; other HTTP errors are raised."""

    def patient(request: urllib.request.Request) -> dict:
        for k in range(tries):
            try:
                with urllib.request.urlopen(request, timeout=settings.timeout_seconds) as response:
                    return json.load(response)
            except urllib.error.HTTPError as e:
                if k + 1 == tries or e.code != 429 and e.code < 500:
                    raise
                said = e.headers.get("Retry-After") or ""
                wait = float(said) if said.isdigit() else pause * 2**k
            except urllib.error.URLError:
                if k + 1 == tries:
                    raise
                wait = pause * 2**k
            time.sleep(wait * random.uniform(1, 1.5))
        raise AssertionError

    def ask(messages: Messages) -> Reply:
        body = {"model": settings.model_name, "messages": messages, "temperature": settings.temperature, "response_format": {"type": "json_object"}}
        head = {"Authorization": f"Bearer {settings.api_key}", "Content-Type": "application/json"}
        request = urllib.request.Request(settings.api_base.rstrip("/") + "/chat/completions", json.dumps(body).encode(), head)
        got = patient(request)
        usage = got.get("usage") or {}
        return got["choices"][0]["message"]["content"], {k: int(usage.get(k) or 0) for k in USAGE}

    ask.concurrency = concurrency
    return ask


@dataclass(frozen=True)
class Calling:
    """How calls are made. ledger: the folder of a ledger; what it has is not asked, unless the salt is another. tasks: among how many tasks calls are dealt; times the client's concurrency, that bounds the calls under way."""

    make_client: Callable[[], Client]
    ledger: str | None = None
    salt: str = ""
    tasks: int | None = None


def call_model(prompts: DataFrame, calling: Calling | Callable[[], Client], keys: list[str], attempt: int = 0) -> DataFrame:
    """prompts: keys and ``system``, ``user``. Returns keys, ``content`` and the usage of one call a row."""
    calling = calling if isinstance(calling, Calling) else Calling(calling)
    make_client, ledger, salt, tasks = calling.make_client, calling.ledger, calling.salt, calling.tasks
    kinds = dict(prompts.dtypes)
    rows = prompts.select(*keys, "system", "user", digest(keys, attempt, salt).alias("digest"))
    replies = kept(prompts.sparkSession, ledger) if ledger else None
    known = None
    if replies is not None:
        known = rows.join(replies, "digest").select(*keys, "content", *USAGE)
        rows = rows.join(replies.select("digest"), "digest", "left_anti").select(*rows.columns)
    if tasks:
        rows = rows.repartition(tasks)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, log = make_client(), Ledger(ledger) if ledger else None

        def one(row: tuple[str, str, str]) -> Reply:
            system, user, key = row
            found = log.find(key) if log else None
            if found is None:
                content, usage = client([{"role": "system", "content": system}, {"role": "user", "content": user}])
                found = content, {k: int(usage.get(k, 0)) for k in USAGE}
                if log:
                    log.keep(key, *found)
            return found

        with ThreadPoolExecutor(getattr(client, "concurrency", 1)) as pool:
            for p in parts:
                got = list(pool.map(one, zip(p["system"], p["user"], p["digest"], strict=True)))
                out = p[keys].assign(content=[c for c, _ in got])
                for k in USAGE:
                    out[k] = [int(u.get(k, 0)) for _, u in got]
                yield out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", content string, " + ", ".join(f"{k} bigint" for k in USAGE)
    asked = rows.mapInPandas(run, schema)
    return asked if known is None else known.unionByName(asked)
