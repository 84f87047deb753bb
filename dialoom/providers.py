"""What a model would do, behind small protocols; deterministic stand-ins; retries."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Judge(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Responder(Protocol):
    def __call__(self, history: list[dict]) -> str: ...


@dataclass(frozen=True)
class Retry:
    """Calls with growing pauses; tries are the calls after the first. Only lost connections, time-outs and HTTP statuses of the list are tried again, or everything."""

    tries: int = 3
    base: float = 1.0
    factor: float = 2.0
    longest: float = 60.0
    jitter: float = 0.2
    status: tuple[int, ...] = (429, 500, 502, 503, 504)
    everything: bool = False

    def delays(self) -> Iterator[float]:
        for k in range(self.tries):
            d = min(self.base * self.factor**k, self.longest)
            yield max(0.0, d * (1 + random.uniform(-self.jitter, self.jitter)))

    def again(self, e: Exception) -> bool:
        code = getattr(e, "status_code", getattr(e, "code", None))
        return self.everything or code in self.status or code is None and isinstance(e, (ConnectionError, TimeoutError))

    def call(self, f: Callable, *args, sleep=time.sleep):
        for d in self.delays():
            try:
                return f(*args)
            except Exception as e:
                if not self.again(e):
                    raise
                sleep(d)
        return f(*args)


#: Retry presets, and those of the online judge and of captions.
AGGRESSIVE, CONSERVATIVE, API = Retry(5, 0.5, 1.5, 30), Retry(2, 2, 2, 10), Retry(3, 1, 2, 60)
ONLINE, VISION = Retry(200, 30, 2, 180, everything=True), Retry(5, 15, 2, 300)


def length_judge(prompts: list[str]) -> list[str]:
    """A stand-in that names the prompt's id and scores by its length."""
    ids = [re.search(r"^id: (.*)$", p, re.M) for p in prompts]
    return [json.dumps({"id": m[1] if m else None, "score": 1 + len(p) % 5}) for m, p in zip(ids, prompts, strict=True)]


class Log:
    """Replies by the hash of what was asked, a file each, in a folder that all executors see; a task that is run again reads them first."""

    def __init__(self, folder: str):
        self.folder = folder

    def place(self, asked: str) -> str:
        key = hashlib.sha256(asked.encode("utf-8", "surrogatepass")).hexdigest()
        return os.path.join(self.folder, key[:2], key)

    def get(self, asked: str) -> str | None:
        try:
            with open(self.place(asked), encoding="utf-8", errors="surrogatepass") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, asked: str, reply: str) -> None:
        path = self.place(asked)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"  # whole before it has its name
        with open(own, "w", encoding="utf-8", errors="surrogatepass") as f:
            f.write(reply)
        os.replace(own, path)


class Pace:
    """At most so many calls a second, over all threads of a task."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                now = time.monotonic()
                at = self.next = max(now, self.next + self.gap)
            time.sleep(at - now)


@dataclass(frozen=True)
class Calls:
    """How a model is called: threads a task, tasks, calls a second over all tasks, retries, and the folder of the log.

    With a rate, the rows are dealt to ``tasks`` tasks, and each keeps its share of it.
    """

    workers: int = 1
    tasks: int = 8
    per_second: float | None = None
    retry: Retry = AGGRESSIVE
    log: str | None = None

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.tasks) if self.per_second else df

    def each(self, groups: Iterable[list[str]], call: Callable[[list[str]], list[str]], lost: Callable[[Exception], str | None]) -> Iterator[list[str | None]]:
        """Replies of groups of prompts, in order; calls run beside each other. A group that fails for good has ``lost`` for each."""
        pace, log = Pace(self.per_second and self.per_second / self.tasks), Log(self.log) if self.log else None

        def one(asked: list[str]) -> list[str | None]:
            known = {a: log.get(a) for a in asked} if log else {}
            open_ = [a for a in asked if known.get(a) is None]
            if open_:
                try:
                    replies = self.retry.call(lambda: (pace.wait(), call(open_))[1])
                    if len(replies) != len(open_):
                        raise ValueError(f"{len(replies)} replies to {len(open_)} prompts")
                    known |= dict(zip(open_, replies, strict=True))
                    for a in open_ if log else ():
                        log.put(a, known[a])
                except Exception as e:  # the contract: what is lost says so, and the others stay
                    known |= {a: lost(e) for a in open_}
            return [known[a] for a in asked]

        with ThreadPoolExecutor(self.workers) as pool:
            waiting: deque = deque()
            for g in groups:
                waiting.append(pool.submit(one, g))
                if len(waiting) > 2 * self.workers:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()


def judged(df: DataFrame, judge: Judge, batch: int = 10, retry: Retry = AGGRESSIVE, calls: Calls | None = None) -> DataFrame:
    """df (id, prompt) with reply; a batch that fails for good, or has too few or too many replies, has null replies."""
    calls = calls or Calls(retry=retry)

    def run(batches):
        for x in batches:
            parts = [list(x.prompt[i : i + batch]) for i in range(0, len(x), batch)]
            yield pd.DataFrame({"id": x.id, "reply": [r for g in calls.each(parts, judge, lambda e: None) for r in g]})

    return calls.dealt(df.select("id", "prompt")).mapInPandas(run, "id string, reply string")


def scripted(questions: DataFrame, responder: Responder) -> DataFrame:
    """(dialogue, pos, role, content): questions of a dialogue asked in order with their history."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        history: list[dict] = []
        for q in x.sort_values("pos").question:
            history.append({"role": "user", "content": q})
            try:
                history.append({"role": "assistant", "content": responder(history)})
            except Exception:  # the contract: a failed question leaves the history
                history.pop()
        return pd.DataFrame({"dialogue": x.dialogue.iloc[0], "pos": range(len(history)), "role": [h["role"] for h in history], "content": [h["content"] for h in history]})

    return questions.groupBy("dialogue").applyInPandas(run, "dialogue int, pos int, role string, content string")
