"""A Python data source that reads the history of chat sessions page by page, one partition per session.

The client is injected: any callable (session_id, offset, size) -> list of rows, newest first, importable by name on the
executors. Pages are read until one is empty, brings nothing new, is short, or lies before the session's lower bound.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 500
MAX_PAGES = 1000
SCHEMA = "session_id string, msg_id string, sender_id string, sender_name string, content string, timestamp long, failed boolean"


class PageGuard(Exception):
    """A list did not end within the pages that a cycle reads."""


def fetch_pages(get: Callable[[int, int], dict], key: str, size: int = PAGE, most: int = MAX_PAGES) -> Iterator[dict]:
    """Rows of an offset-paged list without repeats; stops at an empty page, one without news, hasMore false or a short one.
    A list that has not ended after `most` pages is an error: what is behind them must not be passed over."""
    seen: set = set()
    for page in range(most):
        answer = get(page * size, size)
        rows = answer.get("items") or []
        fresh = [r for r in rows if r.get(key) not in seen]
        seen.update(r.get(key) for r in fresh)
        yield from fresh
        if not rows or not fresh or answer.get("hasMore") is False or len(rows) < size:
            return
    raise PageGuard(f"more than {most} pages")


def resolve(name: str) -> Callable:
    module, _, attribute = name.rpartition(":")
    return getattr(importlib.import_module(module), attribute)


class SessionPartition(InputPartition):
    def __init__(self, session_id: str, since: int):
        super().__init__(session_id)
        self.session_id, self.since = session_id, since


class SessionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client = options["client"]
        self.sessions = [s for s in options.get("sessions", "").split(",") if s]
        self.since = dict(p.split("=", 1) for p in options.get("since", "").split(",") if p)
        self.page = int(options.get("page", PAGE))
        self.most = int(options.get("maxpages", MAX_PAGES))

    def partitions(self) -> list[InputPartition]:
        return [SessionPartition(s, int(self.since.get(s, 0))) for s in self.sessions]

    def read(self, partition: SessionPartition) -> Iterator[tuple]:
        client, s = resolve(self.client), partition.session_id
        rows, failed = [], False
        try:
            for r in fetch_pages(lambda offset, size: client(s, offset, size), "msg_id", self.page, self.most):
                stamp = int(r.get("timestamp") or 0)
                if stamp < partition.since:
                    break
                rows.append((s, str(r["msg_id"]), r.get("sender_id"), r.get("sender_name"), r.get("content"), stamp, False))
        except Exception:  # the session is marked and read again in the next cycle
            failed = True
        yield from rows
        if failed:
            yield (s, None, None, None, None, None, True)


class SessionSource(DataSource):
    """spark.dataSource.register(SessionSource); spark.read.format("chat_sessions").option("client", "module:function")..."""

    @classmethod
    def name(cls) -> str:
        return "chat_sessions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SessionReader:
        return SessionReader(self.options)
