"""The registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views that the SQL of signal queries begins with.
VIEWS = {
    "sig": "SELECT event_id AS n, CAST(round(value * 100) AS BIGINT) AS x FROM events",
    "sig2": "SELECT event_id AS n, CAST(round(value * 100) AS BIGINT) AS l, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS r FROM events",
    "sigu": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(round(value * 100) AS BIGINT) AS x FROM events",
    "fp": "SELECT vec_id AS f, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "sym": "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents",
}


def query(sql: str | None = None, views: str = "sig") -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with SQL over the named views."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            head, body = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split()), sql.strip()
            loops = body.startswith("WITH RECURSIVE ")
            own = body.removeprefix("WITH RECURSIVE " if loops else "WITH ") if body.startswith("WITH ") else None
            start = "WITH RECURSIVE " if loops else "WITH "
            ORACLE_SQL[f.__name__] = body if not head else f"{start}{head} {body}" if own is None else f"{start}{head}, {own}"
        return f

    return add
