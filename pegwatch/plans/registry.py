"""Named queries, their DuckDB counterparts and the shared SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}
_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, body: str, needs: Sequence[str] = ()) -> None:
    """Registers one common table expression and what it reads."""
    _BLOCKS[name] = (tuple(needs), body.strip())


def _collect(names: Sequence[str], done: dict[str, str]) -> None:
    for name in names:
        if name not in done:
            needs, body = _BLOCKS[name]
            _collect(needs, done)
            done[name] = body


def with_blocks(select: str, needs: Sequence[str] = ()) -> str:
    done: dict[str, str] = {}
    _collect(needs, done)
    if not done:
        return select.strip()
    parts = ",\n".join(f"{name} AS MATERIALIZED (\n{body}\n)" for name, body in done.items())
    select = select.strip()
    rest = f",\n{select[5:]}" if select.startswith("WITH ") else f"\n{select}"
    return f"WITH RECURSIVE {parts}{rest}"


def query(name: str, sql: str | None = None, needs: Sequence[str] = ()) -> Callable[[Plan], Plan]:
    """Registers a query; ``sql`` may use the blocks named in ``needs``."""

    def add(fn: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = (sql, tuple(needs))
        return fn

    return add


def oracles() -> dict[str, str]:
    return {name: with_blocks(sql, needs) for name, (sql, needs) in _SQL.items()}
