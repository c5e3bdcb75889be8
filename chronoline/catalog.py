"""Names of the library's own queries, their functions and the DuckDB SQL they agree with."""

from __future__ import annotations

FLAGSHIP = "timeline_sync"


def queries() -> dict:
    from chronoline.plans import ALL

    return {name: q.build for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    from chronoline.plans import ALL

    return {name: q.sql for name, q in ALL.items() if q.sql}
