"""Independent SQL for the registered queries, assembled from named CTEs."""

from __future__ import annotations

CTES: dict[str, tuple[str, str]] = {}
SELECTS: dict[str, tuple[str, str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    """Register a CTE; ``needs`` names the CTEs it reads, separated by blanks."""
    CTES[name] = (needs, sql)


def with_ctes(needs: str, select: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in CTES[name][0].split():
            visit(n)
        order.append(name)

    for name in needs.split():
        visit(name)
    select = select.strip()
    if not order:
        return select
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in order]
    if select.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + select[5:]
    return "WITH " + ",\n".join(parts) + "\n" + select


def oracle(name: str, needs: str, select: str) -> None:
    SELECTS[name] = (needs, select)


def all_sql() -> dict[str, str]:
    return {name: with_ctes(needs, select) for name, (needs, select) in SELECTS.items()}
