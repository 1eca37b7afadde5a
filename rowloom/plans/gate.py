"""The guard against scans of large tables: allowed below a number of rows, or by name, or with a useful predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import NoIndex

ROWS_ALLOWED = 100_000


def allowed(name: str, listed: str) -> bool:
    return name.lower() in {x.strip().lower() for x in listed.split(",") if x.strip()}


def check_scan(name: str, rows: int | None, listed: str = "", limit: int = ROWS_ALLOWED) -> None:
    if rows is not None and rows >= limit and not allowed(name, listed):
        raise NoIndex(f"ERR_NO_INDEX: a full scan of {name}, which has {rows} rows")


def filtered_columns(df: DataFrame, table: str) -> set[str]:
    """Columns of a table's view that a query filters on, in lower case; as analysed, before names dissolve into how snapshots are read."""
    conditions, own = [], set()

    def walk(node) -> None:
        if node.nodeName() == "Filter":
            refs = node.condition().references().toSeq()
            conditions.extend(refs.apply(i) for i in range(refs.length()))
        elif node.nodeName() == "SubqueryAlias" and node.alias().lower() == table.lower():
            out = node.output()
            own.update(out.apply(i).exprId().id() for i in range(out.length()))
        kids = node.children()
        for i in range(kids.length()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().analyzed())
    return {x.name().lower() for x in conditions if x.exprId().id() in own}


def pushed_filters(df: DataFrame) -> list[str]:
    """The PushedFilters lines of the physical plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("]")[0] for part in text.split("PushedFilters: [")[1:]]


def read_columns(df: DataFrame) -> list[str]:
    """The ReadSchema entries of the physical plan's scans."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [part.split(">")[0] for part in text.split("ReadSchema: struct<")[1:]]
