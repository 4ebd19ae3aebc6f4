"""All queries of the library by name, with SQL for those that SQL can express."""

from __future__ import annotations

from paperloom.plans import files_and_joins, sources_and_streams, summaries_and_windows, views

_REGISTERING = (files_and_joins, summaries_and_windows, sources_and_streams)


def queries() -> dict:
    return dict(views.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(views.ORACLES)
