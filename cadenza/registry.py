"""All queries of the library by the ids of the survey, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import ingest, matching, models, playlists, profiles, recommend  # noqa: F401 (registers its queries)
from .plans.queries import QUERIES, SQL

FLAGSHIP = "A01_session_rollup"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
