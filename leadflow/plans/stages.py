"""What the tools share: provider tables and written stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from leadflow.functions.workspace import workspace

Stage = Callable[[DataFrame, str], DataFrame]
Answers = DataFrame | Callable[[DataFrame], DataFrame]


def lazy(df: DataFrame, label: str) -> DataFrame:
    """Keep the stage inside the plan."""
    return df


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the stage to the shared folder and read it back.

    Later phases then neither repeat the work before nor carry its plan, and a lost executor costs one
    phase. Right for large jobs, where a phase feeds several joins.
    """
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Providers:
    """Answers of the outside services as tables; None where a tool does not use one. A function in the place of a table
    gets the requests and gives the answers (``plans.cache``); ``sites`` is one in the place of crawled and site_pages.

    search(request_key, body); verdicts(the job columns of the key, batch_id, body); redirects(domain, final_url);
    directory(domain, title_idx, pos, record fields); crawled(domain); site_pages(domain, ordinal, url,
    text); extractions(domain, body); profiles(request_key, body)
    """

    search: Answers | None = None
    verdicts: DataFrame | None = None
    redirects: DataFrame | None = None
    directory: Answers | None = None
    crawled: DataFrame | None = None
    site_pages: DataFrame | None = None
    extractions: Answers | None = None
    profiles: Answers | None = None
    sites: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None


def answers(source: Answers, requests: Callable[[], DataFrame]) -> DataFrame:
    """A provider's table, or what its function answers to the requests."""
    return source if isinstance(source, DataFrame) else source(requests())
