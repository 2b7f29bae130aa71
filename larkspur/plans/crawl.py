"""Crawling as breadth-first expansion of a frontier of urls."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CrawlParams
from ..log import Log, Silent
from ..operators.metrics import Registry
from ..sources.files import Resolve, fetching, parse_pages
from ..storage import cut


@dataclass
class CrawlResult:
    """Documents with `links` and `depth`; failed urls with their errors; all urls that were taken up."""

    documents: DataFrame
    errors: DataFrame
    visited: DataFrame
    pages: int
    seconds: float


def next_frontier(links: DataFrame, visited: DataFrame, budget: int | None) -> DataFrame:
    """New distinct urls of `links` (url), in order of url and no more than the budget; all of them, unordered, without one."""
    fresh = links.select("url").where("url is not null and url <> ''").distinct()
    new = fresh.join(visited.select("url"), "url", "left_anti")
    return new if budget is None else new.orderBy("url").limit(max(budget, 0))


def crawl(
    seeds: DataFrame,
    resolve: Resolve | None = None,
    params: CrawlParams = CrawlParams(),
    sink: Callable[[DataFrame], None] | None = None,
    registry: Registry | None = None,
    log: Log | None = None,
) -> CrawlResult:
    """Fetch the seeds (url), follow links level by level until no new url or the budget is left.

    A url is taken up once; failed fetches use up the budget; within a level urls go in order.  Each
    level is one job whose result is cut from its lineage in the shared checkpoint folder.  A sink gets the
    documents of each level; the registry counts documents and errors.
    """
    registry, log = registry or Registry(), log or Silent()
    began = time.monotonic()
    spark = seeds.sparkSession
    resolve = resolve or fetching(workers=params.workers, politeness=params.politeness)
    visited = spark.createDataFrame([], "url string")
    frontier = cut(next_frontier(seeds, visited, params.max_pages))
    taken = frontier.count()
    documents = errors = None
    depth, new = 0, taken
    while new:
        visited = visited.unionByName(frontier)
        got = cut(resolve(frontier))
        parsed = parse_pages(got.where("error is null"), "url", "body").withColumn("depth", F.lit(depth))
        failed = got.where("error is not null").select("url", "error", F.lit(depth).alias("depth"))
        ok, bad = got.agg(F.count_if(F.isnull("error")), F.count_if(F.isnotnull("error"))).first()
        registry.crawled += ok
        registry.crawl_errors += bad
        log.info("crawl_level", depth=depth, documents=ok, errors=bad)
        if sink is not None and ok:
            sink(parsed.drop("links", "depth"))
        documents = parsed if documents is None else documents.unionByName(parsed)
        errors = failed if errors is None else errors.unionByName(failed)
        found = parsed.select(F.explode("links").alias("url"))
        frontier = cut(next_frontier(found, visited, None if params.max_pages is None else params.max_pages - taken))
        new = frontier.count()
        taken += new
        depth += 1
    if documents is None or errors is None:
        none = spark.createDataFrame([], "url string, body string, error string")
        documents = parse_pages(none, "url", "body").withColumn("depth", F.lit(0))
        errors = none.select("url", "error", F.lit(0).alias("depth"))
    return CrawlResult(documents, errors, visited, taken, time.monotonic() - began)
