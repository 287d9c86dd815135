"""The daily run and store maintenance as jobs over a store."""

import logging
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.operators.retention import failed_purge, retention_cutoff
from newsweave.operators.statistics import (
    age_buckets,
    article_count,
    dedup_metrics,
    empty_sources,
    image_coverage,
    top_sources,
)
from newsweave.operators.upsert import upsert_outcome
from newsweave.plans.digest import digest, digest_order
from newsweave.plans.reports import article_preview, url_list
from newsweave.schema import ARRIVAL
from newsweave.session import materialize, remove_folder, write_out
from newsweave.sources.sinks import save_json
from newsweave.sources.store import ArticleStore

LOG = logging.getLogger(__name__)


def daily_run(
    articles: DataFrame,
    pages: DataFrame,
    store: ArticleStore,
    snapshots: str,
    run_ts: datetime,
    size: int = settings.DIGEST_SIZE,
    arrival: list = ARRIVAL,
    domains: list[str] = settings.TRUSTED_DOMAINS,
    purge_months: int | None = settings.RETENTION_MONTHS,
    newest_page: list | None = None,
    parse_rfc822: bool = False,
    sources: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Purge, build the digest, write its snapshot and save it.

    Returns the frames a caller may show: ``purge``, ``preview``, ``outcome``, ``total``,
    ``urls``, and the run's metrics ``duplicates``, ``coverage`` and, where the configured
    ``sources`` (with a ``source_rank``) are given, ``empty_sources``. Articles are computed once,
    into a working table. A purge that fails is reported and the run goes on; a run
    without articles writes no snapshot and saves nothing. Running it again with the same
    ``run_ts`` leaves the same store.
    """
    shown: dict[str, DataFrame] = {}
    if purge_months is not None:
        try:
            shown["purge"] = store.purge(run_ts, purge_months)
        except Exception:
            LOG.exception("the purge failed; the run goes on")
            shown["purge"] = failed_purge(store.spark, retention_cutoff(run_ts, purge_months))
    staged, folder = write_out(articles, "collected")
    shown["duplicates"] = materialize(dedup_metrics(staged))
    if sources is not None:
        shown["empty_sources"] = materialize(empty_sources(sources, staged, "source_rank"))
    chosen = materialize(
        digest(staged, pages, size, arrival, domains, newest_page, parse_rfc822, reread=True)
    )
    remove_folder(store.spark, folder)
    shown["coverage"] = image_coverage(chosen)
    order = [F.col("had_image").desc(), *digest_order(arrival)]
    shown["preview"] = article_preview(chosen, order)
    if chosen.isEmpty():
        shown["outcome"] = upsert_outcome(store.newest_times().limit(0), chosen)
    else:
        snapshot = chosen.orderBy(*order).drop("had_image", "published_ts", *arrival)
        save_json(snapshot, snapshots, run_ts.date())
        shown["outcome"] = store.save(chosen, run_ts.strftime("%Y%m%dT%H%M%S"), arrival, run_ts)
    shown["total"] = article_count(store.counts(), F.col("articles"))
    shown["urls"] = url_list(chosen, order)
    return shown


def store_statistics(store: ArticleStore, as_of: datetime) -> dict[str, DataFrame]:
    """Age counts and the sources with most articles, from what the saves changed."""
    counts = materialize(store.counts())
    weight = F.col("articles")
    return {"ages": age_buckets(counts, as_of, weight=weight), "sources": top_sources(counts, weight=weight)}
