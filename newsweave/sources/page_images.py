"""Images of landed pages, found once per page and kept.

A table holds, for every page that may name an image, its key, its address and what was found, also
if that was nothing. Pages landed since are told by their keys alone; only their HTML is read and
parsed. Digests and enrichment take ``pages()`` in the place of pages with HTML.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsweave import settings
from newsweave.functions.html import page_image
from newsweave.operators.images import guarded_pages
from newsweave.session import broadcast_if_small, materialize


class PageImages:
    """The table of a folder. ``key`` names a landed page, ``newest`` orders those of an address."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: list[str],
        newest: list[str] | None = None,
        domains: list[str] = settings.TRUSTED_DOMAINS,
    ):
        self.spark, self.path, self.domains = spark, path.rstrip("/"), domains
        self.key = list(dict.fromkeys([*key, *(newest or [])]))

    def _kept(self, pages: DataFrame) -> DataFrame | None:
        text = [StructField(name, StringType()) for name in ("url", "page_image") if name not in self.key]
        schema = StructType([pages.schema[name] for name in self.key] + text)
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def extend(self, pages: DataFrame) -> int:
        """Take in the pages that are not there yet; returns how many were parsed.

        Keys are compared without any HTML. Running it again after a failure takes in what
        is still missing.
        """
        trusted = guarded_pages(pages, self.domains)
        kept = self._kept(pages)
        if kept is None:
            new, parsed = trusted, trusted.count()
        else:
            keys = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in self.key]
            known = kept.select(*[F.col(name).alias(f"_{name}") for name in self.key]).distinct()
            unseen = materialize(trusted.select(*self.key).join(known, keys, "left_anti").distinct())
            parsed = unseen.count()
            renamed = unseen.select(*[F.col(name).alias(f"_{name}") for name in self.key])
            new = trusted.join(broadcast_if_small(renamed), keys, "left_semi")
        if parsed:
            found = new.select(*self.key, "url", page_image(F.col("html")).alias("page_image"))
            found.write.mode("append").parquet(self.path)
        return parsed

    def pages(self, like: DataFrame) -> DataFrame:
        """Key, url and page_image of all pages taken in; ``like`` gives the key's types."""
        kept = self._kept(like)
        return like.select(*self.key, "url", F.lit("").alias("page_image")).limit(0) if kept is None else kept
