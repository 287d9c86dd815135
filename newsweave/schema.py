"""Column layouts shared by sources, operators and the store.

Times are ``TIMESTAMP_NTZ`` holding UTC wall-clock time, so no result depends
on the session time zone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "string"

# What a reader of articles sees. Missing text is '' and missing tags are [].
ARTICLE_FIELDS = {
    "title": TEXT,
    "url": TEXT,
    "published": TEXT,
    "summary": TEXT,
    "source": TEXT,
    "tags": "array<string>",
    "image": TEXT,
    "inshorts_id": TEXT,
    "original_source": TEXT,
}

# Where an article stands in arrival order: rank of its source, the landed
# payload it came from, and its position in that payload.
ARRIVAL_FIELDS = {
    "source_rank": "int",
    "payload_id": "bigint",
    "position": "int",
}
ARRIVAL = list(ARRIVAL_FIELDS)

STORE_FIELDS = {
    **ARTICLE_FIELDS,
    "article_id": TEXT,
    "scraped_at": "timestamp_ntz",
    "scraped_date": "date",
    "batch": TEXT,
    # Which save this was: the last save of an address wins, whatever its times.
    "saved": "bigint",
}


def ddl(fields: dict) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def conform(df: DataFrame, fields: dict, keep: tuple = ()) -> DataFrame:
    """Select ``fields`` in order with their types, adding missing ones as null."""
    present = set(df.columns)
    columns: list[Column] = [
        (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
        for name, kind in fields.items()
    ]
    return df.select(*columns, *[F.col(name) for name in keep])
