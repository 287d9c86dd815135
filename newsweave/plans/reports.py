"""What a run shows its reader: article previews and the list of addresses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.functions.text import present, preview
from newsweave.operators.ranking import number_rows


def article_preview(articles: DataFrame, order: list) -> DataFrame:
    """Numbered title, source, address, joined tags and shortened summary."""
    shown = articles.withColumns(
        {
            "tags_text": F.array_join("tags", ", "),
            "summary_preview": preview(F.col("summary"), settings.PREVIEW_CHARS),
        }
    ).drop("summary", "tags", "image")
    return number_rows(shown, order, "number").select(
        "number", "title", "source", "url", "tags_text", "summary_preview"
    )


def url_list(articles: DataFrame, order: list) -> DataFrame:
    """Numbered addresses, blank ones left out."""
    filled = articles.where(present(F.col("url"))).drop("summary", "tags", "image")
    return number_rows(filled, order, "number").select("number", "url")
