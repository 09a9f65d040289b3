"""Query op6: main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.extraction import with_main_text
from veldra.session import table


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null or empty html gives an empty text; a null url has no host and so no wrapper; repeated rows each return and
    count once for the wrapper; an empty table gives an empty one.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages, "url", "html", "text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLE_SQL: dict[str, str] = {}
