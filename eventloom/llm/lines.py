"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate.

A line moves once for each page and task's sums, as a key of counts. What is dropped is small: lines on more than a
share r of a host's pages number at most 1 / r times the lines of its average page, so that each host's can travel as
one array to its pages, whose lines never have to be gathered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.plans.storage import written

#: The host of a URL, without user and port.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"
#: What of HTML has no text, what ends a line, and what is left out. Each begins with its one first character, which a
#: search finds much faster than alternatives that each begin with it.
SILENT = r"(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->)"
BLOCKS = r"(?i)<(?:/?(?:html|head|body|title|meta|p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|aside|main|br|hr|tr|td|th|table|pre|blockquote|form)(?:[\s/][^>]*)?|!doctype[^>]*)>"
TAGS = r"<[^>]*>"


def host_of(url: str) -> Column:
    """The host in lower case; of a null URL or one without a host: an empty string."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(f"`{url}`")), HOST, 1), F.lit(""))


def html_text(html: str) -> Column:
    """The text of HTML, with a line for each block. Entities stay as they are."""
    quiet = F.regexp_replace(F.col(f"`{html}`"), SILENT, " ")
    return F.regexp_replace(F.regexp_replace(quiet, BLOCKS, "\n"), TAGS, "")


def lines_of(text: Column) -> Column:
    """Lines without blanks around them, empty ones left out; of a null text, none."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    return F.filter(trimmed, lambda x: x != "")


def boilerplate(df: DataFrame, ratio: float) -> DataFrame:
    """host and boilerplate, an array, from __host and __lines. A host without a name has none, nor has one of a single page."""
    named = df.where("__host != ''")
    totals = named.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    counts = named.select("__host", F.explode(F.array_distinct("__lines")).alias("__line")).groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__n"))
    often = counts.where("__n > 1").join(totals, "__host").where(F.col("__n") / F.col("__pages") > ratio)
    return often.groupBy("__host").agg(F.collect_set("__line").alias("__boilerplate"))


def without_boilerplate(df: DataFrame, url: str, text: Column, ratio: float = 0.3) -> DataFrame:
    """df with host, n_lines, n_dropped and kept_text: lines on more than `ratio` of their host's pages go.

    text: a column of texts with line ends, such as html_text("html"). Lines are compared without blanks around them; a
    line that a page repeats counts once for the page and goes wherever it stands. A line on one page of its host only
    stays, whatever the ratio; pages without a host keep everything. A null or empty text has no lines and an empty
    kept_text, and its page counts in its host's total; so do repeated rows. An empty table stays empty; columns of
    these names are replaced.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio lies above 0 and is at most 1")
    cut = df.withColumns({"__host": host_of(url), "__lines": lines_of(text)})
    # written, so that its size is known: broadcast below Spark's limit, else a join whose hot hosts Spark can split
    found = written(boilerplate(cut.select("__host", "__lines"), ratio).withColumnRenamed("__host", "__of"), "boilerplate")
    joined = cut.join(found, F.col("__host") == F.col("__of"), "left")
    kept = F.when(F.col("__boilerplate").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.array_contains(F.col("__boilerplate"), x)))
    out = joined.withColumn("__kept", kept).withColumns(
        {
            "host": F.col("__host"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long"),
            "kept_text": F.array_join("__kept", "\n"),
        }
    )
    return out.drop("__host", "__lines", "__of", "__boilerplate", "__kept")
