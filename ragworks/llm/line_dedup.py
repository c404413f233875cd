"""Line dedup: site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragworks.llm.common import free_names, materialize

#: A line on more than this share of a site's pages is boilerplate, if it stands on two pages at all.
RATIO = 0.1
#: White space around a line that does not count.
BLANKS = " \t\r"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(_bare(line).cast("binary")))


def _site(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def boilerplate_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO) -> DataFrame:
    """One row per site: (site, keys), the 128-bit digests of its boilerplate lines.

    Boilerplate stands on more than `ratio` of the site's pages and on two or
    more (what stands on one page repeats nothing). A page counts once for a
    line, however often the line stands on it. Lines are compared without
    spaces, tabs and carriage returns around them; blank lines never count.
    The list of a site is bounded by (mean distinct lines a page) / ratio.
    """
    pages = docs.select(_site(F.col(host)).alias("site"), F.col(text).alias("page"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    lines = F.filter(F.split("page", "\n", -1), lambda x: _bare(x) != "")
    counts = (
        pages.where(F.col("page").isNotNull())
        .select("site", F.explode(F.array_distinct(F.transform(lines, _key))).alias("key"))
        .groupBy("site", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    hot = counts.join(totals, "site").where(F.col("n") > F.lit(float(ratio)) * F.col("total"))
    return hot.groupBy("site").agg(F.collect_set("key").alias("keys"))


def line_dedup(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, counts: tuple[str, str] = ("__n_lines", "__n_dropped")) -> DataFrame:
    """docs with boilerplate lines taken out of `text`, plus the numbers of lines found and dropped, called as `counts` says.

    Nulls: a null text stays null with 0 lines; rows with a null host form a
    site of their own. An empty text is one blank line. Rows are never lost:
    a page of boilerplate alone keeps an empty text. Repeated rows count as
    pages of their own. Other columns pass through untouched, whatever their
    names; only columns called as `counts` says are replaced.
    """
    found, dropped = counts
    docs = docs.drop(found, dropped)
    site, keys, kept = free_names(docs.withColumns({found: F.lit(0), dropped: F.lit(0)}), "site", "keys", "kept")
    hot = materialize(boilerplate_lines(docs, text, host, ratio), "boilerplate").select(F.col("site").alias(site), F.col("keys").alias(keys))
    joined = docs.join(hot, _site(docs[host]) == hot[site], "left")
    lines = F.split(F.col(text), "\n", -1)
    own = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(F.col(keys), _key(x)))
    joined = joined.withColumn(kept, F.when(F.col(keys).isNull(), lines).otherwise(own))
    size = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    joined = joined.withColumn(found, size).withColumn(dropped, F.when(F.col(text).isNull(), 0).otherwise(F.col(found) - F.size(kept)))
    joined = joined.withColumn(text, F.when(F.col(dropped) > 0, F.array_join(kept, "\n")).otherwise(F.col(text)))
    return joined.drop(site, keys, kept)
