"""Line dedup by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column_of, numbered, skew_safe_join, stored

#: A line on more than this share of a host's pages is boilerplate, if it is on MIN_PAGES of them: what stands on
#: one page alone repeats nowhere, however few pages a host has.
MAX_RATIO = 0.02
MIN_PAGES = 2


def trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  "))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)
    return F.when(host != "", host)


def line_dedup(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, url: bool = False) -> DataFrame:
    """Drop the lines that stand on more than ``max_ratio`` of their host's pages (and on ``min_pages``).

    Returns one row per row of ``pages``: its columns, with the text rebuilt from the lines that stay, then
    n_lines and n_dropped (long). Lines are split at \\n and compared after trimming blanks; blank lines are
    never boilerplate; a page counts once for a line that it repeats, and all places of a boilerplate line go.
    ``url``: ``host_col`` holds URLs, whose hosts are meant.

    A null text stays null with 0 lines; an empty one has one blank line. A null host is a host of its own.
    Repeated rows count as pages of their own and get the same text. An empty table gives an empty result.
    Other columns pass through whatever their names; of two with the name of an input the first is read, and a
    column named n_lines or n_dropped is replaced.

    Pages of one host and places of one line are never gathered: counts are partial sums before the shuffle,
    and lines meet what is known of them in a join that spreads hot lines. A row is known by two hashes of
    its id, host and text, so nothing depends on how a scan is cut into tasks.
    """
    plain, text_c, id_c = numbered(pages), column_of(pages, text_col), F.col(column_of(pages, id_col))
    host = F.col(column_of(pages, host_col))
    host = host_of(host) if url else host
    text = F.coalesce(F.col(text_c), F.lit(""))
    lines = F.split(text, "\n", -1)
    row_key = [F.xxhash64(id_c, host, F.col(text_c)).alias("_u"), F.xxhash64(F.col(text_c), F.lit(11), host, id_c).alias("_v")]

    def key(line: Column) -> Column:
        # A string: what the engine tells apart by hashing, so that long pages take linear time.
        return F.md5(F.concat(F.coalesce(host, F.lit("")), F.when(host.isNull(), "\n").otherwise("\n\n"), trimmed(line)).cast("binary"))

    hashed = stored(plain.select(*row_key, host.alias("_host"), F.array_distinct(F.transform(F.filter(lines, lambda x: trimmed(x) != ""), key)).alias("_keys")))
    total = hashed.count()
    # A null host is a key too.
    of_host = F.when(F.col("_host").isNull(), "\n").otherwise(F.concat("_host", F.lit("\n\n"))).alias("_of")
    hosts = hashed.groupBy(of_host).agg(F.count(F.lit(1)).alias("_host_pages"))
    places = hashed.select("_u", "_v", "_host", F.explode("_keys").alias("_key"))
    # A line's key holds its host, so one exchange counts it; its host comes along for the ratio.
    counts = places.groupBy("_key").agg(F.count(F.lit(1)).alias("_line_pages"), F.first("_host").alias("_host")).where(F.col("_line_pages") >= min_pages)
    counts = stored(counts.select("_key", "_line_pages", of_host))
    sized = counts.groupBy("_of").agg(F.count(F.lit(1)).alias("_lines")).join(hosts, "_of")
    judged = skew_safe_join(counts, sized, ["_of"], "_lines", counts.count(), "inner")
    boiler = stored(judged.where(F.col("_line_pages") > max_ratio * F.col("_host_pages")).select("_key", "_line_pages"))
    hit = skew_safe_join(places.select("_u", "_v", "_key"), boiler, ["_key"], "_line_pages", total, "inner")
    drops = hit.groupBy("_u", "_v").agg(F.collect_set("_key").alias("_drops"))
    joined = plain.withColumns({"_u": row_key[0], "_v": row_key[1]}).join(drops, ["_u", "_v"], "left")
    stays = F.filter(lines, lambda x: ~F.array_contains(F.col("_drops"), key(x)))
    n_lines = F.when(F.col(text_c).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    kept = joined.withColumn("_stays", F.when(F.col("_drops").isNotNull(), stays))
    rebuilt = F.when(F.col("_drops").isNull(), F.col(text_c)).otherwise(F.array_join("_stays", "\n"))
    n_dropped = F.when(F.col("_drops").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_stays")).cast("long")
    names = [(c, n) for c, n in zip(plain.columns, pages.columns) if n not in ("n_lines", "n_dropped")]
    out = kept.select(*[rebuilt.alias(c) if c == text_c else F.col(c) for c, _ in names], n_lines.alias("_n"), n_dropped.alias("_d"))
    return out.toDF(*[n for _, n in names], "n_lines", "n_dropped")
