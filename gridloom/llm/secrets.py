"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import column_of, numbered, skew_safe_join, stored

#: The base patterns (kind, Java pattern, group of the value, least length of that group).
#: ``[A-Z...]+`` runs are maximal, so a least length can stand in the pattern where a match is one run.
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Without one of these a text has no match of the kind; they cost less than the pattern.
HINTS = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": r"[0-9a-f]{16}"}

#: A value that this many owners or repositories share is a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 6
#: Kinds in the order in which spans of one start are listed; ``live`` is the method's own.
KINDS = ("assign", "access", "hex", "live")


def found(kind: str, pattern: str, group: int, least: int, text: Column) -> Column:
    """array<struct<rank, gap, whole, size, hash>>: of each match of a kind, how many characters lie before it (from
    the match before), its own, its value's, and the value's digest (null where the value is too short to count)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), whole.alias("w"), F.regexp_extract_all(text, F.lit(pattern), group).alias("v"))
    # One gap more than matches: what follows the last one.
    matches = F.filter(zipped, lambda x: x["w"].isNotNull())
    described = F.transform(
        matches,
        lambda x: F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("whole"), F.length(x["v"]).alias("size"), F.when(F.length(x["v"]) >= least, F.sha2(x["v"], 256)).alias("hash")),
    )
    return F.when(text.rlike(HINTS[kind]), described).otherwise(F.expr("cast(array() as array<struct<rank:int,gap:int,whole:int,size:int,hash:string>>)"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source") -> DataFrame:
    """Candidates for secrets in whole texts, told apart by how many owners of the corpus share a value.

    Returns one row per row of ``docs``: doc_id, n_assign, n_access, n_hex (long), base_sha256 (of the base
    spans kind:start:end, by start, then kind), spans (base and ``live`` spans, likewise), n_live, n_example.
    A ``live`` span marks the value of a candidate held by fewer than EXAMPLE_OWNERS owners and EXAMPLE_REPOS
    repositories; a value beyond that is a copied example. Places count code points; ends are exclusive.

    A null text counts as empty: no spans, the digest of the empty string. A null owner or repository is one
    of its own. Repeated rows are scanned each; an empty table gives an empty result; other columns are
    ignored whatever their names, and of two with the name of an input the first is read. Values are compared by
    SHA-256 only. A value in a third of all rows is summed before the shuffle and joined back so that it spreads.
    Places are running sums over a text's matches, so time is linear in them.
    """
    plain = numbered(docs)
    col = lambda n: F.col(column_of(docs, n))
    text = F.coalesce(col(text_col), F.lit(""))
    repo = F.xxhash64(*[col(c) for c in repo_cols], *[col(c).isNull() for c in repo_cols])
    owner = F.xxhash64(col(owner_col), col(owner_col).isNull())
    every = F.concat(*[found(*b, text) for b in BASE])
    scanned = stored(plain.select(col(id_col).alias("doc_id"), repo.alias("repo"), owner.alias("owner"), F.monotonically_increasing_id().alias("row"), every.alias("m")))
    before = Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    matches = scanned.where(F.size("m") > 0).select("row", "repo", "owner", F.posexplode("m").alias("pos", "x")).select("row", "repo", "owner", "pos", "x.*")
    placed = matches.withColumn("end", F.sum((F.col("gap") + F.col("whole")).cast("long")).over(before)).where(F.col("hash").isNotNull())
    places = stored(placed.select("row", "repo", "owner", (F.col("end") - F.col("whole")).alias("start"), "rank", "end", "size", "hash"))
    held = places.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    shared = stored(held.groupBy("hash").agg(F.sum("n").alias("places"), F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos")))
    total = shared.agg(F.sum("places")).first()[0] or 1
    judged = skew_safe_join(places.select("row", "start", "rank", "end", "size", "hash"), shared, ["hash"], "places", total, "inner")
    live = (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repos") < EXAMPLE_REPOS)
    span = lambda start, rank, live: F.struct(start.alias("start"), rank.alias("rank"), F.col("end"), live.alias("live"))
    base = span(F.col("start"), F.col("rank"), live)
    mark = span(F.col("end") - F.col("size"), F.lit(len(BASE)), F.lit(True))
    spans = judged.select("row", F.explode(F.when(live, F.array(base, mark)).otherwise(F.array(base))).alias("s"))
    # Two candidates may mark the same live value.
    by_row = spans.groupBy("row", "s").agg(F.lit(1).alias("one")).groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("s"))
    joined = scanned.select("doc_id", "row").join(by_row, "row", "left").select("doc_id", F.coalesce("s", F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,live:boolean>>)")).alias("s"))
    name = F.array(*[F.lit(k) for k in KINDS])
    show = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(name, x.rank), x.start, x.end)), ",")
    base = F.filter("s", lambda x: x.rank < len(BASE))
    count = lambda test: F.size(F.filter("s", test)).cast("long")
    of_kind = lambda k: count(lambda x: x.rank == k)
    return joined.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)],
        F.sha2(show(base), 256).alias("base_sha256"),
        show(F.col("s")).alias("spans"),
        count(lambda x: (x.rank < len(BASE)) & x.live).alias("n_live"),
        count(lambda x: (x.rank < len(BASE)) & ~x.live).alias("n_example"),
    )
