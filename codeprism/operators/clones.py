"""Clone detection over token windows: pairs, occurrence families, findings.

Equal windows meet in one aggregation on a 128-bit hash, never pair by pair:
pair counts follow from group sizes less the pairs that overlap in one file,
and families are components over windows and the ranges of lines they cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.scalars import window_fingerprint
from .graph import connected_components, kept

#: How sure a match is in each normalisation.
SIMILARITY = {"strict": 1.0, "mild": 0.95, "weak": 0.85, "semantic": 0.75}
#: Tokens of a window and families of a report, where a configuration names none.
MIN_TOKENS, MAX_FAMILIES = 50, 200


#: Pairs of a window with n places, of which ``close`` overlap.
PAIRS = "n * (n - 1) div 2 - close"


def window_key(hashes: Column, pos: Column, n: Column | int) -> Column:
    """Identity of ``n`` tokens from a place on: two hashes over the hashes of its tokens."""
    part = F.slice(hashes, pos + 1, n)
    return F.struct(F.xxhash64(part).alias("h"), F.xxhash64(F.lit(1), part).alias("g"))


def token_windows(tokens: DataFrame, n: int) -> DataFrame:
    """A row per window of ``n`` consecutive tokens: file, pos, start, end, key.

    ``tokens``: file, toks (array of strings) and, if it has lines, the line of
    each; start and end are the lines of a window's first and last token, or
    their places. Made inside a row, so no sort or shuffle is needed.
    """
    if n < 1:
        raise ValueError("a window has at least one token")
    lines = "lines" in tokens.columns
    held = tokens.select("file", F.transform("toks", lambda t: F.xxhash64(t)).alias("hs"), *(["lines"] if lines else []))
    # a condition inside the generator, so that tokens aren't made a second time for a filter below it
    places = F.when(F.size("hs") >= n, F.sequence(F.lit(0), F.size("hs") - n))
    wide = held.select("*", F.explode(places).alias("pos"))
    last = F.col("pos") + (n - 1)
    start, end = (F.get("lines", F.col("pos")), F.get("lines", last)) if lines else (F.col("pos"), last)
    return wide.select("file", "pos", start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), window_key(F.col("hs"), F.col("pos"), n).alias("key"))


def repeated_places(tokens: DataFrame, n: int) -> DataFrame:
    """All places of windows that stand at two or more.

    As :func:`token_windows`, with the places of the window (n_places), how many
    earlier ones of its file overlap this one (close), and whether any place
    makes a pair with it (partner): one that doesn't overlap it in its file.
    """
    windows = token_windows(tokens, n)
    hot = windows.groupBy("key").agg(F.count("*").alias("n_places")).where("n_places > 1")
    at = W.partitionBy("key", "file").orderBy("pos")
    over = lambda lo, hi: F.count("*").over(at.rangeBetween(lo, hi)) if n > 1 else F.lit(0).cast("bigint")
    out = windows.join(hot, "key").withColumn("close", over(-(n - 1), -1)).withColumn("later", over(1, n - 1))
    return out.withColumn("partner", F.col("n_places") - 1 - F.col("close") - F.col("later") > 0).drop("later")


def paired_windows(tokens: DataFrame, n: int) -> DataFrame:
    """Windows with an equal one that doesn't overlap them in their own file."""
    return repeated_places(tokens, n).where("partner")


def repeated_windows(tokens: DataFrame, n: int) -> DataFrame:
    """Windows of at least one pair: fingerprint, n (places), files, pairs.

    Pairs that overlap in one file don't count. The fingerprint is a label of
    32 bits, which unlike windows can share; equal ones are told by their key.
    """
    per_file = repeated_places(tokens, n).groupBy("key", "file").agg(F.first("n_places").alias("n_places"), F.sum("close").alias("close"), F.min("pos").alias("pos"))
    groups = per_file.groupBy("key").agg(F.first("n_places").alias("n"), F.count("*").alias("files"), F.sum("close").alias("close"), F.min(F.struct("file", "pos")).alias("one"))
    groups = groups.select("n", "files", F.expr(PAIRS).alias("pairs"), "one.file", "one.pos").where("pairs > 0")
    # labels are made from one place of each window
    places = groups.groupBy("file").agg(F.collect_list(F.struct("n", "files", "pairs", "pos")).alias("x"))
    each = tokens.select("file", "toks").join(places, "file").select("toks", F.explode("x").alias("x"))
    return each.select(window_fingerprint(F.slice("toks", F.col("x.pos") + 1, n)).alias("fingerprint"), "x.n", "x.files", "x.pairs")


#: Distinct windows of a corpus that are broadcast to find them in another; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def shared_windows(tokens: DataFrame, others: DataFrame, n: int) -> DataFrame:
    """file, other, windows: how many places of a file hold a window of another corpus' text (its distinct windows count)."""
    places = token_windows(tokens, n).select("file", "key")
    wanted = token_windows(others, n).select(F.col("file").alias("other"), "key").distinct()
    if wanted.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    return places.join(wanted, "key").groupBy("file", "other").agg(F.count("*").alias("windows"))


def coalesce_ranges(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Merge ranges of a key that overlap or touch (a start at most ``gap`` past an end)."""
    return islands(ranges, keys, start, end, gap).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def islands(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Ranges with the number of the merged range (island) that they are part of."""
    order = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    return ranges.withColumn("_new", F.when(F.col(start) <= before + gap, 0).otherwise(1)).withColumn("island", F.sum("_new").over(order)).drop("_new")


def clone_blocks(tokens: DataFrame, n: int) -> DataFrame:
    """file, start, end of each block that paired windows cover."""
    return coalesce_ranges(paired_windows(tokens, n).select("file", "start", "end"), ["file"])


def clone_families(tokens: DataFrame, n: int = MIN_TOKENS) -> DataFrame:
    """Families of clones: family, file, start, end for each occurrence, and the family's pairs.

    Windows are one family if they cover a line together in some file. Their
    extension beyond a window needs no step of its own: each further token
    makes a paired window that overlaps the last. ``family`` is a number that
    is stable within a run; :func:`family_ids` makes the id to show.
    """
    places = kept(repeated_places(tokens, n).select("file", "start", "end", F.xxhash64("key").alias("node"), "close", "n_places", "partner"))
    held = kept(islands(places.where("partner").select("file", "start", "end", "node"), ["file"], gap=0).withColumn("block", F.xxhash64("file", "island")))
    # the blocks of a window chain to its first one: edges are as many as such pairs of blocks, however long these are
    first = kept(held.groupBy("node").agg(F.min("block").alias("first")))
    edges = held.join(first, "node").where("block <> first").select(F.col("first").alias("a"), F.col("block").alias("b")).distinct()
    family = kept(connected_components(edges).select(F.col("node").alias("block"), F.col("component").alias("family")))
    blocks = held.groupBy("block", "file").agg(F.min("start").alias("start"), F.max("end").alias("end")).join(family, "block", "left").select(F.coalesce("family", "block").alias("family"), "file", "start", "end")
    per = places.groupBy("node").agg(F.first("n_places").alias("n"), F.sum("close").alias("close")).join(first.withColumnRenamed("first", "block"), "node")
    per = per.join(family, "block", "left").withColumn("family", F.coalesce("family", "block"))
    pairs = per.groupBy("family").agg(F.sum(F.expr(PAIRS)).alias("pairs"))
    return coalesce_ranges(blocks, ["family", "file"]).join(pairs, "family")


def family_ids(families: DataFrame) -> DataFrame:
    """A row per family: family_id, family, occurrences (sorted), pairs.

    The id hashes each occurrence as file, colon, start, dash, end and line
    break, with the numbers as four bytes, the lowest first.
    """
    four = lambda c: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(c), 8, "0"), k, 2) for k in (7, 5, 3, 1))))
    raw = F.concat(F.col("file").cast("string").cast("binary"), F.lit(":").cast("binary"), four(F.col("start")), F.lit("-").cast("binary"), four(F.col("end")), F.lit("\n").cast("binary"))
    listed = families.groupBy("family").agg(F.array_sort(F.collect_list(F.struct(F.col("file").cast("string").alias("file"), "start", "end", raw.alias("raw")))).alias("o"), F.first("pairs").alias("pairs"))
    whole = F.aggregate("o", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["raw"]))
    places = F.transform("o", lambda x: F.struct(x["file"].alias("file"), x["start"].alias("start"), x["end"].alias("end")))
    return listed.select(F.concat(F.lit("dup:"), F.substring(F.sha2(whole, 256), 1, 8)).alias("family_id"), "family", places.alias("occurrences"), "pairs")


def longest_matches(tokens: DataFrame, n: int = MIN_TOKENS) -> DataFrame:
    """file, pos, length: how far the longest pair of a paired window reaches, for the places that hold a family's longest.

    Binary lifting over the length: two places whose longest match is each
    other grow in step, since each length that one holds the other does too. A
    window of a place can't be paired further than the unbroken run of paired
    places from it, which leaves few places to the large steps. Lengths of
    other places are lower bounds.
    """
    places = paired_windows(tokens, n).select("file", "pos")
    order = W.partitionBy("file").orderBy("pos")
    run = F.col("pos") - F.row_number().over(order)
    places = kept(places.withColumn("r", run).withColumn("most", F.max("pos").over(W.partitionBy("file", "r")) - F.col("pos") + n).drop("r").withColumn("length", F.lit(n)))
    longest = places.agg(F.max("most")).first()[0]
    if longest is None:
        return places.select("file", "pos", "length")
    hashes = kept(tokens.select("file", F.transform("toks", lambda t: F.xxhash64(t)).alias("hs")))
    step = 1 << (longest - n).bit_length()
    while step := step >> 1:
        wider = places.where(F.col("length") + step <= F.col("most")).groupBy("file").agg(F.collect_list(F.struct("pos", "length")).alias("x"))
        wider = wider.join(hashes, "file").select("file", "hs", F.explode("x").alias("x"))
        wider = wider.select("file", "x.pos", (F.col("x.length") + step).alias("wide"), window_key(F.col("hs"), F.col("x.pos"), F.col("x.length") + step).alias("key"))
        # paired: an equal stretch in another file, or so far off in this one that the first windows don't overlap
        ends = wider.groupBy("key", "wide").agg(F.min("file").alias("f"), F.max("file").alias("t"), F.min("pos").alias("a"), F.max("pos").alias("b"))
        ends = ends.where((F.col("f") != F.col("t")) | (F.col("b") - F.col("a") >= n)).select("key", "wide")
        grown = wider.join(ends, ["key", "wide"], "left_semi").select("file", "pos", "wide")
        places = kept(places.join(grown, ["file", "pos"], "left").withColumn("length", F.coalesce("wide", "length")).drop("wide"))
    return places.select("file", "pos", "length")


def duplication(files: DataFrame, n: int = MIN_TOKENS, mode: str = "strict", max_families: int = MAX_FAMILIES) -> DataFrame:
    """Findings of duplicated code: the first families by id, at most ``max_families`` (a report's size).

    ``files``: path, content, language. Columns: rule_id, file, start_line,
    end_line, message, severity, confidence, metadata. An unknown mode is strict.
    """
    from ..parse import tables as T

    mode = mode if mode in SIMILARITY else "strict"
    tokens = kept(T.token_table(files.where("language is not null"), mode))
    families = kept(clone_families(tokens, n))
    named = family_ids(families)
    reach = longest_matches(tokens, n).join(tokens.select("file", "lines"), "file").select("file", F.get("lines", F.col("pos")).cast("bigint").alias("line"), "length")
    most = reach.join(families.select("family", "file", "start", "end"), "file").where("line between start and end").groupBy("family").agg(F.max("length").alias("most"))
    top = named.orderBy("family_id").limit(max_families).join(most, "family", "left").withColumn("most", F.coalesce("most", F.lit(n)))
    similarity = SIMILARITY[mode]
    one = F.element_at("occurrences", 1)
    others = F.transform(F.slice("occurrences", 2, 2_000_000_000), lambda o: F.concat(o["file"], F.lit(":"), o["start"].cast("string"), F.lit("-"), o["end"].cast("string")))
    rest = F.size("occurrences") - 4
    summary = F.concat(F.array_join(F.slice(others, 1, 3), ", "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(""))
    message = F.concat(
        F.lit(f"clone family ({n}-"), F.col("most").cast("string"), F.lit(f" tokens, {similarity * 100:.0f}% similar, "), F.size("occurrences").cast("string"), F.lit(" locations): "), summary
    )
    metadata = F.create_map(
        F.lit("family_id"), F.col("family_id"), F.lit("similarity"), F.lit(f"{similarity:.2f}"), F.lit("token_count_min"), F.lit(str(n)), F.lit("token_count_max"), F.col("most").cast("string"),
        F.lit("mode"), F.lit(mode.capitalize()), F.lit("clone_locations"), F.to_json("occurrences"), F.lit("raw_pair_count"), F.col("pairs").cast("string"),
        F.lit("reported_location_count"), F.size("occurrences").cast("string"),
    )
    rule = F.when(F.exists("occurrences", lambda o: o["start"] == 1), "duplicate-function").otherwise("duplicate-block")
    return top.select(
        rule.alias("rule_id"), one["file"].alias("file"), one["start"].cast("int").alias("start_line"), one["end"].cast("int").alias("end_line"), message.alias("message"),
        F.lit("warning").alias("severity"), F.lit(similarity).cast("float").alias("confidence"), metadata.alias("metadata"),
    )


def clone_counters(families: DataFrame, max_families: int = MAX_FAMILIES) -> DataFrame:
    """One row: raw_clone_pairs, clone_families, reported_findings, collapsed_matches, truncated_families."""
    one = families.groupBy("family").agg(F.first("pairs").alias("pairs")).agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("raw_clone_pairs"), F.count("*").alias("clone_families"), F.coalesce(F.sum(F.col("pairs") - 1), F.lit(0)).alias("collapsed_matches")
    )
    return one.withColumns({"reported_findings": F.least("clone_families", F.lit(max_families).cast("bigint")), "truncated_families": F.greatest(F.col("clone_families") - max_families, F.lit(0).cast("bigint"))})
