"""License scans by diagonal voting [native].

All rolling word k-grams of a text meet, by hash in one Spark join, the places
of the same grams in license templates. A hit votes for the diagonal (place in
the text minus place in the template); neighbouring diagonals of a template
merge into spans, so that a few inserted or dropped words don't break a match;
spans are verified by the template words they really cover.

A template with a budget of no error must be covered whole on one diagonal:
that is an exact phrase.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from .common import staged, table
from .url_filter import ascii_lower

K = 3
#: What separates words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand consecutively: (phrase, label).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Wordings of the method's own, matched with errors: (text, label). Sentences that versions of a license share have a label without one.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)
#: Templates up to this many grams are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 50_000


def words_of(text: Column) -> Column:
    """The words of a text as an array, empty for null and wordless texts."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], k: int = K) -> DataFrame:
    """A row per gram place of each template, exact phrases first.

    Templates shorter than ``k`` words have no gram and are refused.
    """
    rows = []
    for t, (text, label, exact) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in templates]):
        w = text.split()
        if len(w) < k:
            raise ValueError(f"a template needs at least {k} words: {text!r}")
        rows += [(t, exact, len(w), label, i, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    out = spark.createDataFrame(rows, "t int, exact boolean, t_words int, label string, t_at int, t_gram string")
    out = out.withColumn("t_hash", F.xxhash64("t_gram"))
    return F.broadcast(out) if len(rows) <= BROADCAST_GRAMS else out


def vote(df: DataFrame, grams: DataFrame, text: str = "text", keep: Sequence[str] = (), k: int = K) -> DataFrame:
    """Votes by (row, template, diagonal), staged in the shared folder.

    Every row of ``df`` has at least one row here (template null if it hit
    nothing), which carries its ``keep`` columns and its number of words.
    """
    base = df.select(F.struct(*keep).alias("keep"), words_of(F.col(text)).alias("words")).withColumn("uid", F.monotonically_increasing_id())
    base = base.select("uid", "keep", F.size("words").alias("n_words"), *(F.expr(f"slice(words, {i + 1}, greatest(size(words) - {k - 1}, 0))").alias(f"w{i}") for i in range(k)))
    names = [f"w{i}" for i in range(k)]
    places = base.select("uid", "keep", "n_words", F.posexplode_outer(F.arrays_zip(*names)).alias("at", "g"))
    places = places.select("uid", "keep", "n_words", F.coalesce("at", F.lit(0)).alias("at"), F.concat_ws(" ", *(F.col("g")[n] for n in names)).alias("gram"))
    # Equal hashes are confirmed by the gram itself. The first place of a text stays, hit or not.
    voted = places.join(grams, (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left").where("t is not null or at = 0")
    diagonals = voted.groupBy("uid", "t", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        *(F.first(c).alias(c) for c in ("keep", "n_words", "label", "exact", "t_words")), F.sort_array(F.collect_list("t_at")).alias("t_ats")
    )
    return staged(diagonals, "license-votes")


def phrase_places(votes: DataFrame, k: int = K) -> DataFrame:
    """Exact phrases: all grams on one diagonal. (uid, label, first, last)"""
    return votes.where(f"exact and size(t_ats) = t_words - {k - 1}").select("uid", "label", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("t_words") - 1).alias("last"))


def near_spans(votes: DataFrame, k: int = K, drift: int = 3, min_cover: float = 0.7) -> DataFrame:
    """Spans of the other templates: (uid, label, first, last, cover).

    Diagonals at most ``drift`` apart merge; a span stays if the template words
    that its grams cover are ``min_cover`` of the template or more. A window
    holds the votes of one template in one text only.
    """
    near = votes.where("not exact")
    order = W.partitionBy("uid", "t").orderBy("diagonal")
    near = near.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= drift, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    spans = near.groupBy("uid", "t", "run").agg(
        F.first("label").alias("label"), F.first("t_words").alias("t_words"),
        F.min(F.col("diagonal") + F.array_min("t_ats")).alias("first"), (F.max(F.col("diagonal") + F.array_max("t_ats")) + (k - 1)).alias("last"),
        F.array_distinct(F.flatten(F.collect_list("t_ats"))).alias("t_ats"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_ats", lambda i: F.sequence(i, i + (k - 1))))))
    return spans.withColumn("cover", covered / F.col("t_words")).where(F.col("cover") >= min_cover).select("uid", "label", "first", "last", "cover")


def license_spans(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), phrases=PHRASES, templates=TEMPLATES, drift: int = 3, min_cover: float = 0.7) -> DataFrame:
    """A row per license span: the ``keep`` columns, label, first and last word,
    cover (1.0 for exact phrases) and whether it is an exact phrase.

    Null, empty and wordless texts, or none at all, give no span. Repeated rows
    are scanned apart; other columns are not looked at, whatever their names.
    """
    votes = vote(df, template_grams(df.sparkSession, phrases, templates), text, keep)
    found = phrase_places(votes).withColumns({"cover": F.lit(1.0), "exact": F.lit(True)}).unionByName(near_spans(votes, drift=drift, min_cover=min_cover).withColumn("exact", F.lit(False)))
    rows = votes.groupBy("uid").agg(F.first("keep").alias("keep"))
    return found.join(rows, "uid").select(*(F.col("keep")[c].alias(c) for c in keep), "label", "first", "last", "cover", "exact")


def scan_licenses(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), phrases=PHRASES, templates=TEMPLATES, drift: int = 3, min_cover: float = 0.7) -> DataFrame:
    """A row per row of ``df`` with what :func:`license_spans` finds, summed up.

    Columns: ``keep``, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the best cover). Nothing found: zero places, null words,
    empty labels and score 0; so also for null, empty and wordless texts.
    """
    votes = vote(df, template_grams(df.sparkSession, phrases, templates), text, keep)
    # what a row's phrases and spans say, beside the row itself, in one union: no row is lost and none is joined
    row = votes.select("uid", "keep", "n_words")
    void = {c: F.lit(None).cast(kind) for c, kind in (("keep", votes.schema["keep"].dataType), ("n_words", "int"), ("base", "string"), ("first", "int"), ("label", "string"), ("cover", "double"))}
    cols = ("uid", *void)
    pad = lambda d: d.withColumns({c: v for c, v in void.items() if c not in d.columns}).select(*cols)
    parts = pad(row).union(pad(phrase_places(votes).select("uid", F.col("label").alias("base"), "first", "label", F.lit(1.0).alias("cover"))))
    parts = parts.union(pad(near_spans(votes, drift=drift, min_cover=min_cover).select("uid", "label", "cover")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = parts.groupBy("uid").agg(
        F.first("keep", ignorenulls=True).alias("keep"), F.max("n_words").cast("bigint").alias("n_words"), F.count("base").alias("n_base"),
        F.min("first").cast("bigint").alias("first_word"), F.max("first").cast("bigint").alias("last_word"),
        joined("base").alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    return out.select(*(F.col("keep")[c].alias(c) for c in keep), *out.columns[2:])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and wordings in every whole text of ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents"))
