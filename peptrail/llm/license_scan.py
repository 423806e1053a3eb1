"""License notices in texts: MinHash bands over overlapping windows, then exact shingle containment.

A text's words are cut into windows of ``STRIDE + SHINGLE - 1`` words, ``STRIDE`` words apart, so every
five-word shingle lies in one window and neighbouring windows share four words. A window's MinHash under
each of ``BANDS`` permutations (one row a band) is looked up among those of the templates' windows at all
offsets. A window of three shingles that holds a one-shingle template meets it with probability
1 - (2/3)^16 = 0.998; a window inside a copy of a longer template equals one of its windows and always
meets it. Everything runs as DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptrail.llm.license_texts import FULL_TEXTS
from peptrail.llm.shared import staged

SHINGLE = 5
STRIDE = 3
BANDS = 16
CONTAINMENT = 0.8
#: bytes that a candidate takes at most in a broadcast table, and that such a table may take
ASKED_BYTES, BROADCAST_BYTES = 128, 32 << 20

#: fixed values: opening or identifying sentences of public licences, beside their full texts
TEMPLATES = FULL_TEXTS | {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hash of the five words from each position on; none of fewer words."""
    last = F.size(words) - SHINGLE
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def windows_of(words: Column, stride: int) -> Column:
    """Words of each window, fewer at a text's end."""
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.slice(words, i + 1, STRIDE + SHINGLE - 1)))


def with_marks(windows: DataFrame, *keep: str) -> DataFrame:
    """A row ``mark`` for each band of each window ``w``: its least shingle hash under the band's permutation.

    The band's number is in the lowest four bits; a band permutes hashes by flipping bits. Hashes are
    columns of scalars, so that this stays compiled code.
    """
    w = F.col("w")
    hashes = {
        f"s{j}": F.when(F.size(w) >= j + SHINGLE, F.xxhash64(*[F.get(w, F.lit(j + i)) for i in range(SHINGLE)])) for j in range(STRIDE)
    }
    flips = [((b + 1) * 0x9E3779B97F4A7C15 ^ (b * 0xD1B54A32D192ED03 >> 3)) & (2**64 - 1) for b in range(BANDS)]
    marks = [
        F.least(*[F.col(s).bitwiseXOR(F.lit(f - 2**64 if f >= 2**63 else f)) for s in hashes]).bitwiseAND(F.lit(~15)).bitwiseOR(F.lit(b))
        for b, f in enumerate(flips)
    ]
    return windows.select(*keep, *[h.alias(s) for s, h in hashes.items()]).select(*keep, F.explode(F.array(*marks)).alias("mark"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(templates.items()), "license string, notice string")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, first_word, n_places``: one row for each document and notice that it holds.

    A notice is held where a stretch of text around a matching window has at least the share
    ``containment`` of the notice's shingles; places are windows with such a stretch. Null, empty and
    short texts hold none. Rows of one doc_id, and those of a null one, are scanned each and reported
    together; equal rows count once. An empty table gives no rows. Templates are the caller's; one of
    fewer than five words is never held.
    """
    spark = docs.sparkSession
    notices = template_table(spark, templates or TEMPLATES)
    # words and shingles are columns of their own, for each is used more than once
    notices = staged(notices.withColumn("words", words_of(F.col("notice"))).withColumn("shingles", shingles_of(F.col("words"))), "notices", narrow=True)
    # templates x windows x bands rows; Spark broadcasts them if their size allows
    index = staged(with_marks(notices.select("license", F.explode(windows_of(F.col("words"), 1)).alias("w")), "license").distinct(), "index", narrow=True)
    # a text is known by its digest: null and repeated ids need no care until the end
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text", F.md5("text").alias("digest"))
    windows = (
        texts.select("digest", words_of(F.col("text")).alias("words"))
        .select("digest", F.posexplode(windows_of(F.col("words"), STRIDE)).alias("window", "w"))
    )
    candidates = staged(
        with_marks(windows, "digest", "window").join(index, "mark").select("digest", "window", "license").distinct(), "licences", narrow=True
    )
    facts = notices.select("license", F.array_distinct("shingles").alias("shingles"), F.size("words").alias("n_words"))
    asked = candidates.select("digest").distinct()
    if asked.count() * ASKED_BYTES <= BROADCAST_BYTES:  # counted: then no text is moved; else Spark sorts or filters by a Bloom filter
        asked = F.broadcast(asked)
    held = (
        texts.join(asked, "digest", "left_semi")
        .select("digest", words_of(F.col("text")).alias("words"))
        .select("digest", F.posexplode(shingles_of(F.col("words"))).alias("at", "shingle"))
        .join(facts.select("license", F.explode("shingles").alias("shingle")), "shingle")
        .dropDuplicates(["digest", "license", "at"])  # texts that stand more than once
        .join(candidates.select("digest", "license").distinct(), ["digest", "license"], "left_semi")
    )
    judged = (
        _held_from(held, candidates, facts).withColumn("share", F.col("n_held") / F.col("n_shingles"))
        .where(F.col("share") >= containment)
        .groupBy("digest", "license").agg(F.max("share").alias("share"), F.min("window").alias("window"), F.count("*").alias("places"))
    )
    return (
        texts.select("doc_id", "digest").join(judged, "digest").dropDuplicates(["doc_id", "digest", "license"])
        .groupBy("doc_id", "license")
        .agg(
            F.round(F.max("share"), 6).alias("containment"), (F.min("window") * STRIDE).alias("first_word"),
            F.sum("places").alias("n_places"),
        )
    )


def _held_from(held: DataFrame, candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """The candidates with ``n_held`` of a notice's ``n_shingles`` distinct shingles in the stretch around the window.

    A stretch begins a notice's length before the window and takes twice that. A shingle at ``at`` is the
    first of its kind in all stretches that begin after its last place before, and not so early that they
    end before it: it adds one from there up to ``at``, so a running sum over where stretches begin
    counts them for all windows of a text at once, in time linear in its shingles.
    """
    facts = facts.select("license", "n_words", F.size("shingles").alias("n_shingles"))
    earlier = F.lag("at").over(Window.partitionBy("digest", "license", "shingle").orderBy("at"))
    begins = F.greatest(F.lit(0), F.coalesce(earlier + 1, F.lit(0)), F.col("at") - 2 * F.col("n_words") - STRIDE)
    turns = (
        held.join(facts, "license").select("digest", "license", begins.alias("low"), "at")
        .select("digest", "license", F.explode(F.array(F.struct(F.col("low"), F.lit(1).alias("step")), F.struct((F.col("at") + 1).alias("low"), F.lit(-1).alias("step")))).alias("turn"))
        .select("digest", "license", "turn.low", "turn.step", F.lit(None).cast("int").alias("window"), F.lit(None).cast("int").alias("n_shingles"))
    )
    asked = candidates.join(facts, "license").select(
        "digest", "license", F.greatest(F.lit(0), F.col("window") * STRIDE - F.col("n_words")).alias("low"), F.lit(0).alias("step"), "window", "n_shingles"
    )
    so_far = Window.partitionBy("digest", "license").orderBy("low").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.unionByName(asked).withColumn("n_held", F.sum("step").over(so_far)).where("window is not null")
