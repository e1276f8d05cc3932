"""Licence scan: diagonal voting of word pairs against licence templates.

Every pair of neighbouring words of a text is hashed and Spark-joined to the places of the same pair in the
templates. A hit at word p of the text and place t of a template lies on diagonal p - t, so a template that stands
in a text unbroken is one full diagonal. Neighbouring diagonals, which words put in or left out give rise to, are
merged. Hits count only after their words have been compared.

The templates are part of the program, so the joined side has a fixed size and is broadcast. Texts are not
shuffled: what moves are hits and one marker row per document, hashed by id and content digest.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.words import WORD_CODES, claim, codes, lists, sha256, windows, with_columns

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Openings of public licences, as their authors publish them.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
    "compliance with the License",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
}
COVERAGE = 0.6
BAND = 3
MARK = 0
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z and all beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def pairs(words: list[bytes]) -> np.ndarray:
    """Codes of neighbouring words as signed numbers, none equal to MARK."""
    made = windows(codes(words), 2).view(np.int64)
    return np.where(made == MARK, 1, made)


def template_rows(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(code, template, place, words): a row for each pair of words of each template, and the marker."""
    rows = [(MARK, "", 0, None)]
    for name, text in [(f"phrase {p}", p) for p in phrases] + [(f"text {t}", x) for t, x in templates.items()]:
        words = words_of(text)
        for i, code in enumerate(pairs(words).tolist()):
            rows.append((code, name, i, bytearray(b" ".join(words[i : i + 2]))))
    return spark.createDataFrame(rows, "code LONG, template STRING, place INT, words BINARY")


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
    identity: str = "doc_id", text: str = "text", coverage: float = COVERAGE,
) -> DataFrame:
    """(identity, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of `docs`.

    n_base counts the places of the phrases, first_word and last_word are their first and last starts or null. Labels
    are those of the phrases found and of the templates of which some stretch covers `coverage`; score is the largest
    share of a template or phrase found. spans lists (template, start, end, share) in words. Null and empty texts have
    no words and empty labels; repeated rows each give a row; a null id stays; an empty table gives no rows.
    """

    def compute(texts):
        claim(WORD_CODES)
        rows = [words_of(t) for t in texts]
        starts = [np.cumsum([0, *[len(w) + 1 for w in words]]) for words in rows]
        return {
            "digest": [sha256(t or "") for t in texts],
            "n_words": [len(words) for words in rows],
            "plain": pa.array([b" ".join(words) for words in rows], pa.binary()),
            "starts": lists(starts, pa.int32()),
            "pairs": lists([np.append(pairs(words), MARK) for words in rows], pa.int64()),
        }

    ddl = "digest STRING, n_words LONG, plain BINARY, starts ARRAY<INT>, pairs ARRAY<LONG>"
    rows = with_columns(docs.select(F.col(identity).alias("id"), F.col(text).alias("text")), "text", ddl, compute)
    known = F.broadcast(template_rows(docs.sparkSession, phrases, templates))
    same = F.expr("words IS NULL OR substring(plain, starts[pos] + 1, starts[pos + 2] - starts[pos] - 1) = words")
    hits = (
        rows.select("id", "digest", "n_words", "plain", "starts", F.posexplode("pairs").alias("pos", "code"))
        .join(known, "code").filter(same)
        .select("id", "digest", "template", "place", F.when(F.col("template") == "", F.col("n_words"))
                .otherwise(F.col("pos") - F.col("place")).alias("diagonal"))
        .repartition("id", "digest")
    )
    doc = ["id", "digest"]
    once = hits.groupBy(*doc, "template", "diagonal", "place").agg(F.count("*").alias("copies"))
    diagonals = once.groupBy(*doc, "template", "diagonal").agg(
        F.collect_set("place").alias("places"), F.max("copies").alias("copies"))
    order = Window.partitionBy(*doc, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    sizes = {f"phrase {p}": len(words_of(p)) - 1 for p in phrases}
    sizes |= {f"text {t}": len(words_of(x)) - 1 for t, x in templates.items()}
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    labels = {f"phrase {p}": label for p, label in phrases.items()} | {f"text {t}": t for t in templates}
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    full = F.size("places") == size[F.col("template")]
    regions = (
        diagonals.withColumn("fresh", (F.coalesce(gap, F.lit(BAND + 1)) > BAND).cast("int"))
        .withColumn("region", F.sum("fresh").over(order))
        .groupBy(*doc, "template", "region").agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
            F.sum(full.cast("long")).alias("whole"),
            F.min(F.when(full, F.col("diagonal"))).alias("first_whole"),
            F.max(F.when(full, F.col("diagonal"))).alias("last_whole"),
            F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
            F.max(F.col("diagonal") + F.array_max("places") + 2).alias("end"),
            F.max("copies").alias("copies"), F.max("diagonal").alias("n_words"),
        )
        .withColumn("share", F.col("covered") / size[F.col("template")])
    )
    marker, phrase = F.col("template") == "", F.col("template").startswith("phrase ")
    found = F.col("template").startswith("text ") & (F.col("share") >= coverage)
    base = phrase & (F.col("whole") > 0)

    def joined(wanted):
        return F.array_join(F.array_sort(F.collect_set(F.when(wanted, label[F.col("template")]))), ",")

    return (
        regions.groupBy(*doc).agg(
            F.max(F.when(marker, F.col("n_words"))).alias("n_words"),
            F.coalesce(F.sum(F.when(base, F.col("whole"))), F.lit(0)).alias("n_base"),
            F.min(F.when(base, F.col("first_whole"))).alias("first_word"),
            F.max(F.when(base, F.col("last_whole"))).alias("last_word"),
            joined(base).alias("base_labels"), joined(base | found).alias("labels"),
            F.coalesce(F.max(F.when(~marker, F.col("share"))), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(base | found, F.struct("template", "start", "end", "share")))).alias("spans"),
            F.max(F.when(marker, F.col("copies"))).alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(F.col("id").alias(identity), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                "score", "spans")
    )
