"""License notices by diagonal voting, with DataFrame functions alone.

Words of a text (runs of a-z, 0-9 and signs beyond ASCII; A-Z as a-z) are cut into all rolling runs of three words and
joined by hash to the places where such runs stand in the templates.  A hit at word i of the text and word j of a
template votes for the diagonal i - j: a verbatim copy puts all its votes on one.  Votes are counted per text, template
and diagonal; diagonals a few words apart, as inserted or missing words make them, are merged while their spans follow
each other; and a merged span is a notice if it has enough of the template's runs and is not much longer than it.

The templates are a fixed table of a few hundred rows, so it is broadcast.  What leaves the first stage is one row per
text and one per hit.

Base phrases are templates of their own; a place where one stands is a diagonal with all its runs.

Defined cases: a null or empty text has no words and score 0; texts of fewer than three words have no hits; rows with
equal doc_id, and equal rows, are scanned one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = 3
MERGE, COVERAGE, STRETCH = 2, 0.75, 1.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose places are counted, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Openings of well-known notices as their licenses word them, and labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later "
     "version", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 2 of the license or at your option any later "
     "version", "gpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(run, at, template, label, base, runs): each run of three words of each template."""
    rows = []
    for number, (text, label) in enumerate([*phrases, *notices]):
        words = text.split()
        runs = len(words) - RUN + 1
        rows += [(*words[at : at + RUN], at, number, label, number < len(phrases), runs) for at in range(runs)]
    table = spark.createDataFrame(
        rows, "w0 string, w1 string, w2 string, at int, template int, label string, base boolean, runs int")
    return table.select(F.xxhash64("w0", "w1", "w2").alias("run"), "at", "template", "label", "base", "runs")


def hits(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, place, at, template, label, base, runs): one row for each text, and one for each hit."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                        words_of(F.coalesce("text", F.lit(""))).alias("words"))
    n = F.size("words")
    runs = F.arrays_zip(F.col("words").alias("w0"), F.slice("words", 2, F.greatest(n, F.lit(1))).alias("w1"),
                        F.slice("words", 3, F.greatest(n, F.lit(1))).alias("w2"))
    rolled = texts.select("row", "doc_id", n.cast("long").alias("n_words"), F.posexplode_outer(runs).alias("place", "r"))
    hashed = rolled.select("row", "doc_id", "n_words", "place",
                           F.when(F.col("place") <= F.col("n_words") - RUN, F.xxhash64("r.w0", "r.w1", "r.w2")).alias("run"))
    # a fixed table of a few hundred rows
    found = hashed.join(F.broadcast(table), "run", "left")
    return found.where("template is not null or coalesce(place, 0) = 0").drop("run")


def scan(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    mine = hits(docs, table).repartition("row").withColumn("diagonal", F.col("place") - F.col("at"))
    voted = mine.groupBy("row", "doc_id", "n_words", "template", "label", "base", "runs", "diagonal").agg(
        F.count("*").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"))
    near = Window.partitionBy("row", "template").orderBy("diagonal", "low")
    # a diagonal starts a new span unless it is near the one before and follows on from it
    apart = (F.col("diagonal") - F.lag("diagonal").over(near) > MERGE) | (
        F.col("low") - F.lag("high").over(near) > RUN + MERGE)
    merged = voted.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
    merged = merged.withColumn("span", F.sum("apart").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("base") & (F.col("votes") == F.col("runs"))
    spans = merged.groupBy("row", "doc_id", "n_words", "template", "label", "base", "runs", "span").agg(
        F.sum("votes").alias("votes"), (F.max("high") - F.min("low") + RUN).alias("length"),
        F.count(F.when(place, 1)).alias("n_base"), F.min(F.when(place, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).alias("last_word"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("runs"))
    fits = F.col("length") <= STRETCH * (F.col("runs") + RUN - 1)
    spans = spans.withColumn("score", F.coalesce(F.when(F.col("n_base") > 0, 1.0).otherwise(F.when(fits, cover)), F.lit(0.0)))
    shown = F.when((F.col("n_base") > 0) | (~F.col("base") & (F.col("score") >= COVERAGE)), F.col("label"))
    return (spans.groupBy("row", "doc_id", "n_words").agg(
        F.sum("n_base").alias("n_base"), F.min("first_word").cast("long").alias("first_word"),
        F.max("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n_base") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(shown)), ",").alias("labels"), F.max("score").alias("score")).drop("row"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    return scan(docs, templates(docs.sparkSession))
