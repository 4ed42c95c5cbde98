"""License scans by diagonal voting, with DataFrame operations only.

Word k-grams (k = 2) of every text meet the k-gram positions of fixed templates in a join by hash. Each hit votes for a
diagonal, the place in the text less the place in the template. Diagonals of one template that differ by up to `SLACK`
(a word added or left out) merge into a span, unless their places lie further apart than the template is long. A span is
verified by the share of the template's k-grams it holds; `base` phrases need every word on one diagonal.

A null text is empty: no words, no places, no labels, score 0. Nulls in doc_id are kept. Repeated rows each give a row with
equal values. Ties between spans don't matter, as labels are sets and the score is a maximum. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases and labels that a scan must report.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening words of well-known public licence notices; labels of the method itself.
NOTICES = {
    "released under the mit license": "mit-notice",
    "licensed under the apache license version 2 0": "apache-2.0",
    "is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
}
K, SLACK, LEAST_SHARE = 2, 2, 0.85
#: Bytes between words, as Java's regular expressions write them.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates(spark: SparkSession) -> DataFrame:
    """template, label, base, grams (its number of k-grams), place and gram, one row for each k-gram of a template."""
    rows = [(i, phrase, label, base) for i, (phrase, label, base) in enumerate([(p, x, True) for p, x in BASE.items()] + [(p, x, False) for p, x in NOTICES.items()])]
    values = ", ".join(f"({i}, split('{p}', ' '), '{x}', {str(b).lower()})" for i, p, x, b in rows)
    all_templates = spark.sql(f"select * from values {values} as t(template, words, label, base)")
    grams = all_templates.select("template", "label", "base", (F.size("words") - (K - 1)).alias("grams"), F.posexplode(_grams("words")).alias("place", "gram"))
    return grams.where(F.col("gram").isNotNull())


def _grams(words: str):
    """The hash of each run of K words by its start; null at the end, where words are missing."""
    return F.transform(F.col(words), lambda w, i: F.when(i + (K - 1) < F.size(words), F.xxhash64(w, *(F.get(F.col(words), i + j) for j in range(1, K)))))


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The scan's row for every row of docs."""
    known = templates(spark)
    # the templates are fixed, so their hashes are a short list; it spares the join the grams that can't meet any
    hashes = sorted({r.gram for r in known.select("gram").distinct().collect()})
    text = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), f"^{NOT_WORD}", "")
    cut = docs.select("doc_id", F.split(text, NOT_WORD).alias("w"))
    # an empty text splits into one empty word, and a last separator leaves one behind
    cut = cut.select("doc_id", F.when(F.element_at("w", -1) == "", F.slice("w", F.lit(1), F.size("w") - 1)).otherwise(F.col("w")).alias("words"))
    hits = F.filter(F.transform(_grams("words"), lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda h: h.getField("gram").isin(hashes))
    rows = cut.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")).withColumn("row", F.monotonically_increasing_id())
    votes = rows.select("doc_id", "n_words", "row", F.explode_outer("hits").alias("hit")).select("doc_id", "n_words", "row", F.col("hit.at").alias("at"), F.col("hit.gram").alias("gram"))
    votes = votes.join(F.broadcast(known), "gram", "left").withColumn("diagonal", F.col("at") - F.col("place"))
    # votes of a diagonal: all grams of a template at one offset are one full place of its phrase
    key = ["row", "doc_id", "n_words", "template"]
    by_diagonal = votes.groupBy(*key, "label", "base", "grams", "diagonal").agg(F.count("place").alias("votes"), F.collect_set("place").alias("places"))
    # neighbouring diagonals merge; a gap in offset starts another span. A window holds one row's hits on one template.
    w = Window.partitionBy(*key).orderBy("diagonal")
    gap = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= SLACK, 0).otherwise(1)
    spans = by_diagonal.withColumn("span", gap)
    spans = spans.withColumn("span", F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*key, "label", "base", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
        F.sum((F.col("votes") == F.col("grams")).cast("long")).alias("full"),
        F.min(F.when(F.col("votes") == F.col("grams"), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("votes") == F.col("grams"), F.col("diagonal"))).alias("last"),
    )
    share = F.coalesce(F.col("held") / F.col("grams"), F.lit(0.0))
    spans = spans.withColumn("share", F.when(F.col("base"), F.when(F.col("full") > 0, 1.0).otherwise(0.0)).otherwise(share))
    base = F.col("base") & (F.col("full") > 0)
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("full"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | (F.col("share") >= LEAST_SHARE), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
