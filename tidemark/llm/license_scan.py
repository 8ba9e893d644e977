"""License scans: word k-grams joined to template positions, votes gathered by diagonal, spans verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lower_az

# Phrases that name a licence, with the licence's label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# The wording of common licence notices, by label.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
}
#: What stands between words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _phrases(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_labels; each phrase is sought in the words joined by two spaces, so that places never share one."""
    row = docs.withColumn("n_words", F.size("words").cast("long"))
    row = row.withColumn("__line", F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))
    count, first, last, found = F.lit(0), [], [], []
    for phrase, label in PHRASES.items():
        mark = " " + "  ".join(phrase.split()) + " "
        n = ((F.length("__line") - F.length(F.replace(F.col("__line"), F.lit(mark), F.lit("")))) / len(mark)).cast("long")
        has = F.contains("__line", F.lit(mark))
        words_in = lambda s: F.floor((F.length(s) - F.length(F.replace(s, F.lit("  "), F.lit("")))) / 2)
        before, after = F.substring_index("__line", mark, 1), F.substring_index("__line", mark, -1)
        k = len(phrase.split())
        count = count + F.when(has, n).otherwise(0)
        # a side that isn't empty is followed by one space of the pair between words, so its pairs are one too few
        first.append(F.when(has, F.when(before == "", 0).otherwise(words_in(before) + 1)))
        last.append(F.when(has, F.col("n_words") - k - F.when(after == "", 0).otherwise(words_in(after) + 1)))
        found.append(F.when(has, F.lit(label)))
    return row.withColumns(
        {
            "n_base": count.cast("long"),
            "first_word": F.least(*first).cast("long"),
            "last_word": F.greatest(*last).cast("long"),
            "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))),
        }
    ).drop("__line")


def template_grams(spark, k: int) -> DataFrame:
    """(label, t_len, t_pos, gram): every word k-gram of the templates; some hundreds of rows, whatever the corpus holds."""
    rows = [(label, F.lit(text)) for label, text in TEMPLATES.items()]
    df = spark.sql("SELECT explode(map(" + ",".join(f"'{a}','{TEMPLATES[a]}'" for a, _ in rows) + ")) AS (label, body)")
    df = df.withColumn("w", F.split("body", " "))
    return df.select("label", F.size("w").alias("t_len"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))).alias("t_pos", "t_gram"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, drift: int = 3, min_words: int = 12, min_share: float = 0.6) -> DataFrame:
    """Verified spans: doc_id, label, first, last (words, from 0), matched, coverage of the template.

    Every k-gram of every text is joined, by 64-bit hash and then by its words, to the template positions (broadcast; a
    few hundred rows). Votes are gathered per text, template and diagonal (place in text less place in template);
    diagonals within drift of each other are merged, and a span stands if it is min_words long and at least min_share
    of its k-grams voted, a place counted once however many diagonals it votes for. matched is the number of words that
    the voting k-grams, whose words are equal, cover. A null text has no span, nor has an empty table; spans of rows
    with one id count together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), license_words(F.col(text_col)).alias("words")).filter(F.size("words") >= k)
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))
    rows = rows.select("doc_id", F.posexplode(grams).alias("pos", "gram"))
    at = template_grams(spark, k)
    votes = rows.join(F.broadcast(at), (F.xxhash64("gram") == F.xxhash64("t_gram")) & (F.col("gram") == F.col("t_gram")))
    # a diagonal's places are as many as the template's words at most
    votes = votes.groupBy("doc_id", "label", "t_len", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("pos").alias("at"))
    near = Window.partitionBy("doc_id", "label").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > drift).cast("int"), F.lit(1))
    votes = votes.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(near))
    spans = votes.groupBy("doc_id", "label", "t_len", "band").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    # words that some equal gram covers, each once: what the template and the text have in common word by word
    steps = F.transform(F.sequence(F.lit(1), F.size("at")), lambda i: F.when(i == 1, F.lit(k)).otherwise(F.least(F.lit(k), F.get("at", i - 1) - F.get("at", i - 2))))
    spans = spans.select("doc_id", "label", "t_len", F.size("at").alias("votes"), F.get("at", F.lit(0)).alias("first"), (F.element_at("at", -1) + k - 1).alias("last"), F.aggregate(steps, F.lit(0), lambda n, x: n + x).alias("matched"))
    whole = F.col("last") - F.col("first") + 1
    spans = spans.filter((whole >= min_words) & (F.col("votes") >= min_share * (whole - k + 1)))
    return spans.select("doc_id", "label", "first", "last", "matched", F.least(F.lit(1.0), F.col("matched") / F.col("t_len")).alias("coverage"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **spans) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text counts as empty: no words, no labels, score 0. Labels are distinct, sorted and joined by commas. score is
    1 where a phrase stands, else the largest coverage of a template. Only the two named columns are looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), license_words(F.col(text_col)).alias("words"))
    rows = _phrases(rows).drop("words")
    found = license_spans(docs, id_col, text_col, **spans).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
