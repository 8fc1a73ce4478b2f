"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of a text is joined by its hash to the places where templates hold the same k-gram; a hit
votes for the diagonal text position - template position. Votes are summed by diagonal, diagonals that
lie within `drift` of each other and whose spans touch are merged (an inserted or deleted word shifts the diagonal by one), and
a merged span is verified: the words that agree must make up `coverage` of the template, within a span
that is not much longer than it. The template table has a few hundred rows whatever the input, so it is
the one side that is broadcast, and hits leave the scan already filtered: no text is shuffled. Each text is cut into words once: one more
k-gram, which no text holds, goes with every text, passes the join and brings the text's number of words.

The short phrases are templates too: they need every word on one diagonal.

Defined results: null text is empty; texts of fewer than k words have no hit; a repeated row is one document a
row; very long texts are scanned whole; empty table: empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, text_of

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of public licenses, as their stewards print them, lower-cased and without punctuation.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc by nc", "licensed under cc by nc 4 0"),
    ("cc by sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)
#: Whole notices: their first words alone are not enough.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
COVERAGE = 0.75
DRIFT = 3
GRAM = 2
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: In no text's words: it stands for the text itself.
WHOLE = "\x00"


def template_places(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES + NOTICES, k: int = GRAM) -> DataFrame:
    """One row for each k-gram of each template: label, is_base, template, t_words, t_pos, gram and its words; template -1 stands for whole texts."""
    if short := [x for x, _ in phrases if len(x.split()) < k]:
        raise ValueError(f"phrases of fewer than {k} words: {short}")
    rows = [
        (label.replace(" ", "-"), base, number, len(words), i, words[i : i + k])
        for number, (label, base, text) in enumerate([(y, True, x) for x, y in phrases] + [(x, False, y) for x, y in templates])
        for words in [text.split()]
        for i in range(len(words) - k + 1)
    ]
    made = spark.createDataFrame([*rows, ("", False, -1, 0, 0, [WHOLE] * k)], "label string, is_base boolean, template int, t_words int, t_pos int, t array<string>")
    return made.select("*", F.xxhash64(*[F.col("t")[j] for j in range(k)]).alias("gram"))


def words_of(docs: DataFrame) -> DataFrame:
    """row, doc_id and words. lower() folds A-Z; the one other character that it folds to a-z, the Kelvin sign, is set aside, and
    what it does to other letters outside ASCII changes neither which characters make words nor any hit. The number of a row is good for one run: what
    carries it is written before it is used twice."""
    text = F.lower(F.replace(text_of(), F.lit("\u212a"), F.lit("ķ")))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(text, F.lit(WORD), F.lit(1)).alias("words"))


def hits(rows: DataFrame, places: DataFrame, k: int = GRAM) -> DataFrame:
    """rows: id columns and words. One row for each k-gram of a text and template place that agree, and one for each text (template -1), with the text's n_words."""
    ids = [c for c in rows.columns if c != "words"]
    w, n = F.col("words"), F.size("words")
    column = lambda j: F.concat(F.array(F.lit(WHOLE)), F.slice(w, j + 1, F.greatest(n - (k - 1), F.lit(0)))).alias(f"w{j}")
    grams = rows.select(*ids, n.cast("long").alias("n_words"), F.posexplode(F.arrays_zip(*[column(j) for j in range(k)])).alias("pos", "g"))
    grams = grams.select(*ids, "n_words", (F.col("pos") - 1).alias("pos"), F.xxhash64(*[F.col("g")[f"w{j}"] for j in range(k)]).alias("gram"), *[F.col("g")[f"w{j}"].alias(f"w{j}") for j in range(k)])
    same = grams.join(F.broadcast(places), "gram")
    for j in range(k):
        same = same.where(F.col(f"w{j}") == F.col("t")[j])
    return same.select(*ids, "n_words", "label", "is_base", "template", "t_words", "t_pos", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))


def spans(found: DataFrame, key: str, coverage: float = COVERAGE, drift: int = DRIFT, k: int = GRAM) -> DataFrame:
    """Verified spans: key, label, is_base, first_word (start), last (its last word), score."""
    diagonals = found.groupBy(key, "label", "is_base", "template", "t_words", "diagonal").agg(F.count_distinct("pos").alias("votes"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    # base phrases stand word for word on one diagonal; their places must not merge
    line = Window.partitionBy(key, "template").orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(line) <= drift) & (F.col("start") <= F.lag("end").over(line) + F.col("t_words")) & ~F.col("is_base")
    merged = diagonals.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("band", F.sum("new").over(line))
    bands = merged.groupBy(key, "label", "is_base", "template", "t_words", "band").agg(F.sum("votes").alias("votes"), F.min("start").alias("first_word"), F.max("end").alias("last"))
    score = F.least(F.lit(1.0), F.col("votes") / (F.col("t_words") - (k - 1)))
    real = bands.withColumn("score", score).where((F.col("score") >= coverage) & (F.col("last") - F.col("first_word") + (k - 1) <= F.col("t_words") * 2))
    return real.where(~F.col("is_base") | (F.col("score") >= 1.0))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES + NOTICES, coverage: float = COVERAGE, drift: int = DRIFT, k: int = GRAM) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    every = stored(hits(words_of(docs), template_places(docs.sparkSession, phrases, templates, k), k))
    found = spans(every.where("template >= 0"), "row", coverage, drift, k)
    by_doc = found.groupBy("row").agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return every.where("template = -1").select("row", "doc_id", "n_words").join(by_doc, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
