"""Licence scans by a positional index of rare words.

Everything is DataFrame operations. One pass over the texts finds each file's
words, the fixed base phrases, and the places of words that licence templates
use (common function words aside). From these places:

* the document frequency of every template word over *all* files gives its IDF;
* each template is indexed by its rarest words, with their positions in it;
* each file looks up all its licence words; every hit votes for (template, file
  position - template position);
* a vote with enough of the template's rare weight is a candidate, and counts
  if the template's mandatory phrase stands at that relative position.

The index has one row per template word (templates are fixed values of this
module, so it is broadcast); votes are rows of (file, template, offset) and
are summed before they are shuffled.

Cases: a null or empty text has no words, labels or score; texts of any length
are read whole; rows equal in id and text share one result; null ids are kept;
an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.common import cut, literal_rows, row_key

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public licence notices; the mandatory phrase of each.
TEMPLATES = {
    "agpl-3.0": ("gnu affero general public license as published by the free software foundation version 3", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license"),
    "artistic-2.0": ("licensed under the artistic license version 2 0", "artistic license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following"
            " conditions are met", "redistribution and use in source and binary forms"),
    "bsd-notice": ("released under the bsd license", "bsd license"),
    "cc-by-4.0": ("licensed under cc by 4 0", "cc by 4 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc-by-attribution": ("creative commons attribution 4 0 international license", "creative commons attribution"),
    "cc0": ("dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    "copyright": ("copyright all rights reserved", "all rights reserved"),
    "epl-2.0": ("made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "general public license version 2"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            "permission to use copy modify"),
    "lgpl": ("gnu lesser general public license", "lesser general public license"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "permission is hereby granted free of charge"),
    "mit-notice": ("released under the mit license", "mit license"),
    "mpl-2.0": ("subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    "proprietary": ("this software is proprietary and confidential", "proprietary and confidential"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software"),
}

#: Function words that the index leaves out.
_COMMON = {"a", "and", "any", "are", "as", "by", "for", "in", "into", "is", "of", "or", "that", "the", "this", "to", "with"}
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE_PER_TEMPLATE, LEAST = 8, 0.6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _vocabulary() -> list[str]:
    return sorted({w for text, _ in TEMPLATES.values() for w in text.split()} - _COMMON)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of a phrase's words standing consecutively."""
    first, *rest = phrase.split(" ")
    at = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    if rest:  # a start stays if every further word stands in its place
        at = F.filter(at, lambda i: reduce(and_, [F.coalesce(F.get(words, i + k) == word, F.lit(False)) for k, word in enumerate(rest, 1)]))
    return F.when(F.array_contains(words, first), at).otherwise(F.array().cast("array<int>"))


def _index(spark: SparkSession) -> DataFrame:
    """One row per template, position and word that isn't a function word."""
    rows = [(name, w, i) for name, (text, _) in TEMPLATES.items() for i, w in enumerate(text.split()) if w not in _COMMON]
    return literal_rows(spark, rows, "template string, word string, place int")


def _phrases(spark: SparkSession) -> DataFrame:
    """Template position and word of every word of the mandatory phrases that isn't a function word."""
    rows = []
    for name, (text, phrase) in TEMPLATES.items():
        words, want = text.split(), phrase.split()
        start = next(i for i in range(len(words)) if words[i:i + len(want)] == want)
        rows += [(name, w, start + i) for i, w in enumerate(want) if w not in _COMMON]
    return literal_rows(spark, rows, "template string, word string, place int")


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """One row per document: id, n_words, base places, labels and score."""
    spark = docs.sparkSession
    lic = F.array(*[F.lit(w) for w in _vocabulary()])
    read = docs.select(F.col(id).alias("id"), row_key(F.col(id), F.col(text)).alias("key"), words_of(F.col(text)).alias("w"))
    hits = F.when(F.arrays_overlap("w", lic), F.filter(F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
                                                       lambda s: s["word"].isin(_vocabulary())))
    base = F.struct(*[_places(F.col("w"), phrase).alias(label) for phrase, label in BASE.items()])
    files = cut(read.select("id", "key", F.size("w").cast("long").alias("n_words"), hits.alias("hits"), base.alias("base")))

    found = (files.filter(F.col("hits").isNotNull()).select("key", "hits").dropDuplicates(["key"])
             .select("key", F.explode("hits").alias("h")).select("key", "h.word", "h.at"))
    # document frequencies over all files, at most one row per template word
    n_files = files.count()
    per_word = (files.filter(F.col("hits").isNotNull()).select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
                .groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    idf = per_word.select("word", F.log(1 + n_files / F.col("df")).alias("idf"))
    rarest = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("idf"), "place"))
    index = (_index(spark).join(idf, "word").withColumn("nth", rarest).filter(F.col("nth") <= RARE_PER_TEMPLATE)
             .select("template", "word", "place", "idf"))
    # words that no file has keep their weight out of reach: templates' totals count all of their rarest words that some file has
    totals = index.groupBy("template").agg(F.sum("idf").alias("total"), F.count(F.lit(1)).alias("n_rare"))
    posting = cut(index.join(totals, "template"))

    votes = (found.join(F.broadcast(posting), "word")
             .groupBy("key", "template", (F.col("at") - F.col("place")).alias("offset"))
             .agg(F.sum("idf").alias("weight"), F.first("total").alias("total")))
    candidates = (votes.withColumn("share", F.least(F.col("weight") / F.col("total"), F.lit(1.0))).filter(F.col("share") >= LEAST))
    phrases = _phrases(spark)
    sizes = phrases.groupBy("template").agg(F.count(F.lit(1)).alias("n_phrase"))
    asked = (candidates.join(F.broadcast(phrases), "template").join(F.broadcast(sizes), "template")
             .select("key", "template", "offset", "share", "n_phrase", "word", (F.col("offset") + F.col("place")).alias("at")))
    verified = (asked.join(found, ["key", "word", "at"]).groupBy("key", "template", "offset")
                .agg(F.count(F.lit(1)).alias("n"), F.first("n_phrase").alias("n_phrase"), F.first("share").alias("share"))
                .filter(F.col("n") == F.col("n_phrase")))
    best = verified.groupBy("key", "template").agg(F.max("share").alias("share"))
    per_file = best.groupBy("key").agg(F.collect_list("template").alias("templates"), F.max("share").alias("share"))

    starts = F.flatten(F.array(*[F.col(f"base.`{label}`") for label in BASE.values()]))
    labels = F.filter(F.array(*[F.when(F.size(f"base.`{label}`") > 0, F.lit(label)) for label in BASE.values()]), lambda x: x.isNotNull())
    out = files.join(per_file, "key", "left")
    every = F.array_sort(F.array_distinct(F.concat(labels, F.coalesce("templates", F.array().cast("array<string>")))))
    score = F.when(F.size(labels) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select(F.col("id").alias(id), "n_words", F.size(starts).cast("long").alias("n_base"),
                      F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                      F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
                      F.round(score, 6).alias("score"))
