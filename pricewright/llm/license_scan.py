"""Licence scan by a positional rare-token index (DataFrame functions only).

Every template is a licence text with a mandatory key phrase inside it.  One pass over the files
keeps each file's licence words with their positions; document frequencies over the whole
corpus rank these words by IDF.  A template is looked up by the two highest-IDF words of its key
phrase: each posting gives the place where the phrase would start, and the two lists of places
are intersected.  There the rest of the key phrase is verified, and the share of the template's
words found in place is measured.  All of that is local to a row, so no text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.llm.scratch import staged

#: Fixed values.  Base labels and phrases: what the contract of the query counts.
BASE_TEMPLATES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Fixed values.  Label, key phrase, licence text around it.
MORE_TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    (
        "apache",
        "you may not use this file except in compliance with the license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    (
        "isc",
        "copy modify and or distribute this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("lgpl", "lesser general public license", "gnu lesser general public license"),
    ("agpl", "affero general public license", "gnu affero general public license"),
    ("gpl-3", "general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "general public license version 2", "gnu general public license version 2"),
    (
        "gpl",
        "gnu general public license as published by the free software foundation",
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license as published by the free software foundation",
    ),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0", "cc0 1 0 universal"),
    (
        "unlicense",
        "free and unencumbered software",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    ),
)
#: Part of a template's words that must stand in place beside the key phrase (base templates are all key phrase).
MIN_SHARE = 0.5
#: Words of a key phrase whose postings are intersected before the phrase is verified.
ANCHORS = 2
#: A word of a text whose A-Z are lower-cased: letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null: none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def license_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple = BASE_TEMPLATES,
    more: tuple = MORE_TEMPLATES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``places`` lists what was found: (label, start, base, share), start counted in words from 0
    and share the part of the template's words found in place, which is at least ``min_share``;
    ``score`` is the best share.  Null and empty texts have no words and no labels (empty
    strings).  Input rows, repeated or not, give one row each; an empty table gives an empty
    result; other columns are ignored.
    """
    templates = [(label, True, key.split(), key.split()) for label, key in base]
    templates += [(label, False, key.split(), text.split()) for label, key, text in more]
    files = staged(_posted(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), templates), "licencewords")
    frequency = {r["word"]: r["count"] for r in files.select(F.explode(F.map_keys("posts")).alias("word")).groupBy("word").count().collect()}
    anchors = sorted({_by_rarity(key, frequency)[0][1] for _, _, key, _ in templates})
    places = F.flatten(F.array(*(_places(t, frequency, min_share) for t in templates)))
    # The condition keeps all but a few files off the lookup.
    possible = F.arrays_overlap(F.map_keys("posts"), F.array(*map(F.lit, anchors)))
    found = files.withColumn("places", F.when(possible, places).otherwise(F.filter(places, lambda p: F.lit(False))))
    base_places = F.filter("places", lambda p: p["base"])
    labels = lambda of: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))))
    starts = F.transform(base_places, lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base_places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base_places).alias("base_labels"),
        labels("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        "places",
    )


def _posted(files: DataFrame, templates: list) -> DataFrame:
    """doc_id, n_words, posts: the places of each licence word in each file."""
    vocabulary = sorted({w for t in templates for w in t[3]})
    words = files.select("doc_id", words_of(F.col("text")).alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    hits = words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(placed, lambda x: x["word"].isin(*vocabulary)).alias("hits"))
    distinct = hits.withColumn("own", F.array_distinct(F.transform("hits", lambda x: x["word"])))
    at = F.transform("own", lambda w: F.transform(F.filter("hits", lambda x: x["word"] == w), lambda x: x["at"]))
    return distinct.select("doc_id", "n_words", F.map_from_arrays("own", at).alias("posts"))


def _by_rarity(key: list[str], frequency: dict[str, int]) -> list[tuple[int, str, int]]:
    """(files, word, offset) of a key phrase's words, highest IDF first, ties by alphabet and place."""
    return sorted((frequency.get(w, 0), w, i) for i, w in enumerate(key))


def _at(word: str | Column) -> Column:
    return F.coalesce(F.try_element_at("posts", F.lit(word) if isinstance(word, str) else word), F.array().cast("array<int>"))


def _places(template: tuple, frequency: dict[str, int], min_share: float) -> Column:
    """Where one template stands: rare words' places intersected, key phrase verified, share measured."""
    label, is_base, key, text = template
    ranked = _by_rarity(key, frequency)
    starts = lambda w, i: F.transform(_at(w), lambda p: p - F.lit(i))
    there = reduce(F.array_intersect, [starts(w, i) for _, w, i in ranked[:ANCHORS]])
    there = F.filter(there, lambda s: reduce(Column.__and__, [F.array_contains(_at(w), s + F.lit(i)) for _, w, i in ranked]))
    key_at = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
    words = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(i - key_at).alias("by")) for i, w in enumerate(text)))
    share = lambda s: F.size(F.filter(words, lambda t: F.array_contains(_at(t["word"]), s + t["by"]))) / F.lit(len(text))
    placed = F.transform(there, lambda s: F.struct(F.lit(label).alias("label"), s.alias("start"), F.lit(is_base).alias("base"), share(s).alias("share")))
    return F.filter(placed, lambda p: p["share"] >= min_share)
