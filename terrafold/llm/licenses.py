"""Licence scan by a positional rare-token index, with DataFrame functions only.

The index is the postings (token, template, place) of licence templates, joined to a file's words. Of each
template its mandatory words of highest IDF are looked up; where postings agree on a beginning they make a
candidate, and a candidate counts when its template's mandatory phrases stand at their places."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licence templates (label, words, mandatory phrases).
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this program is free software under the terms of the gnu general public license version 2", ["gnu general public license version 2"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", ["permission to use copy modify and or distribute this software"]),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    first, *others = phrase.split()

    def here(w: Column, i: Column) -> Column:
        return F.when(reduce(lambda a, b: a & b, (F.get(words, i + k) == t for k, t in enumerate(others, 1)), w == first), i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _must(template: str, phrases: list[str]) -> set[int]:
    """Places of the template's words that its mandatory phrases hold."""
    tokens = template.split()
    out: set[int] = set()
    for p in (p.split() for p in phrases):
        first = next(k for k in range(len(tokens)) if tokens[k : k + len(p)] == p)
        out |= set(range(first, first + len(p)))
    return out


def _postings(weight: dict[str, float], rare_words: int) -> list[tuple]:
    """(word, template, place, looked_up, must, share) of all templates: a fixed table of a few hundred rows."""
    out = []
    for n, (_, template, phrases) in enumerate(TEMPLATES):
        tokens, must = template.split(), _must(template, phrases)
        rare = sorted({tokens[k] for k in must}, key=lambda w: (-weight[w], w))[:rare_words]
        whole = sum(weight[t] for t in tokens)
        out += [(t, n, k, int(k in must and t in rare), int(k in must), weight[t] / whole) for k, t in enumerate(tokens)]
    return out


def scan(docs: DataFrame, rare_words: int = 8, least: float = 0.6) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its words, base phrase places, labels and score.

    n_words counts the words of the text with A-Z lower-cased; n_base, first_word and last_word are the
    number and the ends of the base phrases' places; ``labels`` are the base labels and those of the
    templates found; ``score`` is 1 for a base phrase, else the largest share (by IDF over all rows) of a
    template's words in place, else 0. Of each template the ``rare_words`` mandatory words of highest IDF are looked up; ``least``
    is the share that makes a label. Null and empty texts have no words. Rows are independent: repeated rows
    and rows without an id are scanned each. Other columns are ignored."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()} | {w for p in BASE for w in p.split()})
    # a file without one of these words can hold no base phrase and no template's mandatory phrase
    gate = sorted({max(p.split(), key=len) for p in [*BASE, *(p for _, _, ps in TEMPLATES for p in ps)]})
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row_key"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))
    known = F.array(*map(F.lit, vocabulary))
    words = words.withColumn("known", F.array_intersect("words", known))
    words = words.withColumn("gated", F.arrays_overlap("known", F.array(*map(F.lit, gate))))
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(known, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    base = F.concat(*(_labelled(_places(F.col("words"), p), label) for p, label in BASE.items()))
    seen = words.select("doc_id", "row_key", F.size("words").cast("long").alias("n_words"), "known", F.when(F.col("gated"), base).alias("base"), F.when(F.col("gated"), hits).alias("hits"))
    seen = written(seen, "licences")
    rows = seen.count()
    df = {r["w"]: r["count"] for r in seen.select(F.explode("known").alias("w")).groupBy("w").count().collect()}  # at most the vocabulary
    idf = {w: math.log((2 + rows) / (1 + df.get(w, 0))) for w in vocabulary}  # above 0 for a word of every row too
    postings = _postings(idf, rare_words)
    names = ("w", "template", "k", "looked_up", "must", "share")
    table = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, p, strict=True))) for p in postings))
    index = docs.sparkSession.range(1).select(F.explode(table).alias("p")).select("p.*")
    # postings that agree on where a template begins: all looked-up words make a candidate, all mandatory places verify it
    total = index.groupBy("template").agg(F.sum("looked_up").alias("all_rare"), F.sum("must").alias("all_must"))
    hit = seen.where(F.size("hits") > 0).select("row_key", F.explode("hits").alias("h")).select("row_key", F.col("h.w").alias("w"), F.col("h.i").alias("i"))
    begins = hit.join(F.broadcast(index), "w").groupBy("row_key", "template", (F.col("i") - F.col("k")).alias("begin"))
    begins = begins.agg(F.sum("looked_up").alias("rare"), F.sum("must").alias("must"), F.round(F.sum("share"), 6).alias("share"))
    candidates = begins.join(F.broadcast(total), "template").where("rare = all_rare")
    label = F.element_at(F.array(*(F.lit(label) for label, _, _ in TEMPLATES)), F.col("template") + 1)
    found = candidates.where("must = all_must").where(F.col("share") >= least).select("row_key", F.struct(label.alias("label"), "share").alias("x"))
    out = seen.join(found.groupBy("row_key").agg(F.collect_set("x").alias("found")), "row_key", "left")
    none = F.array().cast("array<string>")
    base_labels, found = F.coalesce(F.col("base.label"), none), F.coalesce(F.col("found.label"), none)
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"),
        F.array_max("base.at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, found))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"),
    )
