"""Operator 10, licence scan: a positional rare-token index, in DataFrame expressions only.

One pass cuts each text into words and keeps the positions of the words that any licence phrase
has. Document frequencies of those words, over the whole corpus, give their IDF. For each phrase
the index posts its highest-IDF words with their relative positions; a file's postings are
intersected by where the phrase would begin, and each place that survives is verified word by
word. A file is looked up under its licence words in order of IDF until every phrase is covered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# --- fixed values: the contract's phrases and labels -----------------------------------------
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# --- fixed values: mandatory key phrases of the method's own labels --------------------------
OWN_PHRASES = [
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("boost software license", "bsl"),
    ("creative commons attribution", "cc-by"),
    ("all rights reserved", "proprietary"),
]
# --- fixed values: grants and headers of licence texts, and their tags ------------------------
GRANTS = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions", "bsd"),
    ("bsd 2 clause", "bsd"),
    ("bsd 3 clause", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy", "bsl"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier isc", "isc"),
    ("spdx license identifier apache 2 0", "apache"),
    ("spdx license identifier gpl", "gpl"),
    ("spdx license identifier lgpl", "lgpl"),
    ("spdx license identifier agpl", "agpl"),
    ("spdx license identifier mpl", "mpl"),
    ("spdx license identifier epl", "epl"),
    ("spdx license identifier bsl", "bsl"),
    ("spdx license identifier cc by", "cc-by"),
]
#: What lies between the words of a text once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# ----------------------------------------------------------------------------------------------

#: Words of a phrase that the index posts.
RARE = 2


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool


def templates(base=BASE_PHRASES, own=OWN_PHRASES + GRANTS) -> list[Template]:
    return [Template(tuple(p.split()), label, kind) for group, kind in ((base, True), (own, False)) for p, label in group]


def lower_ascii(text: Column) -> Column:
    """Lower case as far as words of a-z can tell.

    ``lower`` works on bytes where the text is ASCII. Of all other characters, only the Kelvin
    sign and the dotted capital I have a-z in their lower case; they become another letter first.
    """
    for ch in "\u212a\u0130":
        text = F.replace(text, F.lit(ch), F.lit("\u0131"))
    return F.lower(text)


def hits(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Each row's n_words and the (position, word) of every word of the vocabulary, by position."""
    parts = F.split(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), BETWEEN)
    # a step of its own, as it is used more than once below; only its first and last part can be empty
    cut = docs.select("doc_id", parts.alias("parts"))
    lead = (F.element_at("parts", 1) == "").cast("int")
    trail = ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")
    known = F.array(*(F.lit(w) for w in vocabulary))
    placed = F.transform("parts", lambda w, i: F.struct(i.cast("int").alias("at"), w.alias("w")))
    found = F.transform(
        F.filter(placed, lambda x: x["w"].isin(vocabulary)),
        lambda x: F.struct((x["at"] - lead).alias("at"), F.array_position(known, x["w"]).cast("int").alias("w")),
    )
    return cut.select("doc_id", (F.size("parts") - lead - trail).cast("long").alias("n_words"), found.alias("hits"))


def inverse_frequency(found: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the vocabulary's words over all rows; at most as many rows as it has words reach the driver."""
    rows = found.count()
    ids = F.array_distinct(F.transform("hits", lambda x: x["w"]))
    df = {r["w"]: r["n"] for r in found.select(F.explode(ids).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log(1 + (rows - df.get(k, 0) + 0.5) / (df.get(k, 0) + 0.5)) for k, w in enumerate(vocabulary, 1)}


def scan_licenses(docs: DataFrame, base=BASE_PHRASES, own=OWN_PHRASES + GRANTS, rare: int = RARE) -> DataFrame:
    """Licence phrases of each row of (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    ``places``: array of (begin, label, base) of every verified phrase. The score is the largest
    share of one phrase's IDF mass that stands at one place in the text, 1 for a verified phrase.

    Null and empty texts have no words, no labels and score 0. Each row is judged by itself, so
    repeated rows and null or repeated doc_ids keep their own results; an empty table gives an
    empty result, and other columns are ignored. Ties of IDF go to the earlier word of a phrase.
    """
    known = templates(base, own)
    vocabulary = sorted({w for t in known for w in t.words})
    number = {w: k for k, w in enumerate(vocabulary, 1)}
    found = staged(hits(docs, vocabulary), "licence-hits")
    idf = inverse_frequency(found, vocabulary)

    # the postings: of each word, the (template, position) where it is one of the template's rarest
    postings: dict[int, list[tuple[int, int]]] = {}
    for t, template in enumerate(known):
        order = sorted(range(len(template.words)), key=lambda i: (-idf[template.words[i]], i))
        for i in order[:rare]:
            postings.setdefault(number[template.words[i]], []).append((t, i))
    posted = F.array(
        *(
            F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in sorted(postings[k])))
            if k in postings
            else F.array().cast("array<struct<t:int,i:int>>")
            for k in range(1, len(vocabulary) + 1)
        )
    )
    sizes = [len(t.words) for t in known]
    needed = F.array(*(F.lit(min(rare, n)) for n in sizes))

    # a file's words are looked up by falling IDF; (template, begin) pairs that its words agree on survive
    weight = F.array(*(F.lit(float(idf[w])) for w in vocabulary))
    rarest = F.array_sort(
        F.filter("hits", lambda x: x["w"].isin(sorted(postings))),
        lambda a, b: F.when(_at(weight, a["w"]) > _at(weight, b["w"]), -1).when(_at(weight, a["w"]) < _at(weight, b["w"]), 1).otherwise(a["at"] - b["at"]),
    )
    looked_up = F.flatten(
        F.transform(rarest, lambda x: F.transform(_at(posted, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["at"] - p["i"]).alias("begin"))))
    )
    # hits of one word lie at distinct places, so a (template, begin) pair comes once for each posted word that agrees
    agreed = F.col("agreed")
    table = found.select("doc_id", "n_words", "hits", F.array_sort(F.filter(looked_up, lambda x: x["begin"] >= 0)).alias("agreed"))
    # equal pairs are neighbours after sorting: keep the pair that ends a run of the needed length
    survived = F.filter(
        agreed,
        lambda x, k: (k + 1 >= _at(needed, x["t"] + 1)) & (F.try_element_at(agreed, (k + 2 - _at(needed, x["t"] + 1)).cast("int")) == x),
    )
    table = table.select("doc_id", "n_words", "hits", survived.alias("candidates"))

    # verification: the template's words all stand, one after the other, in the text
    keyed = F.map_from_entries(F.transform("hits", lambda x: F.struct(x["at"], x["w"])))
    table = table.withColumn("word_at", F.when(F.size("candidates") > 0, keyed))
    phrase = F.array(*(F.array(*(F.lit(number[w]) for w in t.words)) for t in known))
    whole = lambda c: F.forall(
        F.transform(_at(phrase, c["t"] + 1), lambda w, i: F.coalesce(F.try_element_at(F.col("word_at"), c["begin"] + i.cast("int")) == w, F.lit(False))), lambda ok: ok
    )
    labels = F.array(*(F.lit(t.label) for t in known))
    bases = F.array(*(F.lit(t.base) for t in known))
    places = F.transform(
        F.filter("candidates", whole), lambda c: F.struct(c["begin"].alias("begin"), _at(labels, c["t"] + 1).alias("label"), _at(bases, c["t"] + 1).alias("base"))
    )
    table = table.withColumn("places", F.array_sort(places))
    in_base = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["begin"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    # partial evidence: what share of a phrase's IDF mass its posted words that agree on a place have
    mass = F.array(*(F.lit(_share(t, idf, rare)) for t in known))
    partial = F.coalesce(F.array_max(F.transform("candidates", lambda c: _at(mass, c["t"] + 1))), F.lit(0.0))
    return table.select(
        "doc_id",
        "n_words",
        F.size(in_base).cast("long").alias("n_base"),
        F.array_min(in_base).cast("long").alias("first_word"),
        F.array_max(in_base).cast("long").alias("last_word"),
        joined(F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["label"])).alias("base_labels"),
        joined(F.transform("places", lambda p: p["label"])).alias("labels"),
        F.round(F.when(F.size("places") > 0, F.lit(1.0)).otherwise(partial), 6).alias("score"),
        "places",
    )


def _at(values: Column, k: Column) -> Column:
    return F.element_at(values, k)


def _share(t: Template, idf: dict[str, float], rare: int) -> float:
    """The share of the phrase's IDF mass that its posted words hold."""
    all_of = sorted((idf[w] for w in t.words), reverse=True)
    return sum(all_of[:rare]) / (sum(all_of) or 1.0)
