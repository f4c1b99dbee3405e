"""Licence scan with DataFrame functions alone: phrases, and a positional index of the licence clauses' words.

The document frequency of every licence word (a template word that is no function word) is counted over all documents.  The index
keeps the places of the rarest licence words of each template, a clause of a licence or its notice.  The places of a
file's words that are among the ``INDEX_WORDS`` of the highest IDF of some template are all looked up, so that what a file gets
does not depend on what else stands in it; postings of one template whose places differ from the file's by the same amount support one
alignment; an alignment with enough of the template's rare weight is accepted where the template's mandatory key phrase stands at
its place in the file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Clauses of licences and of their notices: (label, text in words, mandatory key phrase, which stands in the text).
CLAUSES = [
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "is hereby granted the software is provided"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "may not use this file except in compliance"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each contributor hereby grants to you a perpetual"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms under which a given free software package may be copied", "a given free software package may be copied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization obtaining a copy of the software"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "distributed in the hope that it will be useful"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-2.0", "as published by the free software foundation either version 2 of the license or at your option any later version", "foundation either version 2 of the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-3.0", "as published by the free software foundation either version 3 of the license or at your option any later version", "foundation either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted provided"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "lesser general public license version 2 1"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "lesser general public license version 3"),
    ("mit-name", "released under the mit license", "the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining"),
    ("mit-text", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "merge publish distribute sublicense and or sell copies"),
    ("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "a copy of the mpl was not distributed"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "must be plainly marked as such and must not be misrepresented"),
]
#: Identifiers that stand after "SPDX-License-Identifier:"; each makes a template of its words.
IDENTIFIERS = """0BSD AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0
MIT MPL-2.0 Unlicense Zlib""".split()
#: Function words, which are no licence words.
FUNCTION_WORDS = frozenset(
    """a all an and any are as at be been but by can each for from has have if in into is it its may must no nor not of on one or that the this to under was
    will with without you your""".split()
)


def _identified(identifier: str) -> tuple[str, str, str]:
    words = "spdx license identifier " + " ".join(identifier.lower().replace("-", " ").replace(".", " ").split())
    return identifier.lower(), words, words


TEMPLATES = CLAUSES + [_identified(i) for i in IDENTIFIERS]
#: Rarest licence words of a template that are indexed; those whose IDF is its weight; the part of it that an alignment needs.
INDEX_WORDS, RARE_WORDS, LEAST_WEIGHT = 8, 4, 0.6


def licence_words(templates: list[tuple[str, str, str]]) -> list[str]:
    """The templates' words that are no function words; the numbers and letters of versions and names are."""
    return sorted({w for _, text, _ in templates for w in text.split() if w not in FUNCTION_WORDS})


def inverse_frequencies(rows: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each word of a fixed vocabulary over all rows (column words)."""
    own = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    found = rows.select(F.explode(F.array_append(own, F.lit(""))).alias("word")).groupBy("word").count().collect()  # the vocabulary at most
    counts = {r["word"]: r["count"] for r in found}
    total = counts.pop("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}


def postings(idf: dict[str, float], templates: list[tuple[str, str, str]]) -> list[tuple]:
    """(word, template, place, part of the template's rare weight, label, key phrase, its place, its size) of the index."""
    out = []
    for t, (label, text, key) in enumerate(templates):
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        own = sorted({w for w in words if w in idf}, key=lambda w: (-idf[w], w))
        weight = sum(idf[w] for w in own[:RARE_WORDS])
        indexed = set(own[:INDEX_WORDS])
        out += [(w, t, i, idf[w] / weight / words.count(w), label, key, at, len(phrase)) for i, w in enumerate(words) if w in indexed]
    return out


def _starts(phrase: str) -> Column:
    """Places of a phrase in the words."""
    words = phrase.split()

    def here(w: Column, i: Column) -> Column:
        same = w == words[0]
        for k, x in enumerate(words[1:], 1):
            same &= F.get("words", i + k) == x
        return F.when(same, i)

    return F.filter(F.transform("words", here), lambda i: i.isNotNull())


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word and last_word are the number and the extreme places of the fixed phrases (null places: none); labels
    joins their labels with those of the templates found; score is the best alignment's part of its template's rare weight,
    0 if none.  Null or wordless texts have no phrases; texts of any length are read whole.  Repeated rows and ties give equal
    results, an empty table none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), words_of(F.col(text_col)).alias("words"))
    idf = inverse_frequencies(rows, licence_words(templates))
    index = postings(idf, templates)
    indexed = F.split(F.lit(" ".join(sorted({p[0] for p in index}))), " ")
    schema = "word string, template int, place int, weight double, label string, key string, key_at int, key_size int"
    table = docs.sparkSession.createDataFrame(index, schema)  # a row per licence word of the templates
    longest = max(len(t[1].split()) for t in templates)
    base = rows.withColumn("n_words", F.size("words").cast("long"))
    base = base.withColumns({f"p{k}": _starts(p) for k, p in enumerate(PHRASES)})
    base = base.withColumn("rare", F.array_intersect(indexed, "words"))
    found_at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("rare", w), i)), lambda i: i.isNotNull())
    base = base.withColumn("places", F.when(F.size("rare") > 0, found_at).otherwise(F.expr("cast(array() as array<int>)")))
    every = F.concat(*[f"p{k}" for k in range(len(PHRASES))])
    labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(v)) for k, v in enumerate(PHRASES.values())])))
    cut = F.transform("places", lambda p: F.struct(p.alias("at"), F.element_at("words", p + 1).alias("word"), F.slice("words", F.greatest(p - longest + 2, F.lit(1)), 2 * longest - 1).alias("around")))
    keys = ["doc_id", "mark", "n_words", "n_base", "first_word", "last_word", "own"]
    base = base.select("doc_id", "mark", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("own"), cut.alias("cut"))
    found = base.select(*keys, F.explode(F.array_append("cut", F.lit(None))).alias("c")).select(*keys, "c.*")
    joined = found.join(F.broadcast(table), "word", "left").withColumn("start", F.col("at") - F.col("place"))
    # The key phrase at its place: the words around begin at max(at - longest + 1, 0).
    from_ = F.col("start") + F.col("key_at") - F.greatest(F.col("at") - longest + 1, F.lit(0)) + 1
    verified = F.when((F.col("start") >= 0) & (from_ >= 1), F.array_join(F.slice("around", F.greatest(from_, F.lit(1)), F.col("key_size")), " ") == F.col("key")).otherwise(F.lit(False))
    joined = joined.where(F.col("at").isNull() | verified)
    votes = joined.groupBy(*keys, "template", "label", "start").agg(F.sum("weight").alias("weight"), F.count_if(F.col("at").isNull()).alias("copies"))
    votes = votes.withColumn("weight", F.col("weight") / F.greatest(F.lit(1.0), F.max("copies").over(_per(keys))))
    accepted = F.col("weight") >= LEAST_WEIGHT
    out = votes.groupBy(*keys).agg(F.max("copies").alias("copies"), F.collect_set(F.when(accepted, F.col("label"))).alias("more"), F.max(F.when(accepted, F.col("weight"))).alias("score"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    both = F.array_sort(F.array_distinct(F.concat("own", "more")))
    score = F.least(F.lit(1.0), F.round(F.coalesce("score", F.lit(0.0)), 6))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def _per(keys: list[str]):
    from pyspark.sql.window import Window

    return Window.partitionBy(*keys)
