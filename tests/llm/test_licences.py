"""The licence scan against a brute-force alignment of every template with every place."""

import math
import re

import numpy as np

from voluma.llm import licences as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(texts):
    docs = [words(t) for t in texts]
    vocabulary = L.licence_words(L.TEMPLATES)
    idf = {w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1)) + 1 for w in vocabulary}
    out = []
    for d in docs:
        labels, score = set(), 0.0
        places = []
        for phrase, label in L.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(d)) if d[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        base = sorted(labels)
        for label, text, key in L.TEMPLATES:
            t, k = text.split(), key.split()
            at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            total = sum(sorted((idf[w] for w in set(t) if w in idf), reverse=True)[: L.RARE_WORDS])
            rare = sorted({w for w in t if w in idf}, key=lambda w: (-idf[w], w))[: L.INDEX_WORDS]
            for start in range(len(d)):
                own = [w for i, w in enumerate(t) if w in rare and start + i < len(d) and d[start + i] == w]
                weight = sum(idf[w] / total / t.count(w) for w in own)
                if own and weight >= L.LEAST_WEIGHT - 1e-9 and d[start + at : start + at + len(k)] == k:
                    labels.add(label)
                    score = max(score, weight)
        out.append((len(d), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), min(1.0, round(score, 6))))
    return out


def test_scan_is_the_brute_force_alignment(spark):
    rng = np.random.default_rng(1)
    prose = ["the", "of", "and", "stone", "river", "license", "copy", "version", "2", "software", "free"]
    texts = [None, "", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: ISC", "// SPDX-License-Identifier: LGPL-2.1"]
    for label, text, _ in L.TEMPLATES[::2]:
        before, after = (" ".join(rng.choice(prose, rng.integers(0, 30))) for _ in range(2))
        texts.append(f"{before}. {text.capitalize()}; {after}")
        broken = text.split()
        broken[len(broken) // 2] = "altered"
        texts.append(" ".join(broken) + " MIT License")
    texts += [" ".join(rng.choice(prose, 20_000)) + " released under the MIT license", texts[5], texts[5]]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, place int")
    got = {r.doc_id: r for r in L.scan_licences(docs).collect()}
    for i, expected in enumerate(brute(texts)):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == expected[:6], (i, texts[i][:80])
        assert abs(r.score - expected[6]) < 1e-5
    assert got[2].labels == "bsd" and got[3].labels == "isc" and "lgpl-2.1" in got[4].labels
    same = L.scan_licences(docs.union(docs.where("doc_id = 5"))).where("doc_id = 5").collect()
    assert len(same) == 2 and same[0] == same[1] and L.scan_licences(docs.limit(0)).count() == 0


def test_a_file_of_all_licences_has_all_labels(spark):
    """However many clauses stand in a file, each is found as if it stood alone."""
    texts = [text for _, text, _ in L.TEMPLATES] + ["\n\n".join(text for _, text, _ in L.TEMPLATES)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in L.scan_licences(docs).collect()}
    alone = set().union(*(got[i] for i in range(len(L.TEMPLATES))))
    assert all(label in got[i] for i, (label, _, _) in enumerate(L.TEMPLATES))
    assert {label for label, _, _ in L.TEMPLATES} <= alone == got[len(L.TEMPLATES)]
