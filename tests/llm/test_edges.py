"""Odd URLs, clashing column names, hot keys and sizes beyond the broadcast bounds."""

import base64
import hashlib
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from voluma.llm import decontaminate, html, langid, minhash, secrets, warc
from voluma.llm.shared import stored

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_warc_reads_ranges_whatever_the_url(spark):
    urls = ["http://a/{id}", "http://a/x y{\"k\": 1}", "not a url {", None, "http://[bad", "https://www.Example.org:8080/p?q={1}"]
    pages = [(i, u, ("page %d " % i) * (40_000 if i == 2 else 9), "x") for i, u in enumerate(urls)] + [(10 + i, "http://c/", "copy", "y") for i in range(20)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, package string")
    for broadcast_rows in (200_000, 0):
        out = {r.page_id: r for r in warc.archive_and_read(rows, broadcast_rows=broadcast_rows).collect()}
        assert len(out) == len(pages)
        for page_id, _, html, _ in pages:
            assert out[page_id].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert [out[10 + i].refers_to for i in range(3)] == [None, 10, 10]
    blocks = warc.write_packages(rows).cache()
    ranges = warc.record_ranges(blocks)
    assert {len(b"".join(r.pieces)) - r.n for r in warc.fetch(blocks, ranges).collect()} == {0}
    one = ranges.orderBy("at").limit(1)
    assert warc.fetch(blocks, one).select(F.size("pieces")).first()[0] == 1  # one block of the package is touched
    files = blocks.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("block", "bytes"))).alias("b")).collect()
    whole = spark.createDataFrame([(f.package, bytearray(b"".join(b.bytes for b in f.b))) for f in files], "path string, content binary")
    assert warc.read_packages(warc.blocks_of(whole)).count() == len(pages)
    assert warc.surt("https://www.Example.org:8080/p?q=1") == "org,example,www:8080)/p?q=1"


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_warc_packages_are_read_where_they_lie_and_in_any_order(spark):
    rng = np.random.default_rng(7)
    pages = [(i, f"http://h/{i}", rng.bytes(10_000).hex() * (30 if i == 5 else 1)) for i in range(500)] + [(1000 + i, None, "") for i in range(3)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    blocks = stored(warc.write_packages(rows), "packages")
    n_packages = blocks.select("package").distinct().count()
    before = shuffled(spark)
    out = warc.read_packages(blocks, payloads=True, broadcast_rows=0).collect()
    assert n_packages > 2 and 0 <= shuffled(spark) - before < sum(len(p[2]) for p in pages) / 10
    first = {}
    for page_id, _, html in pages:
        first.setdefault(html, page_id)
    want = sorted((i, None if first[h] != i else h, first[h] if first[h] != i else None) for i, _, h in pages)
    key = lambda r: (r.page_id, None if r.payload is None else bytes(r.payload).decode(), r.refers_to)
    assert sorted(map(key, out)) == want
    mixed = blocks.repartition(5, "block").sortWithinPartitions(F.xxhash64("package", "block"))
    cut = blocks.where("block < 7").union(blocks.where("block >= 7"))
    for other, held_bytes in ((mixed, warc.HELD_BYTES), (cut, warc.HELD_BYTES), (blocks, 0), (blocks, 4_400_000)):
        for broadcast_rows in (0, 50_000):
            assert sorted(map(key, warc.read_packages(other, payloads=True, broadcast_rows=broadcast_rows, held_bytes=held_bytes).collect())) == want
    broken = blocks.withColumn("bytes", F.when(F.col("block") == 3, F.reverse(F.hex("bytes")).cast("binary")).otherwise(F.col("bytes")))
    with pytest.raises(Exception):
        warc.read_packages(broken).collect()
    assert warc.read_packages(blocks.limit(0)).count() == 0


def test_clashing_columns_and_long_texts_of_decontamination(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    long = " ".join(f"w{i % 977}" for i in range(200_000)) + " " + passage
    rows = [(1, passage + " end"), (2, "clean text"), (3, long), (None, None), (2, "clean text"), (5, "")]
    schema = "doc_id long, text string, _id long, _mark string, _spans string, hash long, words string, salt int"
    docs = spark.createDataFrame([(i, t, 7, "m", "s", 1, "w", 2) for i, t in rows], schema)
    bench = spark.createDataFrame([(1, passage, "x")], "item_id long, text string, hash string")
    for limit in (200_000, 0):
        kept = decontaminate.clean_documents(docs, bench, broadcast_rows=limit)
        assert kept.columns == docs.columns and sorted((r.doc_id or 0, r._id) for r in kept.collect()) == [(0, 7), (2, 7), (2, 7), (5, 7)]
        cut = decontaminate.clean_spans(docs, bench, broadcast_rows=limit)
        out = {r.doc_id: r for r in cut.collect()}
        assert cut.columns == docs.columns and out[1].text == "end" and out[3].text.endswith(" w691 ") and out[1]._spans == "s"
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == 6


def test_html_templates_by_pages_and_words_of_classes(spark):
    def page(i, site, boxes=""):
        return f"<body>{site}{boxes}<section><p>Text {i} of its own {i * 7} {'and more of it ' * 3}</p>{'<p>A line that some quote</p>' * (i % 3 == 0)}</section></body>"

    many = [(i, "http://a/", page(i, "<div><p>Site box</p></div>" if i < 16 else "")) for i in range(40)]
    few = [(100 + i, "http://b/", page(i, "<div><p>Small site</p></div>")) for i in range(4)]
    parts = '<h1 class="post-header">Title</h1><div class="related-work">Work</div><p class="copyright-law">Law</p><div class="ad">Buy</div><div class="share-buttons">Share</div>'
    one = [(200, "http://c/", f"<article>{parts}<p>Quoted</p></article>")] + [(201 + i, "http://c/", f"<article><p>Own {i}</p><p>Quoted</p></article>") for i in range(6)]
    rows = spark.createDataFrame([(*r, "x") for r in many + few + one], "page_id long, url string, html string, host string")
    for limit in (200_000, 0):
        out = {r.page_id: r.main_text for r in html.extract_main_text(rows, broadcast_rows=limit).collect()}
        assert not any("box" in out[i] for i in range(40)) and not any("Small" in out[100 + i] for i in range(4))
        assert all(out[i].startswith(f"Text {i} of its own") and out[i].endswith("quote") == (i % 3 == 0) for i in range(40))
        assert out[200] == "Title Work Law Quoted" and out[201] == "Own 0 Quoted"


def test_html_templates_are_all_that_tells_the_text(spark):
    """Hosts without article elements: boilerplate of any length goes, near copies keep their text; nothing goes from articles."""
    rng = np.random.default_rng(4)
    word = [a + b for a in ("ba", "de", "fi", "go", "lu", "mer") for b in ("ra", "sen", "tol", "ving", "xa", "mi")]

    def prose(n):
        return " ".join(rng.choice(word, n))

    pages, expected = [], []

    def add(host, page, text):
        pages.append((len(pages), f"http://{host}/", page, "x", 0))
        expected.append(text)

    for size in (10, 120, 2000):
        site = f"<div><p>{prose(size // 2)}</p><p>{prose(size - size // 2)}</p></div>"
        for text in (prose(60) for _ in range(40)):
            add(f"site{size}", f"<body>{site}<div><p>{text}</p></div></body>", text)
    site, body = f"<div><p>{prose(30)}</p></div>", [prose(40) for _ in range(6)]
    for i in range(30):  # near copies of one article, a third of a host's pages, and other articles
        parts = [*body[:i % 6], body[i % 6] + f" edited{i}", *body[i % 6 + 1 :]]
        add("copies", f"<body>{site}<div>{''.join(f'<p>{p}</p>' for p in parts)}</div></body>", " ".join(parts))
    for text in (prose(200) for _ in range(60)):
        add("copies", f"<body>{site}<div><p>{text}</p></div></body>", text)
    for i, text in enumerate(prose(50) for _ in range(20)):  # a block quoted inside articles, a box beside them
        quote = "<div class='quote'><p>Said by one and quoted by four</p></div>" * (i < 4)
        add("quotes", f"<body><div>Box of the site</div><article><p>{text}</p>{quote}</article></body>", text + " Said by one and quoted by four" * (i < 4))
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, host string, subtree int")
    rows = rows.unionByName(rows.where("page_id = 3"))
    for limit in (200_000, 0):
        got = html.extract_main_text(rows, broadcast_rows=limit).collect()
        assert len(got) == len(pages) + 1 and [r.page_id for r in got if r.main_text != expected[r.page_id]] == []
    plain = [html.Page(p[2]).main_text() for p in pages]
    assert sum(a != b for a, b in zip(plain, expected)) == 210  # pages that the template changes
    assert html.extract_main_text(rows.limit(0)).count() == 0


def test_deduplicate_keeps_columns_of_any_name_and_splits_hubs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)  # every list and node is long
    rng = np.random.default_rng(1)
    bases = [[f"w{n}" for n in rng.integers(0, 5000, 120)] for _ in range(4)]
    texts = []
    for base in bases:
        for i in range(12):
            copy = list(base)
            copy[(i * 7) % 120] = f"edit{i}"
            texts.append(" ".join(copy))
    schema = "doc_id long, text string, _key string, _KEY_ string, _id int, _mark int, _rows int"
    docs = spark.createDataFrame([(i, t, f"k{i}", "z", 1, 2, 3) for i, t in enumerate(texts)], schema)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._key) for r in kept.collect()) == [(i, f"k{i}") for i in (0, 12, 24, 36)]
    exact = minhash.near_duplicates(docs, k=minhash.EXACT, deviations=minhash.EXACT).collect()
    assert sorted((r.doc_id, r.component_id) for r in exact) == [(i, i // 12 * 12) for i in range(48)]


def test_languages_beyond_one_slice(spark):
    """130 languages, each with an alphabet of its own, in three slices of the filter."""
    def text(i, k):
        letters = [chr(0x4E00 + 40 * i + j) for j in range(40)]
        return " ".join("".join(letters[(k * 7 + a * 3 + b) % 40] for b in range(5)) for a in range(30))

    rows = [(i * 10 + k, text(i, k), f"l{i:03d}", "x") for i in range(130) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _language string")
    filters = langid.train(docs)
    assert filters.words.shape[0] == 3 and filters.false.max() < 0.09
    out = langid.identify(docs, filters).collect()
    assert all(r.language.lang_pred == r.lang for r in out)
    kept = langid.known_language(docs.unionByName(docs.limit(1)), filters)
    assert kept.columns == docs.columns and kept.count() == 391


def test_language_of_a_single_short_row_is_learned(spark):
    rows = [(i, "the cat and the dog with that and what they had seen in the town", "en") for i in range(60)]
    rows += [(100, "hva skjer når jeg ikke får øye på båten ved brygga", "no")]
    filters = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, rows[-1][1]), (2, "ikke på båten når jeg får se hva"), (3, rows[0][1])], "doc_id long, text string")
    assert [r.language.lang_pred for r in langid.identify(asked, filters).orderBy("doc_id").collect()] == ["no", "no", "en"]


def test_masks_and_corrected_counts_are_those_of_plain_sets(spark):
    """The filters hold every n-gram of the sets that the rates define, few others, and the decision follows from their masks."""
    rng = np.random.default_rng(9)
    parts = {"aa": "ba be bo da de do", "bb": "ka ke ba be to te", "cc": "mu mi ka da lu li"}
    rows = [(i * 3 + j, " ".join("".join(rng.choice(p.split(), 3)) for _ in range(20)), k) for j, (k, p) in enumerate(parts.items()) for i in range(15)]
    filters = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {k: {} for k in parts}
    for _, text, lang in rows:
        for keys, _ in langid.ngrams([text]):
            for key in keys.tolist():
                counts[lang][key] = counts[lang].get(key, 0) + 1
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    every = sorted(set().union(*rate.values()))
    sets = {k: {g for g in rate[k] if rate[k][g] >= langid.RATE_SHARE * max(r.get(g, 0) for r in rate.values())} for k in parts}
    masks = filters.masks(np.array(every, np.uint64))[0].tolist()
    for i, k in enumerate(filters.languages):
        assert all(mask >> i & 1 for g, mask in zip(every, masks) if g in sets[k])
        assert sum(mask >> i & 1 for g, mask in zip(every, masks) if g not in sets[k]) <= 2
    asked = [r[1] for r in rows[::4]] + ["bakete mulida", "dodo kaka"]
    names, scores = filters.decide(asked)
    for text, name, score in zip(asked, names, scores):
        grams = [g for keys, _ in langid.ngrams([text]) for g in keys.tolist()]
        hits = np.array([sum(g in sets[k] for g in grams) for k in filters.languages], float)
        assert hits[filters.languages.index(name)] == hits.max() and abs(score - hits.max() / hits.sum()) < 0.02


def brute_secrets(text, library):
    """Spans by scanning characters, with ids of the tokenizers library."""
    spans, n = [], len(text)
    word = string.ascii_letters + string.digits
    i = 0
    while i < n:  # assignments
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[i : i + len(name)].lower() == name:
                j = i + len(name)
                j += j < n and text[j] in "\"'"
                while j < n and text[j] == " ":
                    j += 1
                if j < n and text[j] in ":=":
                    j += 1
                    while j < n and text[j] == " ":
                        j += 1
                    j += j < n and text[j] in "\"'"
                    k = j
                    while k < n and text[k] in word + "+/_.=-":
                        k += 1
                    if k > j:
                        if k - j >= 6:
                            spans.append((i, k, "assign"))
                        i = k - 1
                        break
        i += 1
    for kind, head, letters, least in (("access", "AKIA", string.ascii_uppercase + string.digits, 20), ("hex", "", "0123456789abcdef", 24), ("random", "", word + "+/_-", 16)):
        i = 0
        while i < n:
            k = i + len(head) if text.startswith(head, i) else i
            while k < n and (k > i or not head) and text[k] in letters:
                k += 1
            if k > i + len(head):
                if kind == "random":
                    end = k
                    while end < min(n, k + 2) and text[end] == "=":
                        end += 1
                    k = end if k - i >= 16 else k
                    run = text[i:k]
                    low = k - i >= 16 and len(run) < 2 * len(library.encode(run, add_special_tokens=False).ids)
                    if low and not secrets.is_known(run, secrets.Vocabulary(BPE), text[max(0, i - 24) : i]):
                        spans.append((i, k, kind))
                elif k - i >= least:
                    spans.append((i, k, kind))
                i = k
            else:
                i += 1
    return secrets.shown(spans)


def test_secrets_by_brute_force(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BPE), np.random.default_rng(4)
    pieces = ["password", "Token", "api_key", "apikey", "SECRET", ": ", "=", " = ", "'", '"', " ", "AKIA", "Q7ZK2M9XW4TB6VPN", "deadbeef" * 3, "9e107d9d372bb6826bd81d3542a419d6", "hello world ", "é", "qhxzjkwvpytrmnbg", "JBSWY3DPEHPK3PXP", "==", "x", "abc123", "\n"]
    texts = ["".join(rng.choice(pieces, 14)) for _ in range(120)] + ["", None, "a" * 30_000, "token: 9E107D9D372BB6826BD81D3542A419D6", "sha 9E107D9D372BB6826BD81D3542A419D6"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x")], "doc_id long, text string, secrets string")
    out = secrets.scan_secrets(docs, BPE).orderBy("doc_id").collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert r.secrets.spans == brute_secrets(texts[r.doc_id] or "", library), texts[r.doc_id]
    spans = {r.doc_id: r.secrets.spans for r in out}
    assert "random" in spans[len(texts) - 2] and "random" not in spans[len(texts) - 1]
    assert secrets.redact_secrets(docs.limit(0), BPE).count() == 0 and secrets.redact_secrets(docs, BPE).columns == docs.columns
