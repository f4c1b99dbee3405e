"""The llm operators against brute force, round trips and odd rows: nulls, empties, ties, repeats, clashing columns."""

import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voluma.llm import decontaminate, flac, html, langid, licences, minhash, packing, quality, secrets, warc
from voluma.llm.tokens import Vocabulary

BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
SCHEMA = "doc_id long, text string, lang string, node string, mark string, spans string"


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "n", "m", "s") for i, t in zip(ids, texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_vocabulary_gives_the_library_ids():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), Vocabulary(BPE)
    library.encode_special_tokens = True
    for text in ["", " ", "a  b", "a \n b\n\n", "don't\tdo", "<|endoftext|> hi", "日本語 x", "a　 b", "\x1c a\x85", "x" * 5000]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_gives_added_tokens_their_ids(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), Vocabulary(BPE, added_tokens=True)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "a <|endoftext b", "plain  text"]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.encode(t).tolist() for t in texts] == expected and expected[0] == [64, 220, 50256, 275]
    lengths = {r.doc_id: r.length for r in packing.pack(docs(spark, texts), BPE, capacity=256).collect()}
    assert [lengths[i] for i in range(len(texts))] == [len(e) + 1 for e in expected]


def test_packing(spark):
    texts = [None, "", "a b c", "word " * 3000, "tie one", "tie two"] + ["x y z " * n for n in range(1, 120)]
    rows = packing.pack(docs(spark, texts, [5, 5, *range(2, len(texts))]), BPE, capacity=256).collect()
    own = Vocabulary(BPE)
    sizes = sorted(len(own.encode(t or "")) + 1 for t in texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(sizes)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    ids = own.encode(texts[3]).tolist() + [2]
    for r in by_doc[3]:
        part = ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and (r.piece == 0 or r.length == 256)
    assert len(by_sequence) <= -(-sum(sizes) // 256) + 1
    assert packing.pack(empty(spark), BPE).count() == 0


def brute_contamination(text, items, n):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    w, hit, found = words(text), set(), set()
    for i, item in items:
        v = words(item)
        size = min(n, len(v))
        grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
        for k in range(len(w) - size + 1):
            if size and tuple(w[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                found.add(i)
    return len(w), len(hit), len(found)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, limit):
    items = [(1, " ".join(WORDS)), (2, "Short item, here"), (3, ""), (4, None), (2, " ".join(WORDS[3:14]))]
    texts = [" ".join(WORDS), "x " + " ".join(WORDS[2:13]) + ". SHORT item here short ITEM here", None, "", "short item", "nothing", " ".join(WORDS) * 2, " ".join(WORDS)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs(spark, texts, [0, 1, 2, 3, 4, None, 6, 0]), bench, 10, broadcast_rows=limit).collect()
    expected = sorted(brute_contamination(t, items, 10) for t in texts)
    assert sorted((r.n_words, r.n_hit, r.n_items) for r in out) == expected
    kept = decontaminate.clean_documents(docs(spark, texts), bench, 10)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == docs(spark, texts).columns
    cut = {r.doc_id: r.text for r in decontaminate.clean_spans(docs(spark, texts), bench, 10).collect()}
    assert cut[1] == "x " and cut[5] == "nothing" and cut[2] is None
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    name = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    name[i] = name[j] = min(name[i], name[j])
    return name, [len(s) for s in sets]


def test_near_duplicates(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "ONE", "Ä b", "ä b"]
    for _ in range(8):
        base = rng.choice(vocabulary, 90).tolist()
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 4, 6, 8):
            copy = list(base)
            for at in rng.choice(90, edits, replace=False):
                copy[at] = "new" + str(rng.integers(1000))
            texts.append(" ".join(copy))
    out = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), width=2).collect()}
    names, sizes = brute_components(texts, 2, 80)
    assert [out[i].component_id for i in range(len(texts))] == names and [out[i].n_shingles for i in range(len(texts))] == sizes
    kept = minhash.deduplicate(docs(spark, [*texts, texts[7]], [*range(len(texts)), 7]), width=2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({n for n in names})
    assert kept.columns == docs(spark, texts).columns and minhash.near_duplicates(empty(spark)).count() == 0


def test_deduplicate_without_usable_ids(spark):
    """Null ids, and one id with unrelated texts: each group keeps one of its own rows."""
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{n}" for n in rng.integers(0, 9000, 80)) for _ in range(9)]
    near = [b + " end" for b in base[:4]]
    rows = [(None, base[0]), (None, base[1]), (None, base[2]), (None, near[0]), (None, base[2]), (7, base[3]), (7, base[4]), (7, near[3]), (7, base[5]), (8, base[6]), (None, base[6] + " end"), (9, ""), (9, None), (None, base[7]), (7, base[7] + " end")]
    table = spark.createDataFrame([(i, t, "en", "n", "m", "s") for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in minhash.deduplicate(table).collect()]
    texts = [t for _, t in kept]
    for group in ([base[0], near[0]], [base[1]], [base[2]], [base[3], near[3]], [base[4]], [base[5]], [base[6], base[6] + " end"], [base[7], base[7] + " end"]):
        assert sum(texts.count(t) for t in group) == 1
    assert (8, base[6]) in kept and (7, base[7] + " end") in kept and (9, "") in kept and (9, None) in kept and len(kept) == 10


def test_language_id(spark):
    texts = ["the cat and the dog with that"] * 20 + ["der hund und die katze mit dem"] * 20
    rows = spark.createDataFrame([(i, t, "en" if i < 20 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    filters = langid.train(rows)
    asked = docs(spark, ["the dog and that cat", "die katze und der hund", None, "123 !!", "", "the " * 50_000])
    out = [(r.language.lang_pred, r.language.score) for r in langid.identify(asked, filters).orderBy("doc_id").collect()]
    assert [o[0] for o in out] == ["en", "de", "und", "und", "und", "en"] and all(0 <= o[1] <= 1 for o in out)
    assert langid.identify(empty(spark), filters).count() == 0
    assert {r.language.lang_pred for r in langid.identify(asked, langid.train(empty(spark).withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_secrets(spark):
    key = "AKIA" + "Q7ZK2M9XW4TB6VPN"
    texts = [f"password: token token=abcdef1 {key} " + "0a" * 12, None, "", "API_KEY = 'abc'", "id 9e107d9d372bb6826bd81d3542a419d6", "x" * 100_000]
    out = [r.secrets for r in secrets.scan_secrets(docs(spark, texts), BPE).orderBy("doc_id").collect()]
    assert [(o.n_assign, o.n_access, o.n_hex) for o in out] == [(1, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)]
    assert secrets.base_spans("secret='abcdef'") == [(0, 14, "assign")]
    hidden = secrets.redact_secrets(docs(spark, texts), BPE).orderBy("doc_id").collect()
    assert key not in hidden[0].text and hidden[1].text is None and hidden[2].text == ""


def test_random_keys_of_any_alphabet():
    own, rng = Vocabulary(BPE), np.random.default_rng(2)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for alphabet in (upper + "234567", lower + digits, upper + lower + digits, upper, upper + lower):
        for size in (20, 32):
            keys = ["".join(rng.choice(list(alphabet), size)) for _ in range(200)]
            low = [k for k in keys if len(k) < 2 * len(own.encode(k))]
            assert len(low) >= 195 and all(secrets.random_spans(k, own, 2.0) == [(0, size, "random")] for k in low)
    assert secrets.random_spans("JBSWY3DPEHPK3PXP", own, 2.0)
    known = ["9e107d9d372bb6826bd81d3542a419d6", "123e4567-e89b-12d3-a456-426614174000", "getUserAccountSettings2", "internationalisierung_datei", "src/main/java/org/apache/spark", "x" * 40]
    assert not any(secrets.random_spans(k, own, 2.0) for k in known)
    assert secrets.is_known("Network/Version/Account/Q7", own) and not secrets.is_known("QHXZJKWVPYTRMNBGFDSL", own)


def test_flac_round_trip(spark):
    payloads = [b"", b"a", bytes(range(256)) * 40, b"\x00\xff" * 5000, b"\x80" * 4096, "ünï çødé".encode() * 900]
    padded = [p + bytes(-len(p) % 64 or (0 if p else 64)) for p in payloads]
    streams = flac.encode(padded)
    for p, blocks, s in zip(padded, flac.decode(streams), streams):
        assert b"".join(bytes(x ^ 0x80 for x in b[2]) for b in blocks) == p
        assert [b[0] for b in blocks] == list(range(0, len(p), 4096))
        assert (flac.read_samples(s, len(p) - 64, 64) + 128).astype(np.uint8).tobytes() == p[-64:]
    broken = bytearray(streams[2])
    broken[-30] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        flac.decode([bytes(broken)])
    rows = spark.createDataFrame(list(enumerate(map(bytearray, payloads))), "doc_id long, payload binary")
    out = flac.media_features(flac.encode_media(rows)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.payload_bytes, r.tail_crc32) for r in out] == [(len(a), len(b), zlib.crc32(b[-64:])) for a, b in zip(payloads, padded)]
    assert flac.pcm_blocks(flac.encode_media(rows)).where("doc_id = 2").count() == 3


def test_flac_linear_predictor():
    """A hand-made frame: order 2 predictor 2x - y (shift 0), warm-up 1, 2, residuals 0 give a ramp."""
    n = 16
    bits = "0" + f"{32 + 1:06b}" + "0" + f"{1:08b}{2:08b}" + f"{3 - 1:04b}" + f"{0:05b}" + f"{2:03b}{7:03b}"
    bits += "00" + "0000" + "0000" + "1" * (n - 2)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    frame = flac.frame_header(0, n) + body
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    head = len(flac.frame_header(0, n))
    got = flac.decode_frames(np.frombuffer(frame, np.uint8), [(0, head, len(frame), n << 6 | 8)])[0]
    assert got.tolist() == list(range(1, n + 1))


@pytest.mark.parametrize("zip64", [False, True])
def test_warc(spark, zip64):
    pages = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/é", None), (4, "x", ""), (None, "y", "same"), (5, "z", "other é" * 999), (1, "r", "same")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = warc.archive_and_read(rows, zip64=zip64, payloads=True).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in out)
    assert got == sorted([("3", 4, "revisit", "1"), ("1", 4, "response", "None"), ("2", 0, "response", "None"), ("4", 0, "revisit", "2"), ("None", 4, "revisit", "1"), ("5", 7992, "response", "None"), ("1", 4, "response", "None")])
    for r in out:
        text = next(h for p, _, h in pages if p == r.page_id or p is None and r.page_id is None) or ""
        assert r.payload_digest == warc.base32_sha1(text.encode())
    assert warc.archive_and_read(rows.limit(0)).count() == 0


def test_licences(spark):
    texts = ["x. Licensed under the Apache License, Version 2.0.", "the MIT license, MIT License", None, "", "General public licence", "This work is licensed under the GNU General Public License, version 3."]
    out = {r.doc_id: r for r in licences.scan_licences(docs(spark, texts)).collect()}
    assert [(out[i].n_base, out[i].base_labels) for i in range(6)] == [(1, "apache"), (2, "mit"), (0, ""), (0, ""), (0, ""), (1, "gpl")]
    assert out[0].labels == "apache,apache-2.0" and out[5].labels == "gpl,gpl-3.0" and (out[1].first_word, out[1].last_word) == (1, 3)
    assert out[2].first_word is None and all(0 <= r.score <= 1 for r in out.values())


def test_html(spark):
    page = "<html><body><nav>menu</nav>{extra}<div>Template {n} line</div><p>Body &amp; <b>te</b>xt {i}<p>More<br>here {i}<div class='comments'><p>c</div><script>1<2</script></body>"
    pages = [(i, f"http://h/{i}", page.format(extra="", n="same", i=i)) for i in range(8)] + [(8, None, None), (9, "http://k/", "<article>a<p>b</article><p>out")]
    out = {r.page_id: r for r in html.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[3].main_text == "Body & text 3 More here 3" and out[8].main_text == "" and out[9].main_text == "a b"


def test_html_near_copies_of_one_article(spark):
    """Slightly different copies are most of a host's articles: their paragraphs stay, the site's template goes."""
    same = [f"Paragraph {k} of the article that many pages of this host repeat without a change" for k in range(6)]
    copies = [[p + f" edited {i}" if k == i % 6 else p for k, p in enumerate(same)] + [f"Date {i}"] for i in range(12)]
    others = [[f"Story {i} part {k} with words of its own number {i * k}" for k in range(6)] for i in range(6)]
    page = "<html><body><div>Site line of all pages</div><div>{}</div></body></html>"
    pages = [(i, "http://h/", page.format("".join(f"<p>{p}</p>" for p in parts))) for i, parts in enumerate(copies + others)]
    pages += [(100 + i, "http://k/", "<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>") for i, parts in enumerate(copies)]
    out = {r.page_id: r.main_text for r in html.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, parts in enumerate(copies + others):
        assert out[i] == " ".join(parts)
    assert all(out[100 + i] == " ".join(parts) for i, parts in enumerate(copies))


@pytest.mark.parametrize("limit", [2_000_000, 70])
def test_quality(spark, limit):
    good = ["the cat sat on the mat and the dog ran off to the hill " * 3] * 30
    rows = docs(spark, [*good, "###$$$%%%&&& ***!!! @@@" * 20, None, "", "the dog sat on the hill and the cat ran " * 2])
    trusted = spark.createDataFrame([(i,) for i in range(20)] + [(None,)], "doc_id long")
    out = {r.doc_id: r for r in quality.score_quality(rows, trusted, shard_rows=limit).collect()}
    assert not out[30].kept and all(out[i].kept for i in [*range(30), 31, 32]) and out[33].perplexity < out[30].perplexity
    assert len(out) == 34


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = np.random.default_rng(3)
    vocabulary = [a + b for a in ("ba", "de", "fi", "go", "lu", "mer", "not") for b in ("ra", "sen", "tol", "ving", "xa")]
    clean = [" ".join(rng.choice(vocabulary, 60)) for _ in range(30)]
    texts = [*clean, clean[0], clean[1] + " more", "12 34 !!", None, clean[2] + " " + " ".join(WORDS), clean[3] + " token = 'a8f5f167f44f4964'"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(WORDS))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import corpus_pipeline

    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert ids == set(range(30))
