"""Licence scan, language, quality, media and the pipeline against plain versions, held-out accuracy and round trips."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import plain
from vigilspark.llm import language, license_scan, media, quality
from vigilspark.llm.common import cut, release
from vigilspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    words = WORD.findall((text or "").translate(plain.LOWER))
    places = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licences(spark, sf_dir):
    notices = ["Released under the MIT License.", "x Licensed under the Apache License, Version 2.0. y", "Licensed under CC BY-NC 4.0.", "CC BY", "All Rights\nReserved general public LICENSE all rights reserved", "apache version license 2 0", "Licensed under the MIT pact", "license " * 3000 + "mit license"]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files (the \"Software\"), to deal in the Software without restriction"
    texts = plain.ODD + notices + [mit, "the " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))
    out = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for r in docs.collect():
        o = out[r.doc_id]
        assert (o.n_words, o.n_base, o.first_word, o.last_word, o.base_labels) == plain_base(r.text)
        assert set(filter(None, o.base_labels.split(","))) <= set(o.labels.split(",")) and 0 <= o.score <= 1
        if r.doc_id >= 1000:
            for line, label in (("the Apache License, Version 2.0.", "apache-2.0"), ("the MIT License.", "mit"), ("Public License, version 3.", "gpl-3.0"), ("CC BY-NC 4.0.", "cc-by-nc-4.0")):
                assert (label in o.labels.split(",")) == (line in r.text)
    n = len(plain.ODD)
    assert [out[n + k].labels for k in range(7)] == ["mit", "apache-2.0", "cc-by,cc-by-nc-4.0", "cc-by", "gpl,reserved", "", ""]
    assert "mit" in out[n + 8].labels and out[n + 9].labels == ""
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_licence_labels_by_trying_all_places(spark, sf_dir):
    rng, notes = random.Random(5), [t.text.split() for t in license_scan.TEMPLATES]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + plain.ODD
    for note in notes * 6:
        words = [w for w in note if rng.random() > 0.08]
        for _ in range(rng.choice((0, 0, 1, 3, 6))):
            words.insert(rng.randrange(len(words) + 1), rng.choice(("other", "license", "the", "public", "v")))
        texts.append(" ".join([*rng.choices(("a", "word", "license", "Free"), k=rng.randrange(9)), *words, *rng.choice(notes)[: rng.randrange(12)]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan.scan(docs).collect()}
    words = [WORD.findall((t or "").translate(plain.LOWER)) for t in texts]
    want = plain.licence_labels(words, license_scan.TEMPLATES, license_scan.BASE, order=lambda w: int(license_scan._hashes(w)[0]))
    assert got == {d: (labels, round(score, 9)) for d, (labels, score) in enumerate(want)}
    assert len({labels for labels, _ in want}) > 20


def greedy(text, of):
    """Phrases of the greedy parse of `of` by substrings of text, in blocks."""
    count = 0
    for lo in range(0, len(of), language.BLOCK):
        part, i = of[lo : lo + language.BLOCK], 0
        while i < len(part):
            n = 1
            while i + n <= len(part) and part[i : i + n] in text:
                n += 1
            i += max(1, n - 1)
            count += 1
    return count


def test_cross_parsing():
    rng = np.random.RandomState(2)
    alphabet = np.frombuffer(b"abcde ", np.uint8)
    own = alphabet[rng.randint(0, 6, 300)].tobytes()
    texts = [alphabet[rng.randint(0, 6, n)].tobytes() + b"\xc3\xa9" * (n % 3) for n in (1, 5, 256, 257, 700, 3)] + [b"", b"zzz"]
    model = language.Languages((("a", own),))
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    folded, place = language.folded(data, at)
    bits = model.bits(data, at)[:, 0]
    for d in range(len(texts)):
        part = folded[place[d] : place[d + 1]].tobytes()
        want = greedy(own, part) * np.log2(300) / len(part) if part else np.inf
        assert bits[d] == want


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = docs.collect()
    assert len(out) == len(rows)
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [out[r.doc_id].lang_pred == r.lang for r in rows if out[r.doc_id].held_out]
    assert sum(held) >= 0.98 * len(held)
    odd = spark.createDataFrame([(i, t, "en" if i % 2 else None, "x") for i, t in enumerate(plain.ODD)] + [(None, "the", "en", "x")], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r.lang_pred for r in language.identify(odd).collect()}
    assert all((got[i] == "und") == (not t or not any(c.isalpha() for c in t)) for i, t in enumerate(plain.ODD))
    assert {r.lang_pred for r in language.identify(odd.where("lang is null")).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_language_learns_whole_texts(spark):
    """Every word of a long labelled text is learned; languages beyond the bound don't fail the query."""
    words = [f"w{''.join(chr(97 + int(c)) for c in str(k))}z" for k in range(1000, 4000)]
    long = spark.createDataFrame([(1, "aa", " ".join(words)), (2, "bb", "qrs")], "doc_id long, lang string, text string")
    learned = dict(language.learn(long))
    assert set(words) <= set(learned["aa"].decode().split()) and learned["bb"].strip() == b"qrs"
    many = spark.range(language.LANGUAGES + 5).selectExpr("id AS doc_id", "concat('l', id) AS lang", "concat('abc ', id) AS text").unionByName(long.selectExpr("doc_id + 1000 AS doc_id", "'zz' AS lang", "text"))
    names = [lang for lang, _ in language.learn(many)]
    assert len(names) == language.LANGUAGES and "zz" in names
    assert language.identify(many).count() == many.count()


def plain_model(texts):
    """The same model from dictionaries."""
    order, size = quality.ORDER, quality.CLASSES
    top = {}
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        for g in quality.gram_codes(raw, np.array([0, len(raw)]))[0].tolist():
            top[g] = top.get(g, 0) + 1
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g % size**k] = counts[k].get(g % size**k, 0) + 1
    discount = {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        discount[k] = [min(j, max(0, j - (j + 1) * y * n[j] / n[j - 1])) if n[j - 1] else 0 for j in (1, 2, 3)]

    def p(g, k):
        if not k:
            return 1 / size
        below = p(g % size ** (k - 1), k - 1)
        after = {h: v for h, v in counts[k].items() if h // size == g // size}
        if not after:
            return below
        total, d = sum(after.values()), discount[k]
        own = after.get(g, 0)
        return (own - (d[min(own, 3) - 1] if own else 0)) / total + sum(d[min(v, 3) - 1] for v in after.values()) / total * below

    return p


def test_quality_model(spark):
    texts = ["the cat sat on the mat, the the cat", "a cat ate the rat. été", "mat mat mat"] * 2 + ["dog and cat at the hat"]
    bits = quality.model(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = plain_model(texts)
    rng = np.random.RandomState(0)
    raw = np.frombuffer("the cat rat a hat dog!".encode(), np.uint8)
    for g in [*rng.randint(0, 1 << 24, 40).tolist(), *quality.gram_codes(raw, np.array([0, len(raw)]))[0].tolist()]:
        assert abs(float(bits[g]) + np.log2(p(g, quality.ORDER))) < 0.02
    context = rng.randint(0, 1 << 18)
    assert abs((2.0 ** -bits[context * 64 : context * 64 + 64].astype(float)).sum() - 1) < 0.01


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = [out[d] for d, q in truth.items() if q], [out[d] for d, q in truth.items() if not q]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, k in out.items() if k}
    odd = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(plain.ODD)] + [(None, "a b", "qq", "x"), (3, "zz", "en", "x")], "doc_id long, text string, lang string, bits string")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(plain.ODD) + 2 and all(r.kept is False for r in rows if r.bits is None)
    assert all(r.kept for r in quality.classify(odd, labels.limit(0)).collect() if r.bits is not None)
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_quality_symbols_keep_all_bytes():
    """No two characters are one symbol: digits, letters of other scripts and punctuation have n-grams of their own."""
    seen = {}
    for c in [*range(0xD800), *range(0xE000, 0x11000, 7), *range(0x1F000, 0x1F700)]:
        raw = np.frombuffer(chr(c).encode(), np.uint8)
        seen.setdefault(tuple(quality.gram_codes(raw, np.array([0, len(raw)]))[0].tolist()), []).append(c)
    assert not [c for c in seen.values() if len(c) > 1]


def test_quality_scores_by_join(spark, monkeypatch):
    """Each document's bits are the plain model's, over many shards, for n-grams seen and unseen; copies and null ids too."""
    monkeypatch.setattr(quality, "SHARD_BYTES", 60)
    learned = ["the cat sat on the mat, the the cat", "Да нет, наверное. 1987", "mat mat mat"] * 2 + ["dog and cat at the hat 42"]
    asked = [*learned, "нет Да 1978 {}", "the Cat\tsat\n\nqqq", "xyzzy 世界 é", "a a", "", " ", None, "the cat sat on the mat " * 40, "x" * 300]
    docs = spark.createDataFrame([(i if i % 4 else None, "en", t) for i, t in enumerate(asked + asked[:3])], "doc_id long, lang string, text string")
    known = quality.model(spark.createDataFrame([(t,) for t in learned], "text string"))
    p, want = plain_model(learned), {}
    for t in asked:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        codes = quality.gram_codes(raw, np.array([0, len(raw)]))[0].tolist()
        bits = {g: -np.log2(p(g, quality.ORDER)) for g in set(codes)}
        want[t] = sum(bits[g] for g in codes) / len(raw) if (t or "").split() else None
    hashes = {r.mark: r.text for r in docs.selectExpr("xxhash64(text) AS mark", "text").collect()}
    rows = quality.score(docs, known).collect()
    assert len(rows) == len(asked) + 3
    for r in rows:
        t = hashes[r.mark]
        assert r.n_bytes == len((t or "").encode()) and (r.bits is None) == (want[t] is None)
        assert r.bits is None or abs(r.bits - want[t]) < 0.03


def test_quality_learns_from_all(spark, monkeypatch):
    """Counts cover every trusted document that isn't toxic, also the few of a rare language among very many others."""
    docs = spark.range(25_000).selectExpr("id AS doc_id", "IF(id % 5000 = 7, 'ru', 'en') AS lang", "IF(id % 5000 = 7, 'да нет', concat('word ', id)) AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id % 100 = 99, 0, 1) AS quality", "IF(doc_id % 100 = 98, 1, 0) AS toxic")
    counted, plain = [], quality.model
    monkeypatch.setattr(quality, "model", lambda learn: counted.append(sorted(r.text for r in learn.select("text").collect())) or plain(learn))
    out = quality.classify(docs, labels)
    assert counted == [sorted(r.text for r in docs.where("doc_id % 100 < 98").collect())]
    assert out.count() == 25_000


def test_pipeline_good_tells_scrambled_scripts(spark, tmp_path):
    """The pipeline's first stage drops texts whose two-byte letters are exchanged for others with the same first byte and last two bits."""
    rng = random.Random(5)
    words = "вода город дорога человек время рука дело жизнь день голова ребенок сила конец вид система часть отношение женщина деньги земля машина".split()
    prose = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(300)]
    alike = {c: [x for x in map(chr, range(0x430, 0x450)) if x.encode()[0] == c.encode()[0] and ord(x) % 4 == ord(c) % 4] for c in set("".join(words))}
    junk = ["".join(rng.choice(alike.get(c, c)) for c in t) for t in prose[200:]]
    docs = spark.createDataFrame([(i, "ru", t) for i, t in enumerate(prose + junk)], "doc_id long, lang string, text string")
    spark.range(200).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good(spark, docs, str(tmp_path)).collect()}
    assert len([i for i in kept if i < 300]) >= 285 and not [i for i in kept if i >= 300]


def test_quality_ngrams_have_whole_characters():
    """An n-gram spans five whole characters of up to two symbols, three ideographs, and none begins within one; the break that ends a text has one too."""

    def codes(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return quality.gram_codes(raw, np.array([0, len(raw)]))[0].tolist()

    for text, n in (("abcdef", 5), ("ABCDEF", 5), ("приват", 5), ("αβγδεζ", 5), ("שלוםאב", 5), ("730192", 5), ("aЖ1,éZ", 5), ("世界人民大会", 3)):
        seen = {c: codes(text[:-1] + c)[-2] for c in text}
        assert len(set(seen.values())) == len(text)
        for back in range(1, len(text)):
            other = text[: -1 - back] + ("大" if n == 3 and text[-1 - back] != "大" else "q") + text[len(text) - back :]
            assert (codes(other)[-2] == codes(text)[-2]) == (back >= n), (text, back)
    assert codes("éabcd")[-2] != codes("Ѐbcd")[-2]  # the second byte of one was the first of the other
    assert all(codes(t)[-1] % quality.CLASSES == quality.BREAK for t in ("", "a", "a.", "世"))


def test_pipeline_good_sees_as_far_in_any_script(spark, tmp_path):
    """The pipeline's first stage drops texts whose words end in letters that go with other first ones, three letters before in Cyrillic and two ideographs before."""
    rng = random.Random(3)
    kinds = {"ru": ("вгджзклм", ["ор", "ен", "ат", "ил", "ус", "ын"], "тпсрнбфх", " "), "zh": ("一世人民大会国家", list("中上下分年作"), "生时要出可也你对", "")}
    rows = []
    for lang, (first, middle, last, gap) in kinds.items():
        for i in range(400):
            picks = [rng.randrange(8) for _ in range(40)]
            rows.append((len(rows), lang, gap.join(first[k] + rng.choice(middle) + last[(k + (rng.randrange(1, 8) if i >= 300 else 0)) % 8] for k in picks)))
    spark.createDataFrame([(d, 1, 0) for d, _, _ in rows if d % 400 < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good(spark, spark.createDataFrame(rows, "doc_id long, lang string, text string"), str(tmp_path)).collect()}
    for lo in (0, 400):
        assert len(kept & set(range(lo, lo + 300))) >= 280 and not kept & set(range(lo + 300, lo + 400)), lo


def test_release_frees_shuffles(spark):
    """Shuffle files of tables that nothing refers to are gone when release() returns."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def blocks():
        return {b for b in manager.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    release(docs)
    before = blocks()
    known = quality.model(quality.learned(docs, cut(quality.trusted_ids(labels))))
    assert blocks() - before
    release(docs)
    assert known is not None and not blocks() - before


def test_media_round_trip(spark, sf_dir):
    docs = spark.createDataFrame(list(enumerate([*plain.ODD, "x" * 64, "x" * 64, "y" * 65])), "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))
    out = {r.doc_id: r for r in media.media_report(docs).collect()}
    for r in docs.collect():
        raw, o = (r.text or "").encode(), out[r.doc_id]
        want = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        mean, square = sum(want) / len(want), sum((x - 128) ** 2 for x in want) / len(want)
        crossed = sum((a < 128) != (b < 128) for a, b in zip(want, want[1:])) / (len(want) - 1)
        assert np.allclose([float(x) for x in o.feature.split(",")], [mean, square**0.5, crossed], rtol=0, atol=1e-4)
        assert media.samples_of(media.to_wave(want)) == want and o.media_bytes == len(want) + 44
    assert tuple(out[11][2:]) == tuple(out[12][2:])
    assert media.media_report(docs.limit(0)).count() == 0


def test_sequences(spark):
    html = "<p>One<img src='d1' alt='A &amp; b'>two <b>bold</b></p><figure><img src=d2><figcaption>Cap <i>tion</i></figcaption></figure><script>no</script>tail<video src='d9'></video>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>plain"), (4, "<figcaption>lost")], "page_id long, html string")
    parsed = media.parse(pages)
    rows = {(r.page_id, len(r["items"])): [(i.pos, i.kind, i.text or i.ref, i.caption) for i in r["items"]] for r in parsed.collect()}
    assert rows[1, 6] == [(0, "text", "One", None), (1, "image", "d1", "A & b"), (2, "text", "two bold", None), (3, "image", "d2", "Cap tion"), (4, "text", "tail", None), (5, "video", "d9", None)]
    assert rows[2, 0] == rows[3, 0] == [] and rows[4, 1] in ([(0, "text", "plain", None)], [(0, "text", "lost", None)])
    files = spark.createDataFrame([("d1", b"one"), ("d1", b"two"), ("d2", b"three")], "digest string, payload binary")
    met = {r.page_id: [i.media and bytes(i.media.payload) for i in r["items"]] for r in media.resolve(parsed, files).where("page_id = 1").collect()}
    assert met == {1: [None, b"one", None, b"three", None, None]}
    assert media.resolve(parsed, files).count() == 5
    assert media.parse(pages.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == first.columns and dict(after.dtypes) == dict(first.dtypes), name
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert 0 < docs.select("doc_id").distinct().count() <= first.count()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty() and out.count() > 0


def test_registered(spark):
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    """Nulls in any column, blank and repeated rows, clashing names, an empty table: all columns and types stay."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, root string, n long, key string, mark string, bits string, __row long"
    good = "the cat sat on the mat and looked at the hat with great care"
    rows = [(i, t, None, None, None, "a", 1, "b", None, "c", i) for i, t in enumerate(plain.ODD)] + [(None, good, None, "s", 3, None, None, None, None, None, None), (50, good, "en", "s", 3, "x", 2, "k", "m", "b", 7), (50, good, "en", "s", 3, "x", 2, "k", "m", "b", 7)]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            after = stage(spark, table, sf_dir)
            assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
            texts = [r.text for r in after.collect()]
            assert table is docs or not texts, name
            if table is docs and name == "once":
                assert texts.count(good) == 1 and texts.count(None) == 1
            if table is docs and name == "clean":
                assert len(texts) == len(rows)
            if table is docs and name == "mixed":
                assert None not in texts and good in texts
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == len(plain.ODD) + 2
