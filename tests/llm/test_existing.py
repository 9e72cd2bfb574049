"""Secret scan, near duplicates, mixing, fingerprints, repeats and packing against plain versions."""

import hashlib
import random
import zlib

import plain
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from vigilspark.llm import fingerprint, mixing, near_dup, packing, repeats, secret_scan

DOCS = "doc_id long, text string, source string, lang string, n_chars long, spans string, node string"


def frame(spark, texts, first=0, source=None):
    rows = [(i + first, t, source(i) if source else f"s{i % 3}", "en", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def whole(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_secrets(spark, sf_dir):
    rng = random.Random(3)
    parts = ["password", "PassWord", "passwd", "secret", "token", "api_key", "apikey", ":", "=", " ", "'", '"', "AKIA", "ABCDEF0123456789XY", "0123456789abcdef", "é", "x", "/+_.", "abcdefabcdef", "\n", "AKIAAKIA" * 3]
    texts = plain.ODD + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)]
    texts += ["token=" + "a" * 30000, "password: token=abcdefghijkl secret='password=abcdefghijkl'"]
    docs = frame(spark, texts).unionByName(whole(spark, sf_dir).selectExpr("doc_id + 100000 as doc_id", "text", "source", "lang", "n_chars", "'x' as spans", "'y' as node"))
    want = {r.doc_id: plain.secrets(r.text) for r in docs.collect()}
    got = {r.doc_id: ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in secret_scan.secret_report(docs).collect()}
    assert got == want


def test_secret_rules_and_redaction(spark):
    jwt = "eyJ" + "hbGci." + "eyJzdWIi." + "c2lnbmF0dXJl"
    texts = ["key " + "ghp_" + "g" * 36, "x " + jwt, "-----BEGIN RSA " + "PRIVATE KEY-----", "mysql://u:" + "pw@host/db", "https://example.org/a:b", "glpat-" + "h" * 19, None]
    rows = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.scan(frame(spark, texts)).collect()}
    assert rows == {0: ["github"], 1: ["jwt"], 2: ["pem"], 3: ["url"], 4: [], 5: [], 6: []}
    done = {r.doc_id: r for r in secret_scan.redact(frame(spark, texts)).collect()}
    assert done[0].text == "key <github>" and done[0].n_chars == 12 and done[5].text == texts[5] and done[6].text is None and done[0].spans == "x"
    assert secret_scan.secret_report(frame(spark, [])).count() == 0


def test_all_spans_by_pythons_expressions(spark, sf_dir):
    rng = random.Random(11)
    parts = ["gh" + "p_", "g" * 36, "gl" + "pat-", "A-" * 10, "xo" + "xb-", "1-2-3-4-5-6", "AI" + "za", "Z_" * 18, "sk_" + "live_", "r" * 24, "ey" + "J", "aGk", ".", "ey" + "JhbGci.eyJzdWI.",  "c2lnbmF0", "-----BEGIN ", "RSA ", "PRIVATE KEY", " BLOCK", "-----", "https://", "mysql://", "u:pw", "@", "host", ":", "/", "é", "漢", " ", "token=", "abcdef0123456789", "\n"]
    texts = plain.ODD + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(1500)]
    docs = frame(spark, texts).select("doc_id", "text").unionByName(whole(spark, sf_dir).selectExpr("doc_id + 100000 as doc_id", "text"))
    want = {r.doc_id: plain.all_spans(r.text, secret_scan.MORE) for r in docs.collect()}
    assert {kind.split(":")[0] for x in want.values() for kind in x.split(",")} >= {r.kind for r in secret_scan.MORE}
    assert {r.doc_id: r.spans for r in secret_scan.secret_report(docs).collect()} == want


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    texts = plain.ODD + plain.sample(words, 90) + ["b a", "A  B\n", "x " * 700, "x " * 900]
    docs = frame(spark, texts)
    got = sorted(tuple(r) for r in near_dup.near_duplicates(docs, words).collect())
    assert got == sorted(plain.near_components(list(enumerate(texts)), words))
    kept = {r.doc_id for r in near_dup.keep_one(docs, words).collect()}
    assert kept == {d for d, _, _, k in got if k}
    assert near_dup.keep_one(docs, words).columns == docs.columns
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Families with links near the threshold, compared in groups and by pairs alike."""
    rng = random.Random(4)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(60):
            w = list(base)
            for k in rng.sample(range(60), rng.randint(0, 7)):
                w[k] = f"v{rng.randrange(9)}"
            texts.append(" ".join(w))
    want = sorted(plain.near_components(list(enumerate(texts)), 2))
    assert len({c for _, _, c, _ in want}) > 5
    for small, group in ((2, 7), (2, 2000), (10**6, 1)):
        monkeypatch.setattr(near_dup, "SMALL", small)
        monkeypatch.setattr(near_dup, "GROUP", group)
        assert sorted(tuple(r) for r in near_dup.near_duplicates(frame(spark, texts)).collect()) == want


def test_near_duplicates_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "q r"), (5, "q r")], "doc_id long, text string")
    rows = [tuple(r) for r in near_dup.near_duplicates(docs).collect()]
    assert sorted(rows, key=str) == sorted([(None, 2, 4, False), (None, 2, 4, False), (4, 2, 4, True), (4, 1, 4, True), (5, 1, 4, False)], key=str)


def test_near_duplicates_on_tables(spark, sf_dir):
    docs = whole(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == sorted(plain.near_components(rows, 2))


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    total = share * sum(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    fixed = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        now = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        over = [i for i in free if now[i] > cap * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, now.get(i)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_mixing(spark, sf_dir):
    docs = whole(spark, sf_dir).select("doc_id", "text", "source", "n_chars").unionByName(spark.createDataFrame([(10**9 + i, t, s, 1) for i, (t, s) in enumerate([(None, "src0"), ("a b", None), ("", "zz"), ("  x", "é"), ("a b", None)])], "doc_id long, text string, source string, n_chars long"))
    rows = docs.collect()
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(3)).collect()}
    assert out == again and len(out) == len(rows)
    size = {r.doc_id: len(plain.SPACED.findall(r.text or "")) for r in rows}
    assert all(out[d].size == s for d, s in size.items())
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(size[r.doc_id] for r in rows if r.source == s) for s in names]
    want = plain_targets(totals)
    for s, t, n in zip(names, want, totals):
        own = [out[r.doc_id] for r in rows if r.source == s]
        assert all(abs(o.target - t) < 1e-6 and o.source_size == n and 0 <= o.taken <= 2 * o.size for o in own)
        assert abs(sum(o.taken for o in own) - t) <= 1
    mixed = mixing.repeat_by_mix(docs)
    assert mixed.columns == docs.columns
    back = {}
    for r in mixed.collect():
        back[r.doc_id] = back.get(r.doc_id, 0) + len(plain.SPACED.findall(r.text))
    assert back == {d: o.taken for d, o in out.items() if o.taken}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_fingerprints(spark, sf_dir):
    docs = frame(spark, plain.ODD + plain.sample(8, 30, 400), first=-5).select("doc_id", "text", "source")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    out = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    by_text = {}
    for k, (d, t) in enumerate(rows):
        cut, follow = len(t) // 4, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - cut] + follow[:cut]
        o = out[d]
        assert o.n_chars == len(t) and o.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= o.near_edited <= 1 and 0 <= o.near_next <= 1
        assert by_text.setdefault(t, o.fingerprint) == o.fingerprint
    long = [o for o in out.values() if o.n_chars > 600]
    assert sum(o.near_edited for o in long) / len(long) > 0.5
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, "x y z"), (7, "q " * 9)], "doc_id long, text string")
    assert fingerprint.fingerprints(odd).count() == 4


def test_fingerprints_of_short_texts(spark):
    """Half-equal texts of 20 words get shares between 0 and 1; merged sketches of single shingles are those of the union, stand-ins or not."""
    half = [(k, " ".join(f"w{k}x{j}" for j in range(10)), " ".join(f"v{k}x{j}" for j in range(10))) for k in range(300)]
    texts = spark.createDataFrame([(k, f"{a} {b}", f"{a} {b[::-1]}") for k, a, b in half], "k long, a string, b string")
    share = [r[0] for r in texts.select(fingerprint.likeness(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")))).collect()]
    assert sum(0 < x < 1 for x in share) >= 0.9 * len(share) and abs(sum(share) / len(share) - 6 / 26) < 0.05
    one = spark.createDataFrame([(a, b) for _, a, b in half], "a string, b string").selectExpr("substring_index(a, ' ', 5) AS a", "substring_index(b, ' ', 5) AS b")
    a, b = (fingerprint.sketch(F.col(c)) for c in "ab")
    low = [(r.m, sorted(r.x + r.y)) for r in one.select(fingerprint.merged(a, b).alias("m"), a.alias("x"), b.alias("y")).collect()]
    top = (1 << 63) // fingerprint.SCALE
    assert all(m == ([h for h in s if -top <= h < top] or s[:1]) for m, s in low)


def test_repeats(spark, sf_dir):
    texts = plain.ODD + plain.sample(5, 60, 300) + ["ab" * 400, "ab" * 199, "z" * 401, "é" * 260]
    docs = frame(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == dict(enumerate(plain.without_repeats(texts)))
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_on_tables_and_split_groups(spark, sf_dir, monkeypatch):
    rows = whole(spark, sf_dir).select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain.without_repeats([r.text for r in rows])))
    for group in (16384, 2):
        monkeypatch.setattr(repeats, "GROUP", group)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(whole(spark, sf_dir)).collect()}
        assert got == want


def test_packing(spark, sf_dir):
    docs = frame(spark, plain.ODD + ["  two  spaces ", "tab\t\tx\n\n y", "<|endoftext|> z", "a" * 9000, " em    nb"]).select("doc_id", "text").unionByName(whole(spark, sf_dir).selectExpr("doc_id + 1000 AS doc_id", "text"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces, used = {}, {}
    for r in packing.pack(docs).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        part = own[r.start : r.start + r.length]
        assert len(part) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for of, total in ((pieces, {d: len(x) for d, x in ids.items()}), (used, None)):
        for k, parts in of.items():
            at = 0
            for s, n in sorted(parts):
                assert s == at
                at += n
            assert at == total[k] if total else at <= 1024
    assert set(pieces) == set(ids)
    padded = sum(1024 - sum(n for _, n in p) for p in used.values())
    assert padded < 0.05 * 1024 * len(used) + 1024
    assert packing.pack(docs.limit(0)).count() == 0


def test_words_have_the_ids_of_the_tokenizer(spark):
    """The faster merge loop against the tokenizer itself: all words of a table, and random ones."""
    rng = random.Random(1)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    texts = [r.text for r in rows] + ["".join(rng.choices("abcxyzTHE'’sé漢字🙂\u00a0\u2003\t\n  ..,,--!?0123<|>_", k=rng.randint(1, 40))) for _ in range(20000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = packing.encoder(path)
    assert words.ranked is not None
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert words.encode(text) == b"".join(i.to_bytes(4, "little") for i in e.ids)


def plain_sketch(text, words=5, scale=2):
    """The fingerprint by a hash library, step by step."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in plain.words(text)]

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    if len(h) < words:
        return None
    every = {chain(h[i : i + words]) for i in range(len(h) - words + 1)}
    top = (1 << 63) // scale
    low = sorted(x for x in every if -top <= x < top)
    return low or [min(every)]


def test_fingerprints_and_likeness_by_hand(spark):
    """Fingerprints, likeness and containment against sets of hashes made step by step, for texts of five words or more."""
    texts = [t for t in plain.sample(11, 60, 200) if len(plain.words(t)) >= 9]
    rows = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        follow = texts[(k + 1) % len(texts)]
        part = len(t) // 4
        edited = t[: len(t) - part] + follow[:part]
        a, b, c = (plain_sketch(x) for x in (t, follow, edited))
        text = lambda s: ",".join(f"{x & (2**64 - 1):x}" for x in s)
        assert rows[k].fingerprint == text(a) and (c is None or rows[k].edited_fingerprint == text(c))
        share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
        assert abs(rows[k].near_next - share(a, b)) < 1e-12
        if c is not None:
            assert abs(rows[k].near_edited - share(a, c)) < 1e-12 and abs(rows[k].kept_in_edited - len(set(a) & set(c)) / len(a)) < 1e-12


def test_redaction_of_columns_that_cannot_be_null(spark):
    kind = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
    docs = spark.createDataFrame([(k, "token=" + "a" * 20 if k == 3 else "x" * 900_000, 1) for k in range(8)], kind).coalesce(1)
    rows = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert rows[3].text == "<assign>" and rows[3].n_chars == 8 and rows[0].n_chars == 1 and len(rows) == 8


def test_mix_shares_words_among_equal_rows(spark):
    docs = spark.createDataFrame([(7, "a b c", "s", 5)] * 3 + [(8, "d e", "s", 3), (9, "f", "t", 1)], "doc_id long, text string, source string, n_chars long")
    taken = {}
    for r in mixing.mix(docs, share=1.2, epochs=1.5).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    back = {}
    for r in mixing.repeat_by_mix(docs, share=1.2, epochs=1.5).collect():
        back[r.doc_id] = back.get(r.doc_id, 0) + len(r.text.split())
    assert back == {d: n for d, n in taken.items() if n}


def test_periodic_blocks_are_runs():
    """Blocks that repeat within a text leave it as runs; all windows are still covered once or more."""
    import numpy as np

    text = ("z" * 3000 + "".join(random.Random(2).choices("abcdef ", k=2000))).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    (d, s0, s1, anchor, n), content = repeats.block_rows(data, at)
    assert len(d) == len(content) < 60 and (n == 0).sum() >= 1 and n.sum() > 2000
    covered = np.zeros(len(text) - 399, bool)
    for a, b in zip(s0, s1):
        covered[a : b + 1] = True
    assert covered.all()


def test_prefixes_keep_partners_and_drop_others(spark):
    """Texts of one template meet by their common words alone, and are dropped; near copies among them stay."""
    rng = random.Random(6)
    base = set(range(100))
    sets = [(k, sorted(base | {1000 * k + j for j in range(60)})) for k in range(1, 40)]
    sets.append((40, sorted(set(sets[4][1]) - set(rng.sample(sorted(base), 3)))))
    rows = spark.createDataFrame(sets, "node long, set array<long>")
    nodes = rows.selectExpr("node", "node AS root")
    assert {r.node for r in near_dup._partners(nodes, rows, 80).collect()} == {5, 40}
