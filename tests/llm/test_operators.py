"""The operators of lanewise.llm against brute force, and on nulls, empty and odd texts, ties, and clashing columns."""

import collections
import hashlib
import random
import re
import struct
import time
import tracemalloc
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lanewise.llm import fingerprint, html_text, language, mixing, near_dup, pieces, quality_knn, quality_rules, secrets, sharding, textnum
from lanewise.llm.components import components
from lanewise.llm.queries import PIECE_MODEL
from lanewise.llm.storage import Scratch, release

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "to", "ve") for b in ("n", "r", "s", "t", "lin", "mor", "dex")]
ODD = ["", None, " \n\t ", "one", "a b c d", "été ñandú ßtraße 日本 🙂", "x" * 5000, "\x00\x1f", "A B C D E F", "a b c d e f"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


# SentencePiece -----------------------------------------------------------------------------------------------------


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def unigram_model(scores, squeeze=False):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(p, s, 1) for p, s in scores.items()]
    body = b"".join(_field(1, _field(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _varint(3 << 3) + _varint(t)) for p, s, t in rows)
    return body + _field(2, _varint(3 << 3) + _varint(1)) + _field(3, _varint(4 << 3) + _varint(int(squeeze)))


def test_bpe_equals_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + [prose(rng, rng.randint(1, 300)) for _ in range(50)]
    texts += ["".join(rng.choice("aeinrst  \n.,1é▁日") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    texts += ["".join(rng.choice("aeinrstho") for _ in range(600)) for _ in range(20)] + [" " * k + "the" for k in range(40)]
    found = pieces.encode(frame(spark, texts), pieces.load(PIECE_MODEL), check=True).orderBy("doc_id").collect()
    assert [list(r.ids) for r in found] == [lib.encode(t) for t in texts]
    assert all(r.round_trip == ("▁" not in r.text) for r in found)


def test_unigram_equals_brute_force():
    rng = random.Random(2)
    scores = {"▁": -3.0} | {c: -4.0 - k / 10 for k, c in enumerate("abcd")}
    for _ in range(40):
        scores["".join(rng.choice("▁abcd") for _ in range(rng.randint(2, 5)))] = -rng.random() * 9
    model = pieces.PieceModel(unigram_model(scores))
    encoder = pieces.Encoder(model)

    def best(text):
        table = [(0.0, [])] + [None] * len(text)
        for j in range(len(text)):
            for k in range(j + 1, min(len(text), j + 5) + 1):
                p = text[j:k]
                s = model.scores[model.ids[p]] if p in model.ids else model.unk_score if k == j + 1 else None
                if s is not None and (table[k] is None or table[j][0] + s > table[k][0]):
                    table[k] = (table[j][0] + s, table[j][1] + [p])
        return table[-1][0]

    for n in [0, 1, 5, 50, 400]:
        for _ in range(10):
            text = "".join(rng.choice(" abcdx") for _ in range(n))
            ids = encoder.encode(text)
            inner = ("▁" + text.replace(" ", "▁")) if text else ""
            total = sum(model.scores[i] if i != model.unk else model.unk_score * len(list(g)) for i, g in [(i, [i]) for i in ids])
            if "x" not in text:
                assert total == pytest.approx(best(inner) if text else 0.0)
                assert encoder.decode(ids) == text


def test_commits_do_not_wait_for_the_end():
    encoder = pieces.Encoder(pieces.load(PIECE_MODEL))
    parts = list(encoder.search("abcdefghij" * 400))
    assert len(parts) > 20 and encoder.decode([i for p in parts for i in p]) == "abcdefghij" * 400


def test_decode_and_clashing_names(spark):
    docs = frame(spark, ODD).withColumn("ids", F.lit("old")).withColumn("round_trip", F.lit(1))
    found = pieces.encode(docs, pieces.load(PIECE_MODEL), check=True)
    assert found.columns == ["doc_id", "text", "ids", "round_trip"] and found.count() == len(ODD)
    back = pieces.decode(found, pieces.load(PIECE_MODEL), out="again").orderBy("doc_id").collect()
    assert [r.again for r in back] == [t or "" for t in ODD]
    assert pieces.encode(empty(spark), pieces.load(PIECE_MODEL)).count() == 0


# Fingerprints ------------------------------------------------------------------------------------------------------


def test_fingerprints_follow_the_definition(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 200)) for _ in range(60)] + ODD
    ids = rng.sample(range(-500, 10_000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    rows = sorted(zip(ids, [t or "" for t in texts], strict=True))
    for parts in (1, 7, 40):
        found = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs, parts).collect()}
        assert len(found) == len(rows)
        for k, (i, t) in enumerate(rows):
            after, n, r = rows[(k + 1) % len(rows)][1], len(t), found[i]
            edited = t[: n - n // 2] + after[: n // 2]
            a, b, c = shingles(t), shingles(edited), shingles(after)
            assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1, abs=0.12)
            assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1, abs=0.12)


def test_fingerprint_cases(spark):
    one = fingerprint.edited_fingerprints(frame(spark, ["a b c d e f"]), 4).collect()
    assert one[0].near_next == 1.0
    assert fingerprint.edited_fingerprints(empty(spark), 4).count() == 0
    same = fingerprint.fingerprints(frame(spark, ODD).withColumn("fingerprint", F.lit(0))).orderBy("doc_id").collect()
    assert same[0].fingerprint == same[1].fingerprint == "" and same[8].fingerprint == same[9].fingerprint != ""
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, None), (None, "x")], "doc_id bigint, text string")
    assert fingerprint.edited_fingerprints(twice, 3).count() == 4


def test_low_bits_are_corrected():
    sketcher = fingerprint.Sketcher(9, 2)
    rng = random.Random(8)
    import pyarrow as pa

    a, b = sketcher.sketches(pa.array([prose(rng, 500), prose(rng, 500)]))
    assert fingerprint.likeness(a, b, 2) < 0.15 and len(sketcher.pack(a)) == 512 * 2 // 4


# Near duplicates ---------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    common = collections.Counter((a, b) for v in where.values() for k, b in enumerate(sorted(v)) for a in sorted(v)[:k])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def changed(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


@pytest.mark.parametrize("small", [64, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 16 if small == 2 else near_dup.BLOCK)
    rng = random.Random(4)
    base, passage = prose(rng, 140), prose(rng, 60)
    texts = [changed(rng, base, rng.randint(0, 9)) for _ in range(120)]  # one group with many members near the threshold
    texts += [passage + " " + prose(rng, 40) for _ in range(40)]  # a common passage
    chain = prose(rng, 100)
    for _ in range(12):  # each near the one before, the ends far apart
        texts.append(chain)
        chain = changed(rng, chain, 2)
    texts += [prose(rng, rng.randint(1, 12)) for _ in range(60)] + ODD + [texts[0]] * 5
    for n in (4, 5, 6, 7, 8, 20):  # short texts that differ by a word
        t = prose(rng, n)
        texts += [t, t + " zz", t.upper(), "zz " + t]
    rng.shuffle(texts)
    found = near_dup.near_duplicates(frame(spark, texts, 10), Scratch(spark, "test")).collect()
    wanted = brute_components([(10 + k, t) for k, t in enumerate(texts)])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_short_texts_at_the_threshold(spark):
    rng, texts = random.Random(12), []
    for n in (3, 6, 9, 12, 48) * 60:  # n of n + n / 3 shingles
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n + n // 3 + 4)]
        texts += [" ".join(words[: n + 4]), " ".join(words)]
    found = near_dup.near_duplicates(frame(spark, texts), Scratch(spark, "test")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {
        k: (len(shingles(t)), k - k % 2) for k, t in enumerate(texts)
    }


@pytest.mark.parametrize("bucket", [64, 2])
def test_small_sets_are_compared_whole_in_every_pass(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_dup, "SMALL", bucket)
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(60)]
    texts = [" ".join(words[a : a + n]) for a in range(0, 24, 2) for n in (7, 8, 11, 16, 20)]
    found = near_dup.near_duplicates(frame(spark, texts), Scratch(spark, "test")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(list(enumerate(texts)))


def test_near_duplicate_cases(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (None, "a b c d e f"), (3, None), (4, ""), (1, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_dup.near_duplicates(docs, Scratch(spark, "test")).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True)}
    kept = near_dup.drop_near_duplicates(docs.withColumn("id", F.lit(7)).withColumn("hub", F.lit(8)), Scratch(spark, "test"))
    assert kept.columns == ["doc_id", "text", "id", "hub"]
    assert collections.Counter(r.doc_id for r in kept.collect()) == {1: 1, None: 1, 3: 1, 4: 1}
    assert near_dup.near_duplicates(empty(spark), Scratch(spark, "test")).count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(30)] + [(500, k) for k in range(501, 560)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "test"), "c").collect()}
    parent = {i: i for e in links for i in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert found == {i: find(i) for a, b in links if a != b for i in (a, b)}


# Language ----------------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(7)
    alphabets = {"xa": "abcde", "xb": "defgh", "xc": "ñéüab"}
    word = lambda lang: "".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(2, 8)))
    rows = [(k, " ".join(word(lang) for _ in range(rng.randint(3, 40))), lang) for k, lang in enumerate(list(alphabets) * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs.where("doc_id < 120"))
    held = language.predict(docs.where("doc_id >= 120"), model).collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in held)
    odd = language.predict(frame(spark, ODD).withColumn("score", F.lit("x")), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in odd[:4]] == [True, True, True, False] and odd[7].lang_pred == "und" and odd[0].score == 0.0
    nothing = language.train(empty(spark))
    assert {r.lang_pred for r in language.predict(frame(spark, ODD), nothing).collect()} == {"und"}
    assert language.predict(empty(spark), model).count() == 0


def test_language_scores_equal_plain_sums(spark):
    import numpy as np

    docs = spark.createDataFrame([(1, "abc abd", "p"), (2, "xyz xyy", "q"), (3, "abz", "q")], "doc_id bigint, text string, lang string")
    model = language.train(docs)
    for text in ("abc", "a", "zyx abc q"):
        codes, _ = language._code_points([text])
        sums = model.log_prior.astype(float).copy()
        for n in range(1, language.ORDERS + 1):
            for c in language._columns(codes, n):
                sums += model.log_probability[c]
        p = np.exp(sums - sums.max())
        r = language.predict(frame(spark, ["q q q", text, "longer text behind"]), model).where("doc_id = 1").first()
        assert r.lang_pred == model.languages[int(sums.argmax())] and r.score == pytest.approx(p.max() / p.sum(), rel=1e-4)


# Secrets -----------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def secret_texts():
    rng = random.Random(9)
    bits = ["token", "Password", "api_key", "apikey", "secret", " = ", ":", "=", '"', "'", "AKIA", "AKIA" + "A1B2" * 4, "deadbeef" * 3, "abc", "é", "日", "\n", " ", "12345678", "x.y-z"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ODD + ["password=token: abcdefgh", "token=secret=abcdefgh"]


def test_secret_base_spans_equal_plain_search(spark):
    texts = secret_texts()
    docs = frame(spark, texts)
    ratios = secrets.train(docs)
    for r in secrets.scan(docs.withColumn("spans", F.lit(1)), ratios).collect():
        wanted = base_spans(r.text or "")
        assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
        assert set(filter(None, wanted.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(wanted.count(k) for k in ("assign", "access", "hex"))


def test_secret_model_tells_random_from_ordinary(spark):
    rng = random.Random(10)
    docs = frame(spark, [prose(rng, 80) for _ in range(60)])
    ratios = secrets.train(docs)
    made = ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(32)) for _ in range(60)]
    plain = ["_".join(rng.choice(WORDS) for _ in range(5)) + f"_{k}" for k in range(60)]
    found = secrets.scan(frame(spark, ["see " + t + " there" for t in made + plain]), ratios).orderBy("doc_id").collect()
    hits = ["random" in r.spans for r in found]
    assert sum(hits[:60]) >= 57 and sum(hits[60:]) == 0
    assert secrets.scan(empty(spark), secrets.train(empty(spark))).count() == 0


def test_secrets_inside_longer_tokens(spark):
    rng = random.Random(14)
    docs = frame(spark, [prose(rng, 80) for _ in range(60)])
    made = ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(32)) for _ in range(40)]
    letters = ["".join(rng.choice(secrets.ALPHABET[:52]) for _ in range(32)) for _ in range(40)]
    path = lambda n: "/".join(rng.choice(WORDS) for _ in range(n))
    texts = [f"{path(8)}/{t}/{path(3)}" for t in made] + letters + [f"{'deadbeef' * 3}_{t}" for t in made]
    texts += [f"{a}/{path(5)}/{b}" for a, b in zip(made, made[1:])] + [path(12) for _ in range(40)] + ["-" * 40, "a" + "=" * 30, "9" * 30]
    found = secrets.scan(frame(spark, texts), secrets.train(docs)).orderBy("doc_id").collect()
    hidden = lambda r, t: any(s.kind == 3 and s.start <= r.text.index(t) and s.end >= r.text.index(t) + len(t) for s in r.secret_spans)
    for at, part in ((0, made), (40, letters), (80, made), (120, made[:39]), (120, made[1:])):
        assert sum(hidden(r, t) for r, t in zip(found[at:], part)) >= 0.95 * len(part)
    assert not any(s.kind == 3 for r in found[159:] for s in r.secret_spans)


def test_redaction(spark):
    texts = ['a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" z', "clean text", None, "", "é AKIA" + "A1B2" * 4 + " " + "deadbeef" * 3]
    docs = frame(spark, texts).withColumn("n_chars", F.lit(1).cast("long"))
    found = secrets.redact(docs, secrets.train(docs)).orderBy("doc_id").collect()
    assert [r.text for r in found] == ['a [SECRET]" z', "clean text", None, "", "é [SECRET] [SECRET]"]
    assert [r.n_chars for r in found] == [13, 1, 1, 1, 19]
    docs = frame(spark, secret_texts()).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    ratios = secrets.train(docs)
    spans = {r.doc_id: [(s.start, s.end) for s in r.secret_spans] for r in secrets.scan(docs, ratios).collect()}
    for (i, before), r in zip(enumerate(secret_texts()), secrets.redact(docs, ratios).orderBy("doc_id").collect(), strict=True):
        text, at = "", 0
        for start, end in spans[i]:
            text += before[at:start] + "[SECRET]" if start >= at else ""
            at = max(at, end)
        assert r.text == (before and text + before[at:]) and r.n_chars == len(r.text or "")


# Mixing ------------------------------------------------------------------------------------------------------------


def mixed_docs(spark):
    rng = random.Random(11)
    rows = [(k, prose(rng, rng.randint(1, 60)) + (" |" * 5 if k % 4 == 0 else ""), rng.choice(["en", "de", None]), "hot" if k % 3 == 0 else f"s{k % 5}") for k in range(900)]
    return spark.createDataFrame(rows + [(1000, None, None, None), (1001, "", "en", "hot")], "doc_id bigint, text string, lang string, source string")


def test_raking_equals_plain_fitting(spark):
    docs = mixed_docs(spark)
    targets = {"source": {"hot": 0.2, "s0": 0.2, "s1": 0.2, "s2": 0.1, "s3": 0.1, "s4": 0.2}, "lang": {"en": 0.5, "de": 0.3, mixing.NONE: 0.2}}
    found = mixing.mixture(docs, Scratch(spark, "test"), targets, 0.4).collect()
    assert len(found) == 902
    rows = mixing.described(docs).collect()
    cells = collections.Counter()
    for r in rows:
        cells[r.mix_source, r.mix_lang, r.mix_topic] += r.mix_tokens
    topic = collections.Counter()
    for c, n in cells.items():
        topic[c[2]] += n
    root = sum(v**0.5 for v in topic.values())
    want = [targets["source"], targets["lang"], {k: v**0.5 / root for k, v in topic.items()}]
    w = dict(cells)
    for _ in range(400):
        for d in range(3):
            sums = collections.Counter()
            for c, v in w.items():
                sums[c[d]] += v
            w = {c: v * want[d].get(c[d], 0) / sums[c[d]] if sums[c[d]] else 0.0 for c, v in w.items()}
    total = sum(cells.values())
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cells[c], mid * v) for c, v in w.items()) < 0.4 * total else (lo, mid)
    for r in found:
        c = (r.source or mixing.NONE, r.lang or mixing.NONE, r.mix_topic)
        p = min(1.0, lo * w[c] / cells[c]) if cells[c] else 0.0
        assert r.probability == pytest.approx(p, rel=1e-3, abs=1e-6)
    spent = sum(r.mix_tokens * r.probability for r in found)
    assert spent == pytest.approx(0.4 * total, rel=1e-6)
    drawn = sum(r.mix_tokens for r in found if r.sampled)
    assert drawn == pytest.approx(0.4 * total, rel=0.15)


def test_mixing_cases(spark):
    assert mixing.mixture(empty(spark), Scratch(spark, "test")).count() == 0
    docs = mixed_docs(spark).withColumn("probability", F.lit("old"))
    kept = mixing.sampled(docs, Scratch(spark, "test"), budget=1.0)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    again = mixing.sampled(docs, Scratch(spark, "test"), budget=1.0)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in again.collect())
    topics = frame(spark, ["", "a | b | c", "HO!! HE!!", "a## b$$ c%%", "1234 5678", "a\nb\nc\nd", "plain words here", None])
    assert [r.mix_topic for r in mixing.described(topics.withColumns({"lang": F.lit("x"), "source": F.lit("y")})).orderBy("doc_id").collect()] == ["empty", "table", "shout", "symbols", "figures", "lists", "prose", "empty"]


# Quality classifier ------------------------------------------------------------------------------------------------


def quality_docs(spark, n=400):
    rng = random.Random(12)
    rows = []
    for k in range(n):
        good = k % 4 != 0
        text = ". ".join(prose(rng, rng.randint(4, 9)) for _ in range(rng.randint(2, 8)))
        rows.append((k, text if good else text.replace(" ", "### ") if k % 8 else " ".join([rng.choice(WORDS)] * 50), int(good)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def test_quality_knn(spark):
    docs = quality_docs(spark)
    labels = docs.select("doc_id", "label")
    model = quality_knn.train(docs, labels.where("doc_id < 300"))
    held = quality_knn.predict(docs.where("doc_id >= 300"), model).collect()
    assert sum(r.predicted == r.label for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)
    odd = quality_knn.predict(frame(spark, ODD).withColumn("score", F.lit("x")), model).orderBy("doc_id").collect()
    assert odd[0].score == odd[1].score == pytest.approx(model.prior)
    nothing = quality_knn.train(docs, labels.limit(0))
    assert {r.score for r in quality_knn.predict(frame(spark, ODD), nothing).collect()} == {0.5}
    assert quality_knn.predict(empty(spark), model).count() == 0
    few = quality_knn.train(docs, labels.where("doc_id in (1, 4)").unionByName(spark.createDataFrame([(2, None), (None, 1)], "doc_id bigint, label int")))
    assert len(few.labels) == 2


def test_quality_knn_equals_plain_voting(spark):
    import numpy as np
    import pyarrow as pa

    docs = quality_docs(spark, 120)
    model = quality_knn.train(docs, docs.select("doc_id", "label"))
    text = docs.where("doc_id = 7").first().text
    counts = next(quality_knn.term_counts(pa.array([text])))
    v = model.project(counts)[0]
    cosine = model.vectors @ v
    best = np.argsort(-cosine)[: quality_knn.NEIGHBOURS]
    w = (np.maximum(cosine[best], 0) ** 8 + 1e-9) * model.votes[best]
    assert model.score(counts)[0] == pytest.approx((w * model.labels[best]).sum() / w.sum(), abs=1e-4)


def test_quality_knn_learns_without_a_dense_matrix(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    docs = quality_docs(spark, 2000).cache()
    labels, texts = docs.select("doc_id", "label"), docs.orderBy("doc_id").collect()
    quality_knn.train(docs, labels.limit(10))  # what is loaded once isn't meant
    monkeypatch.setattr(quality_knn, "release", lambda spark: "")
    tracemalloc.start()
    model = quality_knn.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = len(model.labels)
    assert n > 1500 and peak < 0.8 * n * quality_knn.TERMS * 4

    # The same rows as a matrix.
    kept = quality_knn.bounded(labels, quality_knn.TRAIN_ROWS, "label").select("doc_id").collect()
    ids = sorted(r.doc_id for r in kept)
    counts = np.concatenate(list(quality_knn.term_counts(pa.array([texts[i].text for i in ids]))))
    assert [texts[i].label for i in ids] == list(model.labels)
    rarity = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    assert (rarity == model.rarity).all()
    x = quality_knn.damped(counts, rarity)
    assert np.abs(quality_knn.unit(x @ model.directions) - model.vectors).max() < 1e-5
    size = np.linalg.svd(x, compute_uv=False)[:4]
    assert np.linalg.norm(x @ model.directions, axis=0)[:4] == pytest.approx(size, rel=1e-3)
    docs.unpersist()


def test_driver_gives_memory_back(spark):
    assert "Trim native heap" in release(spark)
    said = []
    scratch = Scratch(spark, "swept")
    kept = scratch.keep(spark.range(3), "few")
    assert kept.count() == 3
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("lanewise.llm.storage.release", said.append)
        scratch.sweep("few")
    assert said == [spark] and not re.search("few", " ".join(map(str, Path(scratch.root.removeprefix("file:")).glob("*"))))


# Quality rules -----------------------------------------------------------------------------------------------------


def plain_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, cover = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark):
    rng = random.Random(13)
    texts = [t or "" for t in ODD] + [None, "\n\na b\n \na b\n", " ".join(["a"] * 100)]
    for k in range(200):
        t = ". ".join(prose(rng, rng.randint(6, 12)).capitalize() for _ in range(rng.randint(5, 12)))
        if k % 7 == 0:
            t = t.replace(" ", "### ")
        if k % 11 == 0:
            t = t + " " + t
        texts.append(t + ("\nsame line\nsame line" if k % 13 == 0 else ""))
    docs = frame(spark, texts).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y"))
    found = quality_rules.judge(docs, Scratch(spark, "test")).collect()
    assert len(found) == len(texts)
    for r in found:
        t = texts[r.doc_id]
        own = plain_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        failed = own[0] < 20 or 100 * own[4] > 30 * own[0]
        assert r.base_failed == failed and not (failed and r.kept)
        if not failed:
            assert r.kept == ("###" not in t)
    assert quality_rules.judge(empty(spark), Scratch(spark, "test")).count() == 0


# HTML --------------------------------------------------------------------------------------------------------------

PARA = "<p>Long text of the article, with commas and stops. It goes on, and on; and here it ends.</p>"
INNER = "Long text of the article, with commas and stops. It goes on, and on; and here it ends."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("plain  text", "plain text"),
        (f"<body><nav><a>Home</a></nav><article><h1>T &amp; U</h1>{PARA}<p>b<b>c</b>d&nbsp;e</p></article><footer>f</footer>", f"T & U {INNER} bcd e"),
        (f"<article><p><b>Open.<br><p>next</p>{PARA}</article><div class='ad'>Buy, now. Yes!</div>", f"Open. next {INNER}"),
        (f"<div class='menu'><a>x</a></div><div><h2>T</h2>{PARA}<p>short</p></div><div id=comments>{PARA}</div>", f"T {INNER} short"),
        (f"<main>{PARA}<aside>a, b. c</aside><form>q<input></form><script>var x='</p>';</script><!-- {PARA} --></main><div class='cookie-notice'>We, use. it!</div>", INNER),
        (f"<article>{PARA}<p>cut of", f"{INNER} cut of"),
        (f"<div class='page has-sidebar'><div class=sidebar>{PARA}</div><div class=entry-content>{PARA}</div></div>", INNER),
        (f"<div class='menu'>{PARA}</div>", INNER),
        (f"<div id=wrap><div class=sec>{PARA * 9}</div><div class=sec>{PARA}</div></div>", " ".join([INNER] * 10)),
        (f"<article><svg a='b'/><p>x</p><svg-icon></svg-icon><title-bar>t</title-bar>{PARA}<svg><text>s</text></svg></article>", f"x t {INNER}"),
        (f"<article>{PARA}<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <object data=u>shown</object></p><math/></article>", f"{INNER} so x=2 shown"),
        (f"<body><form id=f><input><label>l</label><div>{PARA * 3}</div></form><footer>f</footer></body>", " ".join([INNER] * 3)),
        (f"<body><form><article>{PARA}</article></form><p>c</p></body>", INNER),
        (f"<body><nav><a>Home</a><article>{PARA}</article></body>", INNER),
        (f"<body><aside><div>{PARA}</div></body>", INNER),
        (f"<div id=wrap>{PARA}<ul><li>a</li><li>b</li></ul><table><tr><td>1</td></tr></table>{PARA}</div><ul><li><a>Home</a></li></ul>", f"{INNER} a b 1 {INNER}"),
        (f"<article><header><h1>T</h1></header>{PARA}<section class='reader-comments'>{PARA}</section><ul class=share><li>S</li></ul></article>", f"T {INNER}"),
        (f"<article>{PARA}<p class=share-price>The price, it rose. A lot, today.</p>{PARA}</article>", f"{INNER} The price, it rose. A lot, today. {INNER}"),
        (f"<body><form>{PARA}<nav><a>x</a></nav><footer>foot, here. And, so.</footer>{PARA}</form></body>", f"{INNER} {INNER}"),
        (f"<article><h1><a href=u>Title</a></h1>{PARA}<ul><li><a>one</a><li><a>two</a></ul></article>", f"Title {INNER}"),
        (f"<body><header><p>Site of, all.</p></header><article>{PARA}<div class='post-share'>Share, this.</div><div class=comments>{PARA * 9}</div></article></body>", INNER),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_html_ratios_choose_the_content():
    """No name says what is content: the path with long, punctuated leaves is, whatever the element."""
    page = f"<div><span class=k1>Home</span><span class=k1>News</span></div><div class=k2>{PARA * 4}</div><div><i class=k3>a</i><i class=k3>b</i></div>"
    nodes, found = html_text.leaves(page)
    ratios = html_text.path_ratios(found)
    # The same by path strings.
    name = lambda n: (name(n.parent) + "/" if n.parent else "") + n.name
    plain = {}
    for node, text, _ in found:
        plain.setdefault((name(node), node.path), []).append(text)
    text = [sum(len(t) - t.count(" ") for t in ts) / len(ts) for ts in plain.values()]
    marks = [sum(len(re.findall("[.,;:!?]", t)) for t in ts) / len(ts) for ts in plain.values()]
    near = lambda v, k: 0.25 * v[max(0, k - 1)] + 0.5 * v[k] + 0.25 * v[min(len(v) - 1, k + 1)]
    fused = [(text[k] * (1 + marks[k]) * near(text, k) * (1 + near(marks, k))) ** 0.5 for k in range(len(text))]
    assert list(ratios.values()) == pytest.approx(fused)
    mean = sum(fused) / len(fused)
    spread = (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5
    assert html_text.content_paths(ratios) == {p for (_, p), x in zip(plain, fused, strict=True) if x >= 0.5 * spread}
    assert html_text.main_text(page) == " ".join([INNER] * 4)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<b>x" * 16_000 + "</i>" * 16_000, "<b>" * 16_000 + "<p>x" * 16_000, "<ul><li>" * 20_000 + "x"])
def test_html_of_many_unclosed_tags(page):
    tracemalloc.start()
    began = time.perf_counter()
    text = html_text.main_text(page)
    assert set(text) <= {"x", " "} and "x" in text
    assert tracemalloc.get_traced_memory()[1] < 200e6 and time.perf_counter() - began < 60
    tracemalloc.stop()


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{PARA}</article>", "old"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    found = html_text.extract(pages).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in found] == [(INNER, len(INNER)), ("", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


# Sharding ----------------------------------------------------------------------------------------------------------


def test_lookup_table_equals_taking_turns():
    names, slots = ["b", "a", "c"], 101
    table = sharding.lookup_table(names, slots=slots)
    choice = lambda s, k: (sharding._hash(s, "offset") % slots + k * (sharding._hash(s, "skip") % (slots - 1) + 1)) % slots
    assert all(sorted(choice(s, k) for k in range(slots)) == list(range(slots)) for s in names)
    plain, at = {}, dict.fromkeys(names, 0)
    while len(plain) < slots:
        for s in sorted(names):
            while len(plain) < slots and choice(s, at[s]) in plain:
                at[s] += 1
            if len(plain) < slots:
                plain[choice(s, at[s])] = s
    assert [names[i] for i in table] == [plain[k] for k in range(slots)]


def test_sharding(spark):
    names = [f"s{k}" for k in range(20)]
    full, less = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    sizes = collections.Counter(full.tolist())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 19)
    assert moved < 0.1 * len(full)
    double = collections.Counter(sharding.lookup_table(["a", "b"], [1, 2]).tolist())
    assert double[1] == pytest.approx(2 * double[0], rel=0.01)
    docs = spark.createDataFrame([(k, 1) for k in range(3000)] + [(None, 2), (5, 3)], "doc_id bigint, shard int")
    found = sharding.assign(docs, names).collect()
    by = {}
    for r in found:
        assert by.setdefault(r.doc_id, r.shard) == r.shard
        digest = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert r.slot == digest % sharding.SLOTS and r.shard == names[full[r.slot]]
    assert len(found) == 3002 and sharding.assign(docs.limit(0), names).count() == 0
    many = collections.Counter(sharding.lookup_table([f"x{k}" for k in range(5000)]).tolist())
    assert len(many) == 5000 and min(many.values()) >= 64
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)


def test_word_hashes_depend_on_words_alone():
    import pyarrow as pa

    hasher = textnum.WordHasher()
    texts = pa.array(["Alpha beta\tGAMMA", "x alpha", "BETA gamma", "", "é É"])
    (_, _, data, starts), = textnum.text_chunks(texts)
    words, at = hasher.words(data, starts)
    assert at.tolist() == [0, 3, 5, 7, 7, 9]
    assert words[0] == words[4] and words[1] == words[5] and words[2] == words[6] and words[7] != words[8]


# Callers' columns, long texts, rows without an id ------------------------------------------------------------------------

CLASHES = (
    "_n", "_kept", "_held", "near_n", "near_own_kept", "scan_text", "scan_base", "secret_spans", "mix_source", "mix_own_topic",
    "rule_words", "vote_words", "part", "key", "range", "a.dotted name", "Score", "predicted",
)


def clashing(spark, texts):
    rows = [(k, t, "en", "s", len(t or "")) + tuple(f"{c}{k}" for c in CLASHES) for k, t in enumerate(texts)]
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}")


def test_callers_columns_stay(spark):
    """Whatever a caller's columns are called, they come back as they were."""
    rng = random.Random(21)
    texts = [prose(rng, 30) for _ in range(12)] + ["", None, "password: Xk29fjQ0a81", "AKIA" + "B7" * 10]
    docs = clashing(spark, texts)
    model = language.train(docs)
    labels = docs.selectExpr("doc_id", "doc_id % 2 as label")
    quality = quality_knn.train(docs, labels)
    table = secrets.train(docs)
    scratch = lambda: Scratch(spark, "test")
    results = {
        "language": (language.predict(docs, model), {"score"}),
        "quality": (quality_knn.predict(docs, quality), {"score", "predicted"}),
        "quality, named": (quality_knn.predict(docs, quality, score="q", predicted="p"), set()),
        "secrets": (secrets.scan(docs, table), {"secret_spans"}),
        "redacted": (secrets.redact(docs, table), set()),
        "mixture": (mixing.mixture(docs, scratch()), set()),
        "sampled": (mixing.sampled(docs, scratch(), budget=5.0), set()),
        "rules": (quality_rules.judge(docs, scratch()), set()),
        "near": (near_dup.drop_near_duplicates(docs, scratch()), set()),
        "pieces": (pieces.encode(docs, pieces.load(PIECE_MODEL)), set()),
        "prints": (fingerprint.fingerprints(docs), set()),
        "shards": (sharding.assign(docs, ["x", "y"]), set()),
    }
    for name, (found, replaced) in results.items():
        held = [c for c in CLASHES if c.lower() not in replaced]
        rows = found.select("doc_id", *[f"`{c}`" for c in held]).collect()
        assert len(rows) == len(texts) or name in ("sampled", "near") and rows, name
        for r in rows:
            assert tuple(r)[1:] == tuple(f"{c}{r.doc_id}" for c in held), name


def test_very_long_text(spark):
    """A text of over a million characters goes through every operator whole."""
    rng = random.Random(22)
    long = prose(rng, 150_000) + " token=Ab3dE5fG7hJ9"
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, long, "en", "s"), (3, "short text of a few words", "de", "s")], "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r for r in near_dup.near_duplicates(docs.select("doc_id", "text"), Scratch(spark, "test")).collect()}
    assert found[2].component_id == 1 and found[1].n_shingles == len(shingles(long))
    (row,) = secrets.scan(docs, secrets.train(docs)).where("doc_id = 1").collect()
    at = long.index("token=")
    assert row.n_assign == 1 and f"assign:{at}:{len(long)}" in row.spans
    own = plain_statistics(long)
    (row,) = quality_rules.judge(docs, Scratch(spark, "test")).where("doc_id = 1").collect()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == own
    assert {r.lang_pred for r in language.predict(docs, language.train(docs)).where("doc_id < 3").collect()} == {"en"}
    encoder = pieces.Encoder(pieces.load(PIECE_MODEL))
    assert encoder.decode(encoder.encode(long)) == long


def test_fingerprints_of_rows_without_an_id(spark):
    texts = ["a b c d e f", "one two three four five six", None]
    docs = spark.createDataFrame([(5, texts[0]), (None, texts[1]), (None, texts[2]), (9, "x y z")], "doc_id bigint, text string")
    rows = fingerprint.edited_fingerprints(docs, 2).collect()
    assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 2
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[5].edited_sha256 == hashlib.sha256(b"a b c " + b"x y z").hexdigest()


def test_letters(spark):
    docs = spark.createDataFrame([(1, "some english words", "en"), (2, "²½①", "en"), (None, "und so weiter", "de")], "doc_id bigint, text string, lang string")
    model = language.train(docs)
    assert model.languages == ["en"]
    assert {r.text: r.lang_pred for r in language.predict(docs, model).collect()}["²½①"] == "und"


def test_samples_stay_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(k, f"other {k}") for k in range(2, 50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1)] * 3000 + [(k, k % 2) for k in range(2, 50)], "doc_id bigint, label int")
    assert len(quality_knn.train(docs, labels).labels) <= 50


def test_equal_neighbours_share_their_votes():
    import numpy as np

    n = quality_knn.NEIGHBOURS * 2
    unit = np.zeros((n, 2), np.float32)
    unit[:, 0] = 1
    model = quality_knn.QualityModel(np.ones(quality_knn.TERMS), np.zeros((quality_knn.TERMS, 2), np.float32), unit, np.arange(n) % 2, np.ones(n), 0.5)
    model.directions[:, 0] = 1
    counts = np.zeros((1, quality_knn.TERMS), np.float32)
    counts[0, 5] = 3
    assert model.score(counts)[0] == pytest.approx(0.5)


def test_bitmap_and_join_mark_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(k if k % 9 else None, f"t{k}") for k in range(200)], "doc_id bigint, text string")
    ids = docs.where("doc_id % 7 = 0").select("doc_id")
    wanted = {r.doc_id for r in ids.collect()}
    marked = {r.text for r in near_dup.marked(docs, ids, "held").where("held").collect()}
    assert {f"t{k}" for k in wanted} <= marked
    monkeypatch.setattr(near_dup, "FILTER_BITS", 8)
    assert {r.doc_id for r in near_dup.marked(docs, ids, "held").where("held").collect()} == wanted


def test_identifier_parts_count_what_identifiers_hold(spark):
    """The weighted parts have the pairs of the identifiers themselves."""
    text = "Alpha beta Gamma delta beta Alpha"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    words, plain = text.split(), collections.Counter()
    number = {r.w: str(r.n) for r in spark.createDataFrame([(w,) for w in set(words)], "w string").selectExpr("w", "pmod(hash(w), 100) as n").collect()}
    for a, b in zip(words, words[1:]):
        for t in (a.lower(), f"{a}_{b}".lower(), a.lower() + b.capitalize(), f"{a}-{b}", f"{a}/{b}", f"{a}_{b}".upper(), f"{b.lower()}_{number[a]}"):
            plain.update(zip(t, t[1:]))
    found = collections.Counter()
    for r in secrets.ordinary_parts(docs).collect():
        for pair in zip(r.token, r.token[1:]):
            found[pair] += r.weight
    assert found == plain


def test_sharding_sql():
    duckdb = pytest.importorskip("duckdb")
    from lanewise.llm.queries import sharding_sql

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT CASE WHEN i > 0 THEN i END AS doc_id, 's' AS source, 1::BIGINT AS n_chars FROM range(50) t(i)")
    names = ["b", "a", "c"]
    table = sharding.lookup_table(names)
    for doc_id, _, _, slot, shard in con.execute(sharding_sql(names)).fetchall():
        assert shard == names[table[slot]]
        assert slot == int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
