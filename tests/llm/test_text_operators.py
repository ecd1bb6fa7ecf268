"""Operators 2, 3, 5, 6, 7 against brute force, held-out accuracy and exact round trips."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codeprism.llm import decontaminate as D, language_id as L, license_scan as LS, packing as P, quality as Q

ODD = [(1, None), (2, ""), (3, "   \n"), (4, "x"), (5, "word " * 30000), (5, "word " * 30000), (None, "some text here"), (7, "\x00<|endoftext|> ünï 漢字 🙂")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "p", 1.0, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, keep string, score double, uid int")


def lorem(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


# -- quality -----------------------------------------------------------------


def test_quality_separates_and_covers_all(spark, odd):
    rng = random.Random(1)
    words = ["the", "of", "report", "people", "city", "walked", "into", "morning", "light", "slowly"]
    good = [(i, lorem(rng, rng.randint(20, 200), words).capitalize() + ".", 1) for i in range(300)]
    bad = [(i, " | ".join(rng.choice(words) for _ in range(rng.randint(20, 200))), 0) for i in range(300, 360)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(1, 1), (None, 0), (9999, 1), (3, None)], "doc_id bigint, quality int")
    model = Q.fit_quality(docs, labels, ~Q.held_out(F.col("doc_id")))
    rows = docs.select("doc_id", Q.held_out(F.col("doc_id")).alias("h"), Q.quality_score(F.col("text"), model).alias("s")).collect()
    truth = {i: q for i, _, q in good + bad}
    held = [r for r in rows if r.h]
    assert len(held) > 50 and np.mean([(r.s >= 0.5) == truth[r.doc_id] for r in held]) > 0.97
    out = odd.select(Q.quality_score(F.col("text"), model).alias("s")).collect()
    assert len(out) == len(ODD) and all(0 <= r.s <= 1 for r in out)
    assert odd.limit(0).select(Q.quality_score(F.col("text"), model)).count() == 0


def test_quality_score_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(2, 2, (50, 3))])
    y = np.array([1] * 200 + [0] * 50)
    m = Q.Discriminant.fit(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    logs = []
    for k in (0, 1):
        g = z[y == k]
        own = [np.cov(z[y == j].T, bias=True) for j in (0, 1)]
        pooled = (own[0] * 50 + own[1] * 200) / 250
        s = (1 - Q.TO_POOLED) * own[k] + Q.TO_POOLED * pooled
        s = (1 - Q.TO_DIAGONAL) * s + Q.TO_DIAGONAL * np.diag(np.diag(s)) + Q.RIDGE * np.eye(3)
        d = z - g.mean(0)
        logs.append(np.log(len(g) / 250) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = Q.fit_quality(odd, none, F.lit(True))
    assert all(0 <= r.s <= 1 for r in odd.select(Q.quality_score(F.col("text"), model).alias("s")).collect())


# -- language ----------------------------------------------------------------


def test_language_held_out(spark, odd):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ção", "lho", "ns"]}
    make = lambda l: " ".join("".join(rng.choice(syllables[l]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 30)))
    docs = spark.createDataFrame([(i, make(l), l) for i, l in enumerate(rng.choice(list(syllables)) for _ in range(400))] + [(1000, "kalo", None)], "doc_id bigint, text string, lang string")
    model = L.fit_languages(docs, ~L.held_out(F.col("doc_id")))
    rows = docs.select("lang", L.held_out(F.col("doc_id")).alias("h"), L.language_of(F.col("text"), model).alias("p")).where("h and lang is not null").collect()
    assert len(rows) > 60 and np.mean([r.lang == r.p.lang_pred for r in rows]) > 0.98
    unseen = model.predict("schungeischung eiungsch")
    assert unseen[0] == "bb" and 0 <= unseen[1] <= 1
    out = {r.doc_id: r.p for r in odd.select("doc_id", L.language_of(F.col("text"), model).alias("p")).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == [L.UND] * 3 and out[1].score == 0 and out[4].lang_pred in syllables
    assert model.predict("123 ... 456") == (L.UND, 0.0)


def test_language_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert L.fit_languages(docs, F.lit(True)).predict("abc") == (L.UND, 0.0)


def test_language_home(spark):
    """Foreign and made-up texts are in no learned language, however sure the best one is; held-out texts are."""
    english = "the government of this country has said that new schools will open in spring and teachers are needed for all of them people there".split()
    spanish = "el gobierno de este país ha dicho que las nuevas escuelas abren en primavera y se necesitan maestros para todas ellas la gente allí".split()
    rng = random.Random(4)
    make = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
    docs = spark.createDataFrame([(i, make((english, spanish)[i % 2]), ("en", "es")[i % 2]) for i in range(300)], "doc_id bigint, text string, lang string")
    learn = ~L.held_out(F.col("doc_id"))
    model = L.fit_home(L.fit_languages(docs, learn), docs, learn)
    assert docs.where(L.at_home(F.col("text"), model)).count() == 300
    italian = "Il governo ha annunciato ieri una legge che riguarda la scuola e gli insegnanti; molti cittadini hanno chiesto spiegazioni"
    turkish = "Hükümet dün ülkedeki okullar ve öğretmenler hakkında yeni bir yasa açıkladı, birçok vatandaş açıklama istedi"
    gibberish = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(30)) for _ in range(50)]
    odd = spark.createDataFrame([(t,) for t in [italian, turkish, *gibberish, "123", "", None]], "text string")
    assert max(model.predict(t)[1] for t in gibberish) > 0.99 and model.predict(italian)[1] > 0.9
    assert odd.where(L.at_home(F.col("text"), model)).count() == 0
    none = docs.limit(0)
    assert docs.where(L.at_home(F.col("text"), L.fit_home(L.fit_languages(none, learn), none, learn))).count() == 0


# -- decontamination ---------------------------------------------------------


def brute_leaks(docs, items, rate=D.ERROR_RATE):
    out = set()
    for doc, t in docs:
        w = D.words_of(t).tolist()
        for item, p in items:
            q = D.words_of(p).tolist()
            if not q:
                continue
            row = [0] * (len(w) + 1)  # edit distance to any stretch, by the plain table
            for i, a in enumerate(q, 1):
                new = [i]
                for j, b in enumerate(w, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
                row = new
            if min(row) <= int(rate * len(q)):
                out.add((doc, item, min(row)))
    return out


@pytest.mark.parametrize("block, part", [(100_000, 1 << 16), (4, 8)])
def test_leaks_equal_brute_force(spark, monkeypatch, block, part):
    """Also with several index blocks and hits taken in small slices."""
    monkeypatch.setattr(D, "BLOCK_ITEMS", block)
    monkeypatch.setattr(D, "SLICE", part)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(i, lorem(rng, rng.choice([1, 3, 8, 15, 30, 70]), words)) for i in range(25)] + [(99, ""), (98, None), (97, "...")]
    docs = []
    for i in range(120):
        body = lorem(rng, rng.randint(0, 60), words).split()
        if i % 2:
            passage = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, 1 + len(passage) // 4)):
                at, kind = rng.randrange(len(passage) or 1), rng.randrange(3)
                passage[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice(words)]
            at = rng.randint(0, len(body))
            body[at:at] = passage
        docs.append((i, " ".join(body).upper() if i % 5 == 0 else ", ".join(body)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    found = D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    rows = found.collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in rows} == brute_leaks(docs, items)
    texts, patterns = dict(docs), dict(items)
    for r in rows:  # the span has the distance that is claimed
        span = D.WORD.findall(texts[r.doc_id].lower())[r.first : r.last + 1]
        assert brute_leaks([(0, " ".join(span))], [(0, patterns[r.item_id])]) == {(0, 0, r.edits)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=30))
def test_myers(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    assert D.myers(pattern, text)[0] == min(row)


def test_common_words_against_a_long_text():
    """An item of very common words, met at every place of a long text, in bounded slices."""
    index = D.PieceIndex.build([(1, "a " * 12), (2, "a b " * 6)])
    seq = D.words_of("a " * 200_000)
    assert max(len(starts) for starts, _ in index.hits(seq)) <= 2 * D.SLICE
    assert index.search(seq) == [(1, 0, 0, 11)]


def test_leaks_blocks_and_removal(spark, odd):
    items = spark.createDataFrame([(1, "some text here"), (2, "some text here")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(odd, items).collect()) == [(None, 1), (None, 2)]
    left = D.remove_leaks(odd, items)
    assert left.columns == odd.columns and left.count() == len(ODD) - 1
    assert D.find_leaks(odd, items.limit(0)).count() == 0 and len(D.build_index(items, block=1)) == 2 and D.build_index(items.limit(0)) == []


# -- packing -----------------------------------------------------------------


def packed(spark, rows, parts=3, window=64, most_open=4):
    import public_tokenizers

    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    return P.pack(df, public_tokenizers.path("byte_bpe_50k.json"), window=window, most_open=most_open).collect()


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, lorem(rng, rng.choice([0, 1, 3, 10, 40, 300]), ["alpha", "beta", "gamma", "δ", "1234"])) for i in range(150)] + [(1000, None), (1001, "<|endoftext|> a")]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packed(spark, rows)
    pieces, sequences = {}, {}
    for r in out:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == {i for i, _ in rows}
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [P.END]
        got = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in got) == np.array(ids, "<u4").tobytes() and {r.doc_tokens for r in got} == {len(ids)}
        assert [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1]]
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]] and (n := sum(r.length for r in s)) <= 64
        assert n == 64 or n & (n - 1) == 0  # no padding at all


def test_packing_odd_rows(spark):
    out = packed(spark, ODD, parts=2)
    assert sorted((r.doc_id for r in out if r.start == 0), key=str) == sorted((i for i, _ in ODD), key=str)
    assert packed(spark, [(1, "a")], parts=1)[0].length == 2
    import public_tokenizers

    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert P.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_best_fit():
    p = P.Packer(10, 3, 0)
    for doc, n in ((1, 6), (2, 8), (3, 4)):
        assert not list(p.put(doc, 0, np.zeros(n, np.uint32), n)) or doc == 3
    assert sorted(p.room) == [(2, 1)]  # the third fitted the first window exactly


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_fast_tokenizer_gives_the_same_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = text.encode("utf-8", "ignore").decode()
    assert list(P.tokenizer(path)([text])[0]) == OWN.setdefault("t", Tokenizer.from_file(path)).encode(text, add_special_tokens=False).ids


OWN: dict = {}

# -- licenses ----------------------------------------------------------------


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in LS.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_equal_brute_force(spark):
    rng = random.Random(5)
    words = "under the mit license apache version 2 cc by nc licensed x É Kelvin".split()
    texts = [lorem(rng, rng.randint(0, 60), words).replace(" ", rng.choice([" ", ", ", "-"])) for _ in range(150)]
    texts += [None, "", "...", "x", "cc by nc " * 3000, "Under the MIT License. UNDER THE mit license", "under the \u212ait license", "cc by\nNC"]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(1, texts[1], "again"), (None, "cc-by-nc", "none")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, uid string")
    out = LS.scan_licenses(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str) == sorted(((i, *brute_licenses(t)) for i, t, _ in rows), key=str)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score == 1 or not r.base_labels)
    assert LS.scan_licenses(df.limit(0)).count() == 0


def test_near_wordings(spark):
    grant = dict((l, t) for t, l in LS.TEMPLATES[:1])["mit"].split()
    broken = grant[:6] + ["indeed"] + grant[6:12] + grant[13:]
    rows = [(1, " ".join(["before"] * 9 + broken)), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "the license of the city under review")]
    spans = LS.license_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {(r.doc_id, r.label) for r in spans}
    assert got == {(1, "mit"), (2, "gpl-3")}
    assert next(r for r in spans if r.doc_id == 1)["first"] == 9 and all(0.7 <= r.cover <= 1 for r in spans)
