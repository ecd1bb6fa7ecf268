"""The registered queries on the smallest test tables: columns, types, held-out rows, SQL, whole results."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeprism.llm import language_id as L, packing as P, quality as Q, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
TABLES = "documents embeddings pages benchmark labels conversations".split()
CONTRACT = {
    "op2_quality_classifier": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op4_embedding_dedup": ["vec_id bigint", "n_links bigint", "component_id bigint", "kept boolean"],
    "op5_packing": ["doc_id bigint", "start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint", "sequence_id bigint", "offset bigint"],
    "op6_language_id": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
    "op7_license_scan": ["doc_id bigint", "n_words bigint", "n_base bigint", "first_word bigint", "last_word bigint", "base_labels string", "labels string", "score double"],
    "op9_url_filter": ["page_id bigint", "host string", "path string", "rule string", "verdict string"],
    "op10_warc": ["page_id bigint", "payload_bytes bigint", "payload_digest string", "record_type string", "refers_to bigint"],
}


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def texts(oracle):
    return {d: t for d, t in oracle.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in ("pipeline",)))
def test_contract(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    types = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]
    assert set(CONTRACT.get(name, [])) <= set(types)
    rows = df.collect()
    if name in queries.ORACLES:
        rel = oracle.execute(queries.ORACLES[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in rows) == sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in rel.fetchall())
    documents = texts(oracle)
    if name in ("op2_quality_classifier", "op6_language_id", "op7_license_scan"):
        assert Counter(r.doc_id for r in rows) == Counter(documents.keys())
    if name == "op2_quality_classifier":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    if name == "op6_language_id":
        langs = {x for (x,) in oracle.execute("SELECT DISTINCT lang FROM documents").fetchall()}
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.lang_pred in langs | {"und"} for r in rows)
        assert all((r.lang_pred == "und") == (not any(map(str.isalpha, documents[r.doc_id] or ""))) for r in rows)
    if name == "op5_packing":
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in places.values():
            ends = np.cumsum([n for _, n in sorted(p)])
            assert [at for at, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 1024
        pieces = {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        for p in pieces.values():
            at = 0
            for start, n, _ in sorted(p):
                assert start == at
                at += n
            assert at == p[0][2]


def test_pipeline_of_empty_tables(spark, tmp_path):
    """Without a document every stage, and the whole, is empty."""
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES["pipeline"](spark, str(tmp_path)).count() == 0


def test_texts_without_a_letter_have_no_language(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund ist hier", "de")] * 20)], "doc_id bigint, text string, lang string")
    model = L.fit_languages(docs, F.lit(True))
    odd = ["½ ²", "Ⅷ ⅔", "12 34", "", None, "_ - _", "①②"]
    assert [model.predict(t)[0] for t in odd] == ["und"] * len(odd)
    assert model.predict("x²y cat")[0] in ("en", "de") and L.words_of("a½b c²") == ["a", "b", "c"]


def test_language_scores_equal_brute_force(spark):
    """Each prediction against a plain sum over dictionaries of the same counts."""
    rows = [(0, "the cat sat on the mat the end", "en"), (1, "a cat and a hat", "en"), (2, "der hund und die katze", "de"), (3, "die katze sitzt", "de"), (4, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.fit_languages(docs, F.lit(True))
    words, grams = {"de": Counter(), "en": Counter()}, {n: {"de": Counter(), "en": Counter()} for n in L.ORDERS}
    for _, t, lang in rows[:4]:
        for w in t.split():
            words[lang][w] += 1
            for n in L.ORDERS:
                m = f"<{w}>"
                for i in range(len(m) - n + 1):
                    grams[n][lang][m[i : i + n]] += 1

    def smoothed(tables, lang, x):
        space = sum(tables[lang].values()) + 0.5 * len(set(tables["de"]) | set(tables["en"])) + 1
        return np.log((tables[lang][x] + 0.5) / space) if tables[lang][x] else np.log(0.5 / space)

    def word(lang, w):
        if any(words[k][w] for k in words):
            return smoothed(words, lang, w)
        m, parts = f"<{w}>", []
        for i in range(len(m)):
            for step, n in enumerate(L.ORDERS):
                x = m[i : i + n]
                if any(grams[n][k][x] for k in words):
                    parts.append(smoothed(grams[n], lang, x) + step * L.BACKOFF)
                    break
            else:
                parts.append(-25.0)
        return np.mean(parts)

    for t in ("the hund", "katzen sitzen", "hats and cats", "xyzzy", "mat der die the"):
        log = {k: sum(word(k, w) for w in t.split()) for k in words}
        best = max(sorted(log), key=log.get)
        lang, score = model.predict(t)
        assert lang == best and score == pytest.approx(1 / sum(np.exp(v - log[best]) for v in log.values()), abs=1e-9)


def test_quality_statistics_equal_plain_ones():
    """Counts and shares of a text, told one character at a time."""
    text = "Hello hello wörld!! | 12 abc\nsame line\nsame line\nextraordinarily-long"
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n, letters = len(raw), sum(c < 128 and chr(c).isalpha() or c >= 128 for c in raw)
    share = lambda k, of, usual, weight: np.log((min(1.0, (k + usual * weight) / (of + weight)) + 0.002) / (1.002 - min(1.0, (k + usual * weight) / (of + weight))))
    expected = {
        "log_chars": np.log1p(n + 200), "log_words": np.log1p(len(words) + 40), "log_word_length": np.log((n + 120) / (len(words) + 20)),
        "upper": share(sum(65 <= c <= 90 for c in raw), letters, 0.03, 60), "digit": share(sum(48 <= c <= 57 for c in raw), n, 0.004, 60), "space": share(raw.count(b" ") + raw.count(b"\n"), n, 0.16, 60),
        "symbol": share(sum(33 <= c <= 126 and not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()|" for c in raw), n, 0.001, 60), "sentence_mark": share(raw.count(b".") + raw.count(b","), n, 0.02, 60),
        "bang": share(2, n, 0.001, 60), "bar": share(1, n, 0.001, 60), "unique_words": share(len(set(words)), len(words), 0.7, 20), "repeated_neighbours": share(0, len(words), 0.005, 20),
        "unique_lines": share(3, 4, 0.97, 8), "log_line_length": np.log((n + 400) / (len(lines) + 4)), "long_words": share(1, len(words), 0.05, 20),
        "compression": share(min(n, len(zlib.compress(raw, 1))), n, 0.5, 200),
    }
    got = dict(zip(Q.FEATURES, Q.text_statistics(text)))
    assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k]) for k in expected)
    assert len(Q.text_statistics(None)) == len(Q.FEATURES) == len(Q.text_statistics("")) and np.isfinite(Q.text_statistics("x" * 100_000)).all()


def test_tokenizers_give_the_same_ids():
    """Long runs, all planes of Unicode, odd spaces: the quick path against the vocabulary's own."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    name = public_tokenizers.path("byte_bpe_50k.json")
    own, quick = Tokenizer.from_file(name), P.tokenizer(name)
    rng = np.random.default_rng(1)
    planes = "".join(chr(c) for c in range(1, 0x110000, 257) if not 0xD800 <= c < 0xE000)
    cases = [
        "a" * 12_000, " " * 12_000, "ab" * 8_000, "\n" * 5_000, "\t \n\r " * 2_000, "é" * 10_001, "1234567890" * 1_500, "don't we'll I'VE " * 500, planes, planes[::-1], "<|endoftext|> x <|endoftext|>",
        "  ​﻿" * 500, "🙂👩‍👩‍👧" * 1_000, "", " ", "".join(chr(c) for c in rng.integers(32, 0x3000, 20_000)),
    ]
    assert quick(cases) == [x.ids for x in own.encode_batch(cases, add_special_tokens=False)]


def test_nothing_travels_by_name():
    """What goes to the workers is whole: no function or class of the operators is named by its module, which may not be installed there."""
    from pyspark import cloudpickle

    from codeprism.llm import chat_format, common, decontaminate, embedding_dedup, near_copies, quality, warc

    for module in (chat_format, common, decontaminate, embedding_dedup, near_copies, quality, warc, L, P):
        own = [x for x in vars(module).values() if getattr(x, "__module__", None) == module.__name__]
        assert own and all(type(x).__name__ in ("function", "type") for x in own)
        assert all(len(cloudpickle.dumps(x)) > 200 for x in own)
