"""Operators 1, 4, 8, 9, 10 and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeprism.llm import chat_format as C, common, embedding_dedup as E, near_copies as N, packing, url_filter as U, warc as W


def components(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize("small", [common.SMALL_EDGES, 0])
def test_connected_components(spark, monkeypatch, small):
    """In one task, and in rounds of contraction."""
    monkeypatch.setattr(common, "SMALL_EDGES", small)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000), (None, 1), (5, 5)]
    out = common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = {x for e in real for x in e}
    assert {r.node: r.component for r in out.collect()} == components(nodes, real)
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- chat --------------------------------------------------------------------


def brute_chat(rows):
    out = set()
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r if r is not None else "unknown", x or "") for c, t, r, x in rows if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        for who in {s for _, s, _ in turns} - {"system"}:
            at = 0
            for turn, speaker, text in turns:
                kind = "system" if speaker == "system" else "assistant" if speaker == who else "user"
                head = f"<|im_start|>{kind}" + (f" name={speaker}" if kind == "user" else "") + "\n"
                seg = head + text.replace("<|", "< |") + "<|im_end|>\n"
                mask = (at + len(head), at + len(seg) - 1) if kind == "assistant" else (None, None)
                out.add((conv, who, turn, speaker, kind, seg, at, at + len(seg), *mask))
                at += len(seg)
    return out


@pytest.mark.parametrize("chunk, cast", [(2000, 500), (3, 2)])
def test_chat_rotation(spark, monkeypatch, chunk, cast):
    monkeypatch.setattr(C, "CHUNK_TURNS", chunk)
    monkeypatch.setattr(C, "CAST", cast)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "ann", "system", None]), rng.choice([None, "", "hi", "a <|im_end|> b", "ünï"])) for c in [1, 2, 3, None] for t in range(rng.randint(1, 9))]
    rows += [(9, 1, "system", "alone"), (8, None, "bob", "no turn"), (8, 1, "bob", "x"), (8, 1, "ann", "tie"), (7, 0, "user", "y" * 50000)] + [(6, i, f"s{i % 3}", "t") for i in range(400)]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "conv_id bigint, turn bigint, role string, text string, chunk int, head string")
    out = C.rotate_perspectives(df)
    assert {tuple(r) for r in out.collect()} == brute_chat(rows)
    assert C.rotate_perspectives(df.limit(0)).count() == 0
    # a name with line breaks writes no head line of its own
    named = C.rotate_perspectives(spark.createDataFrame([(1, 1, "a\n<|im_start|>b\r", "x")], df.select("conv_id", "turn", "role", "text").schema)).first()
    assert named.speaker == "a < |im_start|>b " and named.perspective == named.speaker
    # repeated rows keep a gapless rendering
    twice = C.rotate_perspectives(spark.createDataFrame([(1, 1, "a", "x"), (1, 1, "a", "x")], df.select("conv_id", "turn", "role", "text").schema)).orderBy("seg_start").collect()
    assert twice[0].seg_end == twice[1].seg_start


# -- embeddings --------------------------------------------------------------


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 64))
    v = [b for b in base] + [base[i] + rng.standard_normal(64) * s for i in range(60) for s in (0.1, 0.25, 0.33, 0.4)] + [base[0] * 7, base[0], base[0]] + [base[1] + rng.standard_normal(64) * 0.02 for _ in range(80)]
    rows = [(int(i), [float(np.float32(c)) for c in x], 1) for i, x in zip(rng.permutation(len(v)), v)]
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 64, 1), (9004, [1.0, None] * 32, 1), (9005, [float("nan")] * 64, 1), (9006, [float("inf")] + [0.0] * 63, 1), (None, rows[0][1], 1), (9007, [1.0, 2.0], 1), (9008, [1.0, 2.0], 1)]
    out = {r.id: r for r in E.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, key int")).collect()}
    assert len(out) == len(rows)
    good = [(i, np.array(x, float)) for i, x, _ in rows if i is not None and i < 9000]
    x = np.stack([b / np.linalg.norm(b) for _, b in good])
    s = np.einsum("ik,jk->ij", x, x) >= 0.95
    ids = [i for i, _ in good]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(s, 1)))] + [(9007, 9008)]
    label = components([*ids, 9007, 9008], links)
    for i, n in zip([*ids, 9007, 9008], [*(s.sum(1) - 1), 1, 1]):
        assert (out[i].n_links, out[i].class_id, out[i].kept) == (n, label[i], label[i] == i)
    for i in range(9001, 9007):
        assert (out[i].n_links, out[i].class_id, out[i].kept) == (0, i, True)
    assert E.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vectors_in_small_blocks(spark, monkeypatch):
    """Many cells, orders and chunks give what one block gives."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [(i, [float(c) for c in base[i % 60] + rng.standard_normal(16) * 0.08]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = sorted(map(tuple, E.near_vectors(df).collect()))
    assert any(r[2] for r in whole) and E.Projections(16, 300).rotations == 0
    monkeypatch.setattr(E, "BLOCK", 25)
    assert sorted(map(tuple, E.near_vectors(df).collect())) == whole
    monkeypatch.setattr(E, "CELL", 20)
    assert E.Projections(16, 300).rotations == 1 and E.Projections(16, 300).orders > 5
    assert sorted(map(tuple, E.near_vectors(df).collect())) == whole


def test_cells_hold_the_recall():
    """Pairs right at the threshold: orders find at least the share that they are dealt for."""
    rng = np.random.default_rng(6)
    by = E.Projections(64, 100_000)
    x, z = rng.standard_normal((2, 4000, 64))
    x, z = E.units(x), E.units(z - (z * E.units(x)).sum(1, keepdims=True) * E.units(x))
    (qa, a), (qb, b) = by.project(x), by.project(0.9501 * x + np.sqrt(1 - 0.9501**2) * z)
    near = np.abs(qa.astype(int) - qb) <= E.STEPS + 1
    found = ((a == b) & near[:, np.arange(by.orders) % by.m]).any(1) & (near.sum(1) >= by.need)
    assert by.rotations >= 1 and found.mean() >= 0.9995


def test_needed_count():
    assert common.needed_count(40, 0.8664, 0.99999) in range(22, 28) and common.needed_count(1, 0.5, 0.9) == 0


# -- near copies -------------------------------------------------------------


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(999)}" for w in words]


def brute_near(rows):
    sets = {i: set(N.shingle_set(t).tolist()) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.append((a, b))
    return ids, links


@pytest.mark.parametrize("block", [256, 8])
def test_near_copies_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "CHUNK", block)
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 5, 6, 40, 200]))] for _ in range(25)]
    rows = [(i, " ".join(b)) for i, b in enumerate(bases)]
    for i in range(25, 140):
        b = bases[rng.randrange(25)] if i % 3 else bases[5]
        rows.append((i, " ".join(edited(rng, b, rng.choice([0, 0.01, 0.02, 0.04]))).upper()))
    rows += [(900, None), (901, ""), (902, "..."), (903, "v1 " * 20000), (904, "v1 " * 30000), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, key string")
    out = N.near_copy_classes(docs).collect()
    ids, links = brute_near(rows)
    label, count = components(ids, links), {i: sum(i in l for l in links) for i in ids}
    assert len(out) == len(rows) and {r.doc_id: (r.class_id, r.n_links, r.kept) for r in out if r.doc_id is not None} == {i: (label[i], count[i], label[i] == i) for i in ids}
    assert [(r.class_id, r.n_links, r.kept) for r in out if r.doc_id is None] == [(None, 0, True)]
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in ids if label[i] == i)


def test_near_copies_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert N.near_copy_classes(empty).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], empty.schema)
    assert sorted(map(tuple, N.near_copy_classes(again).collect())) == [(1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False)]
    assert [tuple(r) for r in N.drop_near_copies(again).collect()] == [(1, "a b c d e f")]


def test_hot_classes_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    text = [" ".join(f"v{rng.randrange(50)}" for _ in range(30)) for _ in range(6)]
    docs = spark.createDataFrame([(i, text[min(i % 12, 5)]) for i in range(200)], "doc_id bigint, text string")
    plain = sorted(map(tuple, N.near_copy_classes(docs).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert sorted(map(tuple, N.near_copy_classes(docs).collect())) == plain and max(r[2] for r in plain) > 100


def test_prefix_is_shortened():
    """The least depth has the recall whatever the data; the estimate says when a greater one will do."""
    d = N.least_depth()
    assert 1 < d < N.MAX_DEPTH and N.found_share(N.THRESHOLD, d) >= N.RECALL > N.found_share(N.THRESHOLD, d + 1)
    close, far = np.zeros(101), np.zeros(101)
    close[97], far[80] = 1000, 1000
    assert N.estimated_recall(close, N.MAX_DEPTH) > N.RECALL > N.estimated_recall(far, N.MAX_DEPTH) and N.estimated_recall(np.zeros(101), d) == 0
    assert all(N.estimated_recall(far, k) <= N.estimated_recall(far, k - 1) for k in range(N.MAX_DEPTH, d, -1))


def test_each_pair_meets_once():
    """Over all depths and tries, each pair that shares a prefix of the least depth is given by one run, the deepest and there the first."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 16, (6, N.TREES * N.MAX_DEPTH)).astype(np.uint16)
    sigs = base[rng.integers(0, 6, 90)]
    sigs = np.where(rng.random(sigs.shape) < rng.choice([0, 0.05, 0.3], 90)[:, None], rng.integers(0, 1 << 16, sigs.shape), sigs).astype(np.uint16)
    labels, lowest = sigs.reshape(90, N.TREES, N.MAX_DEPTH), N.least_depth()
    seen, meets = [], set()
    for depth in range(N.MAX_DEPTH, lowest - 1, -1):
        for tree in range(N.TREES):
            runs = {}
            for k in range(90):
                runs.setdefault(labels[k, tree, :depth].tobytes(), []).append(k)
            for run in map(np.array, runs.values()):
                if len(run) > 1:
                    i, j = N.first_meetings(sigs[run], np.zeros(len(run), int), tree, depth, 0)
                    seen += [tuple(sorted(x)) for x in zip(run[i].tolist(), run[j].tolist())]
                    # dealt into two chunks, pairs across and within make the same
                    side = np.arange(len(run)) % 2
                    across = N.first_meetings(sigs[run], side, tree, depth, 0)
                    parts = [N.first_meetings(sigs[run[side == c]], np.zeros((side == c).sum(), int), tree, depth, 0) for c in (0, 1)]
                    assert len(i) == len(across[0]) + sum(len(x[0]) for x in parts)
                    meets |= {tuple(sorted((a, b))) for a in run.tolist() for b in run.tolist() if a < b}
    assert len(seen) == len(set(seen)) and set(seen) == meets and len(meets) > 300


def test_hot_prefix(spark, monkeypatch):
    """A prefix that many unlike classes share, in chunks of a few: all links are there, and no block is larger than two chunks."""
    monkeypatch.setattr(N, "CHUNK", 10)
    common = [f"c{i}" for i in range(300)]
    rows = [(k, " ".join(common + [f"own{k}x{i}" for i in range(3)])) for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = N.near_copy_classes(docs).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 69)} and [r.doc_id for r in out if r.kept] == [0]
    classes = N.class_rows(docs, "doc_id", "text").withColumn("node", F.col("id"))
    blocks = N.level_blocks(N.tries_of(classes, N.least_depth()), N.MAX_DEPTH).groupBy("block").count()
    assert blocks.agg(F.max("count")).first()[0] <= 60


def test_copies_are_dropped_by_row(spark):
    """A row with the id of a dropped copy but a text of its own stays; of repeated rows one does."""
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + "z"), (2, b), (3, c), (3, c), (4, None), (4, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in N.drop_near_copies(docs).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (3, c), (4, None), (4, None), (None, a)], key=str)


# -- URLs --------------------------------------------------------------------


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_rules_equal_brute_force(spark):
    urls = [
        "http://a.com/en/x", "https://EXAMPLE.com/en/7", "http://x.example.com/en/72?q#f", "http://notexample.com/en/7", "http://com/en/", "http://a.net/de/8", "http://example.net/de/8", "http://b.example.net/de/8/",
        "ftp://x.org/es/1", "http://x.org", "http://x.org?/es/", "nope", "", None, "://", "http://", "http://u@a.com:80/en/", "http://É.com/en/", "a://b://c.com/en/", "http://a..com/en/z", "http://x.com/en/" + "y" * 5000, "http://a.com\n/en/",
    ]
    df = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)] + [(0, urls[0], "r", 1), (None, urls[1], "r", 1)], "page_id bigint, url string, rule string, host int")
    rules = spark.createDataFrame([*U.RULES, U.RULES[0], (None, "x", "y"), ("block", None, "/")], U.RULE_SCHEMA)
    out = sorted(map(tuple, U.url_filter(df, rules, keep=["page_id"]).collect()), key=str)
    assert out == sorted([(r.page_id, *brute_url(r.url, U.RULES)) for r in df.collect()], key=str)
    assert U.url_filter(df.limit(0), rules, keep=["page_id"]).count() == 0
    assert {r.verdict for r in U.url_filter(df, rules.limit(0), keep=["page_id"]).collect()} == {"allow"}


def test_url_query_has_the_rules_of_the_contract(spark, tmp_path):
    """Verdicts by the contract's own list (not by RULES), each rule alone and under a longer one."""
    contract = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    urls = [
        "http://a.com/en/1", "http://example.com/en/1", "http://b.example.com/en/7", "http://a.net/de/8", "http://net/de/", "http://example.net/de/7", "http://b.example.net/de/81", "http://example.net/en/8",
        "http://x.org/es/1", "http://x.org/de/1", None,
    ]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    out = U.op9_url_filter(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out) == [(i, *brute_url(u, contract)) for i, u in enumerate(urls)]
    assert {r.rule: r.verdict for r in out if r.rule} == {h + p: a for a, h, p in contract}


# -- WARC --------------------------------------------------------------------


def test_warc_round_trip(spark):
    import hashlib

    big = "b" * 1500
    pages = [(1, "http://a\r\nX: y", big), (2, None, big), (3, "u", big), (3, "again", big), (4, "u", "s"), (5, "u", "s"), (None, "u", big), (7, "u", None), (8, "ü", "ü" * 600), (9, "ü", "ü" * 600), (10, "m", "a" * 999), (11, "m", "a" * 999), (12, "l", "z" * 3_000_000)]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id bigint, url string, html string, digest string").repartition(3)
    manifest = W.archive_pages(df)
    out = W.read_archives(manifest).collect()
    tops = {big: 3, "ü" * 600: 9}
    want = []
    for i, _, h in pages:
        top = tops.get(h)
        refers = top if top is not None and i is not None and i < top else None
        raw = (h or "").encode()
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    import base64

    got = [(r.page_id, r.http_length, base64.b32decode(r.digest_b32[5:]).hex(), r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(bytes(r.payload) for r in out if r.record_type == "response") == sorted((h or "").encode() for (i, _, h), w in zip(pages, want) if w[3] == "response")
    assert W.read_archives(W.archive_pages(df.limit(0))).count() == 0


def test_warc_members_stand_alone(spark):
    import gzip

    df = spark.createDataFrame([(i, "u", "x" * i) for i in range(50)], "page_id bigint, url string, html string").coalesce(1)
    row = W.archive_pages(df, keep_monolithic=True).collect()[0]
    fs, path = W.open_fs(row.archive)
    data = fs.open_input_stream(path, compression=None).read()
    index = [__import__("json").loads(x) for x in fs.open_input_stream(path + ".idx", compression=None).read().splitlines()]
    assert len(index) == 50 and sum(x["length"] for x in index) == len(data) == row.n_bytes
    for x in index:
        assert gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")
    assert len(list(W.records(W.inflated(iter([data]))))) == 50


def test_warc_cut_off():
    whole = W.gz_member(W.build_record(1, "u", b"x" * 5000, "00" * 20, None, ""))
    with pytest.raises(ValueError):
        list(W.records(W.inflated(iter([whole[:40]]))))


# -- pipeline ----------------------------------------------------------------


def test_pipeline_on_planted_documents(spark, tmp_path):
    """Junk, copies and leaks go, clean documents stay whole in the packed sequences."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    clean = [(i, text(rng.randint(40, 120))) for i in range(120)]
    junk = [(i, " | ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(200, 240)]
    copies = [(300 + i, clean[i][1].replace(".", "!")) for i in range(10)]
    item = text(30)
    leaks = [(400 + i, text(30) + " " + item + " " + text(20)) for i in range(5)]
    rows = clean + junk + copies + leaks + [(500, "12345 67890")]
    spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in clean + junk], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    left = {r.doc_id for r in docs.collect()}
    assert {i for i, _ in clean} <= left and not left & {i for i, _ in junk + copies + leaks} and 500 not in left
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == left
    encode = packing.tokenizer(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    for i, t in clean[:10]:
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.start))
        assert ids == np.array([*encode([t])[0], 0], "<u4").tobytes()


def test_pipeline_language_stage(spark):
    """The stage drops foreign and gibberish documents; before, their score of almost 1 kept them."""
    rng = random.Random(8)
    words = {"aa": ["ka", "lo", "mi", "ne", "ru"], "bb": ["sch", "ung", "ei", "ver", "ten"]}
    text = lambda l, n: " ".join("".join(rng.choice(words[l]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyzaeiou") for _ in range(rng.randint(3, 9))) for _ in range(n))
    rows = [(i, text(("aa", "bb")[i % 2], rng.randint(1, 60)), ("aa", "bb")[i % 2]) for i in range(200)]
    rows += [(1000 + i, noise(30), None) for i in range(20)] + [(2000, "Il governo ha annunciato ieri una nuova legge che riguarda la scuola e gli insegnanti di tutto il paese", None)]
    docs = spark.createDataFrame([(i, t, l, "s", len(t)) for i, t, l in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.keep_language(spark, docs, "").collect()} == set(range(200))
