"""The corpus operators on small fixtures, against brute force and on odd rows."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.llm import embeddings, html, media, mixing, packing, quality, simhash, substrings, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def corpus():
    r = random.Random(7)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 90))) for _ in range(40)]
    texts += [texts[3], texts[3], "start " + texts[5] + " end", "", " \t\n", None, "word", "A b", "x" * 50_000, "ü " * 30]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def test_fingerprints_and_components(spark, docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: int.from_bytes(simhash.fingerprint(t), "big") for i, t, *_ in corpus()}
    root = {i: i for i in fp}
    for _ in fp:
        for a, b in itertools.combinations(sorted(fp), 2):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                root[b] = root[a] = min(root[a], root[b])
    assert {i: r.component_id for i, r in got.items()} == root
    assert fp[43] == fp[44] == fp[45] == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_substrings_against_brute_force(spark, docs):
    got = {r.doc_id: r for r in substrings.repeated_words(docs, per_block=4000).collect()}
    seen = {}
    for i, t, *_ in corpus():
        w = (t or "").split()
        gone = set()
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert substrings.repeated_words(docs.limit(0)).count() == 0


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + 0.02 * r.standard_normal(16)).astype("float32").tolist(), i % 2) for i in range(60)]
    rows += [(60, None, 0), (61, [0.0] * 16, 0), (62, [float("nan")] + [1.0] * 15, 0), (63, rows[0][1], None), (64, rows[0][1], 0), (65, [1.0, 2.0], 0)]
    got = {x.vec_id: x for x in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = {i: np.array(v, dtype=float) / np.linalg.norm(v) for i, v, lab in rows if i not in (60, 61, 62, 63)}
    label = {i: lab for i, _, lab in rows}
    links = {i: {j for j in unit if j != i and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98} for i in unit}
    for i, _, _ in rows:
        near = links.get(i, set())
        group, todo = {i}, [i]
        while todo:
            todo += (new := links.get(todo.pop(), set()) - group)
            group |= new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near), min(group), min(group) == i)


def test_mixing_reaches_targets_and_copies(spark, docs):
    rows = mixing.mix(docs).collect()
    total = sum(r.size for r in rows)
    assert sum(t for t in {r.source: r.target for r in rows}.values()) == pytest.approx(total)
    assert all(0 <= r.copies <= 3 and (r.size or not r.copies) for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_urls(spark):
    cases = {
        "https://WWW.Example.com/en/a?x#y": ("www.example.com", "/en/a", "www.example.com/en/", "allow"), "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com": ("example.com", "", None, "allow"), "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://planet/es/": ("planet", "/es/", None, "allow"), "no": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(u, "clash") for u in cases], "url string, rule string")
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()} == cases
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_media_round_trip(spark, docs, tmp_path):
    for r, (_, t, *_) in zip(media.store(docs, f"file://{tmp_path}").orderBy("doc_id").collect(), corpus()):
        payload = media.payload_of(t)
        stored = media.read_member(r.shard, r.offset, r.media_bytes)
        assert media.samples_of(stored) == payload and (r.width * r.height, 192) == (len(payload), r.width) and len(payload) % 192 == 0 and payload.rstrip(b" ") == (t or "").encode().rstrip(b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_sha256) == (zlib.crc32(payload[-16:]), hashlib.sha256(stored).hexdigest())


def test_packing_holds_every_token_once(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, packing.default_tokenizer()).collect()
    for i, text, *_ in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cut_points(len(ids), 1024)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in own)
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0), packing.default_tokenizer()).count() == 0
    assert packing.tokenizer(packing.default_tokenizer())("a <|endoftext|> b") == t.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_html_blocks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p>One  two<br>three<p>Short.</p><div class=comments>me too</div></article><footer>&copy;</footer>"
    assert html.main_text(page) == "Head & more\nOne two three\nShort."
    assert html.main_text(None) == html.main_text("") == html.main_text("<div") == ""
    long = "<div>" + "the cat and the dog of the house are in it " * 8 + "</div>"
    assert html.main_text(f"<body><div>Go!</div>{long}<div>Yes.</div>{long}</body>").count("\n") == 2 + 1


def test_quality_rejects_junk_and_odd_rows_pass_through(spark):
    r = random.Random(1)
    good = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(200)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good)] + [(900, "AB!! " * 60, "en", "s", 0), (901, "alpha " * 60, "en", "s", 0), (902, None, None, "s", 0), (903, "", "en", "s", 0)]
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(got) == len(rows) and not got[900] and not got[901] and all(got[i] for i in range(200))
    assert all(x.kept for x in quality.classify(spark.createDataFrame(rows, DOCS), labels.limit(0)).collect())


def test_toxicity_on_held_out_texts(spark):
    r = random.Random(2)
    texts = [" ".join([*(r.choice(WORDS) for _ in range(40)), *(["nastyword"] if i % 4 == 0 else [])]) for i in range(600)] + [None, ""]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got.values())
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400, 600)) and got[600].predicted == got[601].predicted == 0


def test_toxicity_value_against_brute_force(spark):
    """The value of every text from exact continuation counts over blocks, and the rows that may be learned from."""
    r = random.Random(4)
    stems = [f"{a}{b}" for a in ("nastyw", "goodyw") for b in ("y", "iness", "ily", "ier", "iest", "ord", "ied", "ies", "ism", "ish", "ist", "ite")]
    rows = [(i, " ".join(r.choice((stems[:12] if i % 3 == 0 and r.random() < 0.3 else WORDS + stems[12:])) for _ in range(30)), "en", "s", 0) for i in range(240)]
    rows += [(900, None, None, None, None), (None, rows[0][1], "en", "s", 0), (901, "", "en", "s", 0), (902, "nastywx " * 20_000, "en", "s", 0)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {(x.doc_id, k): x.value for k, x in enumerate(toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels, per_block=5000).orderBy("doc_id").collect())}
    seen = [{}, {}]
    for i, text, *_ in rows[:200]:
        if zlib.crc32(f"calibrate {i}".encode()) % toxicity.CALIBRATE:
            line = [None, *text.split(), None]
            for before, w, after in zip(line, line[1:], line[2:]):
                seen[i % 3 == 0].setdefault(w, set()).add((before, after))
    words = sorted({*seen[0], *seen[1]})
    count = [np.array([len(s.get(w, ())) for w in words]) for s in seen]
    total = [int(c.sum()) for c in count]

    def soften(n, e):
        d = toxicity.SIGMAS * (e + 1) ** 0.5 + toxicity.SHARE * e
        return max(n - d if n - d > e else n + d if n + d < e else e, toxicity.FLOOR * e)

    def ratio(w):
        stem = w[: toxicity.STEM]
        n = [sum(len(v) for k, v in s.items() if k.startswith(stem)) for s in seen]
        if not sum(n):
            return 0.0
        e = [sum(n) * t / sum(total) for t in total]
        own = [soften(*x) for x in zip(n, e)]
        out = np.log(own[1] / e[1]) - np.log(own[0] / e[0])
        each = [len(s.get(w, ())) for s in seen]
        if sum(each):
            x = [o * sum(each) / sum(own) for o in own]
            out += np.log(soften(each[1], x[1]) / x[1]) - np.log(soften(each[0], x[0]) / x[0])
        return out

    want = {}
    for i, t, *_ in rows:
        w = (t or "").split()
        want[i] = sum(map(ratio, w)) / max(len(w), 1)
    assert len(got) == len(rows) and any(abs(v) > 0.05 for v in got.values())
    for (i, _), v in got.items():
        assert v == pytest.approx(want[i], abs=1e-6)


def test_toxicity_without_rows_or_labels(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), labels).count() == 0
    assert [x.predicted for x in toxicity.toxicity(spark.createDataFrame([(1, "a b", None, None, None)] * 2, DOCS), labels.limit(0)).collect()] == [0, 0]


def test_html_broken_pages_take_linear_time_and_articles_keep_their_blocks():
    for bad in ("<p " * 350_000, '<a "' * 250_000, '<a b="' * 180_000, "<div>" * 100_000 + "</p>" * 100_000, "<!--" * 250_000, "<script>" * 120_000):
        began = time.time()
        html.main_text(bad)
        assert time.time() - began < 10
    page = '<article><div class="notice-board"><p>Hello there</p></div><p><a href=x>all link</a></p><div class="cookie-banner">no</div></article>'
    assert html.main_text(page) == "Hello there\nall link"


def test_mixing_with_repeated_ids_comes_near_targets(spark):
    rows = [(i, "w " * 50, "en", "a", 0) for i in range(20)] + [(999, "w " * 7, "en", "a", 0)] * 200 + [(i, "w " * (i % 30), "en", None, 0) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for s in ("a", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 7


def test_plan_needs_no_more_sequences_than_best_fit():
    for seed, n in ((1, 40), (2, 400), (3, 5000)):
        r = np.random.default_rng(seed)
        count = np.bincount(np.minimum(r.lognormal(5, 1, n).astype(int) + 1, 1024), minlength=1025)
        found = packing.plan(count.copy(), 1024)
        assert (sum(c * k for c, k in found) == count).all() and all((c * np.arange(1025)).sum() <= 1024 for c, _ in found)
        rooms = []
        for ell in np.repeat(np.arange(1025), count)[::-1].tolist():
            k = min((x for x in range(len(rooms)) if rooms[x] >= ell), key=lambda x: rooms[x], default=None)
            if k is None:
                rooms.append(1024)
                k = len(rooms) - 1
            rooms[k] -= ell
        bound = packing.prices(np.where(np.arange(1025) == 1024, 0, count), 1024)[1] + count[1024]
        assert bound - 1e-6 <= sum(k for _, k in found) <= len(rooms)
    exact = np.bincount([6, 6, 4, 4, 5, 5, 3, 7, 2, 8], minlength=11)
    assert sum(k for _, k in packing.plan(exact, 10)) == 5


def test_media_shards_stay_the_same_when_evaluated_again(spark, docs, tmp_path):
    stored = media.store(docs.coalesce(2), f"file://{tmp_path}")
    first = sorted(stored.select("doc_id", "shard", "offset").collect())
    assert sorted(stored.select("doc_id", "shard", "offset").collect()) == first
    assert len(list(tmp_path.glob("*.tar"))) == len({r.shard for r in first}) and not list(tmp_path.glob(".*[!c]"))
    by_text = {}
    for r, (_, t, *_) in zip(stored.orderBy("doc_id").collect(), corpus()):
        assert by_text.setdefault(t or "", r.feature) == r.feature and r.feature.startswith("mean=")
    assert media.store(docs.limit(0), f"file://{tmp_path}/none").count() == 0


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([("http://x.net/es/1", 1, "a", "b")], "url string, best int, host string, suffix string")
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    (r,) = urls.judge(pages, rules).collect()
    assert (r.best, r.suffix, r.host, r.rule, r.verdict) == (1, "b", "x.net", "net/es/", "block")


def test_pipeline_stages_keep_null_and_repeated_ids(spark):
    import corpus_pipeline

    r = random.Random(5)
    long = [" ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(60)) for _ in range(6)]
    rows = [(None, long[0], "en", "s", 1), (None, long[1], None, None, 1), (5, long[2], "en", "s", 1), (5, long[3], "en", "s", 1), (5, long[3], "en", "s", 1), (6, long[4], "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    key = lambda d: sorted(map(str, (tuple(x) for x in d.select("doc_id", "text").collect())))
    once = sorted({str((i, t)) for i, t, *_ in rows})
    assert key(corpus_pipeline.simhash(spark, docs, "")) == once
    assert key(corpus_pipeline.substrings(spark, docs.dropDuplicates(), "")) == once
    taken = corpus_pipeline.mixture(spark, docs, "")
    assert taken.count() == sum(x.copies for x in mixing.mix(docs).collect()) > 0


def test_pipeline_keeps_the_columns_until_the_last_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() > 0
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)


def test_pipeline_removes_near_copies_like_brute_force(spark):
    import corpus_pipeline

    r = random.Random(11)
    names = [f"w{i}" for i in range(500)]
    bases = [[r.choice(names) for _ in range(r.randint(60, 400))] for _ in range(12)]
    common = [r.choice(names) for _ in range(100)]
    texts = [" ".join(b) for b in bases] + [" ".join(common + [r.choice(names) for _ in range(r.randint(20, 80))]) for _ in range(30)]
    for b in bases:
        for _ in range(8):
            copy = list(b)
            for _ in range(r.randint(1, max(1, len(b) // 40))):
                copy[r.randrange(len(copy))] = r.choice(names)
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), "one two", "one  two", "", " ", None, "a b c d e f"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    got = corpus_pipeline.simhash(spark, spark.createDataFrame(rows, DOCS).repartition(5), "").collect()
    assert len(set(root)) < len(texts) - 50
    assert sorted(x.doc_id for x in got) == sorted(set(root))
    assert corpus_pipeline.simhash(spark, spark.createDataFrame(rows[:0], DOCS), "").count() == 0


def test_pipeline_finds_near_copies_by_simhash_alone(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(12)
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    texts = [" ".join(base), " ".join(base[:190]), " ".join(base).upper(), "one two three four five six seven eight", "one two three four five six seven eight nine", " ".join(f"v{r.randrange(500)}" for _ in range(200))]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert sorted(x.doc_id for x in corpus_pipeline.simhash(spark, rows, "").collect()) == [0, 3, 5]
    # Without the classes that fingerprints make, only equal sets of shingles are found.
    monkeypatch.setattr(simhash, "simhash_classes", lambda nodes, n: nodes.select("node", F.col("node").alias("root")).limit(0))
    assert sorted(x.doc_id for x in corpus_pipeline.simhash(spark, rows, "").collect()) == [0, 1, 3, 4, 5]


def test_wide_fingerprints_of_similar_sets_differ_in_few_bits():
    r = np.random.default_rng(3)
    words = simhash.HEAD + 13
    for common, a, b in ((4, 1, 0), (8, 1, 1), (160, 20, 20), (160, 40, 0), (5000, 600, 600)):  # similarities of 0.8 or little more
        for _ in range(10):
            h = r.integers(0, 1 << 64, common + a + b, dtype=np.uint64)
            x, y, z = (simhash.wide_fingerprint(s, words) for s in (h[: common + a], np.delete(h, slice(common, common + a)), ~h))
            assert np.bitwise_count(x ^ y).sum() <= simhash.most_bits(64 * words) < np.bitwise_count(x ^ z).sum()
    assert simhash.wide_fingerprint(h[:0], words).sum() == 0


def test_links_of_a_bucket_connect_what_brute_force_connects():
    r = np.random.default_rng(4)
    bases = r.integers(0, 1 << 64, (6, simhash.HEAD), dtype=np.uint64)
    w = bases[r.integers(0, 6, 300)]
    for row in w:
        for bit in r.choice(64 * simhash.HEAD, r.integers(0, 45), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    i, j = simhash.bucket_links(w)
    most, first = simhash.most_bits(64 * simhash.HEAD), simhash.most_bits(64)
    d = np.bitwise_count(w[:, None] ^ w[None])
    p, q = np.nonzero(d.sum(axis=2) <= most)
    assert all(d[x, y].sum() <= most for x, y in zip(i, j))
    p, q = p[d[p, q, 0] <= first], q[d[p, q, 0] <= first]
    root, wanted = simhash.forest(i, j, 300), simhash.forest(p, q, 300)
    assert np.array_equal(root, wanted) and len(set(root)) < 300


def test_links_of_a_group_grow_with_its_members_and_not_with_the_bands(spark, monkeypatch):
    r = np.random.default_rng(6)
    n = 600
    bands, width = simhash.band_plan(n)
    bits = r.random((40, 64 * simhash.HEAD + bands * width)) < 0.5
    bits = bits[np.where(np.arange(n) < 500, 0, r.integers(1, 40, n))]  # one large group, others of a few
    bits ^= r.random(bits.shape) < 0.06
    heads = np.packbits(bits[:, : 64 * simhash.HEAD], axis=1).view(np.int64)
    buckets = bits[:, 64 * simhash.HEAD :].reshape(n, bands, width) @ (1 << np.arange(width)[::-1]) + (np.arange(bands) << width)
    node = r.permutation(n)
    rows = [(int(k), b.tolist(), *h.tolist()) for k, b, h in zip(node, buckets, heads)]
    links, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda e: links.append(e.distinct().count()) or components(e))
    got = simhash.simhash_classes(spark.createDataFrame(rows, "node long, bands array<long>, " + ", ".join(f"w{i} long" for i in range(simhash.HEAD))), n)
    near = np.bitwise_count((heads[:, None] ^ heads[None]).view(np.uint64)).sum(axis=2) <= simhash.most_bits(64 * simhash.HEAD)
    meet = np.zeros((n, n), dtype=bool)
    for x in buckets.T:
        meet |= x[:, None] == x[None]
    i, j = np.nonzero(near & meet)
    root = simhash.forest(node[i], node[j], n)
    assert {(x.node, x.root) for x in got.collect()} == {(k, int(v)) for k, v in enumerate(root) if v != k}
    assert sum(links) <= (simhash.FIRST + 1) * n


def test_quality_messages_do_not_depend_on_the_order_of_rows():
    from annulus.llm.quality import Grams, by_shard

    texts = ["one two two three", "", "drei vier", "\u00e9\U0001f600 one"]
    seen = []
    for order in (texts, texts[::-1]):
        grams = Grams(order, 4).distinct
        at, first = by_shard(grams, 3)
        seen.append(([grams[i] for i in at], first.tolist()))
    assert seen[0] == seen[1] and len(seen[0][0]) == first[-1]


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("per_block", [8 << 20, 400])
def test_of_rows_of_one_id_the_earlier_start_stays_in_any_order(spark, turned, per_block):
    passage = " ".join(f"w{k}" for k in range(25))
    lead = lambda n: " ".join(f"x{n}_{k}" for k in range(n))
    rows = [(5, f"{lead(10)} {passage}"), (5, f"{lead(3)} {passage}"), (9, f"{lead(1)} {passage} end"), (None, f"{lead(7)} {passage} {lead(40)}"), (None, f"{lead(2)} {passage}")]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.repeated_words(df, per_block=per_block).collect()}
    # Null ids come first as one document: of their two rows the earlier start stays.
    assert got == {(5, 35): 25, (5, 28): 25, (9, 27): 25, (None, 72): 25, (None, 27): 0}


def test_long_urls_are_cut_at_the_depths_of_rules(spark):
    rules = spark.createDataFrame([("block", "b.org", "/a/"), ("allow", "x.b.org", "/a/a/a/q"), ("block", "", "/only/")], "verdict string, host string, path string")
    long = [(1, "http://" + "s." * 20_000 + "b.org" + "/a" * 40_000), (2, "http://x.b.org/a/a/a/qq"), (3, "http://x.b.org/a/a"), (4, "http:///only/z"), (5, "http://b.org/a"), (6, None)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(long, "page_id long, url string"), rules).collect()}
    assert got == {1: ("b.org/a/", "block"), 2: ("x.b.org/a/a/a/q", "allow"), 3: ("b.org/a/", "block"), 4: ("/only/", "block"), 5: (None, "allow"), 6: (None, "allow")}
