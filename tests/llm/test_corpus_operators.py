"""The corpus operators against brute force, round trips and held-out accuracy, with edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlog.llm import bpe, exact_dedup, fingerprints, html_extract, mixing, order_minhash, quality, queries, substring_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_2 int"


def corpus(seed=3, n=60):
    """Random prose with exact copies, near copies, a shared passage, periodic junk, nulls, empties and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(k))
    shared = prose(70)
    texts = [prose(rng.randint(1, 400)) for _ in range(n)]
    texts[5] = texts[2]
    texts[9] = texts[2].replace(" ", "  ")
    words = texts[7].split(" ")
    texts[11] = " ".join(w if i % 61 else "zzz" for i, w in enumerate(words))
    for i in (13, 17, 19):
        texts[i] = texts[i][:200] + "\n" + shared + "\n" + texts[i][200:]
    texts[21] = "In. " * 300
    texts[22] = "In. " * 250
    texts[23] = "a" * 4000
    texts[24] = "b" + "a" * 3000
    texts[25], texts[26], texts[27] = None, "", " \n\t "
    texts[28] = texts[3] + " " + texts[4]
    texts[29] = "日本語のテキスト🤦🏼‍♂️ " * 30
    texts[30] = texts[29][3:]
    rows = [(i * 3 - 20, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(t or ""), 1) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def documents(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    extra = ["don't we'LL", " a  b\n\n c ", "x<|endoftext|> y<|endoftext|>", "\t\t a", "½①é\x1c\x85 z", "=" * 200, " " * 300]
    rows = [(i, t) for i, t in enumerate([r[1] for r in documents[0]] + extra)]
    got = {r.doc_id: r for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        ids = np.array(want, dtype="<u4").tobytes()
        assert bytes(got[i].ids) == ids and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(empty(spark), path).count() == 0


def test_substring_dedup_equals_brute_force(spark, documents):
    rows, df = documents
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.digest(substring_dedup.remove_repeated_windows(df)).collect()}
    want = substring_dedup.brute_force([(r[0], r[1]) for r in rows])
    assert got == want and sum(v[1] for v in want.values()) > 500
    assert substring_dedup.remove_repeated_windows(empty(spark)).count() == 0


def test_suffix_dedup_equals_brute_force(spark, documents):
    rows, df = documents
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(df)).collect()}
    assert got == suffix_dedup.brute_force([(r[0], r[1]) for r in rows])
    assert suffix_dedup.remove_repeated_bytes(empty(spark)).count() == 0


def test_long_documents_are_cut_into_blocks_without_loss(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(130_000))
    rows = [(1, long), (2, "x " + long[1000:700_000]), (3, long[650_000:] + " y"), (3, long[650_000:] + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module, run in ((substring_dedup, substring_dedup.remove_repeated_windows), (suffix_dedup, suffix_dedup.remove_repeated_bytes)):
        got = module.digest(run(df)).collect()
        want = module.brute_force(rows)
        assert len(got) == 4 and all(tuple(r[1:]) == want[r[0]] for r in got)


def test_rows_that_share_an_id_lose_only_what_their_own_text_repeats(spark):
    rng = random.Random(12)
    prose = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    base, clean, tail = prose(60), prose(300), prose(40)
    rows = [(1, base), (None, clean), (None, tail + " " + clean + " " + base), (None, "x " + base[7:]), (3, prose(90)), (3, base + " " + tail), (None, prose(4)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for module, run in ((substring_dedup, substring_dedup.remove_repeated_windows), (suffix_dedup, suffix_dedup.remove_repeated_bytes)):
        got = sorted((r[0] or 0, tuple(r[1:])) for r in module.digest(run(df)).collect())
        want = []
        for i, text in rows:  # each row with all rows of smaller ids
            key = lambda x: 2**63 - 1 if x is None else x
            known = [(n, t) for n, (j, t) in enumerate(rows) if key(j) < key(i)]
            want.append((i or 0, module.brute_force([*known, (len(rows), text)])[len(rows)]))
        assert got == sorted(want), module.__name__


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (4, text), (4, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeated_windows(df).collect()) == [(0, 0), (0, 80), (4, 0), (4, 0)]
    groups = exact_dedup.exact_groups(df).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in groups) == [(0, 0, 1, True), (0, 4, 3, False), (4, 4, 3, False), (4, 4, 3, True)]
    assert exact_dedup.keep_one(df).count() == 2
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df.where("text is not null")).collect()} == {None: 4, 4: 4}
    assert fingerprints.fingerprint_with_edits(df).count() == 4
    assert mixing.mix_sources(df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x"))).count() == 4


def test_exact_groups_equal_brute_force(spark, documents):
    rows, df = documents
    groups = {}
    for i, t, *_ in rows:
        key = "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((-len(t or ""), i))
    want = {}
    for key, members in groups.items():
        best = min(members)[1]
        for _, i in members:
            want[i] = (best, len(members), i == best, hashlib.sha256(key.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in exact_dedup.exact_groups(df).collect()} == want
    assert {r.doc_id for r in exact_dedup.keep_one(df).collect()} == {i for i, w in want.items() if w[2]}
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_near_duplicates_equal_brute_force(spark, documents):
    rows, df = documents
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df).collect()}
    assert got == order_minhash.brute_force([(r[0], r[1]) for r in rows])
    assert got[rows[11][0]] == rows[7][0]
    assert order_minhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_behind_a_common_passage(spark):
    """Short documents that share a long passage fail against their bucket's smallest one; the prefix filter finds their pairs."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(0, 80, 2):
        own = [word() for _ in range(28)]
        rows += [(i, " ".join(passage + own)), (i + 1, " ".join(passage + own[:-1] + [word()]))]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows} == order_minhash.brute_force(rows)


def test_near_duplicates_keep_links_between_documents_of_which_only_one_is_linked_to_the_smallest(spark):
    rng = random.Random(11)
    rows = []
    for group in range(40):
        words = [f"g{group}w{rng.randrange(10**6)}" for _ in range(200)]
        for step in range(12):  # each a little further from the first: only neighbours are similar enough
            rows.append((len(rows), " ".join(words)))
            for _ in range(2):
                words[rng.randrange(200)] = f"e{group}s{rng.randrange(10**6)}"
    rng.shuffle(rows)
    rows = [(n, text) for n, (_, text) in enumerate(rows)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == order_minhash.brute_force(rows)


def test_near_duplicates_tell_rows_that_share_an_id_apart_by_text(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    base, alone, other = prose(), prose(), prose()
    rows = [(5, base), (None, base + " tail"), (None, alone), (None, alone.upper()), (7, other), (7, base + " end"), (7, other + " end"), (7, other)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted((r.doc_id or 0, r.class_id) for r in order_minhash.near_duplicates(df).collect())
        null = 2**63 - 1
        assert got == [(0, 5), (0, null), (0, null), (5, 5), (7, 5), (7, 7), (7, 7), (7, 7)]
        kept = sorted((r.doc_id or 0, r.text.lower()) for r in order_minhash.keep_one(df).collect())
        assert {i for i, _ in kept} == {0, 5, 7} and [t for i, t in kept if i == 0] == [alone] and (5, base) in kept
        assert {t for i, t in kept if i == 7} in ({other}, {other + " end"})


def test_components_follow_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)]
    got = {r.doc: r.root for r in order_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


def test_fingerprints(spark, documents):
    rows, df = documents
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(df).collect()}
    order = sorted(rows)
    for n, row in enumerate(order):
        text, following = row[1] or "", order[(n + 1) % len(order)][1] or ""
        changed = fingerprints.edited(text, following)
        assert got[row[0]].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[row[0]].n_chars == len(text)
        assert got[row[0]].fingerprint == fingerprints.to_hex(*fingerprints.vectors([text]))[0]
        assert got[row[0]].edited_fingerprint == fingerprints.to_hex(*fingerprints.vectors([changed]))[0]
        assert 0 <= got[row[0]].near_edited <= 1 and 0 <= got[row[0]].near_next <= 1
    assert got[rows[2][0]].fingerprint == got[rows[5][0]].fingerprint
    long = [r for r in got.values() if r.n_chars > 800 and len(set(r.fingerprint)) > 4]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.3
    assert fingerprints.fingerprint_with_edits(empty(spark)).count() == 0


def test_fingerprints_are_homomorphic():
    make = lambda t: fingerprints.to_hex(*fingerprints.vectors([t]))[0]
    assert make("a b\nc d\ne") == make("e\na b\nc d")
    assert fingerprints.combine(make("a b\nc d"), make("e")) == make("a b\nc d\ne")
    assert fingerprints.combine(make("a b\nc d\ne"), make("c d"), -1) == make("a b\ne")
    assert make("a b\nc") != make("a b\nd")


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use, cookies</div>
<div class="layout"><div class="content"><h2>Title &amp; more</h2><p>One, two   three&nbsp;four<br>five <a href=x>six</a>.<p>Two<ul><li>a<li>b</ul>
<form><input>q</form><div class="ad-slot">buy</div><blockquote>quote</blockquote></div>
<div class=sidebar><p>Other, things, with, many, commas, to, read, here</p></div><div id=comments><p>nice, post</p></div></div>
<footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    assert html_extract.extract(PAGE) == "Title & more\nOne, two three four five six.\nTwo\na\nb\nquote"
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<p>cut <b"), (4, "w", "plain &lt; text"), (5, "x", "<article><h1>A</h1><p>" + "word " * 50_000 + "</article><aside>z</aside>")]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[(2, None)] == got[(None, "v")] == ("", 0) and got[(5, "x")][1] == 2 + 250_000 - 1
    assert html_extract.extract("<p>cut <b") == "cut" and html_extract.extract("plain &lt; text") == "plain < text"


def test_html_extraction_keeps_the_text_of_an_article_whole():
    p = "<p>" + "Some words, with commas, in a paragraph that is long enough, to count. " * 3 + "</p>"
    said = " ".join(p[3:-4].split())
    links = "".join(f"<li><a href=x>reference number {i}</a></li>" for i in range(8))
    listed = "\n".join(f"reference number {i}" for i in range(8))
    assert html_extract.extract(f"<article>{p}<h2>References</h2><ul>{links}</ul></article>") == f"{said}\nReferences\n{listed}"
    assert html_extract.extract(f"<article>{p}<div><p>See <a href=x>this link to another page here</a>.</div></article>") == f"{said}\nSee this link to another page here."
    for name in ("entry-header", "article-header", "header"):
        assert html_extract.extract(f"<article><div class='{name}'><h1>Title</h1></div>{p}</article>") == f"Title\n{said}"
    for name in ("container no-sidebar", "layout has-sidebar", "content ad-free"):
        assert html_extract.extract(f"<div class='{name}'><div class=c>{p}{p}</div></div>") == f"{said}\n{said}"
        assert html_extract.extract(f"<div class='{name}'><article>{p}</article><div class=sidebar>{p}{p}{p}</div></div>") == said
    # What the names rightly drop stays dropped, link lists outside articles too.
    assert html_extract.extract(f"<div class=c>{p}{p}<ul>{links}</ul></div>") == f"{said}\n{said}"
    assert html_extract.extract(f"<div class=site-header>{p}</div><div class=c>{p}{p}</div><div class=ad>{p}</div><div id=comments>{p * 9}</div>") == f"{said}\n{said}"


def labelled(spark, n=900):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(["grubwit", "muckhead"])
        if junk:
            own = [w.upper() + "!!" for w in own]
        rows.append((i, " ".join(own)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    documents, labels = labelled(spark)
    model = toxicity.train(documents, labels.where("doc_id < 500"))
    result = toxicity.classify(documents, model).join(labels, "doc_id").where("doc_id >= 500").collect()
    # About a hundred toxic documents to learn from: it finds 70 of the 80 held-out ones and flags no clean one.
    assert not any(r.is_toxic for r in result if not r.toxic)
    assert np.mean([r.is_toxic for r in result if r.toxic]) >= 0.8
    assert all(0 <= r.p_severe <= 1 and 0 <= r.p_toxic_spam <= 1 for r in result)
    assert toxicity.train(documents, labels.where("toxic = 0")) is None
    none = toxicity.classify(documents.limit(3), None).collect()
    assert not any(r.is_toxic or r.p_toxic is not None for r in none)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "grubwit " * 30_000)], "doc_id long, text string")
    assert sorted(r.is_toxic for r in toxicity.classify(odd, model).collect()) == [False, False, True]


def test_quality_on_held_out_documents(spark):
    documents, labels = labelled(spark)
    model = quality.train(documents, quality.grades_of(labels.where("doc_id < 500")))
    assert len(model["cuts"]) == 2 and model["cuts"][0] < model["cuts"][1]
    result = quality.score(documents, model).join(labels, "doc_id").where("doc_id >= 500").collect()
    assert np.mean([r.kept == bool(r.quality) for r in result]) > 0.98
    assert {r.doc_id for r in quality.keep(documents, model).collect()} == {r.doc_id for r in quality.score(documents, model).where("kept").collect()}
    assert quality.train(documents, quality.grades_of(labels.limit(0))) is None
    assert quality.score(documents.limit(2), None).where("kept").count() == 2
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "w " * 50_000)], "doc_id long, text string")
    assert quality.score(odd, model).count() == 3


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = np.digitize(x @ np.array([2.0, -1.0, 0.0, 0.5]) + rng.logistic(size=3000) * 0.3, [-1.5, 1.5])
    w, cuts = quality.fit_ordinal(x, y, np.ones(3000), 3)
    assert cuts[0] < cuts[1] and abs(w[1] / w[0] + 0.5) < 0.05 and abs(w[2] / w[0]) < 0.05


def test_mixing_reaches_its_targets(spark, documents):
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 500, 60).astype(float)
    codes = [rng.integers(0, 4, 60), rng.integers(0, 3, 60)]
    targets = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2])]
    factors = mixing.rake(tokens, codes, targets)
    for code, target in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, weights=tokens * factors) / (tokens * factors).sum(), target, atol=1e-6)
    scale = mixing.scale_for(tokens, factors, 0.3)
    assert np.isclose((tokens * np.minimum(1, scale * factors)).sum(), 0.3 * tokens.sum(), rtol=1e-6)
    rows, df = documents
    result = mixing.mix_sources(df).collect()
    assert len(result) == len(rows)
    by_words = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    assert all(r.n_tokens == by_words[r.doc_id] and 0 <= r.probability <= 1 for r in result)
    assert {r.doc_id for r in mixing.keep_sample(df).collect()} == {r.doc_id for r in result if r.kept}
    assert mixing.mix_sources(empty(spark)).count() == 0


def skewed(spark):
    """One source with a third of the rows, 39 rarer and rarer ones, languages of unequal size."""
    rng = random.Random(4)
    names = ["hot"] * 300 + [f"s{k}" for k in range(1, 40) for _ in range(150 // k)]
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 60))), rng.choices(["en", "de", "fr"], [6, 3, 1])[0], s) for i, s in enumerate(names)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_mixing_reaches_its_targets_with_capped_probabilities(spark):
    result = mixing.mix_sources(skewed(spark)).cache()
    report = mixing.mix_report(result).collect()
    assert {r.dimension for r in report} == set(mixing.DIMENSIONS)
    assert all(abs(r.achieved / r.target - 1) < 1e-4 for r in report)
    assert result.where("probability >= 1").count() > 0 and result.agg(F.max("probability")).first()[0] <= 1
    hot = next(r for r in report if r.value == "hot")
    assert hot.available > 0.25 > hot.target


def test_raking_by_spark_equals_raking_on_the_driver(spark):
    rows = [("a", "x", "t0", 40), ("a", "y", "t0", 10), ("b", "x", "t1", 30), ("b", "y", "t0", 5), ("c", "y", "t1", 15)]
    goals = {"source": {"a": 0.3, "b": 0.3, "c": 0.4}, "lang": {"x": 0.5, "y": 0.5}}
    frames = {k: spark.createDataFrame(list(v.items()), "value string, share double") for k, v in goals.items()}
    got = mixing.rake_frames(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), frames, rounds=3).collect()
    codes = [np.array(["abc".index(r[0]) for r in rows]), np.array(["xy".index(r[1]) for r in rows])]
    want = mixing.rake(np.array([r[3] for r in rows], dtype=float), codes, [np.array(list(v.values())) for v in goals.values()], rounds=3)
    by_cell = {(r.source, r.lang): r.factor for r in got}
    assert np.allclose([by_cell[r[:2]] for r in rows], want)


def test_mixing_does_not_depend_on_where_cells_are_raked(spark, monkeypatch):
    # Sparse cells: raking needs 28 rounds.
    rows = [("a", "x", "t0", 1000), ("a", "y", "t1", 60), ("b", "x", "t1", 60), ("b", "y", "t0", 300), ("c", "y", "t1", 200), ("c", "x", "t0", 60), ("d", "y", "t1", 60), ("d", "x", "t0", 60)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    probabilities = lambda: {r[:3]: r.probability for r in mixing.calibrated(cells, {"source": 0.8, "lang": 0.8}, 0.4).collect()}
    driver = probabilities()
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 3)
    frames = probabilities()
    assert len(driver) == len(rows) and driver.keys() == frames.keys()
    assert all(np.isclose(driver[k], frames[k], rtol=1e-9) for k in driver)


def test_pipeline_applies_each_stage(spark, tmp_path):
    documents, labels = labelled(spark, 300)
    documents = documents.withColumn("lang", F.lit("en")).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3)).withColumn("n_chars", F.length("text").cast("long"))
    copies = documents.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000)
    near = documents.where("doc_id between 30 and 40").withColumn("doc_id", F.col("doc_id") + 2000).withColumn("text", F.concat("text", F.lit(" tail")))
    whole = documents.unionByName(copies).unionByName(near)
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], str(tmp_path))
        assert out.columns == docs.columns, name
        kept.append(out.cache())
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(ids[1] & (junk | {j + 1000 for j in junk})) <= 2 and len(ids[0] - ids[1]) < 1.3 * (len(junk) + 5)
    assert ids[2] == ids[1] - {i for i in ids[1] if 1000 <= i < 2000 and i - 1000 in ids[1]}
    classes = order_minhash.brute_force([(r.doc_id, r.text) for r in kept[2].collect()])
    assert ids[3] == set(classes.values())
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in result} == ids[4] and all(r.n_tokens > 0 for r in result)
