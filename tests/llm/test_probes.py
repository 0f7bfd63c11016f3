"""Single properties of the corpus operators that once failed, and near duplicates against a brute force that shares no code."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenlog.llm import _kernels, fingerprints, html_extract, mixing, order_minhash


def thue_morse(levels):
    word, other = "a", "b"
    for _ in range(levels):
        word, other = word + other, other + word
    return word, other


def test_regular_words_have_hashes_of_their_own():
    for levels in (4, 8, 10, 12):
        words = [*thue_morse(levels), "ab" * 2 ** (levels - 1), "a" * 2**levels, "a" * (2**levels - 1)]
        lanes, offsets = _kernels.word_hashes(pa.array(words, pa.large_string()), 2)
        assert list(np.diff(offsets)) == [1] * 5
        for lane in lanes:
            assert len(set(lane.tolist())) == 5
    (one,), _ = _kernels.word_hashes(pa.array(["x y", "y  x", " x\ny "], pa.large_string()), 1)
    assert one.tolist() == [one[0], one[1], one[1], one[0], one[0], one[1]]


def test_words_hash_alike_wherever_they_stand():
    text = " ".join(["préfix"] * 3 + ["w" * n for n in range(1, 40)])
    whole, _ = _kernels.word_hashes(pa.array([text], pa.large_string()), 2)
    for n, word in enumerate(text.split()):
        alone, _ = _kernels.word_hashes(pa.array([word], pa.large_string()), 2)
        assert [lane[0] for lane in alone] == [lane[n] for lane in whole]


def test_deep_markup_is_read_to_the_end():
    depth = 50_000
    page = "<body><article>" + "<div>" * depth + "<p>the story</p>" + "</div>" * depth + "<p>its end</p></article></body>"
    assert html_extract.extract(page) == "the story\nits end"
    assert "open" in html_extract.extract("<div>" * 5000 + "open text, of some length, without an end")


def test_names_that_only_begin_like_boilerplate_stay():
    prose = "This paragraph, as all of them, is long enough to count as a part of the article, with commas. " * 3
    for name in ("football-news", "shareholder-report", "navy-blue", "socialism", "advice", "promotional-history", "menuhin", "footnotes-essay"):
        assert prose.strip() in html_extract.extract(f"<body><div class='{name}'><p>{prose}</p><p>{prose}</p></div></body>"), name
    for name in ("footer", "ad", "share-links", "nav", "cookie-banner", "related"):
        page = f"<body><article><p>{prose}</p><div class='{name}'><p>buy this now</p></div><p>{prose}</p></article></body>"
        assert "buy this" not in html_extract.extract(page), name
    page = f"<body><article><p>{prose}</p><p class='legal'>The court ruled, after all, for him.</p></article></body>"
    assert "The court ruled" in html_extract.extract(page)


def test_likeness_of_long_repeated_texts():
    line = "one two three four five six seven eight nine ten "
    a, b = (fingerprints.vectors([line * n]) for n in (4000, 3000))
    few = [fingerprints.vectors([line * n]) for n in (400, 300)]
    whole, small = fingerprints.likeness(a, b)[0], fingerprints.likeness(*few)[0]
    assert 0.5 < whole <= 1 and abs(whole - small) < 0.01
    # Insertion and deletion, by a sum of its own.
    x, y = "alpha beta\ngamma", "delta epsilon"
    hexed = [fingerprints.to_hex(*fingerprints.vectors([t]))[0] for t in (x, y, f"{y}\n{x}", x.split("\n")[1] + "\n" + x.split("\n")[0])]
    assert fingerprints.combine(hexed[0], hexed[1]) == hexed[2] and fingerprints.combine(hexed[2], hexed[1], -1) == hexed[0] == hexed[3]


def plain_shingles(text):
    words = (text or "").lower().encode().split()
    grams = [tuple(words[n : n + 5]) for n in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
    seen, out = {}, []
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out


def plain_similarity(a, b):
    if not a or not b:
        return float(a == b)
    before = [0] * (len(b) + 1)
    for x in a:  # the longest common subsequence, cell by cell
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        before = row
    return before[-1] / (len(a) + len(b) - before[-1])


def test_near_duplicates_equal_a_plain_brute_force(spark):
    rng = random.Random(17)
    words = [f"w{n}" for n in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(30, 60))] for _ in range(6)]
    passage = [rng.choice(words) for _ in range(25)]
    rows = []
    for base in bases:
        rows.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 6):
            own = list(base)
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 2)] = [rng.choice(words)] * rng.randint(0, 2)
            rows.append((" " if edits % 2 else "\n").join(own).upper())
        rows.append(" ".join(base[:10] + passage + base[10:]))
    rows += [None, "", "a b", "b a", "a b"]
    rng.shuffle(rows)
    split = [plain_shingles(t) for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if plain_similarity(split[i], split[j]) >= 0.8 - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_targets_topics_and_clashing_names(spark):
    rows = [(n, "some words here " * (1 + n % 5), f"s{n % 3}", "en", f"t{n % 2}", 0.0) for n in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, _lumenlog_0 double")
    targets = {"source": {"s0": 6, "s1": 3, "s2": 1}, "topic": {"t0": 1, "t1": 1}}
    result = mixing.mix_sources(df, topic_col="topic", targets=targets).cache()
    shares = {r.source: r.k for r in result.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("k")).collect()}
    whole = sum(shares.values())
    assert all(abs(shares[s] / whole - w) < 0.001 for s, w in {"s0": 0.6, "s1": 0.3, "s2": 0.1}.items())
    kept = mixing.keep_sample(df, topic_col="topic", targets=targets)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in result.collect() if r.kept}
