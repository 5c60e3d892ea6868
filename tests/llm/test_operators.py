"""The ten operators against brute force, round trips and held-out labels; nulls, ties, repeats, clashing names."""

import json
import random
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sprachwerk.llm import bytewords, common, decontaminate, extract, licences, materialise, packing, quality, sharding, simhash, tokenize, topk, toxicity
from sprachwerk.llm.common import table

#: Ids, texts: repeats, blanks, nulls, a long text; the frame below adds columns with names that operators use themselves.
ODD = [(1, "one two three four"), (2, ""), (3, None), (4, "one two three four"), (4, "one two three four"), (5, "x"), (6, "Ünï " * 4000), (None, "no id here"), (7, " \n\t "), (8, "a b")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "web", 0, 1, "h", 2.0, "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, h string, score double, hits string").withColumns({"a.b": F.lit(1), "_sw_before": F.lit(2), "_n": F.lit(3), "row": F.lit("x")}).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, f"{data}/sf0.001", "documents")


# ---- 1 sharding ----
def test_shards_are_whole_and_near_equal(docs):
    got = sharding.assign(docs, 16).toPandas()
    assert sorted(got.doc_id) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    size, most = got.groupby("shard")["size"].sum(), got.groupby("text_crc32")["size"].sum().max()
    assert size.max() <= size.sum() / 16 + 2 * most


def test_shards_of_odd_rows(odd, none):
    got = sharding.assign(odd, 4).collect()
    assert len(got) == len(ODD)
    assert {r["text_crc32"] for r in got if r["doc_id"] == 4} == {zlib.crc32(b"one two three four")}
    assert {r["size"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert sharding.assign(none, 4).count() == 0


def test_shards_take_any_language_and_write_every_row_once(spark, tmp_path):
    rows = [(None, "日本語の文", "日本語")] * 3 + [(1, None, None), (1, "x", "de"), (1, "y", "a.b.c.d.e.f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("shard", F.lit("clash"))
    for shards in (1, 4):
        got = sharding.assign(docs, shards).collect()
        assert len(got) == len(rows)
        sharding.write_shards(docs, str(tmp_path / str(shards)), shards)
        back = spark.read.parquet(str(tmp_path / str(shards)))
        key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
        assert sorted(map(key, back.select("doc_id", "text", "lang").collect())) == sorted(map(key, rows))


def test_equal_rows_are_numbered_without_gaps(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 3).alias("shard"), F.lit("x").alias("t"))
    got = common.gapless(rows, ["shard"], ["doc_id"], "slot").toPandas()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert len(got) == 20_000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_join_like_others(spark, monkeypatch, how):
    many = spark.createDataFrame([(i % 3 if i < 60 else i, None if i % 7 == 0 else "k", i) for i in range(100)], "a long, b string, v long")
    one = many.select("a", "b").distinct().where("a <> 70").withColumn("w", F.col("a") * 2)
    want = many.join(one.withColumnsRenamed({"a": "x", "b": "y"}), F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y")), how).drop("x", "y")
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    got = common.join_hot(many, one, ["a", "b"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_scratch_tables_go(spark, tmp_path):
    with common.scratch(spark) as kept:
        a, b = common.written(spark.range(3).toDF("x"), "a"), common.written(spark.range(4).toDF("x"), "b")
        kept.append(b._sprachwerk_path)
    assert b.count() == 4 and not Path(a._sprachwerk_path).exists()
    assert common.release(spark) and not Path(b._sprachwerk_path).exists()


def test_a_cluster_names_its_shared_folder():
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        common.checkpoint_root(Cluster)


# ---- 2 top-k ----
def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    vectors += [(300, None), (301, [float("nan")] * 6), (302, [None] * 6), (None, [1.0] * 6), (303, vectors[0][1]), (303, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("far", F.lit("clash")).withColumn("rank", F.lit(0))
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and v and all(x is not None and x == x for x in v)}
    want = set()
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-int(good[q] @ good[x]), x) for x in good if x != q)[:20]
        want |= {(q, r, x, -s) for r, (s, x) in enumerate(best, 1)}
    for blocks in ((1024, 4096), (4, 16)):  # one block, and many in several rounds
        got = topk._top_k(df, F.col("vec_id") % 20 == 0, 20, 64, 4, *blocks).collect()
        assert {tuple(r)[:4] for r in got} == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_pivots_rule_candidates_out(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 24))  # four directions that matter
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(flat + 0.01 * rng.normal(size=flat.shape))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk._top_k(df, F.col("vec_id") % 100 == 0, 20, 64, 8, 1024, 256).toPandas()
    assert got["evaluated"].sum() < 0.25 * 30 * 2999


def test_caps_are_never_too_low():
    rng = np.random.default_rng(3)
    v = np.floor(64 * rng.normal(size=(400, 20))).astype(np.int64)
    v[5] = v[6] = 0
    v[7] = v[8]
    f = v.astype(float)
    for n in (0, 1, 7, 20, 30):
        p = topk.choose_pivots(v, n)
        at = topk.Simplex(p).places((f * f).sum(1), np.sqrt(((f[:, None] - p[None]) ** 2).sum(2)))
        single = ((f * f).sum(1)[:, None] + (f * f).sum(1)[None]) / 2
        # heights are raised by up to sqrt(1e-9) of the length for rounding, which loosens a cap by that share
        slack = 7e-5 * np.sqrt((f * f).sum(1)[:, None] * (f * f).sum(1)[None]) + 1
        for row in p:
            d = np.sqrt(((f - row) ** 2).sum(1))
            assert (at @ at.T <= single - (d[:, None] - d[None]) ** 2 / 2 + slack).all()  # no single pivot caps lower
        assert (at @ at.T + 1 >= f @ f.T).all()


# ---- 3 simhash ----
def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_classes_are_those_of_all_pairs(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    want = union(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = simhash.classes(docs).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_links_survive_the_cutting_of_long_lists(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({b ^ sum(1 << rng.randrange(24) for _ in range(rng.randrange(4))) for b in base for _ in range(60)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = union([s for (s,) in signed], [(a, b) for (a,), (b,) in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3])
    for rows, short in ((7, 1 << 30), (2048, 1 << 30), (7, 0)):
        found = simhash.links(spark.createDataFrame(signed, "fp long"), list_rows=rows, short_sets=short).collect()
        assert union([s for (s,) in signed], [tuple(r) for r in found]) == want


def test_position_sets_cover_every_pair_that_reaches_the_minimum():
    for distance in range(8):
        for shortest in (True, False):
            sets = simhash.position_sets(distance, shortest)
            assert all(any(set(s) <= set(same) for s in sets) for same in combinations(range(8), 8 - distance))


def test_shared_bytes_are_tallied():
    rng = np.random.default_rng(4)
    a = rng.integers(-(1 << 62), 1 << 62, 500)
    b = np.where(rng.random((500, 8)) < 0.5, a[:, None].view(np.uint8).reshape(-1, 8), rng.integers(0, 256, (500, 8))).astype(np.uint8).view(np.int64).ravel()
    want = (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(1)
    assert (simhash.shared_bytes(a, b) == want).all()


def test_near_copies_of_odd_rows(odd, none):
    got = simhash.classes(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 7)} == {2}
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.classes(none).count() == 0


PROSE = ("The council said that it will be open to all of the people who have been in the town for more than a year. " * 3).strip()


# ---- 4, 9 classifiers ----
def accuracy(found, labels, label, fold, rest):
    rows = found.join(labels.where(f"{label} is not null"), "doc_id").where(f"pmod(crc32(cast(doc_id as string)), {fold}) = {rest}").select("score", label).toPandas()
    return ((rows.score >= 0.3) == (rows[label] == 1)).mean(), (rows[label] == 1).mean()


def test_quality_on_held_out_rows(spark, data):
    found = quality.op4_quality(spark, f"{data}/sf0.01")
    right, share = accuracy(found, table(spark, f"{data}/sf0.01", "labels"), "quality", 5, 0)
    assert right > max(share, 1 - share)
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_on_held_out_rows(spark, data):
    found = toxicity.op9_toxicity(spark, f"{data}/sf0.01")
    right, share = accuracy(found, table(spark, f"{data}/sf0.01", "labels"), "toxic", 4, 2)
    assert right > max(share, 1 - share)
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_offending_sentences_are_found(spark):
    texts = [(i, f"Sentence {i} is calm. {'You are a vile grumpf.' if i % 3 == 0 else 'You are a good friend.'} More follows here.") for i in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert all((r["score"] >= 0.3) == (i % 3 == 0) for i, r in rows.items())
    assert {s["text"] for r in rows.values() for s in r["sentences"]} == {"You are a vile grumpf."}


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for module, own in ((quality, "quality_score"), (toxicity, "toxicity")):
        for some in (labels, labels.where("false")):
            assert module.score(odd, module.train(odd, some)).where(f"{own} is not null").count() == len(ODD)
        assert module.score(none, module.train(none, labels)).count() == 0


def test_scores_do_not_depend_on_size():
    name = lambda w: bytewords.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    m = toxicity.Model(np.sort(np.concatenate([name(b"vile"), name(b"grumpf")])), np.array([2.5, 2.5]), -4.0, 0.0)
    texts = [b"you vile and grumpf", b"you vile " + b"and " * 1_100_000 + b"grumpf", b"Calm words here. " * 300_000 + b"you vile grumpf. And more."]
    scores, found, _ = m.score(pa.array(texts, pa.binary()))
    assert len(set(scores.round(9).tolist())) == 1
    assert [texts[r][a:b].strip() for r, _, a, b in found.T.tolist()] == [texts[0], texts[1], b"you vile grumpf."]
    lines = quality.FEATURES.index("repeated_lines")
    assert (quality.features(pa.array([b"same line " + b"x " * 2_400_000, b"same line x"], pa.binary()))[:, lines] == 0).all()
    long = b"\n".join(b"line %d of some" % (i % 5000) for i in range(400_000))
    parts, whole = quality.features(pa.array([long], pa.binary())), [len(set(long.split())), len(set(long.split(b"\n")))]
    n_words, n_lines = len(long.split()), 400_000
    assert parts[0, quality.FEATURES.index("distinct_words")] == whole[0] / n_words
    assert parts[0, lines] == (n_lines - whole[1]) / n_lines


# ---- 5 extraction ----
@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<p>Tom &amp; &#74;erry   run\n home</p>", "Tom & Jerry run home"),
        ("<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One <b>two</b>.</p><p>Three.</p></article><footer>Imprint</footer>", "Title\nOne two.\nThree."),
        ("<article><p>Text.</p><div class='comments'><p>First!</p></div><script>var x = '<p>no</p>'</script></article>", "Text."),
        ("<article><p>unclosed <i>tags", "unclosed tags"),
        ('<article><p>First. <svg class="i"/></p><p>Second.</p></article>', "First.\nSecond."),
        ('<article><iframe src="x"/><p>Text.</p></article>', "Text."),
        ('<article><p class="share">Share<p>article text</article>', "article text"),
        ('<article><ul><li class="social">Tweet<li>kept</ul></article>', "kept"),
        (f'<div class="content comments-enabled"><p>{PROSE}</p></div>', PROSE),
        (f'<div class="content with-sidebar"><p>{PROSE}</p></div>', PROSE),
        ('<article><div class="article-header"><h1>Head</h1></div><p>x</p><div class="site-footer">no</div><div id="mainNav">no</div></article>', "Head\nx"),
        ("<article>For <math><mi>x</mi></math> we see</article>", "For x we see"),
        ("<article><p>if a <b and c> d, <b>bold</b></p></article>", "if a <b and c> d, bold"),
        ("<form action=/><article>kept</article></form>", "kept"),
        ("<article>kept <form><input>no</form></article>", "kept"),
        ("<main>yes<script>no", "yes"),
        ("<main>" + "<p>word</p>" * 20000 + "</main>", "\n".join(["word"] * 20000)),
    ],
)
def test_main_text(html, text):
    assert extract.main_text(html) == text


def test_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "clash"), (2, "u", "<p>a</p>", "clash"), (2, "u", "<p>a</p>", "clash")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in extract.extract(pages).collect()) == ["", "a", "a"]
    assert extract.extract(pages.where("false")).count() == 0


# ---- 6 packing ----
def test_packing_is_whole(docs, odd, none):
    words = tokenize.word_ids(tokenize.default_vocabulary()).tokenizer
    for some in (docs, odd):
        rows = some.select("doc_id", "text").collect()
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(words.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in rows)
        got = packing.pack(some).toPandas()
        assert sorted((-1 if d != d else int(d), int(n)) for d, n in got[got["start"] == 0][["doc_id", "doc_tokens"]].values) == want
        assert got["length"].sum() == sum(n for _, n in want)
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert own["length"].sum() <= 4096
            assert (own["offset"].values == own["length"].cumsum().values - own["length"].values).all()
    assert packing.pack(none).count() == 0


def test_no_id_fills_a_group(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words").alias("text"))
    got = packing.pack(docs, group_rows=1000).toPandas()
    sizes = got.groupby(got["sequence_id"] // packing.SEQUENCES).size()
    assert len(got) == 20_000 and len(sizes) == 20 and sizes.max() < 2500


def test_piece_checksums(docs):
    words = tokenize.word_ids(tokenize.default_vocabulary()).tokenizer
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for p in packing.pack(docs).collect():
        ids = np.array([*words.encode(texts[p["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())


def test_first_fit_decreasing_is_the_plain_loop():
    rng = random.Random(2)
    for n in (0, 1, 2, 50):
        sizes = np.array([rng.randint(1, 100) for _ in range(n)], np.int64)
        room, want = [], np.zeros(n, np.int64)
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (b == len(room))
            room[b] -= sizes[i]
            want[i] = b
        assert (packing.first_fit_decreasing(sizes, 100)[0] == want).all()


def test_words_are_tokenised_as_by_the_library():
    words = tokenize.word_ids(tokenize.default_vocabulary())
    texts = ["It's 12 o'clock, isn't it?", "Größe <|endoftext|> x", "日本語 text", "a" * 3000, "we'll've 'quoted' 's", "", "Äİ b", "tabs\tand\nlines 3.14 e-mail@x.org"]
    got = {r: ids.tolist() for r, ids in words.rows(pa.array([t.encode() for t in texts], pa.binary()))}
    assert [got[i] for i in range(len(texts))] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# ---- 7 licences ----
def test_licence_lines(spark, odd, none):
    text = "Intro.\nReleased under the MIT License.\r\nLicensed under the Apache License, Version 2.0.\nA quiet line about apaches."
    docs = spark.createDataFrame([(1, text, 9), (1, text, 9), (2, None, 9), (None, text, 9)], "doc_id long, text string, line_no int").withColumn("told", F.lit(1))
    got = {(r["doc_id"], r["line_no"], r["family"]) for r in licences.scan(docs).collect()}
    assert got == {(i, n, f) for i in (1, None) for n, f in ((1, "MIT"), (2, "Apache-2.0"))}
    assert licences.scan(odd).count() == 0 and licences.scan(none).count() == 0
    with pytest.raises(ValueError):
        licences.scan(docs, confirmed=0.1)


STATEMENTS = [
    ("We wrote it in a week, and it is released under the MIT License.", {"MIT"}),
    ("Released under the MIT license by the authors of this small tool in 2021", {"MIT"}),
    ("Copyright (c) 2021 Jane Doe. All rights reserved.", {"Proprietary"}),
    ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC"}),
    ("He came with the train. " * 30 + "This work is licensed under the GNU General Public License, version 3. " + "It was late at night. " * 30 + "All rights reserved.", {"GPL", "Proprietary"}),
    ("The rights of the people are reserved for all.", set()),
    ("Er kam mit dem Zug und mit ihr.", set()),
    ("A student at the MIT has a driving licence.", set()),
]


def test_statements_are_found_wherever_they_stand(spark):
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(STATEMENTS)], "doc_id long, text string")
    got = {(r["doc_id"], r["family"]) for r in licences.scan(docs).collect()}
    assert got == {(i, f) for i, (_, families) in enumerate(STATEMENTS) for f in families}


def test_licences_on_wordings_never_seen():
    told = licences.held_out()
    assert told["wordings"] > 300
    assert told["precision"] > 0.97 and told["recall"] > 0.95 and told["left_alone"] > 0.97


def test_licence_scores_are_those_of_the_model(spark):
    lines = [x for _, _, x in licences._wordings()]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {(r["doc_id"], r["family"]): (r["probability"], r["known"]) for r in licences.scan(docs).collect()}
    want = {(i, f): (p, known) for i, x in enumerate(lines) for f, p, known in licences.classify(x)}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_anchors_leave_nothing_out():
    m = licences.train()
    for _, pairs in m.templates:
        without = [p for p in pairs if set(m.anchors).isdisjoint(p.split(" "))]
        assert len(without) < licences.CONFIRMED * len(pairs)


# ---- 8 decontamination ----
def test_hits_are_those_of_all_windows(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("ab cd ef gh Ä1 x".split()) for _ in range(n))
    items = [(i, say(rng.choice((0, 2, 9, 10, 14, 40)))) for i in range(20)] + [(20, None), (None, "ab cd")]
    texts = [(i, say(rng.choice((0, 1, 9, 60, 200)))) for i in range(40)] + [(40, None), (41, items[5][1])]
    word = lambda t: decontaminate.re_words(t) if hasattr(decontaminate, "re_words") else [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").replace(",", " ").split()]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"hits": F.lit("clash"), "_sw_before": F.lit(1), "a.b": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (16 << 20, 60):
        for r in decontaminate.find_contamination(docs, bench, block_bytes=block).collect():
            ws, hit, met = word(r["text"]), set(), set()
            for item, text in items:
                iw = word(text)
                k = min(10, len(iw))
                for s in range(len(iw) - k + 1) if item is not None and k else ():
                    for p in range(len(ws) - k + 1):
                        if ws[p : p + k] == iw[s : s + k]:
                            hit |= set(range(p, p + k))
                            met.add(str(item))
            assert {x for a, b in r["hits"]["spans"] for x in range(a, b)} == hit
            assert r["hits"]["items"] == sorted(met) and r["hits"]["n_words"] == len(ws)
    assert decontaminate.find_contamination(docs.where("false"), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.where("false")).where("size(hits.spans) > 0").count() == 0


# ---- 10 training order ----
def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 100, 1025):
        x = np.arange(n)
        y = materialise.permute(x, n, key=7)
        assert sorted(y.tolist()) == x.tolist() and (materialise.permute(y, n, key=7, back=True) == x).all()


def test_very_many_equal_rows_come_in_parcels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(materialise, "HOT_ROWS", 100)
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words").alias("text")).union(spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string"))
    got = materialise.materialise(rows, f"file://{tmp_path}/hot", sequence_tokens=128, shard_bytes=1024, stream_bytes=1 << 12)
    assert got.agg(F.sum("n_tokens")).first()[0] == 3000 * 3 + 1 + 2
    assert got.select(F.explode("doc_ids")).where("col is null").count() >= 3000


def test_shards_hold_every_token_at_its_slot(odd, docs, none, tmp_path):
    words = tokenize.word_ids(tokenize.default_vocabulary()).tokenizer
    for name, some in (("a", docs), ("b", odd)):
        path = f"file://{tmp_path}/{name}"
        told = {r["slot"]: r for r in materialise.materialise(some, path, sequence_tokens=512, shard_bytes=8192).collect()}
        read = list(materialise.read_slots(path))
        assert sorted(told) == list(range(len(read)))
        for slot, ids in enumerate(read):
            own = ids[: told[slot]["n_tokens"]]
            assert told[slot]["ids_crc32"] == zlib.crc32(own.astype("<u4").tobytes()) and (ids[len(own) :] == 2).all()
        assert all((a == b).all() for a, b in zip(materialise.read_slots(path, 2, 3), read[2:5], strict=True))
        total = sum(len(words.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in some.select("text").collect())
        assert sum(r["n_tokens"] for r in told.values()) == total
    with_copies = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(docs.limit(30).select("doc_id", "text"))
    files = []
    for n in (2, 5):  # the order depends on the rows, not on how they are split
        materialise.materialise(with_copies.repartition(n), f"file://{tmp_path}/split{n}", sequence_tokens=512, shard_bytes=8192, stream_bytes=1 << 16).collect()
        files.append({p.name: p.read_bytes() for p in (tmp_path / f"split{n}").iterdir() if p.suffix == ".bin"})
    assert files[0] == files[1] and len(files[0]) > 3
    assert not list(tmp_path.rglob(".shard-*"))
    path = f"file://{tmp_path}/none"
    assert materialise.materialise(none, path).count() == 0
    assert json.loads((tmp_path / "none/manifest.json").read_text())["sequences"] == 0 and list(materialise.read_slots(path)) == []
