"""Near copies of the pipeline against all pairs, with null and repeated ids."""

from collections import Counter

import corpus_pipeline as pipeline
import numpy as np

from sprachwerk.llm import nearcopies, simhash
from sprachwerk.llm.common import table, written


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(texts):
    """The class of each text: what is reachable over pairs of Jaccard 0.8 or more."""
    own = {t: shingles(t) for t in texts}
    sets = sorted(set(own.values()), key=len)
    at, holders = {s: i for i, s in enumerate(sets)}, {}
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders.get(x, ()))
        for j, n in shared.items():
            if 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            holders.setdefault(x, []).append(i)
    return {t: find(at[s]) for t, s in own.items()}


def kept_are_one_per_class(docs, kept):
    of = classes([r["text"] for r in docs])
    least = {}
    for r in docs:
        rank = (r["doc_id"] is None, r["doc_id"] or 0)
        least[of[r["text"]]] = min(rank, least.get(of[r["text"]], rank))
    got = {of[r["text"]]: (r["doc_id"] is None, r["doc_id"] or 0) for r in kept}
    assert len(kept) == len(got)
    assert got == least


def test_stage_is_all_pairs_of_five_words(spark, data):
    docs = table(spark, f"{data}/sf0.01", "documents")
    kept = dict(pipeline.STAGES)["near_copies"](spark, docs, f"{data}/sf0.01")
    kept_are_one_per_class(docs.collect(), kept.collect())


def test_stage_links_at_the_line(spark):
    words = [f"w{i}" for i in range(64)]
    # changing the last n words of 64 leaves 60 - n of 60 shingles: 54/66 is above 0.8, 53/67 below
    texts = [" ".join(words[: 64 - n] + [f"{n}x{i}" for i in range(n)]) for n in (0, 6, 7)]
    texts = [*texts, "a b", "A  b", "", None, " \n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "alone without id"), (None, "another without id"), (3, "same id as a b"), (3, "same id as a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = dict(pipeline.STAGES)["near_copies"](spark, docs, "").collect()
    kept_are_one_per_class(docs.collect(), kept)
    assert {r["doc_id"] for r in kept} == {0, 2, 3, 5, None}
    assert dict(pipeline.STAGES)["near_copies"](spark, docs.where("false"), "").count() == 0


def test_simhash_step_is_all_pairs_of_fingerprints(spark, data):
    rows = nearcopies._sketches(table(spark, f"{data}/sf0.01", "documents")).select("node", "fp").distinct()
    got = {r["node"]: (r["fp"], r["group"]) for r in nearcopies.simhash_groups(written(rows, "test-nodes")).collect()}
    assert len(got) == rows.count()
    fps = np.array(sorted({fp for fp, _ in got.values()}), np.int64)
    label = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count((fps ^ fps[i]).view(np.uint64)) <= 5):
            label[label == label[j]] = label[i]
    whole = dict(zip(fps.tolist(), label.tolist(), strict=True))
    pairs = {(whole[fp], group) for fp, group in got.values()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) < len(fps)


def test_stage_links_by_simhash_where_minima_say_nothing(spark, monkeypatch):
    def never(values):
        return lambda i, rest: np.zeros(len(rest), bool)

    monkeypatch.setattr(nearcopies, "_near_bits", never)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "one", "more"]), " ".join(f"v{i}" for i in range(400))]
    fps = [simhash.majority(nearcopies.shingle_set(t.encode())) for t in texts]
    assert 0 < (fps[0] ^ fps[1]).bit_count() <= 5 < (fps[0] ^ fps[2]).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in dict(pipeline.STAGES)["near_copies"](spark, docs, "").collect()} == {0, 2}


def test_stage_verifies_what_simhash_links(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "DISTANCE", 7)
    words = [f"w{i}" for i in range(64)]
    # 53 of 67 shingles are below the line, however few bits differ
    others = [" ".join(words[:57] + [f"{k}x{i}" for i in range(7)]) for k in range(300)]
    fps = [simhash.majority(nearcopies.shingle_set(t.encode())) for t in [" ".join(words), *others]]
    near = min(others, key=lambda t: (fps[0] ^ fps[1 + others.index(t)]).bit_count())
    assert (fps[0] ^ fps[1 + others.index(near)]).bit_count() <= 7
    docs = spark.createDataFrame([(0, " ".join(words)), (1, near)], "doc_id long, text string")
    assert dict(pipeline.STAGES)["near_copies"](spark, docs, "").count() == 2
