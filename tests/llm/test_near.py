"""Near-duplicates by exact similarity: against brute force on texts."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tessitura.llm import near

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def _shingles(text):
    words = _words(text)
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _groups(texts):
    """Component (smallest id) of every id, by comparing every two texts."""
    sets, group = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 10 * len(x & y) >= 8 * len(x | y) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return group


def _kept(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], COLUMNS)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())


def test_stage_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(_groups(texts).values())


@pytest.mark.parametrize("common", [0, 12])
def test_stage_equals_brute_force_on_edited_copies(spark, common):
    """Copies with 1 to 12 replaced words of 150: similarity from well over to well under 0.8, and chains of them."""
    rng = np.random.default_rng(common)
    texts = {}
    for base in range(8):
        words = [f"w{rng.integers(3000)}" for _ in range(150)] + [f"line{k}" for k in range(common)]
        for _ in range(30):
            own = list(words)
            for at in rng.choice(150, rng.integers(1, 13), False):
                own[at] = f"x{rng.integers(10**9)}"
            texts[len(texts)] = " ".join(own[: int(rng.integers(120, 163))])
    want = _groups(texts)
    assert len(set(want.values())) < len(texts) - 20
    assert {i for _, i, _ in _kept(spark, texts.items())} == set(want.values())


def test_sets_without_words_and_short_sets(spark):
    rows = [(1, ""), (2, None), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e f")]
    assert [i for _, i, _ in _kept(spark, rows)] == [1, 4, 6, 7, 8]
    assert near.keep_one_near(spark.createDataFrame([], COLUMNS)).count() == 0


def test_sketches_turn_no_similar_pair_away():
    rng = np.random.default_rng(2)
    turned = 0
    for n in (1, 5, 40, 500, 5000):
        for share in (0.79, 0.8, 0.85, 1.0, 0.0):
            pool = np.unique(rng.integers(0, 1 << 64, 3 * n, np.uint64, False))
            both = int(2 * n * share / (1 + share))
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
            similar = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            may = near.may_be_similar(near.set_sketch(a), near.set_sketch(b))
            assert may or not similar
            turned += not may
    assert turned >= 5 and near.set_sketch(np.arange(300, dtype=np.uint64) << np.uint64(40)) is None and near.may_be_similar(None, b"x")


def test_what_simhash_links_is_not_compared_again(spark, monkeypatch):
    """Copies with one replaced word of 2,000: what SimHash links leaves the prefix filter nothing to compare."""
    rng = np.random.default_rng(4)
    rows = []
    for base in range(3):
        words = [f"w{rng.integers(10**6)}" for _ in range(2000)]
        rows += [(12 * base + k, " ".join(words[: 150 * k] + [f"x{base}y{k}"] + words[150 * k + 1 :])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    write, counts = near.durable, []

    def counted(table, name):
        out = write(table, name)
        if name == "candidates":
            counts[-1] += out.count()
        return out

    def groups():
        counts.append(0)
        return {r["doc_id"]: r["comp"] for r in near.near_groups(df).collect()}

    monkeypatch.setattr(near, "durable", counted)
    linked = groups()
    monkeypatch.setattr(near, "link_fingerprints", lambda fps, distance: fps.select("fp", fps["fp"].alias("comp")).distinct())
    assert groups() == linked and len(set(linked.values())) == 3
    assert counts[0] == 33 < counts[1]
