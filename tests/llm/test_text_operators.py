"""Fingerprints, tokens, language, quality, language model: against brute force and held-out rows."""

import hashlib
import math
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessitura.llm import bpe, langid, lm, quality, simhash, token_counts
from tessitura.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string, fp string, score string"
#: Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns.
EDGES = [
    (1, "The same words over and over again here", "en", "a", 3, "x", "x", "x"),
    (1, "The same words over and over again here", "en", "a", 3, "x", "x", "x"),
    (2, "the SAME words over and over again here", "en", "b", 3, None, None, None),
    (3, "", "en", "a", 0, "", "", ""),
    (4, None, None, None, None, None, None, None),
    (None, "one two", "de", None, None, None, None, None),
    (5, "one two", "de", "b", 7, None, None, None),
    (6, " \t\n ", None, "a", 4, None, None, None),
    (7, "wörter ñandú 日本語 🙂 <|endoftext|>  \n\n x", "de", "a", 4, None, None, None),
    (8, "lorem ipsum dolor " * 20000, "en", "a", 360000, None, None, None),
    (9, "12345 67890 !!", "en", "a", 14, None, None, None),
    (10, "x" * 3000, "en", "a", 3000, None, None, None),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _fingerprint(text, n=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _check_groups(rows, texts, distance=4):
    fps = {i: _fingerprint(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= distance]
    want = {i: i for i in fps} | _components(links)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["fp"] % (1 << 64) == fps[r["doc_id"]]
            assert r["component_id"] == want[r["doc_id"]], r


def test_simhash_equals_brute_force(spark, docs):
    _check_groups(simhash.near_duplicates(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_simhash_edge_cases(spark, edges):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    _check_groups(rows, {e[0]: e[1] for e in EDGES if e[0] is not None})
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [5]
    assert simhash.near_duplicates(edges.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 4, 6])
def test_links_of_dense_fingerprints(spark, distance):
    rng = np.random.default_rng(distance)
    centers = rng.integers(0, 1 << 63, 6)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), False)) for c in centers for _ in range(60)}
    got = {r["fp"]: r["comp"] for r in simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), distance).collect()}
    links = [(a, b) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= distance]
    assert got == {f: f for f in fps} | _components(links)


@pytest.mark.parametrize("parts", [2, 3, 4, 5, 6])
def test_thresholds_keep_the_pigeonhole_promise(parts):
    rng = np.random.default_rng(parts)
    counts = [np.cumsum(rng.random((50, 5)), axis=1) * 1000 for _ in range(parts)]
    units = simhash.allocate(counts, [np.array([1.0, 10, 50, 200, 500])] * parts, 4)
    assert (units.sum(axis=1) == 5).all() and (units >= 0).all()


def test_thresholds_that_no_list_of_probes_holds_raise():
    with pytest.raises(ValueError, match="too many probes"):
        simhash.allocate([np.ones((3, 5))], [np.array([1.0, 10, 50, simhash.UNLISTED, simhash.UNLISTED])], 4)


def test_fingerprints_of_long_texts_in_pieces(monkeypatch):
    texts = [b"", b"a b", b" ".join(b"w%d" % (i % 37) for i in range(500)), b"x y z q", b" ".join(b"v%d" % i for i in range(300)), b""]
    whole = simhash.majority([simhash.shingle_hashes(t, 4) for t in texts])
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert (simhash.majority([simhash.shingle_hashes(t, 4) for t in texts]) == whole).all()
    assert [int(f) for f in whole] == [_fingerprint(t.decode()) for t in texts]


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (7, None), (200, 150)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = _components([p for p in pairs if None not in p])
    assert got == {k: v for k, v in want.items() if k != v}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bpe_equals_the_library(spark, docs, edges):
    path = bpe.default_vocabulary()
    t = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    texts = [(r["doc_id"], r["text"] or "") for r in both.collect()]
    want = Counter()
    for i, x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(both).collect())
    assert got == want
    rows = bpe.encode_stage(edges).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((e[0], e[1]) for e in EDGES)
    assert bpe.encode_stage(edges.limit(0)).count() == 0


def test_bpe_long_words_and_forgetting():
    c, t = bpe.Codec(bpe.read_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("aeinst"), 700)), "ab" * 1000, " " * 999, "".join(map(chr, rng.integers(32, 0x2FF, 3000)))]
    for _ in range(2):
        for x, ids in zip(texts, c.encode_batch(texts), strict=True):
            assert ids.tolist() == t.encode(x, add_special_tokens=False).ids
        c.clear()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, docs, edges, rule):
    t = Tokenizer.from_file(bpe.default_vocabulary())
    both = docs.select("doc_id", "text").limit(40).unionByName(edges.select("doc_id", "text")).unionByName(spark.createDataFrame([(77, "a\n\n\n\nb \n\n c\n")], "doc_id long, text string"))
    own = bpe.Codec(bpe.read_vocabulary())
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["section_tokens"])) for r in token_counts.section_tokens(both, rule=rule).collect())
    want = Counter()
    for r in both.collect():
        data = (r["text"] or "").encode()
        starts = [0, *[i + 1 for i, b in enumerate(data) if b == 10 and i + 1 < len(data)]]
        line = np.zeros(len(data) + 1, int)
        for k, s in enumerate(starts):
            line[s:] = k
        counts, at = [0] * len(starts), 0
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        for i in ids:
            hit = line[at : at + len(own.bytes[i])].tolist()
            at += len(own.bytes[i])
            counts[{"first": hit[0], "last": hit[-1], "most": max(sorted(set(hit)), key=hit.count)}[rule]] += 1
        want[r["doc_id"], len(ids), tuple(counts)] += 1
    assert got == want


def _held(i, folds, out):
    return zlib.crc32(b"" if i is None else str(i).encode()) % folds == out


class _Automaton:
    """States, arcs and failure arcs in dictionaries, walked arc by arc."""

    def __init__(self, texts, order, m):
        self.counts, self.order, self.m = Counter(), order, m
        for words in texts:
            path = [b"", *words]
            for k in range(1, order + 1):
                self.counts.update(tuple(path[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(path)))
        words = {w[0]: c for w, c in self.counts.items() if len(w) == 1}
        self.total, self.words = sum(words.values()), words
        once, twice = (sum(c == n for c in words.values()) for n in (1, 2))
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if twice else lm.DISCOUNT

    def arc(self, state, word):
        """Probability of an arc that is there, or None."""
        c = self.counts.get((*state, word), 0)
        if not c:
            return None
        if not state:
            return (c - self.discount) / self.total
        return (c + self.m * self.arc(state[1:], word)) / (self.counts[state] + self.m)

    def step(self, state, word):
        weight = 1.0
        while (p := self.arc(state, word)) is None:
            if not state:
                return weight * (self.discount * len(self.words) / self.total if self.total else 1.0), ()
            weight *= self.m / (self.counts[state] + self.m)
            state = state[1:]
        after = (*state, word)[-(self.order - 1) :] if self.order > 1 else ()
        return weight * p, after

    def walk(self, words):
        state, out = ((b"",) if self.order > 1 and (b"",) in self.counts else ()), 0.0
        for w in words:
            p, state = self.step(state, w)
            out += math.log10(p)
        return out


@pytest.mark.parametrize("order,block,span", [(1, 100, 1000), (2, 2_000_000, 16_000_000), (3, 3000, 5000), (4, 700, 900)])
def test_language_model(spark, docs, edges, order, block, span):
    """Against an automaton walked arc by arc; blocks and ranges of any size give the same."""
    both = docs.select("doc_id", "text").unionByName(edges.select((F.col("doc_id") + 900_000).alias("doc_id"), "text"))
    rows = lm.score_texts(both, F.col("doc_id") % 3 != 0, order, 2.5, block_tokens=block, range_bytes=span).collect()
    texts = [(r["doc_id"], [*lm.words_of((r["text"] or "").encode()), b""]) for r in both.collect()]
    a = _Automaton([w for i, w in texts if i is not None and i % 3], order, 2.5)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(texts)
    for i, words in texts:
        for r in got[i]:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in a.words for w in words), a.total)
            assert math.isclose(r["base_score"], sum(math.log10((a.words.get(w, 0) + 1) / (a.total + len(a.words) + 1)) for w in words), rel_tol=1e-9)
            assert math.isclose(r["score"], a.walk(words), rel_tol=1e-9), i
    # the probabilities of a state sum to 1 over all words and the unseen one
    rng = np.random.default_rng(0)
    states = [(), *[g for g in a.counts if len(g) < order and not (len(g) > 1 and g[-1] == b"")]]
    for at in rng.choice(len(states), min(12, len(states)), False).tolist():
        mass = sum(a.step(states[at], w)[0] for w in a.words) + a.step(states[at], b"never seen")[0]
        assert abs(mass - 1) < 1e-9


def test_language_model_of_nothing(spark, edges):
    rows = lm.score_texts(edges, F.lit(None).cast("boolean")).collect()
    assert len(rows) == len(EDGES) and all(r["base_score"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in rows)
    assert lm.score_texts(edges.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 50_000])
def test_packed_arrays(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64, False))
    for own in (keys, np.unique(keys & ~np.uint64(255))):
        assert n == 0 or (lm.unpack_keys(lm.pack_keys(own)) == own).all()
    for top in (1, 255, 256, 1 << 40):
        values = rng.integers(0, top, n)
        assert (lm.unpack_ints(lm.pack_ints(values)) == values).all()


def test_language_model_beats_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.op5_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert docs.count() and out["s"] > out["b"]


def test_language_accuracy_and_edges(spark, edges):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = langid.op7_langid(spark, folder).filter("held_out").join(docs, "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.98 * held.count()
    model = langid.fit_outside(docs)
    got = Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(edges, model).collect())
    for i, text, *_ in EDGES:
        if not any(ch.isalpha() for ch in text or ""):
            assert (i, "und") in got
    assert sum(got.values()) == len(EDGES) and all(0 <= r["score"] <= 1 for r in langid.identify(edges, model).collect())
    nothing = langid.train(edges.limit(0))
    assert {r["lang_pred"] for r in langid.identify(edges, nothing).collect()} == {"und"}


def _runs(text):
    """Runs of letters, with marks inside, of the lower-cased tokens of a text."""
    out = []
    for token in text.split():
        own = ""
        for ch in token.lower() + " ":
            if unicodedata.category(ch)[0] == "L" or (own and unicodedata.category(ch)[0] == "M"):
                own += ch
            elif own:
                out.append(own)
                own = ""
    return out


def test_language_scores_equal_brute_force(spark, docs, edges):
    both = docs.select("doc_id", "text", "lang").unionByName(edges.select("doc_id", "text", "lang"))
    rows = both.collect()
    words, grams = {}, {}
    for r in rows:
        if r["text"] is None or r["lang"] is None or len(r["text"]) > langid.TRAIN_CHARS or _held(r["doc_id"], 5, 0):
            continue
        for w in _runs(r["text"]):
            words.setdefault(r["lang"], Counter())[w] += 1
            m = f"^{w}$"
            grams.setdefault(r["lang"], Counter()).update(m[i - n : i] for i in range(1, len(m) + 1) for n in range(1, min(4, i) + 1))
    langs = sorted(words)
    total = sum(words.values(), Counter())
    known = {w for w, n in total.items() if n >= 2}
    of_gram = {g for c in grams.values() for g in c}

    whole = {(lang, 0): sum(n for w, n in words[lang].items() if w in known) for lang in langs}
    whole |= {(lang, k): sum(n for g, n in grams[lang].items() if len(g) == k) for lang in langs for k in (1, 2, 3, 4)}

    def log(kind, entry, lang):
        own, size = (words, len(known)) if kind else (grams, len(of_gram))
        return math.log((own[lang][entry] + 0.5) / (whole[lang, 0 if kind else len(entry)] + 0.5 * (size + 1)))

    memo = {}

    def word(w):
        if w not in memo:
            if w in known:
                memo[w] = [log(True, w, lang) for lang in langs]
            else:
                m, out = f"^{w}$", [0.0] * len(langs)
                for end in range(2, len(m) + 1):
                    g = next((m[end - n : end] for n in range(min(4, end), 0, -1) if m[end - n : end] in of_gram), None)
                    if g is not None:
                        out = [v + 0.5 * log(False, g, lang) for v, lang in zip(out, langs, strict=True)]
                memo[w] = out
        return memo[w]

    some = [r for r in rows if len(r["text"] or "") < 3000][:90] + [r for r in rows if r["doc_id"] is None or r["doc_id"] < 12]
    got = {}
    for r in langid.identify(both, langid.fit_outside(both)).collect():
        got.setdefault(r["doc_id"], set()).add((r["lang_pred"], round(r["score"], 4)))
    for r in some:
        own = _runs(r["text"] or "")
        want = ("und", 0.0)
        if own:
            sums = np.sum([word(w) for w in own], axis=0) / math.sqrt(len(own))
            share = np.exp(sums - sums.max())
            want = (langs[int(share.argmax())], float(share.max() / share.sum()))
        assert any(lang == want[0] and abs(score - want[1]) < 2e-3 for lang, score in got[r["doc_id"]]), (r["doc_id"], want, got[r["doc_id"]])


def test_quality_held_out_and_edges(spark, edges):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.op9_quality(spark, folder).filter("held_out").join(labels, "doc_id")
    assert scored.filter("predicted = quality").count() >= 0.95 * scored.count()
    own = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (9, 0, 1), (None, 1, 0), (5, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(edges, quality.fit(edges, own)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    flat = quality.score_quality(edges, quality.fit(edges, own.limit(0))).collect()
    assert all(r["score"] == 0.5 for r in flat)
    assert quality.score_quality(edges.limit(0), quality.train([], [])).count() == 0


def test_quality_of_a_text_does_not_depend_on_its_neighbours():
    """Every length 0 to 200 (all residues of blocks and windows), alone and between other texts."""
    rng = np.random.default_rng(3)
    net = quality.Network()
    texts = [rng.integers(1, 256, n).astype(np.uint8).tobytes() for n in range(201)]
    alone = np.array([net.score([t])[0] for t in texts])
    assert np.abs(net.score(texts) - alone).max() < 1e-6
    order = rng.permutation(len(texts))
    assert np.abs(net.score([texts[i] for i in order]) - alone[order]).max() < 1e-6


def _naive_quality(p, text):
    """The network by loops over positions: embed, echo, 8-byte filters at every 4th byte, chunks of two blocks, maximum."""
    blocks = max(2, -(-len(text) // 64))
    data = list(text) + [0] * (64 * blocks - len(text))
    echo = [float(i >= 3 and any(i - lag >= 3 and text[i - 3 : i + 1] == text[i - lag - 3 : i - lag + 1] for lag in range(2, 33))) if i < len(text) else 0.0 for i in range(len(data))]
    cells = [np.append(p["embed"][b], e) for b, e in zip(data, echo, strict=True)] + [np.zeros(9)] * 4
    sums, sizes = [], []
    for b in range(blocks):
        at = [i for i in range(64 * b, 64 * b + 64, 4) if i < len(text)]
        sums.append(sum((np.maximum(np.concatenate(cells[i : i + 8]) @ p["conv"] + p["conv_bias"], 0) for i in at), np.zeros(16)))
        sizes.append(len(at))
    chunks = [(sums[b] + sums[b + 1]) / max(sizes[b] + sizes[b + 1], 1) @ p["chunk"] + p["chunk_bias"] for b in range(blocks - 1)]
    peak = np.maximum(np.max(chunks, axis=0), 0)
    return 1 / (1 + math.exp(-(peak @ p["out"] + p["out_bias"][0])))


def test_quality_equals_loops():
    net = quality.Network()
    net.p["conv_bias"][:] = np.linspace(-0.3, 0.3, 16)
    texts = [b"", b"a", b"abc abc abc abc", b"some words | with | bars " * 9, bytes(range(256)) * 2, b"q" * 61, b"xyz " * 32, b"12345678" * 20]
    for text, score in zip(texts, net.score(texts), strict=True):
        assert abs(score - _naive_quality(net.p, text)) < 1e-5, text


def test_quality_learns_from_repeated_ids_once(spark):
    rows = [(1, "good " * 30), (1, "other " * 30), (2, "bad " * 30), (3, "x" * (quality.TRAIN_CHARS + 1)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 5)], "doc_id long, quality int")
    one, two = quality.fit(docs, labels), quality.fit(docs.union(docs).repartition(3), labels)
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_quality_gradients_match_differences():
    net = quality.Network()
    texts, y = [b"some words | with | bars " * 9, b"plain text of a kind " * 14, b"", b"abcd" * 32], np.array([0, 1, 1, 0], np.float32)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    g = net.gradients(texts, y)

    def loss():
        p = np.clip(net.score(texts), 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("out", "chunk", "conv", "conv_bias", "embed"):
        flat, own = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in np.argsort(-np.abs(own))[:3]:
            before, eps = flat[i], 1e-3
            flat[i] = before + eps
            up = loss()
            flat[i] = before - eps
            down = loss()
            flat[i] = before
            assert abs((up - down) / (2 * eps) - own[i]) < 2e-2 * max(abs(own[i]), 1e-2), (name, i)


def test_null_only_tables(spark):
    schema = T.StructType([T.StructField(n, T.LongType() if n in ("doc_id", "n_chars") else T.StringType()) for n in ("doc_id", "text", "lang", "source", "n_chars")])
    nulls = spark.createDataFrame([(None,) * 5] * 3, schema)
    assert simhash.near_duplicates(nulls).count() == 3 and bpe.digests(nulls).count() == 3
    assert langid.identify(nulls, langid.train(nulls)).count() == 3 and lm.score_texts(nulls, F.lit(True)).count() == 3
