"""Top-k, chats, media, mixing, registered queries and the pipeline."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm import chat, gif, langid, mixing, quality, registry, topk
from tessitura.llm.common import DOCUMENT_COLUMNS
from test_near import _groups
from test_text_operators import EDGES, SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for n in os.listdir(SF):
        c.execute(f"CREATE VIEW {n.split('.')[0]} AS SELECT * FROM '{SF}/{n}'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.execute(registry.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert got[cols].sort_values(cols).reset_index(drop=True).equals(want[cols].sort_values(cols).reset_index(drop=True))


# --- top-k ----------------------------------------------------------------------------------------------------------


def _brute(rows, k):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p in ok if j != i and len(p) == len(q))
            out[i] = [(j, -v) for v, j in s[:k]]
    return out


@pytest.mark.parametrize("shard", [16, 10_000])
def test_top_k(spark, shard):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 4]) for i in range(150)]
    rows += [(150, None), (160, [None, 1.0, 1.0, 1.0, 1.0]), (170, [float("nan")] * 5), (180, [float("inf")] + [0.0] * 4), (None, [1.0] * 5), (190, [1.0, 2.0]), (191, [0.5, 2.0]), (200, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 7, shard, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {k: v for k, v in _brute(rows, 7).items() if v}
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    df = spark.createDataFrame([(10, [1e12, 1.0]), (1, [1.0, 3.0]), (2, [1.0, 4.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<double>")
    rows = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == [2, 1, 1] and rows[0]["score"] == 1024 * int(1024e12) + 4 * 1024 * 1024


def test_top_k_that_no_long_can_hold(spark):
    df = spark.createDataFrame([(10, [1e18]), (1, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 3).collect()


def test_top_k_skips_shards_of_clustered_vectors(spark):
    """Tight clusters far apart: most shards and leaves can't reach the k-th score; a vector with thousands of copies."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 4)) * 30
    rows = [(i, [float(x) for x in centres[i % 16] + rng.normal(size=4) * 0.01]) for i in range(3000)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000, 5000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counters = {}
    got = {}
    for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0, 5, 128, 16, counters).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    v = np.floor(1024 * np.array([x for _, x in rows])).astype(np.int64)
    scores = v @ v[::100].T
    for at, own in enumerate(range(0, 5000, 100)):
        order = sorted((i for i in range(5000) if i != own), key=lambda i: (-scores[i, at], i))[:5]
        assert got[own] == [(i, scores[i, at]) for i in order]
    assert counters["searched"] < 0.8 * counters["pairs"] and counters["visited"] < counters["leaves"]


def test_tree_boxes_are_tight_and_bounds_hold():
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(500, 6)), rng.normal(size=(9, 6))
    t = topk.KDTree(p, 16)
    bounds = t.bounds(q)
    for node, (a, b) in enumerate(t.span):
        own = p[t.order[a:b]]
        assert (own.min(axis=0) == t.lo[node]).all() and (own.max(axis=0) == t.hi[node]).all()
        assert (q @ own.T).max(axis=1).max() <= bounds[:, node].max() + 1e-9 and ((q @ own.T).max(axis=1) <= bounds[:, node] + 1e-9).all()


# --- chats ----------------------------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "user", "a < b & c <|end|>\n"), (1, 1, "assistant", "<|turn|>user\n&lt; &amp;lt;"), (1, 2, "assistant", "<|next|>"), (1, 3, "user", None), (1, 3, "user", ""),
    (2, None, None, None), (2, 5, "assistant", "x" * 50000), (2, 4, "we\nird<role>", "é🙂\n"), (None, 1, "assistant", "lost"), (3, 0, "assistant", ""),
]


def test_chats_round_trip(spark):
    df = spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    rows = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        want = [(t[2] or "", t[3] or "") for t in own]
        assert [(t["role"], t["text"]) for t in rows[conv]["turns"]] == want
        assert rows[conv]["loss_text"] == "".join(x for r, x in want if r == "assistant")
        blocks = sum(1 for i, (r, _) in enumerate(want) if i == 0 or want[i - 1][0] != r)
        assert rows[conv]["formatted"].count(chat.TURN) == blocks == rows[conv]["formatted"].count(chat.END)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark):
    plan = registry.QUERIES["op6_chat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- media ----------------------------------------------------------------------------------------------------------


def _naive_lzw(codes, bits):
    clear, end = 1 << bits, (1 << bits) + 1
    out, table, last = b"", [], None
    for code in codes:
        if code == clear:
            table, last = [bytes([i]) for i in range(clear)] + [b"", b""], None
        elif code == end:
            break
        else:
            string = table[code] if code < len(table) else last + last[:1]
            out += string
            if last is not None and len(table) < 4096:
                table.append(last + string[:1])
            last = string
    return out


def _pack(codes, bits):
    """An independent encoder's view: widths grow as the reader's table does."""
    clear, size, width, value, at = 1 << bits, 0, bits + 1, 0, 0
    table, first = (1 << bits) + 2, True
    for code in codes:
        value |= code << at
        at += width
        if code == clear:
            table, width, first = (1 << bits) + 2, bits + 1, True
        elif first:
            first = False
        elif table < 4096:
            table += 1
            if table == 1 << width and width < 12:
                width += 1
        size = at
    return value.to_bytes((size + 7) // 8, "little")


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_reads_streams_without_late_clears(bits):
    rng = np.random.default_rng(bits)
    clear, end = 1 << bits, (1 << bits) + 1
    codes, table, first = [clear], clear + 2, True
    for _ in range(9000):  # the table fills up and stays full
        codes.append(int(rng.integers(0, clear)) if first or rng.random() < 0.6 else int(rng.integers(clear + 2, table)) if table > clear + 2 else 0)
        table, first = (table if first else min(table + 1, 4096)), False
    codes.append(end)
    want = _naive_lzw(codes, bits)
    assert gif.lzw_decode(_pack(codes, bits), bits, len(want)) == want


@pytest.mark.parametrize("size", [0, 1, 64, 5000, 70000])
def test_lzw_round_trip(size):
    rng = np.random.default_rng(size)
    for symbols in (1, 3, 256):
        data = bytes(rng.integers(0, symbols, size).astype(np.uint8))
        assert gif.lzw_decode(gif.lzw_encode(data), 8, size) == data


def _file(w, h, frames, palette):
    out = b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([0x80 | 1, 0, 0]) + bytes(palette)
    for left, top, fw, fh, pixels, delay, disposal, transparent, interlaced in frames:
        flags = disposal << 2 | (transparent is not None)
        out += b"\x21\xf9\x04" + bytes([flags]) + delay.to_bytes(2, "little") + bytes([transparent or 0, 0])
        out += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, fw, fh)) + bytes([0x40 if interlaced else 0])
        stream = _pack([4, *sum(([p, 4] for p in pixels), [])[:-1], 5], 2)
        out += b"\x02" + bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def test_frames_disposal_transparency_interlace():
    palette = [0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]
    data = _file(2, 2, [(0, 0, 2, 2, [1, 1, 1, 1], 5, 1, None, False), (0, 0, 2, 1, [2, 3], 7, 2, 3, False), (1, 1, 1, 1, [3], 1, 3, None, False), (0, 0, 1, 1, [2], 1, 0, None, False)], palette)
    w, h, frames = gif.decode_gif(data)
    assert (w, h, [f.delay_ms for f in frames]) == (2, 2, [50, 70, 10, 10])
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    shown = [[tuple(map(int, p)) for row in image for p in row] for image in gif.compose(w, h, frames)]
    assert shown == [[red] * 4, [green, red, red, red], [none, none, red, blue], [green, none, red, red]]
    told = gif.timed_frames(data)
    assert [t["histogram"][0][15] for t in told] == [4, 3, 1, 2] and [t["histogram"][1][15] for t in told] == [0, 1, 0, 1] and [t["time_ms"] for t in told] == [0, 50, 120, 130]
    _, _, (f,) = gif.decode_gif(_file(1, 5, [(0, 0, 1, 5, [0, 1, 2, 3, 1], 0, 0, None, True)], palette))
    assert f.indices[:, 0].tolist() == [0, 3, 2, 1, 1]
    for broken in (b"", b"GIF89a", data[:40], data[:-10]):
        with pytest.raises(ValueError):
            gif.decode_gif(broken)


def test_media_queries(spark):
    texts = [(1, "hello"), (2, None), (3, ""), (4, "é" * 64), (5, "word " * 40000), (5, "hello"), (None, "hello")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    stored = gif.store_media(df)
    rows = gif.read_payloads(stored).collect()
    want = Counter()
    for i, t in texts:
        p = gif.payload_of(t)
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["n_bytes"] == 5}) == 1
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r["n_bytes"], r["doc_id"] or 0)), sorted(texts, key=lambda x: (len((x[1] or "").encode()), x[0] or 0)), strict=True):
        p = gif.payload_of(t)
        parts, screen, shown = -(-len(p) // 65536), b"", Counter()
        for k in range(parts):  # a shorter last frame leaves the rest of the screen as it was
            own = p[65536 * k : 65536 * (k + 1)]
            screen = own + screen[len(own) :]
            shown.update(v >> 4 for v in screen)
        grey = ",".join(str(shown[b]) for b in range(16))
        assert (r["doc_id"], r["feature"]) == (i, f"frames={parts};ms={100 * parts};red={grey};green={grey};blue={grey}")
        assert (r["media_bytes"], r["media_sha256"]) == (len(gif.encode_gif(p)), hashlib.sha256(gif.encode_gif(p)).hexdigest())
    wide = _file(65535, 65535, [(0, 0, 1, 1, [1], 0, 0, None, False)], [0] * 12)
    odd = gif.read_payloads(spark.createDataFrame([(1, 0, wide), (2, 0, None), (3, 0, b"x")], "doc_id long, n_bytes long, media binary")).collect()
    assert all(r["frames"] is None and r["feature"] is None for r in odd) and len(odd) == 3 and gif.timed_frames(wide) is None
    seen = gif.frame_columns(stored.unionByName(spark.createDataFrame([(9, 0, b"junk"), (10, 0, None)], "doc_id long, n_bytes long, media binary"))).collect()
    by = {r["doc_id"]: r["frames"] for r in seen if r["doc_id"] in (9, 10) or r["n_bytes"] == 200000}
    assert by[9] is None and by[10] is None and [f["time_ms"] for f in by[5]] == [100 * i for i in range(len(by[5]))] and len(by[5]) == 4
    assert gif.read_payloads(gif.store_media(df.limit(0))).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------------------


def _fill(sizes, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_equal_iterated_sharing(spark):
    sizes = {"a": 10, "b": 5000, "c": 3, None: 700, "z": 0, "é": 40, "Z": 900}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = _fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
    assert {r["source"]: r["target"] for r in mixing.source_targets(df, range_rows=2).collect()} == got
    many = {f"host{i}": (i * 7919) % 1000 for i in range(500)}
    df = spark.createDataFrame(list(many.items()), "source string, source_size long")
    got, want = {r["source"]: r["target"] for r in mixing.source_targets(df, range_rows=40).collect()}, _fill(many)
    assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_mix_takes_what_it_plans(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 11 else None, "x") for i in range(3000)] + [(1, None, "a", "x"), (None, "a b", None, "x"), (5, "", "q", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1).cast("long"))
    plan = mixing.plan_mix(df)
    got = plan.collect()
    assert len(got) == len(rows) and Counter(map(tuple, got)) == Counter(map(tuple, mixing.plan_mix(df.repartition(7)).collect()))
    assert all(r["copies"] <= 3 for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 0.1 * own[0]["target"] + 60
    assert mixing.mix(df).count() == sum(r["copies"] for r in got) and mixing.plan_mix(df.limit(0)).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        assert after.columns[: len(DOCUMENT_COLUMNS)] == list(DOCUMENT_COLUMNS)
        kept[name] = (before, after)
        before = after
    first, after = kept["quality"]
    net = quality.Network(quality.fit(first, labels))
    want = {r["doc_id"] for r in first.collect() if net.score([(r["text"] or "").encode()])[0] >= 0.3}
    assert {r["doc_id"] for r in after.collect()} == want
    first, after = kept["language"]
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.identify(first, langid.fit_outside(first)).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, lang in pred.items() if lang != "und"}
    first, after = kept["near_duplicates"]
    assert {r["doc_id"] for r in after.collect()} == set(_groups({r["doc_id"]: r["text"] for r in first.collect()}).values())
    assert kept["tokens"][1].count() == kept["mixture"][1].count() and kept["language"][1].count() > 0
    assert kept["tokens"][1].filter("size(ids) <> n_tokens").count() == 0


@pytest.mark.parametrize("rows", ["edges", "nulls", "none"])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, empty and long texts, repeated rows, other columns with clashing names; nothing at all."""
    df = spark.createDataFrame(EDGES, SCHEMA)
    df = {"edges": df, "nulls": df.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]), "none": df.limit(0)}[rows]
    df.withColumn("ids", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (9, 0, 1), (None, 1, 0), (5, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(out) > 0) == (rows == "edges") and all(len(r["ids"]) == r["n_tokens"] for r in out)
    assert {r["text"] for r in out} <= {e[1] for e in EDGES if e[1]}
