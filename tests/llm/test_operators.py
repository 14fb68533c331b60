"""Each operator against brute force, a round trip or held-out accuracy."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomstead.llm.staging import Stage
from loomstead.llm import minhash, mixing, pairwise_quality, piece_bpe, pitman_yor, queries, sharding, simhash, substring_dedup, url_rules, vector_neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def documents(spark, tables, n=200):
    rows = tables("documents").select("doc_id", "text", "lang", "source", "n_chars").limit(n).collect()
    return spark.createDataFrame(rows, DOCS), {r.doc_id: r.text for r in rows}


def test_quality_held_out(spark, tables):
    docs, labels = tables("documents", "sf0.01"), tables("labels", "sf0.01")
    model = pairwise_quality.train(docs, labels)
    got = {r.doc_id: r.score for r in pairwise_quality.score(docs.select("doc_id", "text"), model).collect()}
    rows = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(s >= pairwise_quality.CUT) == q for s, q in rows]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())


def test_bradley_terry_prefers_winners():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    model = pairwise_quality.fit(x, y)
    assert model.weights[0] > 0 > model.weights[1] and np.mean((model.scores(x) >= pairwise_quality.CUT) == y) > 0.95


def test_bradley_terry_weights_are_the_optimum():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((120, 4)), rng.integers(0, 2, 120)
    model, l2 = pairwise_quality.fit(x, y, seed=3), 1e-3
    # The same pairs by hand: every row against PAIRS_EACH of the other mark.
    draw, each = np.random.default_rng(3), pairwise_quality.PAIRS_EACH
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    losers = [b for b in bad for _ in range(each)] + draw.choice(bad, len(good) * each).tolist()
    winners = draw.choice(good, len(bad) * each).tolist() + [g for g in good for _ in range(each)]
    z = [[(v - m) / s for v, m, s in zip(row, x.mean(0), x.std(0), strict=True)] for row in x]
    # choice() is drawn for losers first.
    gradient = [l2 * w for w in model.weights]
    for a, b in zip(winners, losers, strict=True):
        d = [p - q for p, q in zip(z[a], z[b], strict=True)]
        p = 1 / (1 + math.exp(sum(w * v for w, v in zip(model.weights, d, strict=True))))
        gradient = [g - p * v / len(winners) for g, v in zip(gradient, d, strict=True)]
    assert max(map(abs, gradient)) < 1e-6
    strength = sorted(sum(w * v for w, v in zip(model.weights, row, strict=True)) for row in z)
    at = (len(strength) - 1) * len(bad) / len(y)
    assert model.threshold == pytest.approx(strength[int(at)] + (at - int(at)) * (strength[min(int(at) + 1, 119)] - strength[int(at)]))


def test_pieces_equal_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    raw = queries.piece_model()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), piece_bpe.Encoder(piece_bpe.PieceModel(raw))
    rng = random.Random(1)
    letters = "aabbcdeeiotrhnls    \n\t▁0123456789.,é漢字ß벨!#*\x00😀ªth"
    texts = ["", " ", "a", "▁x", "<s>", " " * 70, "a" * 90, "ab" * 400, "=*" * 300] + ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 5, 40, 300) for _ in range(60)]
    ids, counts = own.encode(texts)
    want = [library.encode(t) for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert own.model.decode(ids, counts) == [library.decode(w) for w in want]
    odd = [[rng.choice([rng.randrange(3, 260), rng.randrange(32000)]) for _ in range(rng.randrange(12))] for _ in range(300)]
    flat = np.array(sum(odd, []), np.int32)
    assert own.model.decode(flat, np.array([len(o) for o in odd])) == [library.decode(o) for o in odd]


def test_queue_equals_rounds(monkeypatch):
    model = piece_bpe.PieceModel(queries.piece_model())
    words = ["internationalisation", "aaaaaaaabaaaa", "   deep", "x" * 50]
    want = model.encode_words(words)
    monkeypatch.setattr(piece_bpe, "MAX_ROUNDS", 1)
    got = model.encode_words(words)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_pitman_yor_counts_and_gain(spark, tables):
    docs, texts = documents(spark, tables)
    got = {r.doc_id: r for r in pitman_yor.score(docs).collect()}
    tokens = {i: WORD.findall(low(t)) + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_seating_alone_probabilities():
    table = pitman_yor.alone_table(0.5, 6)
    assert table[1, 1] == pytest.approx(1) and table[2, 2] == pytest.approx(1) and table[2, 1] == 0
    # Three customers at two tables: the lone one is any of three.
    assert table[3, 2] == pytest.approx(1 / 3)


def test_urls(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("deep.org", "/a/b", "block"), ("x.org", "", "block")], "host string, path string, action string")
    urls = ["http://a.net/x", "http://a.net", "https://WWW.Example.NET/en/1?q", "http://example.net/enx", "http://e.org/fr/", "ftp://s.deep.org/a/bc", "http://x.org", "no scheme", None, "", "http://net/", "http://annet/"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    all_rules = [tuple(r) for r in rules.collect()]
    for url, (host, path, rule, verdict) in zip(urls, got, strict=True):
        m = re.search("://([^/?#]*)([^?#]*)", url or "")
        want_host, want_path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(h + p, a) for h, p, a in all_rules if (want_host == h or want_host.endswith("." + h)) and want_path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        assert (host, path, rule, verdict) == (want_host, want_path, *best)


def vectors_by_hand(rows, cosine):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine]
    return links, roots(links, [i for i, _ in rows])


def test_vectors_find_planted_links(spark, monkeypatch):
    monkeypatch.setattr(vector_neardup, "BLOCK", 40)
    monkeypatch.setattr(vector_neardup, "CELL", 30)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 64))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.standard_normal(64) * (0.15 if i % 3 else 0.3)]) for i in range(360)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, []), (1004, [0.0] * 64), (1005, [float("nan")] * 64), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [None] + [1.0] * 63)]
    got = {r.vec_id: r for r in vector_neardup.link_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")).collect()}
    links, comps = vectors_by_hand(rows, 0.95)
    assert sum(r.n_links for r in got.values()) / 2 >= 0.98 * len(links)
    degree = collections.Counter(x for pair in links for x in pair)
    assert all(r.n_links <= degree[i] for i, r in got.items())
    assert {i: r.component_id for i, r in got.items()} == comps and all(r.kept == (i == comps[i]) for i, r in got.items())


def test_vectors_near_the_threshold_are_found(spark, monkeypatch):
    monkeypatch.setattr(vector_neardup, "CELL", 300)
    rng = np.random.default_rng(5)
    x, z = rng.standard_normal((2, 1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    c = rng.uniform(0.9501, 0.955, 1500)[:, None]
    both = np.vstack([x, c * x + np.sqrt(1 - c**2) * z / np.linalg.norm(z, axis=1)[:, None]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    found = {r.vec_id for r in vector_neardup.link_vectors(df).where("n_links = 1").collect()}
    assert len(found) >= 0.985 * 3000 and vector_neardup.plan(3000, 0.95)[0] > 1


def repeats_by_hand(rows, length=50):
    first, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, t in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] != i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats(spark, tables, monkeypatch):
    docs, texts = documents(spark, tables)
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab é") for _ in range(200)) for _ in range(5)]
    rows = list(texts.items())[:120]
    for i in range(150):
        text = ""
        for _ in range(rng.randrange(8)):
            at = rng.randrange(150)
            text += rng.choice(pool)[at : at + rng.randrange(20, 120)] + rng.choice(["", "x", "a" * 80])
        rows.append((5000 + i, text))
    rows += [(9000, None), (9001, ""), (9002, "a" * 300), (9003, "a" * 700), (9004, "ab" * 300), (9005, "long" * 40_000), (None, "a" * 100 + "z")]
    monkeypatch.setattr(substring_dedup, "PIECE", 512)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == repeats_by_hand(rows)


def test_repeats_in_many_blocks(spark, monkeypatch):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abc ") for _ in range(300)) for _ in range(20)]
    rows = [(i, "".join(rng.choice(pool)[at : at + 90] + str(i) for at in rng.sample(range(200), 3))) for i in range(1500)] + [(None, pool[0]), (7000, None)]
    total = sum(len(t or "") for _, t in rows)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", total // 600)
    blocks, bundle, parts = substring_dedup.layout(total)
    assert blocks >= 600 and bundle == substring_dedup.BUNDLE > 1 and parts == blocks // 2
    df = spark.createDataFrame([(i, t, f"tag {i}") for i, t in rows], "doc_id long, text string, tag string")
    got = substring_dedup.remove_repeats(df, carry=("tag",)).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == repeats_by_hand(rows) and all(r.tag == f"tag {r.doc_id}" for r in got)
    # Rows between the steps: one for a bundle and part, not one for each block and part.
    table = pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows]), "block": pa.array([i % 8 for i in range(len(rows))], pa.int32()), "bundle": pa.array([0] * len(rows), pa.int32())})
    anchors = substring_dedup._find_anchors(5)(table)
    assert sorted(anchors.column("part").to_pylist()) == [0, 1, 2, 3, 4]
    shared = pa.concat_tables([substring_dedup._shared_anchors(anchors.slice(k, 1)) for k in range(5)])
    sent = substring_dedup._cut_segments(5)(table, shared)
    assert sorted(sent.column("part").to_pylist()) == [-1, 0, 1, 2, 3, 4]


def test_transform_files_are_written_over(monkeypatch, tmp_path):
    opened = []
    monkeypatch.setattr(substring_dedup, "open", lambda path, mode: opened.append((path, mode)) or open(path, mode), raising=False)
    parts = [b"abcabcabc", b"bcabca", b"cab"]
    substring_dedup.transformed(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), str(tmp_path))
    emptied = [path for path, mode in opened if mode == "wb"]
    assert len(opened) > 20 and len(emptied) == len(set(emptied))


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 18])
def test_transform_and_common_prefixes(monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(substring_dedup.ColumnwiseTransform, "CHUNK", chunk)
    rng = random.Random(chunk)
    parts = ["".join(rng.choice("aab") for _ in range(rng.randrange(1, 14))).encode() for _ in range(12)] + [b"zzzz", b"a", b"abab" * 6]
    parts = list(dict.fromkeys(parts))
    bwt = substring_dedup.transformed(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), str(tmp_path))
    codes = {b: i + 1 for i, b in enumerate(sorted(set(b"".join(parts))))}
    every = sorted((p[k:], i, codes[p[k - 1]] if k else 0) for i, p in enumerate(parts) for k in range(len(p) + 1))
    symbols, common = (np.fromfile(path, np.uint8).tolist() for path in bwt.paths)
    assert symbols == [c for _, _, c in every]
    assert common == [0] + [len(os.path.commonprefix([a, b])) for (a, _, _), (b, _, _) in zip(every, every[1:], strict=False)]


def test_equal_spans_and_collisions(monkeypatch):
    data = np.frombuffer(b"abcabcxbcabd", np.uint8)
    starts, sizes = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 3])
    want = substring_dedup.alike(data, starts, sizes)
    assert want[0] == want[1] and len(set(want.tolist())) == 3
    monkeypatch.setattr(substring_dedup, "span_hashes", lambda d, a, b: np.zeros(len(a), np.uint64))
    got = substring_dedup.alike(data, starts, sizes)
    assert got[0] == got[1] and len(set(got.tolist())) == 3


def test_sharding_balance_and_slots(spark, tables):
    docs = tables("documents", "sf0.01").select("doc_id", "text")
    hot = spark.range(10_000, 10_600).selectExpr("id AS doc_id", "repeat('same text ', 20) AS text")
    rows = sharding.shard(docs.union(hot)).toPandas()
    assert len(rows) == docs.count() + 600 and set(rows["shard"]) == set(range(24))
    size = rows.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.05
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 8 for r in rows.itertuples() if r.doc_id in texts)


def packed_by_hand(vectors, shards):
    totals = [max(1, sum(v[d] for v in vectors)) for d in range(3)]
    unit = [[v[d] / totals[d] * shards for d in range(3)] for v in vectors]
    free, placed = [[1.0] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(unit)), key=lambda k: (-max(unit[k]), -sum(unit[k]), k)):
        able = [s for s in range(shards) if free[s][0] + sharding.SLACK >= unit[i][0]] or list(range(shards))
        placed[i] = max(able, key=lambda s: (round(sum(f * u for f, u in zip(free[s], unit[i], strict=True)), 12), -s))
        free[placed[i]] = [f - u for f, u in zip(free[placed[i]], unit[i], strict=True)]
    return [placed[i] for i in range(len(unit))], free


def test_packing_by_hand():
    rng = np.random.default_rng(4)
    vectors = np.column_stack([rng.integers(1, 1000, 300), rng.integers(1, 200, 300), rng.integers(1, 9, 300)]).astype(float)
    placed, free = packed_by_hand(vectors.tolist(), 7)
    assert sharding.pack(vectors, 7).tolist() == placed
    assert max(abs(f[0]) for f in free) < 0.02


def test_groups_that_fit_stay_whole(spark):
    # One group of half a shard, one of three shards.
    rows = [(i, f"text {i} of its own") for i in range(2400)] + [(5000 + i, "half a shard, group") for i in range(70)] + [(9000 + i, "three shards of one text") for i in range(420)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 20).toPandas()
    text = dict(rows)
    where = got.groupby(got["doc_id"].map(text))["shard"].nunique()
    assert where["half a shard, group"] == 1 and where["three shards of one text"] >= 3 and (where.drop("three shards of one text") == 1).all()
    size = got.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.1


def test_simhash_edits(spark, tables, monkeypatch):
    docs, texts = documents(spark, tables)
    monkeypatch.setattr(simhash, "RUN_ROWS", 31)
    got = {r.doc_id: r for r in simhash.edited_fingerprints(docs).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(text) // 4
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
        assert got[i].next_fp == got[ids[(k + 1) % len(ids)]].fp
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert np.mean([far(r.fp, r.edited_fp) < far(r.fp, r.next_fp) for r in got.values()]) > 0.95


def test_hamming_search_is_complete(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(1, 6))) for b in base]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    copies = {v: 1 + k % 3 for k, v in enumerate(dict.fromkeys(signed))}
    want = {a: n for a in copies if (n := sum(c for b, c in copies.items() if b != a and near(a, b)))}
    for blocks in (4, 5, 6):
        monkeypatch.setattr(simhash, "key_blocks", lambda n, radius, blocks=blocks: blocks)
        assert {r.fp: r.near for r in simhash.within_radius(spark.createDataFrame(list(copies.items()), "fp long, copies long"), 3).collect()} == want
    rows = [v for v, c in copies.items() for _ in range(c)]
    found = simhash.near_fingerprints(spark.createDataFrame(list(enumerate(rows)), "id long, fp long")).collect()
    assert len(found) == len(rows) and all(r.n_near == want.get(r.fp, 0) + copies[r.fp] - 1 for r in found)
    assert simhash.near_fingerprints(spark.createDataFrame([], "id long, fp long")).count() == 0


def test_key_blocks():
    assert simhash.key_blocks(10, 3) == 4 and 64 * (simhash.key_blocks(10**9, 3) - 3) / simhash.key_blocks(10**9, 3) >= 27


def test_mixing_targets(spark, tables):
    rows = mixing.draw(tables("documents", "sf0.01")).toPandas()
    assert (rows["copies"] <= 2).all() and (rows["copies"] >= 0).all()
    taken = (rows["copies"] * rows["size"]).groupby(rows["source"]).sum()
    target = rows.groupby("source")["target"].first()
    longest = rows.groupby("source")["size"].max()
    assert (abs(taken - target) <= longest).all() and abs(taken.sum() / target.sum() - 1) < 0.02
    again = mixing.draw(tables("documents", "sf0.01").repartition(3)).toPandas()
    assert dict(zip(rows["doc_id"], rows["copies"], strict=True)) == dict(zip(again["doc_id"], again["copies"], strict=True))


@pytest.mark.parametrize(("sizes", "share", "want"), [([100, 100, 800], 1.5, [200, 200, 1100]), ([0, 0], 1.5, [0, 0]), ([10, 10, 10, 1000], 1.5, [20, 20, 20, 1485]), ([10, 20], 3.0, [20, 40]), ([1000, 10], 0.5, [485, 20])])
def test_water_filling(spark, sizes, share, want):
    table = spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)], "source string, source_size long, rows long")
    got = {r.source: r.target for r in mixing.targets(table, Stage(spark, "test"), (5.0, 2.0, 1.0), share, 2.0).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def near_by_hand(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    met = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            met[g].append(i)
    common = collections.Counter((a, b) for ids in met.values() for x, a in enumerate(ids) for b in ids[x + 1 :])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    return sets, roots(links, list(sets))


def test_near_duplicates(spark, tables, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(60)]
    rows = list(documents(spark, tables)[1].items())
    for i in range(160):
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((5000 + i, " ".join(text)))
    rows += [(9000, None), (9001, ""), (9002, " \t"), (9003, "a b"), (9004, "A  b"), (9005, "a"), (9006, "x y " * 30_000), (9007, "X y " * 30_000)]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    sets, comps = near_by_hand(rows, 4, 80)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comps[i], comps[i] == i) for i in sets}
