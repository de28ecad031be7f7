"""Every operator against brute force, on the small tables and on odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.llm import attention_quality as AQ
from weftline.llm import block_ann, components, context_tree, jaccard_join, line_quality, mixing, packing, secret_scan, token_counts, warc_store
from weftline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(small):
    return pd.read_parquet(f"{small}/documents.parquet").set_index("doc_id").text


# ---- packing


def check_plan(h, caps):
    p = packing.plan(h, caps)
    counts, content = Counter(), defaultdict(list)
    for length, _, n, first, each, fill in p.placed.tolist():
        counts[length] += n
        for i in range(n):
            content[first + i // each].append((fill + i % each * length, length))
    assert counts == Counter(h)
    sizes = {b + i: (c, f) for b, n, c, f in p.bins.tolist() for i in range(n)}
    assert set(sizes) == set(content)
    for b, items in content.items():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert (min(c for c in caps if c >= at), at) == sizes[b]
    return p


def test_plans_are_packings():
    rng = random.Random(1)
    for _ in range(200):
        caps = sorted(rng.sample([8, 12, 16, 32, 48, 64], 3))
        check_plan({rng.randint(1, caps[-1]): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}, caps)


def test_plan_is_best_fit_with_one_size():
    """With one capacity and one piece at a time the plan is plain best-fit decreasing."""
    rng = random.Random(2)
    for _ in range(100):
        h = Counter(rng.randint(1, 20) for _ in range(60))
        rooms = []
        for x in sorted(h.elements(), reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(20 - x)
        fills = sorted(f for _, n, _, f in check_plan(h, [20]).bins.tolist() for _ in range(n))
        assert fills == sorted(20 - r for r in rooms)


def cheapest(pieces, caps, costs):
    """The least cost of any packing, by trying all."""
    best = math.inf

    def place(i, bins):
        nonlocal best
        if sum(min(costs[c] for c in caps if c >= b) for b in bins) >= best:
            return
        if i == len(pieces):
            best = sum(min(costs[c] for c in caps if c >= b) for b in bins)
            return
        for j in range(len(bins)):
            if bins[j] + pieces[i] <= caps[-1]:
                place(i + 1, [*bins[:j], bins[j] + pieces[i], *bins[j + 1 :]])
        place(i + 1, [*bins, pieces[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("caps", [[4, 8, 16], [10, 13, 20], [6, 7]])
def test_plans_of_several_sizes_are_near_the_cheapest(caps):
    rng, ratios = random.Random(3), []
    costs = {c: c + 1 for c in caps}
    for _ in range(60):
        pieces = [rng.randint(1, caps[-1]) for _ in range(rng.randint(1, 7))]
        made = packing.plan(Counter(pieces), caps, costs)
        ratios.append(sum(n * costs[c] for _, n, c, _ in made.bins.tolist()) / cheapest(sorted(pieces, reverse=True), caps, costs))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.35 and sum(ratios) / len(ratios) < 1.06


def test_sequences_follow_the_rows(spark, tmp_path):
    spark.range(500).selectExpr("id as doc_id", "repeat('w ', int(1 + id * 7919 % 400)) as text").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    rows = packing.pack(spark.read.parquet(f"{tmp_path}/docs")).toPandas()
    first = rows.groupby("sequence").doc_id.min()
    assert first.is_monotonic_increasing and list(first.index) == list(range(1, rows.bin_id.nunique() + 1)) and len(rows) == 500
    for _, same in rows.sort_values("doc_id").groupby("length"):  # of equal pieces the earlier ones are in the plan's earlier places
        assert same.doc_id.is_monotonic_increasing and len(set(zip(same.bin_id, same.bin_offset))) == len(same)
    none = packing.pack(spark.createDataFrame([(1, 0), (2, None), (3, 5)], "doc_id long, size int"), F.col("size")).toPandas().set_index("doc_id")
    assert none.bin_id.isna().to_dict() == {1: True, 2: True, 3: False} and none.length.to_dict() == {1: 0, 2: 0, 3: 5}


def test_pack_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs).toPandas()
    assert len(rows) == odd_docs.count() - 1 + math.ceil(60_001 / 4096)
    long = rows[rows.doc_id == 10].sort_values("piece")
    assert long.length.sum() == 60_001 and (long.start == long.length.cumsum() - long.length).all()
    for _, b in rows.groupby("bin_id"):
        b = b.sort_values("bin_offset")
        assert (b.bin_offset == b.length.cumsum() - b.length).all() and b.length.sum() == b.bin_fill.iloc[0] <= b.bin_capacity.iloc[0]
    assert packing.pack(no_docs).count() == 0


# ---- neighbours


def inner(x, y):
    total = 0.0
    for a, b in zip(x.tolist(), y.tolist()):  # sum() would compensate
        total += a * b
    return total


def brute(ids, x, q, k):
    scores = [(-inner(x[q], y), i) for i, y in zip(ids, x) if i != ids[q]]
    return [(i, -s) for s, i in sorted(scores)[:k]]


@pytest.mark.parametrize("limits", [{}, {"QUERY_BLOCK": 7, "CANDIDATE_BLOCK": 40, "QUERY_PART": 3, "CANDIDATE_PART": 6}, {"CANDIDATE_BLOCK": 50, "MOST_SURVIVORS": 0.5, "CANDIDATE_PART": 8}])
def test_neighbours(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(block_ann, k, v)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 9)).astype(np.float32)
    x[20:90] = x[20]  # many equal vectors
    rows = [(i, v.tolist(), 0, 1.0) for i, v in enumerate(x)] + [(150, None, 0, 1.0), (160, [0.0] * 9, 0, 1.0), (170, [math.nan] + [1.0] * 8, 0, 1.0), (180, [None] + [1.0] * 8, 0, 1.0), (190, [math.inf] * 9, 0, 1.0), (200, [1.0], 0, 1.0), (None, [1.0] * 9, 0, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = defaultdict(list)
    for r in block_ann.nearest(df, F.col("vec_id") % 10 == 0, 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 150, 10))
    for q, found in got.items():
        assert [(c, s) for _, c, s in sorted(found)] == brute(list(range(150)), x, q, 20) and sorted(r for r, _, _ in found) == list(range(1, 21))


def test_sizes_of_any_order(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)) * 10.0 ** rng.choice([-320, -300, -10, 0, 100, 150], size=(60, 1))
    x = x[np.abs(x).max(axis=1) > 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in block_ann.nearest(df, F.col("vec_id") % 7 == 0, 5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    with np.errstate(over="ignore", invalid="ignore"):
        for q in range(0, len(x), 7):
            scores = [inner(x[q], y) for y in x]
            found = sorted(got[q])
            assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
            worst = found[-1][2]
            assert all(s == scores[c] for _, c, s in found) and all(not s > worst for c, s in enumerate(scores) if c != q and c not in {c for _, c, _ in found})


def test_few_or_no_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    assert block_ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).count() == 0
    assert [tuple(r) for r in block_ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], schema), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.5)]


# ---- mixing


def test_schedules_match_a_search_of_every_slot():
    """Slot by slot, over all sources: the released block with the earliest deadline, in exact fractions."""
    rng = random.Random(14)
    for _ in range(40):
        weights = {f"s{i}": rng.choice([0.1, 0.25, 1 / 3, rng.random(), 2.0]) for i in range(rng.randint(1, 8))}
        blocks = {s: rng.randint(0, 40) for s in weights}
        share = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
        done, slot, want = Counter(), 0, []
        while any(done[s] < blocks[s] for s in weights):
            ready = [(math.ceil((done[s] + 1) / share[s]), -share[s], i, s) for i, s in enumerate(weights) if done[s] < blocks[s] and math.floor(done[s] / share[s]) <= slot]
            if ready:
                deadline, _, _, s = min(ready)
                want.append((s, done[s], slot, math.floor(done[s] / share[s]), deadline))
                done[s] += 1
            slot += 1
        assert list(mixing.whole_schedule(weights, blocks)) == want


def test_schedule_rows(odd_docs, no_docs):
    rows = mixing.schedule(odd_docs, {"s": 3.0, "t": 1.0}, block_rows=2).toPandas()
    assert len(rows) == odd_docs.count() and not rows.duplicated(["slot", "place"]).any()
    for _, one in rows.groupby("source", dropna=False):
        assert sorted(one.block * 2 + one.place) == list(range(len(one)))
    assert mixing.schedule(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == odd_docs.count()


def test_given_weights_hold_over_the_whole_horizon(spark, monkeypatch):
    cases = [{"big": 0.5} | {f"s{i}": 0.025 for i in range(20)}, {"big": 0.5} | {f"s{i}": 0.0005 for i in range(1000)}, {"a": 0.9999, "b": 0.0001}, {f"s{i}": n**0.5 for i, n in enumerate([66_667, *[7_000] * 19])}]
    for weights in cases:
        total, seen, last = math.fsum(weights.values()), Counter(), {}
        blocks = {s: math.ceil(20_000 * w / total) for s, w in weights.items()}
        for s, j, slot, release, deadline in mixing.whole_schedule(weights, blocks):
            share = weights[s] / total
            # before and after each of its blocks: its deviation is largest there
            assert release <= slot < deadline and j == seen[s] and abs(j - share * slot) < 1 + 1e-6 and abs(j + 1 - share * (slot + 1)) < 1 + 1e-6
            assert slot > last.get(None, -1)
            seen[s], last[None] = j + 1, slot
        assert seen == blocks
    # a run-out source leaves its slots empty; sources without a weight come last
    late = list(mixing.whole_schedule({"a": 0.5, "b": 0.5, "c": 0}, {"a": 1, "b": 4, "c": 2}))
    assert [x[2] for x in late if x[0] == "b"] == [1, 2, 4, 6] and [x[0] for x in late[-2:]] == ["c", "c"]
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) as source")
    want = sorted(map(tuple, mixing.schedule(df, {"a": 0.3, "b": 0.7}, block_rows=8).collect()), key=str)
    monkeypatch.setattr(mixing, "PIECE", 100)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    assert len(want) == 3000 and sorted(map(tuple, mixing.schedule(df, {"a": 0.3, "b": 0.7}, block_rows=8).collect()), key=str) == want


# ---- quality


def plain_features(text):
    """Of each passage of 80 words, by loops: the shares of byte classes, and statistics of its words."""
    data = text + b"\n"
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    starts = [0] + [words[i][0] for i in range(80, len(words), 80)] + [len(data)]
    kind = lambda c: "lower" if 97 <= c <= 122 else "upper" if 65 <= c <= 90 else "digit" if 48 <= c <= 57 else "newline" if c == 10 else "blank" if c in b" \t\v\f\r" else "high" if c > 127 else "stop" if c in b".,;:?!" else "symbol" if c in b"#*$%&|<>@{}[]\\^~_=+/" else "other"
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for k, (a, b) in enumerate(zip(starts, starts[1:])):
        own = [w for _, w in words[80 * k : 80 * k + 80]]
        low, n, part = [w.translate(lower) for w in own], max(1, len(own)), data[a:b]
        classes, lengths = Counter(map(kind, part)), [len(w) for w in own] or [0]
        mean = sum(map(len, own)) / n
        spread = math.sqrt(max(0, sum(x * x for x in lengths) / n - mean**2))
        letters = max(1, classes["lower"] + classes["upper"])
        yield [classes[c] / len(part) for c in AQ.CLASSES] + [mean / 10, spread / 5, sum(65 <= w[0] <= 90 for w in own) / n, len(set(low)) / n, sum(x == y for x, y in zip(low, low[1:])) / n, max(Counter(low).values(), default=0) / n, math.log1p(len(own)) / 5, classes["upper"] / letters, (classes["high"] / len(part)) ** 0.5]


def test_features_and_scores_match_plain_ones(docs):
    texts = [t.encode() for t in [*docs.iloc[:60], "", "  \n", "A a B! é", "x " * 500, " lead and  gaps \n" * 30]]
    x = np.concatenate([a for a, _ in AQ.encoded(texts)])
    n = np.concatenate([b for _, b in AQ.encoded(texts)])
    want = [list(plain_features(t)) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert np.allclose(x[:, : len(AQ.CLASSES) + 9], np.concatenate(want), atol=1e-9)
    hashed = x[:, len(AQ.CLASSES) + 9 :]
    assert np.allclose(np.linalg.norm(hashed[np.linalg.norm(hashed, axis=1) > 0.999], axis=1), 1)
    model = AQ.learn(np.split(x, np.cumsum(n)[:-1]), np.arange(len(n)) % 2.0, epochs=1)
    got, p = model.score(x, n), model.p
    sig = lambda v: 1 / (1 + math.exp(-v))
    for bag, score in zip(np.split(x, np.cumsum(n)[:-1]), got):
        e = [np.tanh((row - p["mean"]) / p["spread"] @ p["W"] + p["b"]) for row in bag]
        raw = [float(np.tanh(v @ p["V"]) * np.array([sig(y) for y in v @ p["U"]]) @ p["w"]) for v in e]
        power = [math.exp(r - max(raw)) for r in raw]
        assert score == pytest.approx(sig(float(sum(a * v for a, v in zip(power, e)) / sum(power) @ p["c"] + p["d"][0])))
    long = b" ".join(texts[:60]) * 3
    parts = [*AQ.whole_passages(long, 3000)]
    assert b"".join(t for t, _ in parts) == long and np.array_equal(np.concatenate([AQ.encode([t], last)[0] for t, last in parts]), AQ.encode([long])[0])


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, AQ.FEATURES)) for n in (1, 3, 2)]
    model, label, n = AQ.learn(bags, np.array([1.0, 0, 1]), epochs=1), np.array([1.0, 0, 1]), np.array([1, 3, 2])
    x = np.concatenate(bags)
    loss = lambda: float(-np.mean(np.log(np.where(label == 1, y := model.score(x, n), 1 - y))))
    grads = model.gradients(model.forward(x, n), label)
    for k in "WbVUwcd":
        at = tuple(0 for _ in model.p[k].shape)
        kept = model.p[k][at]
        model.p[k][at] = kept + 1e-5
        up = loss()
        model.p[k][at] = kept - 1e-5
        down = loss()
        model.p[k][at] = kept
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op4_attention_quality"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id")
    both = labels.join(got)
    held = both[both.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    assert (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1), (11, 0), (11, 1)], "doc_id long, quality int")
    got = AQ.quality_scores(odd_docs, labels)
    assert got.count() == odd_docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert AQ.quality_scores(no_docs, labels).count() == 0
    assert {r.score for r in AQ.quality_scores(odd_docs, labels.where("false")).collect()} == {0.5}


# ---- archive


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>", 0), (2, "http://b", "<p>x</p>", 0), (3, None, None, 0), (4, "u\r\nv", "", 0), (5, "http://c", "é\r\n\r\nWARC/1.1\r\n", 0), (5, "http://c", "é\r\n\r\nWARC/1.1\r\n", 0), (None, "http://n", "alone", 0), (8, "http://l", "y" * 300_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, top int")
    back = warc_store.read_archive(spark, warc_store.write_archive(pages))
    got = back.toPandas()
    assert len(got) == len(rows)
    want = Counter((p, h.encode() if h else b"") for p, _, h, _ in rows)
    assert Counter((None if pd.isna(p) else int(p), bytes(b)) for p, b in zip(got.rid, got.payload)) == want
    for r in got.itertuples():
        header, block = next(warc_store.parse_warc(bytes(r.record)))
        assert header == bytes(r.header) and block == (bytes(r.payload) if r.kind == "response" else b"")
        assert r.digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
    kinds = {None if pd.isna(r.rid) else int(r.rid): (r.kind, None if pd.isna(r.refers_to) else int(r.refers_to)) for r in got.itertuples()}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None), 8: ("response", None)}
    warc_store.export_warc(back, f"file://{tmp_path}/warc")
    files = warc_store.import_warc(spark, f"file://{tmp_path}/warc/part-*").toPandas()
    assert Counter(map(bytes, files.header)) == Counter(map(bytes, got.header))
    assert Counter(map(bytes, files.block)) == Counter(bytes(r.payload) if r.kind == "response" else b"" for r in got.itertuples())
    assert warc_store.page_records(pages.where("false")).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "xyz"), (4, "d", "xyz")], "page_id long, url string, html string")
    back = warc_store.read_archive(spark, warc_store.write_archive(pages, min_bytes=2))
    assert {r.rid: r.kind for r in back.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


# ---- tokens


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_match_the_library(spark, docs, odd_docs, no_docs, library, monkeypatch):
    lib, path = library
    rng = random.Random(5)
    model = token_counts.load_model(path)
    whole = token_counts.prove_whole(model)
    assert all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in rng.sample(whole, 2000))
    texts = [*docs, "a<|endoftext|>b <|endoftext|><|endoftext|>", "  \n\n x ", "y" * 3000, "don't we'll", "　é ü 12ab \U0001f600", *("".join(rng.choice("ab eE\n'sté1!") for _ in range(400)) for _ in range(200))]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert list(map(token_counts.Counter(model, whole).count, texts)) == want
    monkeypatch.setattr(token_counts, "PIECE", 50)
    monkeypatch.setattr(token_counts.Merger, "SHORT", 6)
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    assert list(map(token_counts.Counter(model, whole).count, texts)) == want
    got = token_counts.token_counts(odd_docs, path).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(got) == odd_docs.count() and all((r.n_tokens, r.n_bytes, r.over_limit) == (n := len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids), len(texts[r.doc_id].encode()), n > 512) for r in got)
    assert token_counts.token_counts(no_docs, path).count() == 0


# ---- near duplicates


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def classes(texts):
    """Of each id: shingles, least id reachable, links."""
    sets = {i: shingles(t) for i, t in texts.items()}
    lists, shared, up, links = defaultdict(list), Counter(), {i: i for i in texts}, Counter()
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for m in lists.values():
        for k, a in enumerate(m):
            for b in m[k + 1 :]:
                shared[a, b] += 1

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), o in shared.items():
        if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            links[a] += 1
            links[b] += 1
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: (len(sets[i]), top(i), links[i]) for i in texts}


def variants(rng, n):
    base = [[f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 120))] for _ in range(n // 8)]
    common = [f"c{i}" for i in range(60)]
    out = {}
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        if rng.random() < 0.3:
            w += common[: rng.randint(5, 60)]
        out[i] = " ".join(w).title() if rng.random() < 0.2 else " ".join(w)
    return out


@pytest.mark.parametrize("limits", [{}, {"COMMON": 2, "LIST": 3, "SHARE": 2000, "MOST_NODES": 5, "SAMPLED": 2, "SEEN": 4, "HEAVY": 2, "LOOKED_AT": 20, "BLOCK_SETS": 3, "COLUMNS": 7}, {"HEAVY": 1, "MOST_HEAVY": 1, "BLOCK_SHINGLES": 200, "MOST_TEXTS": 1}])
def test_classes_match_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard_join, k, v)
    texts = variants(random.Random(6), 400)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, n int, digest long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.near_duplicate_classes(df).collect()}
    assert got == classes(texts)


def test_classes_of_odd_rows(odd_docs, no_docs):
    got = jaccard_join.near_duplicate_classes(odd_docs).toPandas()
    by = {None if pd.isna(r.doc_id) else int(r.doc_id): (r.n_shingles, None if pd.isna(r.component_id) else int(r.component_id)) for r in got.itertuples()}
    assert len(got) == odd_docs.count() and by[1][1] == by[2][1] == by[3][1] == 1 and by[4] == (0, 4) and by[5] == (0, 5) and sorted(got[got.doc_id < 4].n_links) == [2, 2, 2] and by[7] == (1, 7) and by[None][1] is None
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, None, 9, 10, 11, 12], key=str)
    assert jaccard_join.near_duplicate_classes(no_docs).count() == 0


def test_one_row_of_each_class_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (None, a), (1, b), (3, b + " tail"), (None, b), (None, c), (None, c), (None, c + " tail"), (5, ""), (5, ""), (6, None), (None, None), (None, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")).collect()
    got = sorted((r.doc_id, r.text) for r in kept if r.text and not r.text.startswith("c"))
    assert got == [(1, a), (1, b)] and [r.doc_id for r in kept if (r.text or "").startswith("c")] == [None]
    assert sorted(((r.doc_id, r.text) for r in kept if not r.text), key=str) == sorted(rows[-5:], key=str)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}


# ---- secrets


def spans_of(text):
    out = []
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for k, (kind, found, group, least) in enumerate((("assign", assign, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))):
        out += [(m.start(), k, m.end(), kind) for m in found.finditer(text) if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets_match_full_scans(spark, small, odd_docs, no_docs):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), odd_docs):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        got = secret_scan.secret_digest(df).collect()
        assert len(got) == df.count()
        for r in got:
            want = spans_of(texts[r.doc_id])
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[3] == k for x in want) for k in ("assign", "access", "hex")]
            base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert secret_scan.secret_digest(no_docs).count() == 0


def test_candidates_hold_every_match():
    rng = random.Random(8)
    seeds = ["Password: abcdefgh1", "api_key='zzzzzzzzz'", "APIKEY=12345678", "tOkEn =  x.y-z_00000", "AKIA" + "Z9" * 8, "0af" * 15, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-123456789012", "eyJhbGciOiJ9.eyJzdWIiOiIxIn0.abcdefghij", "https://me:pass@x.org", "ſecret: abcdefgh", "toKen= abcdefgh"]
    texts = ["".join(rng.choice(seeds + ["noise ", "é", "akia", " "]) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    scanner = secret_scan.Scanner((*secret_scan.BASE, *secret_scan.EXTRA))
    full = [sorted((m.start(), k, m.end()) for k, r in enumerate(scanner.rules) for m in r.compiled().finditer(t) if m.end(r.group) - m.start(r.group) >= r.least) for t in texts]
    assert scanner.scan(texts) == full and scanner.scan([]) == []
    assert [q == ("all",) for q in scanner.queries] == [r.kind == "hex" for r in scanner.rules]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdefgh1 end"), (2, None), (3, "AKIA" + "A" * 20 + " x"), (4, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert got == {1: "é [secret] end", 2: None, 3: "[secret] x", 4: "plain"}


def test_whole_secrets_are_redacted(spark):
    lines = "\n".join(chr(65 + i) * 63 + "/" for i in range(20))
    label = "RSA PRIVATE KEY-----"
    tail = "b1/" * 5
    secrets = [
        f"-----BEGIN {label}\n{lines}\nQ==\n-----END {label}",
        f"-----BEGIN {label}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{lines}\n-----END {label}",
        f"-----BEGIN {label}\\n{lines[:64]}\\n{tail}\\n-----END {label}",
        f"-----BEGIN {label}\r\nProc-Type: 4,ENCRYPTED\r\n\r\n{lines}\n{tail}",
        "ghp_" + "a1" * 200, "xoxb-" + "1a-" * 200, "https://" + "u" * 150 + ":" + "p" * 150 + "@",
    ]
    df = spark.createDataFrame([(i, f"before {s}\n after it") for i, s in enumerate(secrets)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert got == {i: "before [secret]\n after it" for i in range(len(secrets))}
    scanner = secret_scan.Scanner(secret_scan.EXTRA)
    assert [len(x) for x in scanner.scan(["-----BEGIN PRIVATE KEY----- is a mark " * 2000, f"the line -----BEGIN {label} only", f"-----END {label}"])] == [2000, 1, 0]


# ---- language model


def test_scores_match_a_brute_force_tree(spark, odd_docs, no_docs):
    rng = random.Random(9)
    texts = {i: " ".join(rng.choice(["Ab", "abc", "ba", "é", "cab a"]) for _ in range(rng.randint(0, 12))) for i in range(40)}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, n int, word string")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    depth = context_tree.DEPTH
    lined = {i: b"\xff" * depth + t.encode().lower() + b"\xff" for i, t in texts.items()}
    counts = defaultdict(lambda: [0, 0])

    def decisions(s):
        for p in range(depth, len(s)):
            for k in range(8):
                yield s[p - depth : p], 1 << k | s[p] >> (8 - k), s[p] >> (7 - k) & 1

    for i, s in lined.items():
        if not held[i]:
            for context, node, bit in decisions(s):
                for d in range(depth + 1):
                    counts[context[depth - d :], node][bit] += 1
    kids = defaultdict(list)
    for c, n in counts:
        if c:
            kids[c[1:], n].append((c, n))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    weighted = {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[key])
        weighted[key] = own if len(key[0]) == depth else math.log(0.5) + float(np.logaddexp(own, sum(weighted[c] for c in kids[key])))

    def one(context, node, d=0):
        key = context[depth - d :], node
        if key not in counts:
            return 0.5
        a, b = counts[key]
        if d == depth:
            return (b + 0.5) / (a + b + 1)
        stop = math.exp(math.log(0.5) + kt(a, b) - weighted[key])
        return stop * (b + 0.5) / (a + b + 1) + (1 - stop) * one(context, node, d + 1)

    words = Counter()
    for i, t in texts.items():
        if not held[i]:
            words.update([*t.encode().lower().split(), None])
    total, kinds = sum(words.values()), len(words)
    got = context_tree.score_texts(df).collect()
    assert len(got) == len(texts)
    for r in got:
        own = [*texts[r.doc_id].encode().lower().split(), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(words[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in own))
        want = sum(math.log10(p if bit else 1 - p) for c, n, bit in decisions(lined[r.doc_id]) for p in [one(c, n)])
        assert r.score == pytest.approx(want, rel=1e-5) and r.bits_per_byte == pytest.approx(-want / math.log10(2) / (len(lined[r.doc_id]) - depth), rel=1e-5)
    odd = context_tree.score_texts(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("score >= 0 or base_score > 0").count() == 0
    assert context_tree.score_texts(no_docs).count() == 0


def test_caches_change_nothing(spark, monkeypatch, odd_docs):
    row = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, pytest.approx(r.base_score), pytest.approx(r.score, rel=1e-6), pytest.approx(r.bits_per_byte, rel=1e-6))
    rows = lambda: [row(r) for r in sorted(context_tree.score_texts(odd_docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))]
    want = rows()
    for k, v in {"CACHED_WORDS": 3, "CACHED": 50, "HELD": 500, "PARTS": 7, "WAITING": 1}.items():
        monkeypatch.setattr(context_tree, k, v)
    assert [x[:4] for x in rows()] == [x[:4] for x in want] and rows() == want


def test_probabilities_of_a_byte_add_up_to_one():
    rng = np.random.default_rng(12)
    texts = [bytes(rng.choice(list(b"abc "), 60)) for _ in range(30)]
    counts = context_tree.Counts()
    counts.add(context_tree.laid_out(texts)[0], True)
    counts.settle()
    trees = context_tree.Subtrees(counts.keys, counts.n)
    key, zeros, ones, below = trees.summary()
    top = context_tree.Top(key, zeros, ones, below)
    for context in (0xFFFFFFFFFFFF, 0x616263206162, 0x010203040506, 0x010203206162):
        runs = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.exp2(trees.log2_of(runs, top)).sum() == pytest.approx(1)


# ---- quality rules


def rule_counts(text):
    w = WORD.findall(text or "")
    seen, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark, small, odd_docs, no_docs):
    repeats = spark.createDataFrame([(i, t, "s") for i, t in enumerate(["a b c d e a b c d e x", "a a a a a a a", "q\nq\n\nq \n z", "1 2 3 4 5 6 1 2 3 4 5 " * 3])], "doc_id long, text string, source string")
    for df in (spark.read.parquet(f"{small}/documents.parquet"), odd_docs, repeats):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = line_quality.quality_rules(df).collect()
        assert len(got) == df.count()
        for r in got:
            want = rule_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r.kept or not r.base_failed)
    assert line_quality.quality_rules(no_docs).count() == 0


def test_frequent_lines_deplete_documents(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    notice = " ".join(f"n{i}" for i in range(60))
    rows = [(i, f"{notice.upper()}\n{i} own" if i < 40 else f"{words(i)}\n{words(i + 1000)}", "h") for i in range(100)]
    rows += [(100 + i, rows[50][1], "h") for i in range(50)] + [(200, f"{notice}\n1 own", None), (201, f" {notice} \n{words(5)} {words(6)} {words(7)} {words(8)} {words(9)} {words(10)}", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in line_quality.quality_rules(df).where("kept").collect()}
    assert kept == {*range(40, 150), 200, 201}


def test_limits_do_not_grow_with_the_host(spark):
    """A line of eight documents is found on a host of two thousand; one of seven is not."""
    rows = [(i, (f"found  line {'x' * 30}\n" if i < 8 else f"other line {'y' * 30}\n" if i < 15 else "") + f"own {i} " * 3, "hot") for i in range(2000)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, `a.b` int, clean string")
    left = {r.doc_id: r.text for r in line_quality.without_frequent_lines(df).collect()}
    assert left == {i: t.split("\n")[1] if i < 8 else t for i, t, _ in rows}
    assert line_quality.without_frequent_lines(df).columns == df.columns and line_quality.base_rules(df).columns[:5] == df.columns


def test_spacing_hides_no_frequent_line(spark):
    spaced = lambda i: "".join(f"{'\t' if k % 5 == i % 5 else ' ' * (1 + (k + i) % 3)}N{k}" for k in range(60))
    rows = [(i, f"{spaced(i)}\n{i} own", "h") for i in range(40)] + [(i, " ".join(f"w{i}x{k}" for k in range(12)), "h") for i in range(40, 100)]
    # only a removed line is left of this one beside indentation and blank lines
    rows += [(100, " " * 500 + spaced(0) + "\n" * 300, "h")]
    kept = {r.doc_id for r in line_quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == set(range(40, 100))


# ---- SQL


@pytest.mark.parametrize("name", ["op2_block_ann", "op5_warc_store", "op7_jaccard_join", "op10_line_quality"])
def test_results_match_their_sql(spark, small, name):
    import duckdb

    from weftline.llm.queries import ORACLE

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = QUERIES[name](spark, small)
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())
