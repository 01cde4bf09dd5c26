import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import abuse, mixing, neighbours, packing, tokens

DIM = 64


def brute_pairs(vectors, k=5, least=0.7):
    ids = sorted(i for i, v in vectors.items() if v is not None and len(v) == DIM and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v))
    m = np.array([vectors[i] for i in ids], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    out = set()
    for a in range(len(ids)):
        order = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out |= {tuple(sorted((ids[a], b))) for d, b in order if -d >= least}
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = {}
    for c in range(40):
        centre = rng.standard_normal(DIM)
        for k in range(rng.integers(1, 9)):
            vectors[f"c{c}-{k}"] = (centre + 0.4 * rng.standard_normal(DIM)).astype(np.float32).tolist()
    copy = rng.standard_normal(DIM).astype(np.float32).tolist()
    vectors |= {f"copy{k:03}": copy for k in range(120)}  # a third of all rows
    vectors |= {"n1": None, "n2": [], "n3": [1.0], "n4": [0.0] * DIM, "n5": [float("nan")] * DIM, "n6": [float("inf")] + [1.0] * (DIM - 1), "n7": [None] + [1.0] * (DIM - 1)}
    rows = [(i, v, 1, "x") for i, v in vectors.items()] + [("copy000", copy, 1, "x"), (None, copy, 1, "x")]
    df = spark.createDataFrame(rows, "id string, content_embedding array<float>, row int, copy string").repartition(6)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, dim=DIM).collect()}
    want = brute_pairs(vectors)
    assert got <= want and len(got) >= 0.98 * len(want)
    split = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, dim=DIM, block=4).collect()}
    assert split <= want and len(split) >= 0.95 * len(want)
    assert neighbours.similar_pairs(df.limit(0), dim=DIM).count() == 0
    near = neighbours.nearest(df, dim=DIM).where("id = 'copy119'").orderBy("position").collect()
    assert [r.other for r in near] == [f"copy{k:03}" for k in range(5)]


def test_neighbours_in_a_dense_group(spark):
    # a third of the rows are different vectors of one dense group, of many blocks
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(DIM)
    vectors = {f"d{k:04}": (centre + 0.55 * rng.standard_normal(DIM)).astype(np.float32).tolist() for k in range(1500)}
    vectors |= {f"r{k:04}": rng.standard_normal(DIM).astype(np.float32).tolist() for k in range(3000)}
    df = spark.createDataFrame(list(vectors.items()), "id string, content_embedding array<float>").repartition(6)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, dim=DIM, block=32).collect()}
    want = brute_pairs(vectors)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_small_groups_beside_a_large_one_share_parts(spark):
    # rows 0 to 39 are a large group, 40 groups of two rows have a close candidate in it each
    lead = [(r, 0) for r in range(40)] + [(r, r // 2 * 2) for r in range(100, 180)]
    pairs = [(k, 100 + 2 * k, 10) for k in range(40)] + [(r, (r + 1) % 40, 10) for r in range(40)]
    groups = spark.createDataFrame(lead, "row long, lead long")
    sizes = groups.groupBy("lead").agg(F.count("*").alias("rows"))
    cells = neighbours._cells(spark.createDataFrame(pairs, "row long, other long, apart int"), groups, sizes, sizes.where("rows > 32"), 32, 0.7).collect()
    of = {}
    for r in cells:
        of.setdefault(r.row, set()).add(r.block)
    assert all(of[a] & of[b] for a in range(40) for b in [*range(40), *range(100, 180)])
    assert len(cells) == 2 * 40 + 80


@pytest.mark.parametrize("kind", ["<f2", "<f4"])
def test_vectors_are_squeezed_by_places(kind):
    rng = np.random.default_rng(4)
    for v in (np.round(rng.standard_normal(768) * 50) / 128, rng.standard_normal(768), np.zeros(768), np.r_[np.ones(1), np.zeros(767)]):
        raw = v.astype(kind).tobytes()
        packed = neighbours._squeezed(raw, 768)
        assert neighbours._unsqueezed(packed, 768) == raw and len(packed) < 0.95 * len(raw)


def test_sketch_beside_a_large_copy_group(spark):
    # a third of the rows are copies of one vector u, others lie at a cosine of 0.70 to 0.75 to it
    rng = np.random.default_rng(3)
    u = rng.standard_normal(DIM)
    u /= np.linalg.norm(u)
    away = rng.standard_normal((400, DIM))
    away -= np.outer(away @ u, u)
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.70, 0.75, (400, 1))
    rows = [u] * 400 + list(cos * u + np.sqrt(1 - cos**2) * away) + list(rng.standard_normal((400, DIM)))
    df = spark.createDataFrame([(f"i{k:04}", r.astype(np.float32).tolist()) for k, r in enumerate(rows)], "id string, content_embedding array<float>")
    vectors = neighbours.usable_vectors(df, dim=DIM)
    _, centre = neighbours._members_and_centre(vectors, 1200, DIM)
    m = np.array(rows, np.float32)
    distinct = m[399:] / np.linalg.norm(m[399:], axis=1, keepdims=True)
    assert np.allclose(centre, distinct.mean(0), atol=1e-5)
    pulled = (m[:400].sum(0) / 1200).astype(np.float32)  # even with a centre that copies pull
    _, sketch = neighbours.hash_strings(m[:800], pulled, 1)
    estimate = neighbours.estimates(neighbours.opened(sketch, pulled @ pulled), slice(0, 400), slice(400, 800), pulled @ pulled)
    assert (estimate >= neighbours.LEAST - neighbours.SLACK).mean() > 0.99


def links(m, k=5, least=0.7):
    m = m.astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return {(r, int(c)) for r in range(len(m)) for c in top[r] if s[r, c] >= least}


def made(case):
    rng = np.random.default_rng(17)
    if case == "common mean":  # any two vectors have a cosine of 0.83
        return rng.standard_normal(768) + 0.45 * rng.standard_normal((2500, 768))
    if case == "one cluster":  # larger than a block
        return rng.standard_normal(64) + 0.6 * rng.standard_normal((4000, 64))
    middles = rng.standard_normal((60, 768))  # 32-bit values that no half float has
    return np.concatenate([*(c + 0.6 * rng.standard_normal((int(rng.integers(2, 40)), 768)) for c in middles), rng.standard_normal((1000, 768))])


@pytest.mark.parametrize("case", ["common mean", "one cluster", "clusters"])
def test_recall(spark, tmp_path, case):
    m = made(case).astype(np.float32)
    pq.write_table(pa.table({"id": [f"r{k:06}" for k in range(len(m))], "content_embedding": pa.array(list(m), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    got = {(int(r.id[1:]), int(r.other[1:])) for r in neighbours.nearest(spark.read.parquet(str(tmp_path / "v.parquet")).repartition(6), dim=m.shape[1]).select("id", "other").collect()}
    want = links(m)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_levels():
    a = np.array([0, 0, 5 << 40, 1], np.int64)
    b = np.array([0, 1, 6 << 40, 1 << (neighbours.TEXT_BITS - 1)], np.int64)
    whole = neighbours.TEXT_BITS // neighbours.LEVEL
    assert neighbours.levels(a, b).tolist() == [whole, (neighbours.TEXT_BITS - 1) // neighbours.LEVEL, (neighbours.TEXT_BITS - 42) // neighbours.LEVEL, 0]


def test_offers_are_ascended_from_the_deepest_level(spark):
    depth = neighbours.TEXT_BITS // neighbours.LEVEL
    offer = lambda level, apart, other: ((depth - level) << 58) | (apart << 50) | other
    deep = [(1, offer(9, 50, 1000 + k)) for k in range(neighbours.ASCENT)]
    rows = [*deep, (1, offer(3, 1, 7)), (2, offer(9, 50, 5)), (2, offer(3, 1, 5)), (2, offer(0, 20, 6))]
    got = {}
    for r in neighbours._candidates(spark.createDataFrame(rows, "row long, offer long")).collect():
        got.setdefault(r.row, []).append((r.apart, r.other))
    assert got[1] == [(50, 1000 + k) for k in range(neighbours.CANDIDATES)]  # the shallow one came after ASCENT others
    assert got[2][0] == (1, 5) and (20, 6) in got[2]


def test_strings_keep_prefixes():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((200, DIM)).astype(np.float32)
    v[1] = v[0]
    text, sketch = neighbours.hash_strings(v, np.zeros(DIM, np.float32), 4)
    assert (text[0] == text[1]).all() and (sketch[0] == sketch[1]).all() and text.min() >= 0


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_packing_keeps_everything(capacity):
    rng = np.random.default_rng(capacity)
    sizes = np.r_[rng.integers(0, 3 * capacity, 400), [0, capacity, 10 * capacity]]
    out = packing.pack_items(np.arange(len(sizes)), sizes, capacity)
    assert out.groupby("doc_id")["tokens"].sum().reindex(range(len(sizes))).tolist() == sizes.tolist()
    used = out.groupby("container")["tokens"].sum()
    assert (used <= capacity).all() and (capacity - used == out.groupby("container")["room_left"].first()).all()
    whole = out.groupby("doc_id")["piece"].count()
    assert all(n == max(1, -(-s // capacity)) for n, s in zip(whole, sizes))


def test_sum_of_squares_choice():
    box = packing.SumOfSquares(10)
    # 4 opens a container; a second 4 beside it would make 2 of one level, so it goes on top; 2 completes it; 6 opens another
    for s in (4, 4, 2, 6):
        box.place(s)
    assert box.room == [0, 4]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 400, 5000)
    out = packing.pack_items(np.arange(5000), sizes, 1000)
    assert out.drop_duplicates("container")["room_left"].sum() / (1000 * out["container"].nunique()) < 0.01
    assert packing.pack_items(np.array([], int), np.array([], int), 5).empty and packing.pack_items(np.array([3]), np.array([0]), 5)["room_left"].tolist() == [5]


DOCS = "doc_id long, text string, source string, shard int, range int, share double"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3.0) for i, t, s in rows], DOCS)


def test_pack_on_spark(spark):
    rows = [(k, "word " * (k % 37), "s") for k in range(300)] + [(None, "x", "s"), (1000, None, None), (1001, "a b " * 9000, "s"), (5, "word " * 5, "s")]
    kinds = spark.createDataFrame([("a", 16, 0), ("b", 512, 0), ("bad", 0, 0), (None, 5, 0)], "container_kind string, capacity_tokens int, shard int")
    out = packing.pack(documents(spark, rows), kinds, shard_tokens=3000).toPandas()
    assert set(out["container_kind"]) == {"a", "b"}
    with open(tokens.VOCABULARY, "rb") as f:
        vocabulary = f.read()
    want = {i: tokens.count(t, vocabulary) for i, t, _ in rows if i is not None}
    for kind, cap in (("a", 16), ("b", 512)):
        part = out[out["container_kind"] == kind]
        assert part.groupby("doc_id")["tokens"].sum().to_dict() == want
        assert (part.groupby("container")["tokens"].sum() + part.groupby("container")["room_left"].first() == cap).all()
    assert packing.pack(documents(spark, []), kinds).count() == 0
    many = spark.createDataFrame([(f"k{k}", 16) for k in range(1100)], "container_kind string, capacity_tokens int")
    assert packing.pack(documents(spark, rows[:2]), many).select("container_kind").distinct().count() == 1100
    r = {x.container_kind: x for x in packing.rooms(packing.pack(documents(spark, rows), kinds)).collect()}
    assert r["b"].unused < 0.1


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "word " * int(rng.integers(1, 60)), "hot" if k % 3 else f"s{k % 4}") for k in range(3000)] + [(None, "x", "hot"), (9001, "", "hot"), (9002, "x y", None), (9003, "x y", "other"), (9004, None, "hot")]
    targets = spark.createDataFrame([("hot", 0.3, 1, 0), ("s0", 0.3, 4, 0), ("s1", 0.2, 3, 0), ("gone", 0.1, 2, 0), ("hot", 0.1, 1, 0), ("bad", None, 1, 0), (None, 0.1, 1, 0)], "source string, target_share double, max_repeats int, tokens int")
    df = documents(spark, rows)
    drawn = mixing.draw(df, targets).cache()
    pdf = drawn.toPandas()
    assert not pdf.duplicated(["doc_id", "repeat"]).any() and pdf["finish_time"].is_monotonic_increasing
    limits = {"hot": 1, "s0": 4, "s1": 3}
    assert all(pdf[pdf.source == s]["repeat"].max() <= n for s, n in limits.items()) and set(pdf.source) == set(limits)
    got = {r.source: r for r in mixing.shares(drawn, targets).collect()}
    assert got["gone"].tokens == 0 and abs(sum(r.reached_share for r in got.values()) - 1) < 1e-5
    for s, share in (("hot", 0.4), ("s0", 0.3), ("s1", 0.2)):
        assert abs(got[s].reached_share - share / 0.9) < 0.01
        assert abs(got[s].off_tokens) <= 60 and got[s].longest <= 60  # no document has more tokens
    assert got["gone"].off_tokens is None
    few = mixing.draw(df, targets, budget=5000).toPandas()
    assert 5000 - 120 <= few["tokens"].sum() <= 5000
    assert few[["doc_id", "repeat"]].values.tolist() == pdf[["doc_id", "repeat"]].values.tolist()[: len(few)]
    assert mixing.repeats(drawn).where("repeats > 1").count() > 0
    all_of_it = mixing.draw(df, targets, budget=10**9).toPandas()
    assert len(all_of_it) > len(pdf)
    assert mixing.draw(documents(spark, []), targets).count() == 0 and mixing.draw(df, targets.limit(0)).count() == 0


GOOD = ["The council met in town {} and spoke about the bridge.", "Prices rose by {} percent in the market.", "Thanks for the piece about town {}.", "This bridge number {} is garbage and should be torn down.", "The museum of town {} shows a nude statue."]
BAD = [("abuse", "you are a worthless idiot and town {} knows it"), ("abuse", "shut your mouth, moron number {}"), ("hate", "those Ubrin of town {} are vermin, drive them out"), ("sexual", "hot naked girls of town {} wait for sex")]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    docs, truth, votes = [], {}, []
    for k in range(n):
        lines = [GOOD[rng.integers(len(GOOD))].format(rng.integers(99)) for _ in range(4)]
        kind = None
        if rng.random() < 0.3:
            kind, bad = BAD[rng.integers(len(BAD))]
            lines.insert(rng.integers(4), bad.format(rng.integers(99)))
        docs.append((k, "\n".join(lines), f"s{k % 3}"))
        truth[k] = kind or "none"
        for r in range(2):
            given = truth[k] if rng.random() > 0.08 else rng.choice(abuse.CLASSES)
            votes.append((k, str(given) if rng.random() > 0.05 else None, f"r{r}"))
    return docs, truth, votes


def test_abuse_on_held_out_rows(spark):
    docs, truth, votes = corpus(700, 4)
    odd = [(10_000, None, "s0"), (10_001, "", None), (None, "you are a worthless idiot", "s0"), (10_002, "The council met. " * 20_000 + "you are a w0rthless 1d1ot and everyone knows", "s0"), (10_003, "y o u are a worthles idi0t, i d i o t", "s0")]
    df = documents(spark, docs + odd)
    labels = spark.createDataFrame([v for v in votes if v[0] % 2 == 0] + [(None, "abuse", "r"), (77_777, "abuse", "r")], "doc_id long, label string, rater string")
    got = {r.doc_id: r for r in abuse.scores(df, labels).collect()}
    held = [k for k in truth if k % 2]
    tp = sum(got[k].label != "none" and truth[k] != "none" for k in held)
    assert tp >= 0.95 * sum(truth[k] != "none" for k in held)
    assert sum(got[k].label != "none" and truth[k] == "none" for k in held) <= 0.02 * len(held)
    assert got[10_000].label == got[10_001].label == "none" and got[10_002].label == "abuse" and got[10_003].label == "abuse"
    assert {r.source for r in abuse.rates(df, labels).collect()} == {"s0", "s1", "s2", None}
    none = abuse.scores(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {None} and abuse.marked(df, labels.limit(0)).count() == 0
    assert abuse.scores(df.limit(0), labels).count() == 0


def test_words():
    assert abuse.words("SHUT 1d1ot, i d i o t and s.c.u.m l**er 12.5") == ["shut", "idiot", "idiot", "and", "scum", "l**er", "#"]
    assert abuse.passages("a. b<br>c\n\nd!") == ["a.", "b", "c", "d!"] and abuse.passages(None) == []
    assert abuse.windows(16) == [(0, 16)] and abuse.windows(20) == [(0, 20), (0, 12), (6, 18), (12, 20)] and abuse.windows(0) == [(0, 0)]
