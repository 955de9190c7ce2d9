"""Mining operators against brute force, hand-made cases and their properties."""

import inspect
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodespark.operators import clustering, graph, itemsets, met_sets, pairs, recommend, relational, set_similarity, sketches, textmining
from lodespark.operators.components import connected_components


def brute_itemsets(baskets, support, size):
    out = {}
    for k in range(1, size + 1):
        for c in itertools.combinations(sorted({i for b in baskets.values() for i in b}), k):
            n = sum(set(c) <= b for b in baskets.values())
            if n >= support:
                out[c] = n
    return out


def test_itemsets(spark):
    rng = random.Random(5)
    baskets = {b: {rng.choice("abcdefg") for _ in range(rng.randint(1, 5))} for b in range(60)}
    rows = [(b, i) for b, s in baskets.items() for i in s]
    df = spark.createDataFrame([*rows, *rows[:9], (None, "a"), (1, None)], "basket int, item string")
    want = brute_itemsets(baskets, 8, 4)
    found = {tuple(r["items"]): r["support"] for r in itemsets.frequent_itemsets(df, 8, 4).collect()}
    assert found == want
    assert all(tuple(x for x in s if x != y) in found for s in found if len(s) > 1 for y in s)
    pairs = {(r["a"], r["b"]): r["support"] for r in itemsets.pcy_pairs(df, 8, 5).collect()}
    assert pairs == {k: v for k, v in want.items() if len(k) == 2}
    local = {tuple(r["items"]) for r in itemsets.local_candidates(df, 8, 3).collect()}
    assert set(want) <= local
    whole = brute_itemsets(baskets, 2, 5)
    assert max(map(len, whole)) >= 4
    for f in (itemsets.frequent_itemsets(df, 2), itemsets.pcy_itemsets(df, 2, 7)):  # until a level is empty
        assert {tuple(r["items"]): r["support"] for r in f.collect()} == whole
    by_slice = {tuple(r["items"]) for r in itemsets.local_candidates(df, 8, 3, F.col("basket")).collect()}
    assert by_slice == {s for k in range(3) for s in brute_itemsets({b: x for b, x in baskets.items() if b % 3 == k}, 8 / 3, 5)}
    few = spark.createDataFrame([(1, ["a"]), (1, ["b"]), (2, ["a", "b"])], "size int, items array<string>")
    assert itemsets.itemset_report(few, few.where("size = 1")) == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a'),('b')"
    assert itemsets.frequent_itemsets(df.limit(0), 2).count() == 0


def test_pairs_of_heavy_keys(spark):
    """A key with a third of all rows gives the same pairs in blocks as without."""
    rng = random.Random(8)
    rows = [(rng.choice("aab" + "cdefghij"), v, v * 2) for v in range(120)]
    df = spark.createDataFrame(rows, "k string, v int, x int")
    want = {(k, a, b, 2 * a, 2 * b) for k, a, _ in rows for j, b, _ in rows if k == j and a < b}
    for block in (7, 1000):
        got = [tuple(r) for r in pairs.pairs_within(df, ["k"], "v", ("x",), block).select("k", "a", "b", "a_x", "b_x").collect()]
        assert set(got) == want and len(got) == len(want)
    users = [(rng.randrange(60), i) for i in range(12) for _ in range(40)] + [(u, 99) for u in range(60)]
    held = {u: {i for w, i in users if w == u} for u, _ in users}
    for least in (1, 3, 5):
        edges = {(r["src"], r["dst"]): r["common"] for r in graph.cooccurrence_edges(spark.createDataFrame(users, "user int, item int"), least).collect()}
        assert edges == {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) >= least}


def test_jaccard_classes(spark):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(2)
    base = [rng.choice(words) for _ in range(120)]
    near = base[:118] + ["x", "y"]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(near)), (4, " ".join(rng.choice(words) for _ in range(120))), (5, ""), (6, None), (7, "one two"), (8, "One, two!"), (None, "one two"), (9, "...")]
    sets = set_similarity.shingle_sets(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    want = {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 7: (7, 1), 8: (7, 1)}
    for pairs in (set_similarity.jaccard_pairs, lambda s, least: set_similarity.banded_pairs(s, least, 20, 3)):
        got = {r["id"]: (r["class_id"], r["links"]) for r in set_similarity.similarity_classes(sets, pairs, 0.8).collect()}
        assert got == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=8), min_size=1, max_size=12), st.sampled_from([0.4, 0.5, 0.8, 1.0]))
def test_prefix_filter_is_exact(spark, lists, least):
    sets = {i: set(x) for i, x in enumerate(lists)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "key int, items array<bigint>")
    got = {(r["a"], r["b"]): r["jaccard"] for r in set_similarity.jaccard_pairs(df, least).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= least})


def test_similarity_ladder(spark):
    rows = [("u1", "a", 5), ("u1", "b", 3), ("u2", "c", 4), ("u3", "c", 2), ("u2", "d", 1), ("u3", "d", 5)] + [(f"v{i}", x, r) for i in range(3) for x, r in (("e", i + 1), ("f", 2 * i + 1), ("k", 3))]
    df = spark.createDataFrame(rows, "user_id string, item string, rating int")
    got = {(r["item_a"], r["item_b"]): r["sim"] for r in recommend.item_similarity(df).collect()}
    assert got["a", "b"] == pytest.approx(3 / 5)
    assert got["c", "d"] == pytest.approx(((5 - 3) + (5 - 3)) / 2 / 5)
    assert got["e", "f"] == pytest.approx(1.0) and got["e", "k"] == 0.0
    item = {(r["item_a"], r["item_b"]): r["sim"] for r in recommend.item_similarity(df, "per_item").collect()}
    assert item["c", "d"] == pytest.approx((10 - 2 - 4) / 10)
    test = spark.createDataFrame([("u1", "zz"), ("nobody", "a"), ("u2", "a"), ("u2", "a")], "user_id string, item string")
    p = {(r["user_id"], r["item"]): r["prediction"] for r in recommend.predict_cf(df, test, recommend.item_similarity(df)).collect()}
    assert p == {("u1", "zz"): 4.0, ("nobody", "a"): 3.5, ("u2", "a"): 3.5}


def as_edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (2000, 2000)]
    got = {r["id"]: r["component"] for r in connected_components(as_edges(spark, pairs)).collect()}
    root = {v: v for p in pairs for v in p}
    for _ in range(len(root)):
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    assert got == root
    assert connected_components(as_edges(spark, pairs).limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="edges are left"):
        connected_components(as_edges(spark, pairs), max_rounds=1)


def test_betweenness_and_communities(spark):
    tree = [(0, 1), (1, 2), (1, 3), (3, 4)]
    got = {(r["src"], r["dst"]): r["score"] for r in graph.betweenness(as_edges(spark, tree)).collect()}
    assert got == {(0, 1): 4.0, (1, 2): 4.0, (1, 3): 6.0, (3, 4): 4.0}  # sizes of both sides multiplied
    cliques = [*itertools.combinations(range(4), 2), *itertools.combinations(range(4, 8), 2), (3, 4)]
    e = as_edges(spark, cliques)
    inner = graph._edge_scores({v: {b if a == v else a for a, b in cliques if v in (a, b)} for v in range(8)})
    for sources in (4096, 3):
        spread = {(r["src"], r["dst"]): r["score"] for r in graph.betweenness(e, sources).collect()}
        assert spread == pytest.approx(dict(inner))
    path = as_edges(spark, [(i, i + 1) for i in range(8)])
    assert [r["score"] for r in graph.edge_lines(graph.betweenness(path)).limit(2).collect()] == [20.0, 20.0]
    for limit in (5000, 3):  # in one task, and by the distributed loop
        parts = graph.communities_by_removal(e, in_memory_edges=limit, max_rounds=2)
        lines = [r["members"] for r in graph.community_lines(parts).collect()]
        assert lines == [[0, 1, 2, 3], [4, 5, 6, 7]]
        assert parts.first()["modularity"] == pytest.approx(2 * (6 / 13 - (13 / 26) ** 2))
    labels = {r["id"]: r["label"] for r in graph.label_propagation(e, 5).collect()}
    assert len(labels) == 8
    edges = graph.cooccurrence_edges(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 2), ("c", 2), (None, 1)], "user string, item int"), 2)
    assert [tuple(r) for r in edges.collect()] == [("a", "b", 2)]
    ids = {r["v"]: r["idx"] for r in graph.dense_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "v string"), "v").collect()}
    assert ids == {"a": 0, "b": 1, "c": 2}


def test_removal_goes_on_until_no_edge_is_left(spark, monkeypatch):
    """The distributed loop has no bound of its own, and says so where a given one ends it."""
    left = []
    between = graph.betweenness
    monkeypatch.setattr(graph, "betweenness", lambda e: left.append(e.count()) or between(e))
    e = as_edges(spark, [(0, 1), (1, 2), (2, 3)])
    whole = {(r["id"], r["community"]) for r in graph.communities_by_removal(e).collect()}
    assert {(r["id"], r["community"]) for r in graph.communities_by_removal(e, in_memory_edges=1).collect()} == whole
    assert left == [3, 2]
    assert inspect.signature(graph.communities_by_removal).parameters["max_rounds"].default is None
    with pytest.warns(UserWarning, match="edges are left"):
        graph.communities_by_removal(e, in_memory_edges=1, max_rounds=1)


def test_bench_refuses_an_empty_graph(spark):
    import bench

    edges = lambda rows: {"q_label_propagation": None, "q_graph_edges": lambda s, d: s.createDataFrame(rows, "src int, dst int")}
    assert bench.starved(edges([]), spark, "") == ["q_label_propagation"]
    assert bench.starved(edges([(1, 2)]), spark, "") == []


def test_bfr_counts_and_outliers(spark):
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(c, 0.3, (61, 2)) for c in ((0, 0), (20, 0), (0, 20))] + [np.array([[200.0, 200.0], [-300.0, 5.0]])])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id bigint, x array<double>")
    out, report = clustering.read_in_rounds(df, 3)
    got = {r["id"]: r["cluster"] for r in out.collect()}
    assert len(got) == len(pts) and out.count() == len(pts)
    assert got[183] == got[184] == -1
    purity = sum(max(list(map(got.get, range(i, i + 61))).count(c) for c in range(3)) for i in (0, 61, 122))
    assert purity >= 0.9 * 183
    last = report.orderBy("round").collect()[-1]
    assert last["discard"] + last["compressed"] + last["retained"] == len(pts)
    assert clustering.read_in_rounds(df.limit(0), 3)[0].count() == 0


def test_statistics_merge(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "cluster int, x array<double>")
    got = {r["cluster"]: (r["n"], r["sum"], r["sumsq"]) for r in clustering.cluster_stats(df).collect()}
    assert got == {0: (2, [4.0, 6.0], [10.0, 20.0]), 1: (1, [5.0, 6.0], [25.0, 36.0])}
    _, centres = clustering.lloyd(df.select(F.monotonically_increasing_id().alias("id"), "x"), [[1.0, 2.0], [5.0, 6.0], [99.0, 99.0]])
    assert centres[2] == [99.0, 99.0]


def test_lloyd_runs_until_no_label_changes(spark):
    pts = np.random.default_rng(1).normal(size=(600, 3))
    centres, label, rounds = pts[:8].copy(), None, 0
    while True:
        fresh = ((pts[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if label is not None and (fresh == label).all():
            break
        label, rounds = fresh, rounds + 1
        centres = np.array([pts[label == c].mean(0) if (label == c).any() else centres[c] for c in range(8)])
    assert rounds > 10
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id bigint, x array<double>").cache()
    got = clustering.lloyd(df, [[float(v) for v in p] for p in pts[:8]])[0].collect()
    assert [r["cluster"] for r in sorted(got, key=lambda r: r["id"])] == label.tolist()
    with pytest.warns(UserWarning, match="still change"):
        clustering.lloyd(df, [[float(v) for v in p] for p in pts[:8]], 2)


def test_sketches(spark):
    rng = random.Random(9)
    rows = [(b, rng.randrange(4000)) for b in range(6) for _ in range(300)] + [(2, None), (None, 3)]
    df = spark.createDataFrame(rows, "b int, v bigint")
    bits, seen, want = [0] * sketches.BLOOM_BITS, set(), {}
    for b in range(6):
        new = fp = 0
        at = lambda v: [(v % sketches.BLOOM_BITS * a + c) % sketches.BLOOM_BITS for a, c in sketches.BLOOM_HASHES]
        batch = [v for x, v in rows if x == b and v is not None]
        for v in batch:
            known = all(bits[i] for i in at(v))
            assert known or v not in seen  # no false negatives
            if v not in seen:
                new, fp = new + 1, fp + known
        for v in batch:
            seen.add(v)
            for i in at(v):
                bits[i] = 1
        want[b] = (new, fp)
    got = {r["batch"]: (r["new"], r["false_positives"]) for r in sketches.bloom_false_positives(df, "b", "v").collect()}
    assert got == want
    est = {r["batch"]: (r["truth"], r["estimate"]) for r in sketches.distinct_estimate(df, "b", "v").collect()}
    assert all(t == len({v for x, v in rows if x == b and v is not None}) and e > 0 for b, (t, e) in est.items())
    assert sketches.reservoir(df, "v", 100).count() == 100 and sketches.reservoir(df.limit(7), "v", 100).count() == 7


def test_relational(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    assert relational.duplicated(df, ["v"]).count() == 4
    f = spark.createDataFrame([(1, 9.0), (2, None)], "k int, v double")
    got = {r["k"]: r["v"] for r in relational.lookup(df, f, "k", {"v": -1.0}).distinct().collect()}
    assert got == {1: 9.0, 2: -1.0, 3: -1.0}
    assert {r["k"] for r in relational.unseen(df, f, "k").collect()} == {3}
    assert relational.value_share(df, "v").agg(F.sum("pct")).first()[0] == pytest.approx(100)
    b = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "basket int, item string")
    c = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x")], "candidate string, item string")
    assert {tuple(r) for r in relational.contained(b, c).collect()} == {(1, "p"), (1, "q"), (2, "q")}
    assert {tuple(r) for r in relational.upsert(df, df.where("k = 3").withColumn("v", F.lit("z")), ["k"]).where("k = 3").collect()} == {(3, "z")}


def test_weighted_errors(spark):
    one = [(1, f, p) for f, p in zip([10, 20, 30, 15, 8], ["O", "B-MIS", "I-PER", "B-PER", "B-LOC"])]
    two = [(2, f, p) for f, p in zip([5, 8, 3, 7, 4], ["B-PER", "O", "I-PER", "O", "B-LOC"])]
    df = spark.createDataFrame([*one, *two, (3, 0, "O")], "g int, f int, p string")
    got = {r["g"]: (r["type1"], r["type2"], r["type3"]) for r in textmining.weighted_errors(df, ["g"], "f", "p").collect()}
    assert got[1] == pytest.approx((38 / 83, 28 / 83, 10 / 83)) and got[2] == pytest.approx((19 / 27, 4 / 27, 15 / 27)) and got[3] == (0, 0, 0)


def test_api_numbers_and_turns(spark):
    t = "33-053-03911 and 33 - 053 - 03911, API 3305305924 or API #:3305305924"
    assert spark.range(1).select(textmining.api_numbers(F.lit(t))).first()[0] == ["33-053-03911", "33-053-05924"]
    df = spark.createDataFrame([(1, "User: a\n\nAssistant: b\n\nUser: c"), (2, ""), (3, None)], "id int, text string")
    assert [tuple(r) for r in textmining.turns(df, "id", "text").orderBy("pair").collect()] == [(1, 0, "User: c", None), (1, 1, "User: a", "Assistant: b")]


def test_chunks():
    lines = [f"line {i} " + "x" * (i % 40) for i in range(200)]
    parts = textmining.chunk("\n".join(lines), 500, 100)
    assert all(len(p) <= 500 for p in parts)
    seen, out = 0, []
    for p in parts:
        own = p.split("\n")
        start = lines.index(own[0])
        assert start <= seen
        out += own[seen - start :]
        seen = start + len(own)
    assert out == lines
    assert textmining.chunk("", 5) == [] and textmining.chunk("y" * 900, 500) == ["y" * 900]


def test_mahalanobis_floor(spark):
    from lodespark.functions.numbers import days_since_year, list_length, mahalanobis, safe_double, text_mod, trailing_zeros

    row = spark.sql("select array(3.0d, 1.0d) as x, array(4.0d, 2.0d) as s, array(10.0d, 2.0d) as q, 'é1' as t").select(
        mahalanobis(F.col("x"), F.lit(2), F.col("s"), F.col("q")).alias("m"), text_mod(F.col("t"), 97).alias("h"), safe_double(F.lit("nan"), 7).alias("n"),
        trailing_zeros(F.lit(40)).alias("z"), list_length(F.lit("None")).alias("l"), days_since_year(F.lit("2001-02-03"), 2025).alias("d"),
    ).first()
    assert row["m"] == pytest.approx(math.sqrt(1 / 1)) and row["h"] == int("é1".encode().hex(), 16) % 97
    assert (row["n"], row["z"], row["l"], row["d"]) == (7.0, 3, 0, 6000)
    assert spark.range(1).select(days_since_year(F.lit("n/a"), 2025), days_since_year(F.lit("2020"), 2025), days_since_year(F.lit(None).cast("string"), 2025)).first()[:] == (1500, 1825, 1500)


def test_meeting_sets_store_no_pairs(spark):
    """Edges, forest, degrees and labels of sets that nearly all meet: as from the edges, and no join or shuffle of pairs."""
    rng = random.Random(11)
    held = {f"u{u:03}": {rng.randrange(9) for _ in range(rng.randint(1, 6))} | {99} for u in range(120)}
    df = spark.createDataFrame([*[(u, i) for u, x in held.items() for i in x], ("u000", 99), (None, 1), ("u001", None)], "user string, item int")
    for least in (2, 4):
        want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) >= least}
        edges = graph.cooccurrence_edges(df, least)
        assert {(r["src"], r["dst"]): r["common"] for r in edges.collect()} == want
        plan = edges._jdf.queryExecution().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        forest = [(r["src"], r["dst"]) for r in graph.cooccurrence_forest(df, least).collect()]
        assert len(forest) < len(held)
        parts = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(forest, "src string, dst string")).collect()}
        assert parts == {r["id"]: r["component"] for r in connected_components(edges).collect()}
        degrees = {r["id"]: r["k"] for r in graph.cooccurrence_degrees(df, least).collect()}
        assert degrees == {u: n for u in held if (n := sum(u in e for e in want))}
        for rounds in (1, 5):
            assert {tuple(r) for r in graph.cooccurrence_labels(df, least, rounds).collect()} == {tuple(r) for r in graph.label_propagation(edges, rounds).collect()}
        communities = connected_components(edges)
        whole = graph.modularity(edges, communities.withColumnRenamed("component", "community")).first()[0]
        assert graph.modularity_of_components(graph.cooccurrence_degrees(df, least), communities).first()[0] == pytest.approx(whole, abs=1e-12)


def test_meeting_sets_in_several_tasks(spark, monkeypatch):
    """The same whatever the number of tasks and the rows of ones."""
    rng = random.Random(12)
    held = {u: {rng.randrange(300) for _ in range(rng.randint(3, 8))} | ({300} if u % 3 else {301, 302}) for u in range(900)}
    df = spark.createDataFrame([(u, i) for u, x in held.items() for i in x], "user int, item int").repartition(5)
    want = {(a, b): n for a in held for b in held if a < b and (n := len(held[a] & held[b])) >= 2}
    monkeypatch.setattr(met_sets, "LEAST_SETS", 100)
    edges = graph.cooccurrence_edges(df, 2)
    assert edges.rdd.getNumPartitions() == 8
    assert {(r["src"], r["dst"]): r["common"] for r in edges.collect()} == want
    parts = {tuple(r) for r in connected_components(graph.cooccurrence_forest(df, 2)).collect()}
    assert parts == {tuple(r) for r in connected_components(edges).collect()}
    assert {tuple(r) for r in graph.cooccurrence_labels(df, 2).collect()} == {tuple(r) for r in graph.label_propagation(edges).collect()}
    packs = [r["pack"] for r in met_sets.packed(spark.createDataFrame([(u, sorted(x)) for u, x in held.items()], "name int, items array<bigint>")).collect()]
    for memory in (0, 900, 64_000_000):
        monkeypatch.setattr(met_sets, "DENSE_BYTES", memory)
        h = met_sets.Held([bytes(x) for x in packs])
        assert {(h.names[a], h.names[b]): n for a in range(900) for b, n in zip(*h.sharing(a, 2, True))} == want


def test_packed_bands_meet_as_banded_pairs_do(spark, monkeypatch):
    """The same pairs from the buckets, hot ones and several tasks too, and no join or shuffle of pairs."""
    rng = random.Random(13)
    sets = {k: sorted({rng.randrange(-40, 40) for _ in range(rng.randint(1, 6))} | {7} - {k % 3 + 5}) for k in range(300)}
    df = spark.createDataFrame(list(sets.items()), "key int, items array<bigint>").repartition(3)
    monkeypatch.setattr(met_sets, "LEAST_SETS", 60)
    packed = set_similarity.banded_pairs_packed(df, 0.5, 30, 2)
    assert packed.rdd.getNumPartitions() == 5 and "Join" not in packed._jdf.queryExecution().toString()
    want = {tuple(r) for r in set_similarity.banded_pairs(df, 0.5, 30, 2).collect()}
    assert {tuple(r) for r in packed.collect()} == want and len(want) > 100
    assert set_similarity.banded_pairs_packed(df.limit(0), 0.5, 30, 2).count() == 0


def test_betweenness_of_a_whole_graph_in_every_task(spark, monkeypatch):
    """The scores of the levels over tables, from tasks that hold the graph; parts and several shortest paths too."""
    rng = random.Random(14)
    e = as_edges(spark, [*{(rng.randrange(60), rng.randrange(60)) for _ in range(150)}, (100, 101), (101, 102), (7, 7)])
    monkeypatch.setattr(graph, "WHOLE_EDGES", 0)
    want = {(r["src"], r["dst"]): r["score"] for r in graph.betweenness(e).collect()}
    monkeypatch.setattr(graph, "WHOLE_EDGES", 1000)
    monkeypatch.setattr(graph, "_flows", None)  # no table of (source, vertex) is made
    assert {(r["src"], r["dst"]): r["score"] for r in graph.betweenness(e).collect()} == pytest.approx(want)
