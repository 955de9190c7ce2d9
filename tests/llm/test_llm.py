"""Text and vector operators against brute force, round trips and defined cases."""

import base64
import json
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark.llm import bpe, groups, packing, similar, splitting, vectors
from lodespark.llm.boilerplate import main_body
from lodespark.llm.queries import BYTE_BPE, p4_found, p6_found, p9_packed
from lodespark.session import release, shared_folder

needs_files = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="no tokenizer files here")


def reference(data: bytes, ranks: dict) -> list[int]:
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_queue_against_plain_merging(tmp_path):
    rng = random.Random(3)
    tokens = [bytes([i]) for i in range(256)] + list({bytes(rng.choice(b"ab") for _ in range(n)) for n in (2, 2, 3, 4, 5, 6) for _ in range(8)})
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    e = bpe.ByteBpe(str(path))
    for _ in range(400):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
        assert e.merge(data) == ([e.ranks[data]] if data in e.ranks else reference(data, e.ranks))


@needs_files
def test_encoding_equals_another_encoder():
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=bpe.encoder(BYTE_BPE).ranks, special_tokens={})
    rng = random.Random(1)
    bits = ["a", "the", "é", "\x1c", " ", "  ", "\n", "½", "漢", "字", "'s", "'S", "1", "_", "-", "　", "\x85", "😀", "́", "Ⅷ", "𝐀", "<|endoftext|>"]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 50)))
        assert bpe.encoder(BYTE_BPE).encode(t) == other.encode_ordinary(t)
    assert len(bpe.encoder(BYTE_BPE).encode("漢字かな" * 5000)) > 0


@needs_files
def test_corpus_defined_cases(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    got = sorted(map(str, ((r["doc_id"], list(r["ids"])) for r in bpe.encode_corpus(df, "doc_id", "text", BYTE_BPE).collect())))
    assert got == sorted(map(str, [(1, [15496, 995])] * 2 + [(2, []), (3, []), (None, [64])]))
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text", BYTE_BPE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit(rule):
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 100, 3000)
    limits = np.array([100.0, 6.0, 6000.0])
    place = packing.best_fit(sizes, limits, np.array([1.0, 0.05, 0.05]), rule)
    n = np.bincount(place)
    total, square = np.bincount(place, sizes), np.bincount(place, sizes**2)
    assert total.max() <= 100 and n.max() <= 6
    assert all(square[p] <= 6000 or n[p] == 1 for p in range(len(n)))
    assert len(packing.best_fit(np.array([], int), limits, np.ones(3), rule)) == 0


@needs_files
def test_packing_whole_texts(spark):
    rows = [(i, "word " * (i % 40)) for i in range(200)] + [(900, "word " * 1000), (901, None), (902, ""), (3, "twice"), (None, "x")]
    got = packing.pack_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", BYTE_BPE, capacity=100, group_rows=60).toPandas()
    assert got.groupby("container").tokens.sum().max() <= 100
    assert (got[got.doc_id == 900].tokens > 0).all() and len(got[got.doc_id == 900]) > 9
    assert len(got[got.doc_id.isin(range(200)) & (got.doc_id != 3)]) == 199 and len(got[got.doc_id == 3]) == 2
    df = spark.createDataFrame(rows * 3, "doc_id bigint, text string")
    one, other = (packing.pack_texts(df.repartition(n), "doc_id", "text", BYTE_BPE, capacity=100, group_rows=60) for n in (2, 7))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))  # however the table is partitioned
    report = packing.packing_report(one, "doc_id", 100, 256, 100**2).first()
    assert report["fill"] > 0.9 and (report["over_tokens"], report["over_items"], report["over_cost"]) == (0, 0, 0)
    assert packing.packing_report(one.limit(0), "doc_id", 100, 256, 100).first()["containers"] == 0


@needs_files
def test_packed_query_binds_the_cost(spark, tmp_path):
    """One text of 3,000 tokens and small ones: by tokens they share a container, by cost they don't."""
    rows = [(1, "word " * 2999 + "word"), *[(i, "word " * 99 + "word") for i in range(2, 12)]]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = p9_packed(spark, str(tmp_path)).toPandas()
    cost = (got.tokens**2).groupby(got.container).sum()
    size = got.groupby("container").size()
    assert len(got) == 11 and sorted(size) == [1, 10] and (cost[size > 1] <= 4096**2 // 2).all()


@needs_files
def test_cutting_round_trip():
    e = bpe.encoder(BYTE_BPE)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "well.", "pump!", "漢字。", "x\n"]) for _ in range(900)), "漢" * 3000, "a" * 5000, "no stops " * 800, " \n" * 2000, "😀" * 900]
    for t in texts:
        pieces = splitting.cut_text(t, e, 200, 30)
        done, out = 0, ""
        for a, b, n, kind in pieces:
            assert kind in ("sentence", "blank", "inside", "end") and (kind == "end") == (b == len(t))
            assert a <= done < b and n <= 200 and n == e.count(t[a:b])
            out += t[done:b]
            done = b
        assert out == t or e.count(t) <= 200
    assert splitting.cut_text("short", e, 200, 30) == []
    assert {p[3] for p in splitting.cut_text(texts[0], e, 200, 30)[:-1]} == {"sentence"}


@needs_files
def test_cuts_are_reported(spark):
    df = spark.createDataFrame([(1, "One sentence of it. " * 400), (2, None), (3, ""), (4, "word " * 900)], "doc_id bigint, text string")
    pieces = splitting.split_oversized(df, "doc_id", "text", BYTE_BPE, 200, 20)
    got = {r["kind"]: r for r in splitting.cut_report(pieces, 200).collect()}
    assert set(got) == {"sentence", "blank", "end"} and got["end"]["cuts"] == 2 and got["end"]["share"] is None
    assert all(r["over"] == 0 for r in got.values()) and got["sentence"]["share"] + got["blank"]["share"] == pytest.approx(1, abs=1e-3)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = unit(rng.normal(size=(60, 32)))
    rows = unit(np.vstack([centres[rng.integers(0, 60, 900)] + rng.normal(size=(900, 32)) * 0.11, np.tile(centres[:1], (5, 1)), unit(rng.normal(size=(40, 32)))]))
    return [f"i{k:04}" for k in range(len(rows))], rows


def frame(spark, ids, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, rows)], "id string, v array<double>")


def test_most_similar_recall(spark, clustered):
    ids, rows = clustered
    s = rows @ rows.T
    np.fill_diagonal(s, -2)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.57}
    got = {(r["id"], r["other"]) for r in similar.most_similar(frame(spark, ids, rows), 3, 0.57, rows_per_part=60).collect()}
    assert len(want & got) / len(want) >= 0.9
    assert similar.most_similar(frame(spark, ids[:1], rows[:1])).count() == 0
    assert similar.most_similar(frame(spark, ids, rows).limit(0)).count() == 0


def test_asked_cells_hold_the_mass():
    """Joint probabilities of both levels, in order, up to the mass."""
    coarse, fine = np.log([[0.9, 0.1], [0.998, 0.002]]), [np.log([[0.6, 0.4], [0.5, 0.5]]), np.zeros((2, 1))]
    cells, before = similar.Router(coarse, fine).ordered(np.eye(2), 0.95)
    assert [c.tolist() for c in cells] == [[0, 1, 2], [0, 1]]
    assert before[0].tolist() == pytest.approx([0, 0.54, 0.9], abs=1e-6)
    assert [c.tolist() for c in similar.Router(coarse, fine).ordered(np.eye(2), 0.3)[0]] == [[0], [0]]
    assert similar.Router(coarse, fine).home(np.eye(2)).tolist() == [0, 0]


def test_cells_stay_small_as_vectors_grow(spark):
    """More than a hundred cells: as many as the rows ask for, balanced, with recall kept."""
    rng = np.random.default_rng(9)
    centres = unit(rng.normal(size=(700, 48)))
    rows = unit(centres[rng.integers(0, 700, 9000)] + rng.normal(size=(9000, 48)) * 0.1)
    ids = [f"i{k:05}" for k in range(len(rows))]
    df = frame(spark, ids, rows).cache()
    for n in (3000, 9000):
        router, mass = similar.fit_two_levels(df.where(f"id < 'i{n:05}'"), n, 5, 0.57, 0.999, 50)
        home = router.home(rows[:n])
        assert all(c[0] == h for c, h in zip(router.ordered(rows[:n], 0.0)[0], home))
        sizes = np.bincount(home, minlength=router.cells)
        assert 0.7 * n / 50 <= router.cells <= 2 * n / 50 and np.percentile(sizes, 95) < 150
    assert router.cells > 100
    s = rows @ rows.T
    np.fill_diagonal(s, -2)
    best = np.argpartition(-s, 5, axis=1)[:, :5]
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in best[i] if s[i, j] >= 0.57}
    got = {(r["id"], r["other"]) for r in similar.most_similar(df, rows_per_part=50).collect()}
    print("recall", len(want & got) / len(want), len(want), mass)
    assert len(want & got) / len(want) >= 0.99


def test_most_similar_recall_from_a_small_sample(spark, monkeypatch):
    """Cosines on both sides of the threshold, and a router fitted on four in a hundred rows."""
    monkeypatch.setattr(similar, "SAMPLE", 240)
    rng = np.random.default_rng(8)
    centres = unit(rng.normal(size=(100, 64)))
    rows = unit(centres[rng.integers(0, 100, 6000)] + rng.normal(size=(6000, 64)) * 0.108)
    ids = [f"i{k:04}" for k in range(len(rows))]
    s = rows @ rows.T
    np.fill_diagonal(s, -2)
    best = np.argpartition(-s, 5, axis=1)[:, :5]
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in best[i] if s[i, j] >= 0.57}
    got = {(r["id"], r["other"]) for r in similar.most_similar(frame(spark, ids, rows)).collect()}
    print("recall", len(want & got) / len(want), len(want))
    assert len(want & got) / len(want) >= 0.9


def brute_groups(ids, rows):
    near = rows @ rows.T >= 0.57
    label = np.arange(len(ids))
    while True:
        fresh = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (fresh == label).all():
            break
        label = fresh
    sizes = np.bincount(label)
    return {ids[i]: ids[label[i]] for i in range(len(ids)) if sizes[label[i]] > 1}


def test_groups_against_brute_force(spark, clustered):
    """Few cosines near the threshold: the default margin. Groups that hang together by single links at it: a wide one."""
    ids, rows = clustered
    rng = np.random.default_rng(4)
    apart = unit(np.repeat(unit(rng.normal(size=(60, 200))), 10, axis=0) + rng.normal(size=(600, 200)) * 0.03)
    for i, r, options in ((ids, rows, {"margin": 0.4}), (ids[:600], apart, {})):
        want = brute_groups(i, r)
        got = {x["id"]: x["group_first_id"] for x in groups.similarity_groups(frame(spark, i, r), rows_per_cell=60, **options).collect()}
        wrong = sum(got.get(k) != want.get(k) for k in i)
        assert wrong <= (0.02 * len(i) if options else 0)


def test_groups_are_exact_by_default(spark, clustered):
    """Overlapping groups, and chains of single links just above the threshold, in one block and in many small ones."""
    ids, rows = clustered
    rng = np.random.default_rng(6)
    chains = []
    for start in unit(rng.normal(size=(40, 48))):
        for _ in range(12):
            chains.append(start)
            off = rng.normal(size=48)
            off = unit((off - off @ start * start)[None])[0]
            start = 0.58 * start + (1 - 0.58**2) ** 0.5 * off
    chains = unit(np.array(chains))
    for i, r in ((ids, rows), (ids[: len(chains)], chains)):
        want = brute_groups(i, r)
        for options in ({}, {"block_rows": 100}):
            got = groups.similarity_groups(frame(spark, i, r), rows_per_cell=20, **options).collect()
            assert {x["id"]: x["group_first_id"] for x in got} == want and len(got) == len(want)


def test_clusters_of_keywords(spark):
    """Hashed weighted keywords of six topics fall into clusters of one topic each, told by size, nearest posts and words."""
    rng = random.Random(3)
    rows = [(f"p{i:03}", sorted({"common", *rng.choices([f"t{i % 6}w{j}" for j in range(5)], k=4)})) for i in range(240)] + [("none", []), ("null", None)]
    df = spark.createDataFrame(rows, "id string, terms array<string>")
    v = groups.hashed_features(df, "id", F.col("terms")).cache()
    assert v.count() == 240 and groups.hashed_features(df.limit(0), "id", F.col("terms")).count() == 0
    topics = {}
    for r in groups.kmeans_clusters(v, 20).collect():
        topics.setdefault(r["cluster"], []).append(int(r["id"][1:]) % 6)
    assert len(topics) >= 6 and sum(max(map(t.count, range(6))) for t in topics.values()) >= 0.95 * 240
    told = groups.describe_groups(groups.kmeans_clusters(v, 20), v, df.select("id", F.explode("terms").alias("term")), group="cluster").collect()
    assert sum(r["size"] for r in told) == 240 and all(len(r["typical"].split(",")) == min(3, r["size"]) and r["keywords"] for r in told)
    assert groups.kmeans_clusters(v.limit(3)).select("cluster").distinct().count() == 1 and groups.kmeans_clusters(v.limit(0)).count() == 0


def test_packed_without_loss():
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=8).round(4), (rng.normal(size=8) * 100).round(6), rng.normal(size=8), np.array([1e300] * 8), np.arange(8.0), np.array([5e-324] * 8), np.array([0.1, -0.0] * 4)]
    held = vectors.packed(np.array(rows))
    assert (vectors.unpacked(held) == np.array(rows)).all()
    assert [len(x) for x in held] == [17, 33, 65, 65, 17, 65, 17]


def taken(spark, make):
    """What ``make`` returns, and the most bytes of shuffle and checkpoint files that it held at a time."""
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), shared_folder(spark).removeprefix("file:")]
    release(spark)

    def now() -> int:
        total = 0
        for folder in folders:
            for where, _, files in os.walk(folder):
                for f in files:
                    try:
                        total += os.path.getsize(os.path.join(where, f))
                    except OSError:
                        pass
        return total

    most, over = [], threading.Event()
    first = now()
    watch = threading.Thread(target=lambda: [most.append(now()) for _ in iter(lambda: over.wait(0.1), True)])
    watch.start()
    try:
        out = make()
    finally:
        over.set()
        watch.join()
    return out, max(most) - first


def posts(spark, folder, n, groups, noise):
    """A table of ``n`` embeddings of 200 numbers in groups; the ids, unit vectors and bytes of it."""
    rng = np.random.default_rng(8)
    rows = (rng.normal(size=(groups, 200))[rng.integers(0, groups, n)] + rng.normal(size=(n, 200)) * noise).round(4)
    ids = [f"p{i:05}" for i in range(n)]
    spark.createDataFrame(list(zip(ids, map(json.dumps, rows.tolist()))), "reddit_post_id string, embedding string").repartition(4).write.parquet(f"{folder}/embedding_vectors.parquet")
    return ids, unit(rows), sum(p.stat().st_size for p in (folder / "embedding_vectors.parquet").iterdir())


def test_similar_within_the_disk(spark, tmp_path, monkeypatch):
    """However many cells a vector asks, no more than a copy or so of the table is on disk for it at a time."""
    monkeypatch.setattr(vectors, "PASS_ROWS", 500)
    ids, rows, size = posts(spark, tmp_path, 4000, 150, 0.6)
    d = rows @ rows.T
    np.fill_diagonal(d, -1)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in np.argsort(-d[i])[:5] if d[i, j] >= 0.57}
    got, most = taken(spark, lambda: {tuple(r) for r in p4_found(spark, str(tmp_path)).collect()})
    assert len(got & want) > 0.98 * len(want)
    assert most < 4 * size


def test_passes_give_the_same(spark, clustered, monkeypatch):
    """Cells split into many blocks and met in many passes: the rows of one pass, also where all are in one cell."""
    df = frame(spark, *clustered).where("id not between 'i0900' and 'i0904'")  # copies, told apart by rounding only
    for rows in (50, 5000):
        once, often = (set(), set())
        for found, sizes in ((once, ()), (often, (100, 64, 200))):
            for name, x in zip(("QUERY_BLOCK", "INDEX_BLOCK", "PASS_ROWS"), sizes):
                monkeypatch.setattr(vectors, name, x)
            found |= {(r["id"], r["other"], round(r["cosine"], 9)) for r in similar.most_similar(df, rows_per_part=rows).collect()}
        monkeypatch.undo()
        assert once == often and len(once) > 4000


def test_groups_within_the_disk(spark, tmp_path, monkeypatch):
    """Many blocks that all meet: the disk taken stays that of a few copies of the table, and the groups are exact."""
    monkeypatch.setattr(groups, "PASS_ROWS", 500)
    monkeypatch.setattr(groups.similarity_groups, "__defaults__", (0.57, 100, 512, None, 200, 2))
    ids, rows, size = posts(spark, tmp_path, 4000, 700, 0.75)
    got, most = taken(spark, lambda: {r[0]: r[1] for r in p6_found(spark, str(tmp_path)).collect()})
    assert got == brute_groups(ids, rows) and 100 < len(set(got.values()))
    assert most < 6 * size  # 4.0 when written, with four blocks a side; 12.6 with a copy for each pair of blocks


def test_unit_vectors(spark):
    good = [3.0, 4.0]
    rows = [("a", json.dumps(good)), ("a", json.dumps(good)), ("b", "[0, 0]"), ("c", "[1]"), ("d", "[1, NaN]"), ("e", None), ("f", "null"), ("g", "bad"), (None, "[1, 1]"), ("h", "[1e300, 1e300]"), ("i", "[1, null]")]
    got = {r["id"]: r["v"] for r in vectors.unit_vectors(spark.createDataFrame(rows, "k string, e string"), "k", "e", 2).collect()}
    assert got == {"a": pytest.approx([0.6, 0.8]), "h": pytest.approx([0.5**0.5] * 2)}


def test_main_body(spark):
    rows = []
    for h in range(6):
        for p in range(12):
            story = f"The {p} number {h} engineers found that pump {p} of field {h} lost pressure during the night and was repaired before noon"
            body = [f"Menu{h} | Shop{h} | News{h}", f"Headline number {'abcdefghijkl'[p]} of site{h}", "", story, f"Second line about valve {p} and the long winter {h} which nobody had expected to be so cold", f"Copyright site{h} all rights", "Back to top"]
            rows.append((f"{h}-{p}", f"Headline number {'abcdefghijkl'[p]} of site{h}", f"https://site{h}.example/{p}", "\n".join(body)))
    rows += [("e", "t", "u", ""), ("n", "t", "u", None), (None, "t", "u", "x"), ("x", None, None, "Error 403"), rows[0]]
    got = {}
    for r in main_body(spark.createDataFrame(rows, "id string, title string, url string, content string")).collect():
        got.setdefault(r["id"], []).append(r["line_no"])
    assert not {"e", "n", None, "x"} & set(got)
    assert all(sorted(v) == [2, 4, 5] for v in got.values()) and len(got) == 72


def test_long_blocks_are_counted_like_short_ones(spark):
    """A block that one host repeats and fifty others hold once is judged by all its hosts, whatever its length."""
    short = "nobody shall be held liable for whatever follows from reading this or from copying it elsewhere without having asked the publisher beforehand"
    long = short + " and nobody else may claim that an answer to such a request was given by word of mouth alone"
    assert len(short) < 200 < len(long)
    got = []
    for notice in (short, long):
        rng = random.Random(2)
        rows = []
        for h in range(60):
            for p in range(6):
                body = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(20)) + "." for _ in range(3)]
                if h == 0 or h <= 50 and p == 0:
                    body.insert(1, notice + ".")
                rows.append((f"{h}-{p}", f"title of {h} {p}", f"https://site{h}.example/{p}", "\n".join(body)))
        got.append({tuple(r) for r in main_body(spark.createDataFrame(rows, "id string, title string, url string, content string")).collect()})
    assert got[0] == got[1] and all((f"0-{p}", 2) in got[1] for p in range(6))


def test_headlines_with_rare_words(spark):
    """Another page's headline is found although its words stand in few of more than 40,000 titles."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rare = "zorvik plaudet quimra ostrel bendux"
    story = [" ".join(word() for _ in range(20)) + "." for _ in range(3)]
    rows = [("p", "own title here", "https://one.example/p", "\n".join([story[0], rare.title(), story[1], story[2]]))]
    rows += [(f"r{i}", rare, f"https://r{i}.example/", "x") for i in range(2)]
    rows += [(f"f{i}", f"{word()} {word()}", f"https://f{i % 50}.example/{i}", "x") for i in range(41_000)]
    got = main_body(spark.createDataFrame(rows, "id string, title string, url string, content string")).where("id = 'p'")
    assert sorted(r["line_no"] for r in got.collect()) == [1, 3, 4]
