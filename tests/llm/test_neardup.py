import random
import tempfile
import uuid
from itertools import combinations
from pathlib import Path

import numpy as np

import corpus_pipeline as p
from keepsake.llm import neardup as n


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)} - {()}


def brute(rows):
    """The smallest id that each id reaches by pairs of similarity 0.8 or more."""
    root, sets = {i: i for i, _ in rows}, {i: sets_of(t) for i, t in rows}
    for (a, x), (b, y) in combinations(sets.items(), 2):
        if 5 * len(x & y) >= 4 * len(x | y) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def edited(words, edits, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    texts = ["", None, " \n", "one two", "One two", "a b c d e f"]
    for _ in range(4):
        base = [f"w{rng.randrange(500)}" for _ in range(300)]
        texts += [edited(base, rng.choice([0, 1, 3, 5, 6, 7, 9, 15, 40]), rng) for _ in range(25)]
    rows = list(enumerate(texts))
    got = {r.id: r.component for r in n.near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) > 8


def test_the_stage_takes_edited_copies_beyond_four_bits(spark):
    rng = random.Random(1)
    rows = []
    for k in range(20):
        base = [f"w{rng.randrange(2000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(base, 4, rng))]
    want = {i for i, r in brute(rows).items() if i == r}
    assert want == set(range(0, 40, 2))
    kept = p.STAGES[1][1](spark, frame(spark, rows), "").collect()
    assert {r.doc_id for r in kept} == want


def test_the_stage_over_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {i for i, r in brute([tuple(r) for r in docs.collect()]).items() if i == r}
    assert {r.doc_id for r in p.STAGES[1][1](spark, docs, "").collect()} == want


def test_rows_without_an_id_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (4, "A b c d e f"), (4, "A b c d e f"), (7, "a b c d e f")]
    assert sorted((str(r.doc_id), r.text) for r in n.keep_first(frame(spark, rows)).collect() if r.text) == [("4", "A b c d e f"), ("None", "a b c d e f")]
    assert n.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_candidates_of_pairs_at_the_threshold():
    """Pairs of similarity 0.8 to 0.83, with edits scattered or in one passage, at the end or inside: nearly all share a variant."""
    rng = random.Random(3)
    found = []
    for k in range(400):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 200, 600]))]
        other, size = list(base), len(base)
        if k % 2:
            start = rng.randrange(size - size // 10)
            other[start:start + size // 10 - 4] = [f"x{rng.randrange(10**6)}" for _ in range(size // 10 - 4)]
        else:
            while True:
                trial = list(other)
                trial[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
                a, b = sets_of(" ".join(base)), sets_of(" ".join(trial))
                if len(a & b) < 0.8 * len(a | b):
                    break
                other = trial
        a, b = sets_of(" ".join(base)), sets_of(" ".join(other))
        assert len(a & b) >= 0.8 * len(a | b)
        sets = [n.shingles(" ".join(t)) for t in (base, other)]
        x, y = (n.variants((v > 0).astype("u1")[None], n._uncertain(v)[None], np.array([len(h)]))[0] for h, v in ((h, n.votes(h)) for h in sets))
        found.append(bool(set(x.tolist()) & set(y.tolist())))
    assert sum(found) >= 0.98 * len(found)


def test_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "7 " * 500_000), (4, "9" * 1_000_000), (5, "," * 1_000_000)]
    docs = frame(spark, rows).selectExpr("*", "'x' AS node", "'y' AS key", "'z' AS id", "1 AS _keep")
    kept = n.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_texts_that_hold_another_are_found(spark):
    """Pairs at 0.8 to 0.83 of which one is the other with more at its end or front: recall against all pairs."""
    rng = random.Random(9)
    rows, pairs = [], []
    for k in range(150):
        size = rng.choice([60, 150, 400])
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        extra = [f"x{rng.randrange(10**6)}" for _ in range(int((size - 4) * rng.uniform(0.2, 0.25)))]
        a, b = " ".join(base), " ".join(base + extra if k % 2 else extra + base)
        rows += [(2 * k, a), (2 * k + 1, b)]
        if 5 * len(sets_of(a) & sets_of(b)) >= 4 * len(sets_of(a) | sets_of(b)):
            pairs.append(2 * k)
    got = {r.id: r.component for r in n.near_duplicates(frame(spark, rows)).collect()}
    assert len(pairs) > 120 and sum(got[i + 1] == i for i in pairs) >= 0.97 * len(pairs)
    assert all(got[i] == i for i in range(0, 300, 2))


def test_rounds_end_when_no_candidate_joins_two_groups(spark, monkeypatch):
    """One candidate a node and round finds what all at once find."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(500)}" for _ in range(250)]
    rows = [(i, edited(base, rng.choice([2, 4, 6, 9, 12, 16]), rng)) for i in range(80)]
    monkeypatch.setattr(n, "CLOSEST", 10_000)
    want = {r.id: r.component for r in n.near_duplicates(frame(spark, rows)).collect()}
    monkeypatch.setattr(n, "CLOSEST", 1)
    monkeypatch.setattr(n, "WIDER", 2)
    assert {r.id: r.component for r in n.near_duplicates(frame(spark, rows)).collect()} == want


def crowd(seed, size=160):
    """Texts of one base too unlike each other to be linked, and a near copy of every fourth of them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts = [edited(base, 8, rng) for _ in range(size)]
    texts += [edited(t.split(), 2, rng) for t in texts[::4]]
    return list(enumerate(texts))


def test_links_that_no_fingerprint_tells(spark, monkeypatch):
    """Where no pair of a variant is a candidate, all links are found nevertheless, however a group is compared."""
    rows = crowd(21)
    want = brute(rows)
    assert len(rows) > 2 * n.FEW and 100 < len(set(want.values())) < len(rows) - 20
    monkeypatch.setattr(n, "_alike", lambda pairs, nodes, similarity: pairs.withColumn("differ", n.F.lit(0)).limit(0))
    for few, block in ((n.FEW, 30), (1000, n.BLOCK)):
        monkeypatch.setattr(n, "FEW", few)
        monkeypatch.setattr(n, "BLOCK", block)
        assert {r.id: r.component for r in n.near_duplicates(frame(spark, rows)).collect()} == want


def test_first_shingles_meet_and_links_of_two_blocks():
    rng = np.random.default_rng(2)
    few = [np.unique(rng.integers(0, 1 << 62, size, np.uint64)) for size in (1, 4, 5, 9, 50, 400)]
    for a in few:
        b = np.unique(np.concatenate([a[: int(np.ceil(0.8 * len(a)))]]))
        frequent = (a[::2].copy(), np.arange(2, 2 + len(a[::2])))
        for order in (None, frequent):
            assert set(n.first_shingles(a, 0.8, order).tolist()) & set(n.first_shingles(b, 0.8, order).tolist())
    sets = [few[5], few[5][:330], few[5][:300], few[4]]
    assert n.spanning_links([7, 8, 9, 10], sets, [7, 8, 9, 10], np.array([0, 0, 0, 0]), 0.8) == [(7, 8), (8, 9)]
    assert n.spanning_links([7, 8, 9, 10], sets, [7, 8, 9, 10], np.array([0, 1, 0, 1]), 0.8) == [(7, 8), (8, 9)]
    assert n.spanning_links([7, 8, 9, 10], sets, [7, 7, 9, 10], np.array([0, 0, 1, 1]), 0.8) == [(8, 9)]
    assert n.spanning_links([7, 8, 9, 10], sets, [7, 7, 7, 10], np.array([0, 0, 0, 0]), 0.8) == []


def test_texts_of_a_family_are_sent_to_sets_of_like_sizes(spark, monkeypatch):
    """A text meets the blocks of sizes that can be similar to its own, and goes nowhere where it meets none."""
    rng = random.Random(31)
    base = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(base[:40 + 24 * i])) for i in range(70)]
    rows += [(100 + i, edited(rows[i][1].split(), 1, rng)) for i in range(0, 70, 9)]
    docs = frame(spark, rows)
    names = {n._node(n.shingles(t)): (i, len(n.shingles(t))) for i, t in rows}
    members = spark.createDataFrame([(1, k, v[1], k) for k, v in names.items()], "family long, node long, n long, root long")
    members = members.union(spark.createDataFrame([(2, next(iter(names)), 40, 0)], members.schema))
    slim = docs.select("text", n.F.xxhash64("text").alias("key"))
    nodes = spark.createDataFrame([(k, n.shingles(dict(rows)[v[0]]).view(np.int64).tolist()) for k, v in names.items()], "node long, s array<long>").select("node").join(
        spark.createDataFrame([(k, dict(rows)[v[0]]) for k, v in names.items()], "node long, text string").select("node", n.F.xxhash64("text").alias("key")), "node")
    monkeypatch.setattr(n, "BLOCK", 8)
    sent, linked = [], n._linked

    def counted(width, similarity):
        def run(batches):
            def seen():
                for batch in batches:
                    open(f"{folder}/{uuid.uuid4().hex}", "w").write(str(len(batch)))
                    yield batch
            yield from linked(width, similarity)(seen())
        return run

    folder = tempfile.mkdtemp(prefix="spark-")
    monkeypatch.setattr(n, "_linked", counted)
    got = n._links(n.cut(members), nodes, slim, n.WIDTH, 0.8).collect()
    sent = sum(int(p.read_text()) for p in Path(folder).iterdir())
    up = {k: k for k in names}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in got:
        up[top(a)] = top(b)
    groups = {i: min(names[k][0] for k in names if top(k) == top(node)) for node, (i, _) in names.items()}
    assert groups == {i: c for i, c in brute(rows).items() if i in groups}
    # All blocks of eight texts: ten times each text and the lone text of its own.
    assert sent < 7 * len(names)


def test_texts_become_strings_by_few_rows(spark, monkeypatch):
    """Whatever an Arrow batch holds; ids beside a row without one stay exact."""
    prints = n._prints

    def watched(width):
        run = prints(width)

        def few(batches):
            for batch in batches:
                assert len(batch) <= 256
                yield batch
        return lambda batches: run(few(batches))

    monkeypatch.setattr(n, "_prints", watched)
    rows = [(2**60 + i, f"t{i % 600}") for i in range(700)] + [(None, "t1"), (5, None)]
    got = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = [(i, 5 if t is None else 2**60 + int(t[1:])) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_wide_bitmaps_tell_long_texts_apart(spark):
    """MAP_BITS are full of a long text's shingles and bound nothing; a wide bitmap rules unlike sets out and loses no like ones, also of two lengths."""
    rng = np.random.default_rng(3)
    a, other, more = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (4000, 4000, 500))
    sets = {"a": a, "like": np.concatenate((a[200:], more[:200])), "longer": np.concatenate((a, more)), "other": other, "short": a[:1500]}
    rows = [(k, len(x), n.bitmap(x).view(np.int64).tolist(), n.bitmap(x, n.wide_bits(len(x))).view(np.int64).tolist() if len(x) > n.MAP_BITS else None) for k, x in sets.items()]
    nodes = spark.createDataFrame(rows, "node string, n long, map array<long>, wide array<long>")
    left, right = (nodes.toDF(*[f"{c}_{side}" for c in nodes.columns]) for side in ("node", "star"))
    got = {(r.node_node, r.node_star): r.most for r in left.crossJoin(right).select("node_node", "node_star", n._own_wide("node", "star").alias("most")).collect()}
    shared = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in sets for j in sets}
    assert all(got[i, j] >= shared[i, j] for i, j in got if "short" not in (i, j))
    need = lambda i, j: (len(sets[i]) + len(sets[j])) * n.SIMILARITY / (1 + n.SIMILARITY)
    full = 4000 - int(np.bitwise_count(n.bitmap(a) & ~n.bitmap(other)).sum())
    assert got["a", "other"] < need("a", "other") <= full and min(got["a", "like"], got["a", "longer"]) >= need("a", "like")
    assert len(rows[0][3]) == 64 and len(rows[2][3]) == 128


def test_possible_links_join_all_pairs_that_bitmaps_allow():
    """Sets of many sizes and bitmaps of several widths, within one block and between two: no similar pair is left apart, and unlike ones are."""
    rng = np.random.default_rng(8)
    sets, base = [], rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    for size in (40, 300, 1900, 2040, 2100, 4090, 5000):
        sets += [np.unique(np.concatenate((base[:size], rng.integers(0, 1 << 63, extra).astype(np.uint64)))) for extra in (0, size // 9, size // 6, size // 2)]
        sets += [np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(3)]
    sizes, maps = np.array([len(x) for x in sets]), [n.bitmap(x, n.wide_bits(len(x))) for x in sets]
    assert len({len(m) for m in maps}) == 3
    alike = {(i, j) for i, j in combinations(range(len(sets)), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    roots = np.array([0 if i in (0, 1) else i for i in range(len(sets))])
    for sides in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        found = n.possible_links(list(range(len(sets))), sizes, maps, roots, sides, 0.8)
        up = list(range(len(sets)))
        for i, j in found:
            assert roots[i] != roots[j] and (not sides.any() or sides[i] != sides[j])
            up = [up[i] if x == up[j] else x for x in up]
        wanted = [(i, j) for i, j in alike if roots[i] != roots[j] and (not sides.any() or sides[i] != sides[j])]
        assert len(wanted) > 5 and all(up[i] == up[j] for i, j in wanted) and len(set(up)) > 20 and len(found) < len(sets)


def test_texts_that_bitmaps_tell_apart_are_not_sent(spark, monkeypatch):
    """Texts that share many passages, none with another most of its own, are a family of which two near copies are sent."""
    rng = random.Random(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(24)]
    rows = [(i, " ".join(passages[k] for k in rng.sample(range(24), 12))) for i in range(80)]
    rows.append((80, edited(rows[3][1].split(), 1, rng)))
    want, sent, verified = brute(rows), n._texts_of, []
    assert len(set(want.values())) == 80 and want[80] == 3
    monkeypatch.setattr(n, "_alike", lambda pairs, nodes, similarity: pairs.withColumn("differ", n.F.lit(0)).limit(0))
    monkeypatch.setattr(n, "_texts_of", lambda touched, nodes, docs: verified.append(touched.count()) or sent(touched, nodes, docs))
    assert {r.id: r.component for r in n.near_duplicates(frame(spark, rows)).collect()} == want
    assert sum(verified) < 20
