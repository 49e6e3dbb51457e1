"""Near-duplicate groups of texts: wide SimHash fingerprints find the candidates, exact similarity decides.

Two texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in some 15 % of the bits of a
SimHash, too many for a few segments of 64 bits. So the fingerprint is wider, and is cut into SEGMENTS runs of
SEGMENT_BITS bits, of which the first TRIED are asked. A segment of two such texts differs by at most one bit now and then, and a bit that differs is
nearly always an uncertain one, whose shingles are about evenly for and against it. A segment therefore gives
deletion variants for its WILDCARDS least certain bits alone: the segment without that bit, under a class of the
set's size, as sets of very different sizes cannot be similar. Texts that share a variant are candidates; they are
thinned by the sizes of their sets and by all bits of their fingerprints, and the sets themselves are compared.

That links most of what is to be linked at a low cost, but not all of it. The rest comes by an exact join: in any one
order of all shingles, two sets of the wanted similarity share one of the first few (of 20 % and one) of each. Texts that
share such a shingle and are not in one component yet are paired where few share it; where many do, the texts that
these shingles join are a family, whose bitmaps are compared with one another. What that leaves as possible joins texts
into families anew, and only of these the texts are sent and the sets compared. Both are done in tasks of two blocks each,
and a task returns no more links than it has texts. Bounds on sizes, places and bitmaps only leave what cannot be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import broadcast_up_to, cut, encode, fresh, map_slices, mix, partitions, shingle_hashes, span_hashes, word_spans
from keepsake.llm.components import components

#: Words of a shingle, and the similarity from which two texts are linked.
WIDTH, SIMILARITY = 5, 0.8
#: Bits of a fingerprint; segments, their bits, and how many variants each of them gives.
BITS, SEGMENTS, SEGMENT_BITS, WILDCARDS = 1408, 88, 22, 4
#: A size class spans so many steps from one size to the least that can be similar to it; each segment shifts the classes.
CLASS_STEPS = 4
#: Segments that are asked for candidates, and with how many of a variant's texts the others are paired; what they miss the exact join finds.
TRIED, STARS = 16, 1
#: Bits of the bitmap of a set, one a shingle: a bit that only one of two sets has is a shingle that only that one has.
MAP_BITS = 2048
#: Texts from which it is guessed which shingles are frequent, and how many such shingles are told to the workers. Any order of the shingles gives the same links.
ORDER_TEXTS, ORDER_SHINGLES = 4_000, 100_000
#: A shingle of up to so many texts gives pairs; texts of more are compared in blocks of so many texts and so many shingles.
FEW, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 21
#: Bitmaps are compared in blocks of so many, and of so many shingles (two bits or fewer a shingle where there are many).
MAPS, MAPS_SHINGLES = 4096, 1 << 23
#: A text is compared first with so many candidates, those of the most alike fingerprints; each round then takes so many times as
#: many, of those in other components, until no candidate is left that joins two components.
CLOSEST, WIDER = 12, 4
#: A pair whose fingerprints are this many deviations less alike than texts of the wanted similarity is left (3 in a million).
DEVIATIONS = 4.5
#: Rows of an outgoing batch.
ROWS_OUT = 256
_LONG, _LONGS = pa.int64(), pa.list_(pa.int64())
#: Names of texts that may be broadcast to find their texts (16 bytes each).
BROADCAST_ROWS = 500_000
_SEED = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))


def _segments() -> np.ndarray:
    """The bits of each segment: runs of all bits in one order after another, as few segments share two bits."""
    rng = np.random.default_rng(5)
    per = BITS // SEGMENT_BITS
    orders = [rng.permutation(BITS)[: per * SEGMENT_BITS].reshape(per, SEGMENT_BITS) for _ in range(-(-SEGMENTS // per))]
    return np.concatenate(orders)[:SEGMENTS]


_OF_SEGMENT = _segments()
_PLACE = (1 << np.arange(SEGMENT_BITS)).astype(np.int64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, ASCII letters lower-cased, ascending; one shingle of fewer words."""
    buf = encode(text).lower()
    return np.unique(shingle_hashes(span_hashes(buf, *word_spans(buf)), width))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint, twice the number of hashes that have it, less all of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4080):
        wide = mix(hashes[at:at + 4080, None] ^ _SEED)
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # sums of up to 255 flags fit a byte
            ones += np.add.reduce(bits[k:k + 255], axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def _uncertain(score: np.ndarray) -> np.ndarray:
    """Places, in its segment, of each segment's least certain bits."""
    return np.argpartition(np.abs(score)[_OF_SEGMENT], WILDCARDS - 1, axis=1)[:, :WILDCARDS].astype(np.uint8)


def variants(bits: np.ndarray, least: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The deletion variants of fingerprints (rows of 0 and 1), given the places of the least certain bits of their first segments and the sizes of their sets."""
    asked = least.shape[1]
    value = (bits[:, _OF_SEGMENT[:asked]] * _PLACE).sum(2)
    place = least.astype(np.int64)
    left = value[:, :, None] & ~(np.int64(1) << place)
    number = np.arange(asked)[None, :, None] * SEGMENT_BITS + place
    step = np.log(np.maximum(sizes, 1)) / -np.log(SIMILARITY)
    shift = np.arange(asked) * (CLASS_STEPS / asked)
    kind = ((step[:, None] + shift) / CLASS_STEPS).astype(np.int64)[:, :, None]
    return ((kind << 12 | number) << SEGMENT_BITS | left).reshape(len(bits), -1)


def _node(hashes: np.ndarray) -> int:
    """A 64-bit hash of the set; equal sets are one node."""
    return int(mix(mix(hashes).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes))).view(np.int64)[0])


def first_shingles(hashes: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first of a set's shingles, of which a set of that similarity shares one at least; frequent (hashes ascending, counts) come last."""
    order = np.arange(len(hashes))
    if frequent is not None and len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], hashes), len(frequent[0]) - 1)
        order = np.lexsort((hashes, np.where(frequent[0][at] == hashes, frequent[1][at], 0)))
    return hashes[order[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]] if len(hashes) else hashes


def wide_bits(n: int) -> int:
    """Bits of a bitmap that n shingles leave in part unset: MAP_BITS, doubled up to n; a bitmap that is full bounds nothing."""
    return MAP_BITS << max(0, (max(n, 1) - 1) // MAP_BITS).bit_length()


def bitmap(hashes: np.ndarray, size: int = MAP_BITS) -> np.ndarray:
    """So many bits, as 64-bit words; each shingle sets one. One of half the size is its two halves, one over the other."""
    bits = np.zeros(size, np.uint8)
    bits[(hashes % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def _prints(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_OUT):
                some, rows = batch.iloc[at:at + ROWS_OUT].reset_index(drop=True), []
                for text in some["text"]:
                    hashes = shingles(text, width)
                    score = votes(hashes)
                    rows.append((_node(hashes), len(hashes), np.packbits(score > 0).view(np.int64), _uncertain(score)[:TRIED].tobytes() if len(hashes) else None,
                                 bitmap(hashes).view(np.int64), bitmap(hashes, wide_bits(len(hashes))).view(np.int64) if len(hashes) > MAP_BITS else None))
                out = pd.DataFrame(rows, columns=["node", "n", "bits", "least", "map", "wide"])
                out.insert(0, "key", some["key"])
                out.insert(0, "id", some["id"])
                yield out
    return run


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(sig, node): the variants of fingerprints."""
    for batch in batches:
        for at in range(0, len(batch), ROWS_OUT):
            some = batch.iloc[at:at + ROWS_OUT]
            bits = np.unpackbits(np.stack(some["bits"].tolist()).astype(np.int64).view(np.uint8), axis=1)
            least = np.frombuffer(b"".join(map(bytes, some["least"])), np.uint8).reshape(len(some), TRIED, WILDCARDS)
            sigs = variants(bits, least, some["n"].to_numpy(np.int64))
            yield pd.DataFrame({"sig": sigs.ravel(), "node": np.repeat(some["node"].to_numpy(np.int64), sigs.shape[1])})


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Sets are larger than texts: few of them are held at a time.
            for at in range(0, len(batch), ROWS_OUT):
                some = batch.iloc[at:at + ROWS_OUT]
                yield pd.DataFrame({"node": some["node"], "set": [shingles(t, width).view(np.int64) for t in some["text"]]})
    return run


def _alike(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, star, differ) of the pairs (node, star) whose sizes allow the similarity and whose fingerprints are alike enough."""
    cos = 2 * similarity / (1 + similarity)  # of two sets of one size; of unequal ones it is larger
    share = float(np.arccos(cos) / np.pi)
    most = BITS * share + DEVIATIONS * (BITS * share * (1 - share)) ** 0.5
    # A node has a bounded number of pairs, so that its own fingerprint reaches them by a window over the node; a star may have any number.
    own = nodes.select("node", F.lit(None).cast("long").alias("star"), "n", "bits")
    with_own = pairs.select("node", "star", F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<long>").alias("bits")).unionByName(own)
    over = Window.partitionBy("node")
    noded = with_own.select("node", "star", F.max("n").over(over).alias("n_node"), F.max("bits").over(over).alias("bits_node")).filter("star is not null")
    of_star = nodes.select(F.col("node").alias("star"), F.col("n").alias("n_star"), F.col("bits").alias("bits_star"))
    differ = sum(F.bit_count(F.col("bits_node")[i].bitwiseXOR(F.col("bits_star")[i])) for i in range(BITS // 64))
    sized = F.least("n_node", "n_star") >= F.greatest("n_node", "n_star") * (similarity - 1e-9)
    return noded.join(of_star, "star").filter(sized).withColumn("differ", differ).filter(F.col("differ") <= most).select("node", "star", "differ")


def _closest(pairs: DataFrame, most: int) -> DataFrame:
    """Of each node's pairs (node, star, differ), the `most` most alike.

    A node has STARS candidates a variant at most, so the rows of a node are bounded; a star is not asked for its
    nodes, of which there may be any number.
    """
    rank = F.row_number().over(Window.partitionBy("node").orderBy("differ", F.xxhash64("star"), "star"))
    return pairs.withColumn("_rank", rank).filter(F.col("_rank") <= most).select("node", "star")


def _texts_of(touched: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes in touched."""
    wanted = broadcast_up_to(cut(nodes.join(touched, "node", "left_semi").select("node", "key")), BROADCAST_ROWS)
    return docs.join(wanted, "key").dropDuplicates(["node"]).select("node", "text")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (node, star), as (a, b), whose exact similarity is high enough; sets are made only of the nodes in pairs."""
    texts = _texts_of(pairs.select(F.explode(F.array("node", "star")).alias("node")).distinct(), nodes, docs)
    sets = cut(map_slices(texts, _sets(width), pa.schema({"node": _LONG, "set": _LONGS})))
    both = pairs.select(F.col("node").alias("a"), F.col("star").alias("b")).join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= (F.size("x") + F.size("y") - common) * (similarity - 1e-9)).select("a", "b")


def _hashes(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"hash": shingles(text, width).view(np.int64)})
    return run


def _tokens(width: int, similarity: float, frequent):
    """(token, node, n, place): the first shingles of each text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_OUT):
                sets = [shingles(t, width) for t in batch["text"].iloc[at:at + ROWS_OUT]]
                firsts, sizes = [first_shingles(x, similarity, frequent.value) for x in sets], np.array([len(x) for x in sets], np.int64)
                some = np.array([len(f) for f in firsts], np.int64)
                place = np.arange(some.sum()) - np.repeat(some.cumsum() - some, some)
                yield pd.DataFrame({"token": np.concatenate(firsts).view(np.int64), "node": np.repeat(np.array([_node(x) for x in sets], np.int64), some), "n": np.repeat(sizes, some), "place": place})
    return run


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that several of some ORDER_TEXTS texts have; what they leave out is taken as rare, whatever it is."""
    every = max(1, docs.count() // ORDER_TEXTS)
    some = docs.filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(every)) == 0).dropDuplicates(["key"]).select("text")
    counted = map_slices(some, _hashes(width), pa.schema({"hash": _LONG})).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    top = counted.orderBy(F.desc("n"), "hash").limit(ORDER_SHINGLES).toPandas()
    hashes, counts = top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def spanning_links(nodes: list, sets: list[np.ndarray], roots: list, sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join what all pairs of similar sets of two sides (or within one, if there is but one) join beyond the roots."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    sizes, out = np.array([len(s) for s in sets]), []
    maps = np.stack([bitmap(s, wide_bits(int(sizes.max()))) for s in sets])
    share, one_side = (similarity - 1e-9) / (1 + similarity), (sides == sides[0]).all()
    for i in range(len(nodes) - 1):
        rest = np.arange(i + 1, len(nodes))
        rest = rest[(sizes[rest] + sizes[i]) * share <= np.minimum(sizes[rest], sizes[i])]
        rest = rest if one_side else rest[sides[rest] != sides[i]]
        own = sizes[i] - np.bitwise_count(maps[i] & ~maps[rest]).sum(1, dtype=np.int64)
        other = sizes[rest] - np.bitwise_count(maps[rest] & ~maps[i]).sum(1, dtype=np.int64)
        for j in rest[np.minimum(own, other) >= (sizes[rest] + sizes[i]) * share]:
            a, b = top(roots[i]), top(roots[j])
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= (sizes[i] + sizes[j] - common) * (similarity - 1e-9):
                    up[a] = b
                    out.append((nodes[i], nodes[j]))
    return out


def possible_links(nodes: list, sizes: np.ndarray, maps: list[np.ndarray], roots: np.ndarray, sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs that join what all pairs of two sides (or within one, if there is but one) join whose bitmaps allow the similarity and whose roots differ.

    A bitmap is as wide as its set asks for (wide_bits); of two, the wider is folded to the other, as sets of more than one doubling cannot be similar.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, roots, sides, words = sizes[order], roots[order], sides[order], np.array([len(maps[k]) for k in order])
    share, one_side, label, out = (similarity - 1e-9) / (1 + similarity), (sides == sides[0]).all(), np.arange(len(order)), []
    for width in np.unique(words):
        held = np.flatnonzero((words == width) | (words == 2 * width))
        table = np.stack([maps[order[k]] if words[k] == width else maps[order[k]][:width] | maps[order[k]][width:] for k in held])
        ones, size = np.bitwise_count(table).sum(1, dtype=np.int64), sizes[held]
        stops = np.searchsorted(size, size * ((1 - share) / share) + 1e-6, side="right")
        for at in np.flatnonzero(words[held] == width):
            i, rest = held[at], np.arange(at + 1, stops[at])
            apart = (roots[held[rest]] != roots[i]) & (label[held[rest]] != label[i])
            rest = rest[apart if one_side else apart & (sides[held[rest]] != sides[i])]
            common = np.bitwise_count(table[rest] & table[at]).sum(1, dtype=np.int64)
            most = np.minimum(size[at] - ones[at], size[rest] - ones[rest]) + common
            near = held[rest[most >= (size[rest] + size[at]) * share]]
            while len(near):
                out.append((nodes[order[i]], nodes[order[near[0]]]))
                label[label == label[near[0]]] = label[i]
                near = near[label[near] != label[i]]
    return out


def _by_cell(read, found):
    """(a, b) of rows (family, low, high, ...) in the order of their two blocks, of which a task holds one pair at a time: found() of what read() makes of (block, ...)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for family, low, high, *row in batch.itertuples(index=False):
                if at != (family, low, high):
                    if held and (at[1] == at[2] or len({h[0] for h in held}) > 1):
                        yield pd.DataFrame(found(held), columns=["a", "b"], dtype=np.int64)
                    at, held = (family, low, high), []
                held.append(read(*row))
        if held and (at[1] == at[2] or len({h[0] for h in held}) > 1):
            yield pd.DataFrame(found(held), columns=["a", "b"], dtype=np.int64)
    return run


def _possible(similarity: float):
    """(a, b) of rows (family, low, high, block, node, root, n, map)."""
    def found(held: list) -> list[tuple[int, int]]:
        block, node, root, n, maps = zip(*held, strict=True)
        return possible_links(node, np.array(n, np.int64), maps, np.array(root, np.int64), np.array(block, np.int64), similarity)
    return _by_cell(lambda block, node, root, n, bits: (block, node, root, n, np.asarray(bits, np.int64).view(np.uint64)), found)


def _linked(width: int, similarity: float):
    """(a, b) of rows (family, low, high, block, node, root, text)."""
    def found(held: list) -> list[tuple[int, int]]:
        block, node, root, sets = zip(*held, strict=True)
        return spanning_links(node, sets, root, np.array(block), similarity)
    return _by_cell(lambda block, node, root, text: (block, node, root, shingles(text, width)), found)


def _families(many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family, node, n, root) of rows (token, k, node, n, root), and (node, whole) of those whose family is compared as a whole.

    The texts that tokens join are one family where all its pairs are no more than the pairs of its tokens; else each token is one.
    """
    of = cut(components(many.select(F.col("node").alias("a"), F.col("token").alias("b"))).withColumnRenamed("root", "family"))
    texts = cut(many.select("node", "n", "root").distinct().join(of, "node"))
    tokens = many.select(F.col("token").alias("node"), "k").distinct().join(of, "node")
    cost = tokens.groupBy("family").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("cost"))
    whole = cut(texts.groupBy("family").agg(F.count("*").cast("double").alias("size")).join(cost, "family").filter("size * size <= cost").select("family"))
    covered = cut(texts.join(whole, "family", "left_semi"))
    apart = many.join(covered, "node", "left_anti").select(F.col("token").alias("family"), "node", "n", "root")
    return covered.select("family", "node", "n", "root").unionByName(apart), covered.select("node", F.col("family").alias("whole"))


def _own_wide(a: str, b: str):
    """The most shingles of a that b can share, by their wide bitmaps; the longer is folded to the shorter, as similar sets are at most one doubling apart."""
    x, y = (F.coalesce(f"wide_{c}", f"map_{c}") for c in (a, b))
    words = F.least(F.size(x), F.size(y))
    at = lambda m, w: F.when(F.size(m) > words, m[w].bitwiseOR(m[w + words])).otherwise(m[w])
    lone = F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda found, w: found + F.bit_count(at(x, w).bitwiseAND(F.bitwise_not(at(y, w)))))
    return F.col(f"n_{a}") - lone


def _rest(nodes: DataFrame, roots: DataFrame | None, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that join what all pairs of similar sets join beyond the roots (node, root)."""
    spark = nodes.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(docs, width))
    tokens = map_slices(docs.select("text"), _tokens(width, similarity, frequent), pa.schema({"token": _LONG, "node": _LONG, "n": _LONG, "place": _LONG}))
    once = tokens.select("token", "node").repartition(partitions(spark), "token").distinct()
    groups = once.groupBy("token").agg(F.count("*").alias("k"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("all")).filter("k > 1")
    # Tokens of the same texts are one token.
    told = cut(groups.groupBy("k", "low", "high", "all").agg(F.min("token").alias("token")).select("token", "k"))
    met = tokens.join(broadcast_up_to(told, BROADCAST_ROWS), "token").groupBy("token", "node").agg(*[F.first(c).alias(c) for c in ("k", "n", "place")])
    met = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = cut(met)
    # Texts of one component have nothing to be compared for.
    between = met.groupBy("token").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("token")
    met = cut(met.join(between, "token"))
    many, every = met.filter(F.col("k") > FEW), None
    few = met.filter(F.col("k") <= FEW).withColumn("whole", F.lit(None).cast("long"))
    if _any(many):
        every, covered = _families(many)
        few = few.drop("whole").join(covered, "node", "left")
    x, y = F.col("x.n"), F.col("y.n")
    i, j = F.col("x.place"), F.col("y.place")
    need = (x + y) * ((similarity - 1e-9) / (1 + similarity))
    fits = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.whole").isNull() | F.col("y.whole").isNull() | (F.col("x.whole") != F.col("y.whole")))
    # Shared are at most what comes before the place of one in both sets, that shingle, and what comes after it in both.
    fits = fits & (F.least(i, j) + F.least(x - i, y - j) >= need)
    few = cut(few)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & fits).select(F.col("x.node").alias("node"), F.col("y.node").alias("star")).distinct()
    left, right = (nodes.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "map", "wide")]) for c in ("node", "star"))
    own = lambda a, b: F.col(f"n_{a}") - sum(F.bit_count(F.col(f"map_{a}")[w].bitwiseAND(F.bitwise_not(F.col(f"map_{b}")[w]))) for w in range(MAP_BITS // 64))
    enough = (F.col("n_node") + F.col("n_star")) * ((similarity - 1e-9) / (1 + similarity))
    close = pairs.join(left, "node").join(right, "star").filter(F.least(own("node", "star"), own("star", "node")) >= enough)
    close = close.filter(F.col("wide_node").isNull() & F.col("wide_star").isNull() | (F.least(_own_wide("node", "star"), _own_wide("star", "node")) >= enough))
    close = close.select(F.col("node").alias("a"), F.col("star").alias("b"))
    # What the bounds leave is nearly all alike: its components are the families whose texts are sent, once each and not with each pair.
    joined = components(close if every is None else close.union(_possible_links(every, nodes, similarity))).withColumnRenamed("root", "family")
    members = joined.join(met.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root")), "node").select("family", "node", "n", "root")
    return _links(cut(members), nodes, docs, width, similarity)


def _cells(members: DataFrame, block: int, block_shingles: int, similarity: float) -> DataFrame:
    """(family, low, high, block, node, root): the texts of families (family, node, n, root), dealt to blocks, at each two blocks that are to be compared."""
    blocks_of = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_shingles)).alias("blocks")
    # Sets of sizes two classes apart cannot be similar, so that a text meets the blocks of its own class and of the next ones only; a family of one block is one class.
    whole = members.groupBy("family").agg(blocks_of).select("family", (F.col("blocks") <= 1).alias("whole"))
    kind = F.floor(F.log(F.greatest("n", F.lit(1))) / -float(np.log(similarity - 1e-6)))
    classed = members.join(whole, "family").withColumn("kind", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(kind)).drop("whole")
    blocks = classed.groupBy("family", "kind").agg(blocks_of)
    near = blocks.withColumn("other", F.explode(F.array(*[F.col("kind") + step for step in (-1, 0, 1)])))
    near = near.join(blocks.select("family", F.col("kind").alias("other"), F.col("blocks").alias("others")), ["family", "other"])
    side = lambda kind, block: F.shiftleft(F.col(kind), 32) + F.col(block)
    dealt = classed.join(near, ["family", "kind"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    dealt = dealt.withColumn("block", side("kind", "part")).withColumn("meets", side("other", "with"))
    cells = cut(dealt.select("family", F.least("block", "meets").alias("low"), F.greatest("block", "meets").alias("high"), "block", "node", "root"))
    # A text goes only to where it meets another, of another component and, where there are two blocks, of the other one.
    both = (F.min("root") < F.max("root")) & ((F.col("low") == F.col("high")) | (F.min("block") < F.max("block")))
    return cells.join(cells.groupBy("family", "low", "high").agg(both.alias("both")).filter("both").select("family", "low", "high"), ["family", "low", "high"])


def _possible_links(members: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) that join all pairs of one family (family, node, n, root) whose bitmaps allow the similarity and whose roots differ."""
    cells = _cells(members, MAPS, MAPS_SHINGLES, similarity)
    maps = nodes.select("node", F.col("n").cast("long").alias("n"), F.coalesce("wide", "map").alias("map"))
    rows = cells.join(maps, "node").select("family", "low", "high", "block", "node", "root", "n", "map").repartition(partitions(nodes.sparkSession), "family", "low", "high")
    return map_slices(rows.sortWithinPartitions("family", "low", "high"), _possible(similarity), pa.schema({"a": _LONG, "b": _LONG}))


def _links(members: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that join what all pairs of similar sets within families (family, node, n, root) join beyond the roots."""
    cells = _cells(members, BLOCK, BLOCK_SHINGLES, similarity)
    texts = _texts_of(cells.select("node").distinct(), nodes, docs)
    rows = cells.join(texts, "node").select("family", "low", "high", "block", "node", "root", "text").repartition(partitions(docs.sparkSession), "family", "low", "high")
    return map_slices(rows.sortWithinPartitions("family", "low", "high"), _linked(width, similarity), pa.schema({"a": _LONG, "b": _LONG}))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component) for each row: component is the smallest id that the row reaches by links of at least `similarity`.

    Rows of equal shingle sets are one node. The nodes of a variant are paired with the first STARS of them, so
    that a large group costs rows in proportion to its size. Candidates are compared exactly, the closest of a
    node first; those whose nodes have meanwhile come into one component need no comparison, and the rounds end
    only when every candidate was compared or lies within a component. An exact join finds all links that are
    missing between the components so far (`_rest`), so that no link is lost but by a clash of 64-bit hashes.

    Null, empty and white-space texts are one group; very long texts are read whole. A row without an id is
    kept; it takes its component's smallest id, or null if no row there has one. Repeated rows repeat; other
    columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    prints = cut(map_slices(slim, _prints(width), pa.schema({"id": _LONG, "key": _LONG, "node": _LONG, "n": pa.int32(), "bits": _LONGS, "least": pa.binary(), "map": _LONGS, "wide": _LONGS})))
    nodes = prints.groupBy("node").agg(F.min("id").alias("lowest"), F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "bits", "least", "map", "wide")])
    signed = nodes.filter("n > 0").select("node", "n", "bits", "least").mapInPandas(_signed, "sig long, node long").repartition(partitions(spark), "sig")
    met = cut(signed.join(signed.groupBy("sig").agg(F.count("*").alias("count")).filter("count > 1").select("sig"), "sig"))
    order = lambda skip: F.min_by("node", F.xxhash64("node", F.lit(skip)))
    stars = met.groupBy("sig").agg(F.array_distinct(F.array(*map(order, range(STARS)))).alias("s")).select("sig", F.explode("s").alias("star"))
    # A pair of two stars is one pair, of which either may be the node.
    tried = (met.join(stars, "sig").filter("node <> star").groupBy(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")).agg(F.max("node").alias("node"))
             .select("node", F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("star")))
    open_ = cut(_alike(tried, nodes, similarity))
    known, roots, most = None, None, CLOSEST
    while _any(open_):
        pairs = cut(_closest(open_, most))
        found = _verified(pairs, nodes, slim, width, similarity)
        known = cut(found if known is None else known.union(found))
        roots = components(known)
        left = (open_.join(pairs, ["node", "star"], "left_anti").join(roots.select(F.col("node"), F.col("root").alias("own")), "node", "left")
                .join(roots.select(F.col("node").alias("star"), F.col("root").alias("other")), "star", "left"))
        open_, most = cut(left.filter(F.coalesce("own", "node") != F.coalesce("other", "star")).select("node", "star", "differ")), most * WIDER
    more = _rest(nodes, roots, slim, width, similarity)
    known = cut(more if known is None else known.union(more))
    named = nodes.select("node", "lowest").join(components(known), "node", "left").select("node", "lowest", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("lowest").alias("component"))
    return prints.select("id", "node").join(named.join(smallest, "root").select("node", "component"), "node").select("id", "component")


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose id is the smallest of its group, one row an id; rows without an id stay."""
    key = fresh(docs, "_keep")
    firsts = near_duplicates(docs, id_col, text_col, width, similarity).filter("component is not null").select(F.col("component").alias(key)).distinct()
    kept = docs.join(firsts, F.col(id_col).cast("long") == F.col(key), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
