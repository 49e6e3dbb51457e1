"""Substring dedup: words covered by long enough repeats of earlier documents are removed.

Nothing is compared with the whole corpus. Documents are dealt to chunks by a hash of id and text. A window of
`width` words has an anchor, the least hash of its 5-word runs, so equal windows have equal anchors:

 1. each anchor that two documents have gets an owner, the smallest document id that has it;
 2. an owner's passages under its own anchors are its reference, sent to each chunk that has such anchors;
 3. a chunk gathers its references into shards of bounded size, makes a suffix automaton of each shard and
    streams its documents through those of their owners: a window met there repeats a smaller document;
 4. windows with a shared anchor that its owner does not have are resolved by their own hash in the same way.

Between chunks only one row a chunk and anchor (or window) is exchanged, so that a passage which a third of
all documents share costs a row a chunk, and whole texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.automaton import SuffixAutomaton
from keepsake.llm.common import encode, partitions, shingle_hashes, span_hashes, word_spans

WIDTH = 13
ANCHOR = 5
#: Words of reference passages that one automaton holds.
SHARD_WORDS = 40_000
#: Rows of documents in a chunk, and bytes of their texts, on average; one document may be longer.
CHUNK_ROWS, CHUNK_BYTES = 4_000, 1 << 25
#: Bytes of passages that are hashed together.
PIECE_BYTES = 1 << 20
#: Words of a reference table that may be broadcast.
REFERENCE_WORDS = 2_000_000


def _anchors(words: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window of `width` word hashes, as signed numbers."""
    if len(words) < width:
        return np.empty(0, np.int64)
    runs = shingle_hashes(words, ANCHOR)
    span = width - ANCHOR + 1
    least, size = runs, 1  # minimum over spans of doubling size
    while 2 * size <= span:
        least, size = np.minimum(least[: len(least) - size], least[size:]), 2 * size
    n = len(words) - width + 1
    return np.minimum(least[:n], least[span - size: span - size + n]).view(np.int64)


class _Doc:
    """A document's words, and what is known of its windows."""

    __slots__ = ("anchors", "buf", "ends", "hashes", "id", "starts")

    def __init__(self, key, text, width):
        self.id = key
        self.buf = encode(text)
        self.starts, self.ends = word_spans(self.buf)
        self.hashes = span_hashes(self.buf, self.starts, self.ends) if len(self.starts) >= width else np.empty(0, np.uint64)
        self.anchors = _anchors(self.hashes, width)

    def words(self, start: int, end: int) -> list[bytes]:
        return self.buf[self.starts[start]:self.ends[end - 1]].split()

    def key(self) -> int:
        return int(np.uint64(xxhash.xxh3_64_intdigest(self.buf)).view(np.int64))


def _docs(frame: pd.DataFrame, width: int) -> Iterator[_Doc]:
    for key, text in zip(frame["id"].tolist(), frame["text"], strict=True):
        yield _Doc(key, text, width)


def _spans(windows: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true windows, as (first, last + 1)."""
    step = np.diff(np.concatenate(([0], windows.view(np.int8), [0])))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def _under(sent: pd.DataFrame, known: np.ndarray, owner: np.ndarray, width: int) -> list[tuple[int, list[bytes]]]:
    """(owner, words) of the passages sent to a chunk, by owner: their parts under the anchors that the chunk shares with that owner."""
    parts, lines, size = set(), [], 0
    for o, ps in zip(sent["owner"].tolist(), sent["passages"], strict=True):
        for p in bytes(ps).split(b"\n"):
            lines.append((o, p))
            size += len(p)
            if size >= PIECE_BYTES:
                parts |= _shared(lines, known, owner, width)
                lines, size = [], 0
    return [(o, p.split()) for o, p in sorted(parts | _shared(lines, known, owner, width))]


def _shared(lines: list[tuple[int, bytes]], known: np.ndarray, owner: np.ndarray, width: int) -> set[tuple[int, bytes]]:
    """(owner, words) of the parts of some passages whose anchors are known and their owner's."""
    buf = b"\n".join(p for _, p in lines)
    starts, ends = word_spans(buf)
    if len(starts) < width:
        return set()
    line = np.searchsorted(np.flatnonzero(np.frombuffer(buf, np.uint8) == 10), starts)
    of = np.array([o for o, _ in lines], np.int64)[line]
    anchors = _anchors(span_hashes(buf, starts, ends), width)
    own = (line[:len(anchors)] == line[width - 1:]) & (_lookup(anchors, known, owner) == of[:len(anchors)])
    return {(int(of[s]), buf[starts[s]:ends[e + width - 2]]) for s, e in _spans(own)}


def _rows_by_key(keys: list[np.ndarray], ids: list[int], chunk: int, name: str) -> pd.DataFrame:
    """A row for each distinct key of a chunk: its smallest document, and whether other documents of the chunk have it."""
    if not keys:
        return pd.DataFrame({name: np.empty(0, np.int64), "chunk": np.empty(0, np.int32), "doc": np.empty(0, np.int64), "many": np.empty(0, bool)})
    key, doc = np.concatenate(keys), np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.append(first[1:], len(key)) - 1
    return pd.DataFrame({name: key[first], "chunk": np.int32(chunk), "doc": doc[first], "many": doc[last] != doc[first]})


def _owners(keyed: DataFrame, name: str) -> DataFrame:
    """(chunk, name, owner, others) of the keys that two documents have; others: does the chunk hold one that is not the owner?

    A key has a row a chunk at most, however common it is.
    """
    w = Window.partitionBy(name)
    seen = keyed.select("chunk", name, F.min("doc").over(w).alias("owner"), (F.count("*").over(w) > 1).alias("far"), F.max("many").over(w).alias("near"), "many", "doc")
    return seen.filter("far or near").select("chunk", name, "owner", (F.col("many") | (F.col("doc") != F.col("owner"))).alias("others"))


def _lookup(keys: np.ndarray, known: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The owner of each key, or the largest number where it has none; known is sorted."""
    if not len(known):
        return np.full(len(keys), np.iinfo(np.int64).max)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, owner[at], np.iinfo(np.int64).max)


def _sorted(frame: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    known, owner = frame[name].to_numpy(np.int64), frame["owner"].to_numpy(np.int64)
    order = np.argsort(known)
    return known[order], owner[order]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 chunk_rows: int = CHUNK_ROWS, shard_words: int = SHARD_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept) for each row of docs; kept is the words that stay, joined by one space.

    A word goes if a window of `width` words over it also starts in a document with a smaller id, as the input
    has them. Null, empty and short texts lose nothing. A row without an id loses nothing and makes no other
    row lose anything; rows that share an id do not count as smaller than one another.
    """
    spark = docs.sparkSession
    key = F.col(id_col).cast("long")
    slim = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    # Rows without an id go round the matching, so that they need no chunk.
    named, unnamed = slim.filter("id is not null"), slim.filter("id is null")
    n_rows, n_bytes = named.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_chunks = max(1, -(-n_rows // chunk_rows), -(-n_bytes // chunk_bytes))
    dealt = named.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks)).cast("int")).repartition(min(partitions(spark), n_chunks), "chunk")

    def emit_anchors(key, frame):
        found = [(np.unique(d.anchors), d.id) for d in _docs(frame, width) if len(d.anchors)]
        return _rows_by_key([a for a, _ in found], [i for _, i in found], key[0], "anchor")

    anchored = dealt.groupBy("chunk").applyInPandas(emit_anchors, "anchor long, chunk int, doc long, many boolean")
    owned = _owners(anchored, "anchor")

    def emit_references(key, frame, owned):
        known, owner = _sorted(owned, "anchor")
        out = []
        for d in _docs(frame, width):
            if len(d.anchors):
                own = _lookup(d.anchors, known, owner) == d.id
                spans = [d.buf[d.starts[s]:d.ends[e + width - 2]] for s, e in _spans(own)]
                if spans:
                    out.append((d.id, b"\n".join(b" ".join(x.split()) for x in spans)))
        return pd.DataFrame(out, columns=["owner", "passages"])

    references = dealt.groupBy("chunk").cogroup(owned.groupBy("chunk")).applyInPandas(emit_references, "owner long, passages binary")
    asked = owned.filter("others").select("owner", "chunk").distinct().join(references, "owner").select("chunk", F.lit(0).cast("long").alias("anchor"), "owner", "passages")
    helped = owned.filter("others").select("chunk", "anchor", "owner", F.lit(None).cast("binary").alias("passages")).union(asked)

    def match(key, frame, helped):
        chunk = key[0]
        plain = helped["passages"].isna()
        known, owner = _sorted(helped[plain], "anchor")
        passages = _under(helped[~plain], known, owner, width)
        # A shard takes whole owners: all passages of an owner are met by the same automaton.
        bounds, size = [0], 0
        for i, (own, words) in enumerate(passages):
            if size >= shard_words and own != passages[i - 1][0]:
                bounds.append(i)
                size = 0
            size += len(words)
        lows = np.array([passages[i][0] for i in bounds] if passages else [], np.int64)
        held, of_shard = [], [[] for _ in bounds]
        for d in _docs(frame, width):
            if len(d.anchors):
                owners = _lookup(d.anchors, known, owner)
                below = owners < d.id
                if below.any():
                    shard = np.where(below, np.searchsorted(lows, owners, side="right") - 1, -1)
                    for k in np.unique(shard[below]).tolist():
                        of_shard[k].append((len(held), shard))
                    held.append((d, below, np.zeros(len(owners), bool)))
        for k, (start, end) in enumerate(zip(bounds, [*bounds[1:], len(passages)], strict=True)):
            automaton = SuffixAutomaton(passages[start:end])
            for i, shard in of_shard[k]:
                d, _, hit = held[i]
                for s, e in _spans(shard == k):
                    hit[s:e] |= automaton.matched(d.words(s, e + width - 1), width, d.id)
        rows, left, ids = [], [], []
        for d, below, hit in held:
            open_ = np.flatnonzero(below & ~hit)
            hashes = shingle_hashes(d.hashes, width)[open_].view(np.int64)
            rows.append((chunk, d.id, d.key(), np.array(_spans(hit), "<i4").tobytes(), open_.astype("<i4").tobytes(), hashes.tobytes()))
            left.append(np.unique(hashes))
            ids.append(d.id)
        first = pd.DataFrame(rows, columns=["chunk", "id", "key", "hit", "open", "hashes"])
        second = _rows_by_key(left, ids, chunk, "window")
        return pd.concat([first.assign(of="doc", window=0, doc=0, many=False), second.assign(of="window", id=0, key=0, hit=b"", open=b"", hashes=b"")])[
            ["chunk", "of", "id", "key", "hit", "open", "hashes", "window", "doc", "many"]].astype(
                {"id": "int64", "key": "int64", "window": "int64", "doc": "int64", "many": "bool", "chunk": "int32"})

    found = (dealt.groupBy("chunk").cogroup(helped.groupBy("chunk"))
             .applyInPandas(match, "chunk int, of string, id long, key long, hit binary, open binary, hashes binary, window long, doc long, many boolean"))
    # One window serves both kinds of rows, so that the matching above is not made for each of them: a
    # document's row is alone under its key.
    w = Window.partitionBy("of", "_k")
    last = found.withColumn("_k", F.when(F.col("of") == "window", F.col("window")).otherwise(F.xxhash64("id", "key"))).select(
        "chunk", "of", "id", "key", "hit", "open", "hashes", "window", F.min("doc").over(w).alias("owner"), F.count("*").over(w).alias("_n"), F.max("many").over(w).alias("_near"))
    last = last.filter("of = 'doc' or _n > 1 or _near").drop("_n", "_near")

    def remove(key, frame, last):
        plain = last["of"] == "doc"
        known, owner = _sorted(last[~plain], "window")
        marks = {(i, k): (bytes(h), bytes(o), bytes(w)) for i, k, h, o, w in zip(*(last.loc[plain, c].tolist() for c in ("id", "key", "hit", "open", "hashes")), strict=True)}
        out = []
        for key_, text in zip(frame["id"].tolist(), frame["text"], strict=True):
            buf = encode(text)
            words = buf.split()
            mark = None if not marks else marks.get((key_, int(np.uint64(xxhash.xxh3_64_intdigest(buf)).view(np.int64))))
            gone = 0
            if mark:
                hit, open_, hashes = np.frombuffer(mark[0], "<i4"), np.frombuffer(mark[1], "<i4"), np.frombuffer(mark[2], np.int64)
                more = open_[_lookup(hashes, known, owner) < key_]
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, np.concatenate((hit[::2], more)), 1)
                np.add.at(cover, np.concatenate((hit[1::2] - 1, more)) + width, -1)
                stays = np.cumsum(cover[:-1]) == 0
                gone = int(len(words) - stays.sum())
                if gone:
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
            out.append((key_, len(words) + gone, gone, b" ".join(words).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    done = dealt.groupBy("chunk").cogroup(last.groupBy("chunk")).applyInPandas(remove, "id long, n_words long, n_removed long, kept string")
    return done.unionByName(unnamed.mapInPandas(_whole, "id long, n_words long, n_removed long, kept string"))


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The result of rows that lose nothing."""
    for batch in batches:
        words = [encode(t).split() for t in batch["text"]]
        yield pd.DataFrame({"id": batch["id"].astype("Int64"), "n_words": [len(w) for w in words], "n_removed": 0, "kept": [b" ".join(w).decode("utf-8", "replace") for w in words]})


def without_reference(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                      shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, n_words, n_removed, kept): docs without the words in runs of `width` or more words that the reference's texts have.

    For a reference table of bounded size: its words are counted first, and more than REFERENCE_WORDS is an
    error (give both as one table to deduplicated(), the reference with the smaller ids). Its automata are broadcast.
    """
    spark = docs.sparkSession
    n = reference.agg(F.sum(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if n > REFERENCE_WORDS:
        raise ValueError(f"the reference has {n} words; {REFERENCE_WORDS} may be broadcast")
    texts = [encode(r[0]).split() for r in reference.select(text_col).filter(F.col(text_col).isNotNull()).collect()]
    shards, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < shard_words:
            size, end = size + len(texts[end]), end + 1
        shards.append(SuffixAutomaton((0, t) for t in texts[at:end]))
        at = end
    shared = spark.sparkContext.broadcast(shards)

    def run(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                words = encode(text).split()
                hit = np.zeros(max(0, len(words) - width + 1), bool)
                for shard in shared.value:
                    hit |= shard.matched(words, width)
                gone = {j for s, e in _spans(hit) for j in range(s, e + width - 1)}
                out.append((None if pd.isna(key) else int(key), len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"]).astype({"id": "Int64"})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "id long, n_words long, n_removed long, kept string")


def op3_substring(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduplicated(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
