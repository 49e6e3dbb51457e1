"""Token-ID output: texts to ids to files of compressed blocks, and back."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm.coder import BLOCK_IDS, pack, unpack
from keepsake.llm.common import char_hashes, map_slices, partitions, shared_folder

END_ID = 2
#: Pieces whose ids a worker remembers before it starts anew, and the slots of the table that finds them, at first and at most.
REMEMBERED, FIRST_BITS, SLOT_BITS = 1_500_000, 16, 22
#: Characters looked up together; pieces that share a call of the library; a longer piece is found by its text.
TOGETHER, JOINED, LONG = 150_000, 1000, 64
#: Texts of an Arrow batch that become strings at once.
TEXTS = 1024
#: Letters, numbers and spaces among the characters that _UNSURE lets through. Fixed values of Unicode.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\x09-\x0d\x20\xa0"
#: Texts with other characters, or with what may start a special token, go through the tokenizer whole.
_UNSURE = re.compile(r"[^\x00-\x84\x86-\u024f\u2010-\u2027]")
#: A space between letters always starts a piece: long texts are looked up in parts that end there.
_BETWEEN = re.compile(rf"(?<=[{_L}])(?= [{_L}])")
_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)


def _kinds() -> np.ndarray:
    kinds = np.full(0x2028, _OTHER, np.uint8)
    for kind, chars in ((_LETTER, _L), (_NUMBER, _N), (_SPACE, _S)):
        one = re.compile(f"[{chars}]")
        kinds[[c for c in range(len(kinds)) if one.match(chr(c))]] = kind
    return kinds


_KINDS = _kinds()


def _starts(chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start, in texts side by side, each with one more character at `ends`; those are starts too.

    The pieces are those of the byte-level tokenizer, whose merges never cross them: an elided ending ('s, 'll),
    or a run of letters, of numbers or of other marks with the one space before it, or white space. White
    space before something else leaves its last character to it or, unless it is a space, to itself.
    """
    kind = _KINDS[chars]
    kind[ends] = _END
    start = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
    start[last] = True
    start[last[chars[last] == 32] + 1] = False
    quote = np.flatnonzero((chars[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER))
    if len(quote):
        one = chars[quote + 1]
        two = np.where(quote + 2 < len(chars), chars[np.minimum(quote + 2, len(chars) - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    start[ends] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian 32-bit bytes.

    The byte-level tokenizer cuts a text into pieces and encodes each by itself, so the ids of a piece are
    remembered: pieces are found by a 64-bit hash and their length in an open table, thousands at a time; new
    ones go through the library many at a time. Any other tokenizer encodes whole texts.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = repr(self.tokenizer.pre_tokenizer)
        self.cuts = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tokenizer.normalizer is None
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder a worker process: what it remembers serves the worker's later tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self._clear(FIRST_BITS)
        self.chars, self.at, self.size = (np.zeros(1024, np.int64) for _ in range(3))
        self.pool, self.pooled, self.entries = np.zeros(4096, np.uint32), 0, 0
        self.long: dict[str, int] = {}

    def _clear(self, bits: int) -> None:
        self.bits, self.filled = bits, 0
        self.hash, self.entry = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _put(self, hashes: np.ndarray, number: np.ndarray) -> None:
        """Entries of distinct hashes that the table lacks; it is made larger where a third of it would be filled."""
        if 3 * (self.filled + len(hashes)) > 1 << self.bits and self.bits < SLOT_BITS:
            held = np.flatnonzero(self.entry >= 0)
            known, numbers = self.hash[held], self.entry[held]
            self._clear(min(SLOT_BITS, max(self.bits, int(3 * (len(known) + len(hashes))).bit_length()) + 1))
            self._put(known, numbers)
        self.filled += len(hashes)
        while len(hashes):  # of those that meet in an empty slot one gets it, the others look on
            _, slot = self._find(hashes)
            self.entry[slot], self.hash[slot] = number, hashes
            lost = self.hash[slot] != hashes
            self.entry[slot[~lost]] = number[~lost]
            hashes, number = hashes[lost], number[lost]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of pieces. Words with a space before them stand side by side, bare words a line each: both are cut where they meet."""
        known: dict[str, bytes] = {}
        spaced = [p for p in new if p[0] == " " and p[1:].isalpha()]
        bare = [p for p in new if p.isalpha()]
        for words, between in ((spaced, ""), (bare, "\n")):
            for i in range(0, len(words), JOINED):
                some = words[i:i + JOINED]
                made = self.tokenizer.encode(between.join(some), add_special_tokens=False)
                piece = np.array(made.word_ids)
                edges = (4 * np.flatnonzero(np.diff(piece, prepend=-1, append=-1))).tolist()
                whole = np.array(made.ids, "<u4").tobytes()
                parts = [whole[s:e] for s, e in zip(edges, edges[1:], strict=False)][:: 2 if between else 1]
                if len(parts) == len(some):
                    known.update(zip(some, parts, strict=True))
        return [known[p] if p in known else self._whole(p) for p in new]

    def _keep(self, pieces: list[str]) -> np.ndarray:
        """Numbers of new entries for the pieces."""
        coded = self._learn(pieces)
        size = np.array([len(c) // 4 for c in coded], np.int64)
        ids = np.frombuffer(b"".join(coded), "<u4")
        while self.pooled + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.entries + len(pieces) > len(self.at):
            self.chars, self.at, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.chars, self.at, self.size))
        self.pool[self.pooled:self.pooled + len(ids)] = ids
        number = np.arange(self.entries, self.entries + len(pieces))
        self.at[number], self.size[number] = self.pooled + np.cumsum(size) - size, size
        self.chars[number] = [len(p) for p in pieces]
        self.pooled, self.entries = self.pooled + len(ids), self.entries + len(pieces)
        return number

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each hash, or -1; and the slot at which it is or would go."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        entry = self.entry[slot]
        left = np.flatnonzero((entry >= 0) & (self.hash[slot] != hashes))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            entry[left] = self.entry[slot[left]]
            left = left[(entry[left] >= 0) & (self.hash[slot[left]] != hashes[left])]
        return entry, slot

    def _entries(self, text: str, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        entry, _ = self._find(hashes)
        size = end - start
        bad = (entry >= 0) & (self.chars[np.maximum(entry, 0)] != size)  # another piece of the same hash
        exact = np.flatnonzero((size > LONG) | bad)
        for i in exact.tolist():
            piece = text[start[i]:end[i]]
            if piece not in self.long:
                self.long[piece] = int(self._keep([piece])[0])
            entry[i] = self.long[piece]
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[first]
            number = self._keep([text[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            entry[new] = number[back]
            self._put(hashes[at], number)
        return entry

    def _looked_up(self, texts: list[str]) -> list[bytes]:
        if self.entries > REMEMBERED:
            self.forget()
        joined = "\0".join([*texts, ""])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        start = _starts(chars, ends)
        end = np.append(start[1:], len(chars))
        held = np.ones(len(chars), bool)
        held[ends] = False
        keep = held[start]
        start, end = start[keep], end[keep]
        entry = self._entries(joined, char_hashes(chars, start, end), start, end)
        size = self.size[entry]
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        out = self.pool[np.repeat(self.at[entry] - to + size, size) + np.arange(total)].astype("<u4").tobytes()
        edges = (4 * np.concatenate(([0], to))[np.searchsorted(start, ends)]).tolist()
        return [out[s:e] for s, e in zip([0, *edges], edges, strict=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        some: list[tuple[int, str]] = []
        held = 0

        def flush():
            for (i, _), coded in zip(some, self._looked_up([t for _, t in some]), strict=True):
                out[i] += coded

        for i, text in enumerate(texts):
            if not self.cuts or "<|" in text or not text.isascii() and _UNSURE.search(text):
                out[i] = self._whole(text)
                continue
            at = 0
            while at < len(text):
                more = _BETWEEN.search(text, at + TOGETHER) if len(text) - at > 2 * TOGETHER else None
                end = more.start() if more else len(text)
                some.append((i, text[at:end]))
                held, at = held + end - at, end
                if held >= TOGETHER:
                    flush()
                    some, held = [], 0
        if some:
            flush()
        return out


def _blocks(tokenizer: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        held, n, number, begun = [], 0, 0, 0
        end = np.array([end_id], "<u4").tobytes()

        def block(more: bool):
            return pd.DataFrame({"part": [part], "block": [number], "begun": [begun], "more": [more], "n_tokens": [n], "data": [pack(held)]})

        for batch in batches:
            for key, coded in zip(batch["id"], encoder.ids(batch["text"].tolist()), strict=True):
                key, ids = None if pd.isna(key) else int(key), np.frombuffer(coded + end, "<u4")
                at = 0
                while at < len(ids):
                    piece = ids[at:at + block_ids - n]
                    held.append((key, piece))
                    n, at = n + len(piece), at + len(piece)
                    if n == block_ids:
                        more = at < len(ids)
                        yield block(more)
                        # The next block opens with the rest of this document, or with a new one.
                        begun = (begun if len(held) == 1 else number) if more else number + 1
                        held, n, number = [], 0, number + 1
        if held:
            yield block(False)
    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
          block_ids: int = BLOCK_IDS) -> None:
    """Writes each text's ids and an end id, in ascending order of document id, as blocks of block_ids ids under path.

    A null text is empty. Rows without an id come first; rows that share an id go by text, and may be dealt to
    several tasks. A document that does not end in its block goes on in the next, so that no text is too long.
    Repeated rows are written again; other columns are left out; an empty table makes no block. The files are
    Parquet files of blocks (part, block, begun, more, n_tokens, data) in that order: begun is the block in which
    the block's first document begins, more tells whether its last goes on. Spark's commit keeps what failed
    or repeated tasks wrote out of the folder, on any file system that it can write to.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = slim.repartitionByRange(partitions(docs.sparkSession), "id", F.substring("text", 1, 32)).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    kinds = {"part": pa.int32(), "block": pa.int32(), "begun": pa.int32(), "more": pa.bool_(), "n_tokens": pa.int64(), "data": pa.binary()}
    map_slices(dealt, _blocks(tokenizer, end_id, block_ids), pa.schema(kinds), TEXTS).write.option(
        "compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, place, id, ids): the documents under path; their order is that of (part, block, place).

    A document that goes over several blocks comes as a row for each of them.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, number, data in zip(batch["part"], batch["block"], batch["data"], strict=True):
                docs = unpack(bytes(data))
                yield pd.DataFrame({"part": part, "block": number, "place": np.arange(len(docs)), "id": pd.array([k for k, _ in docs], "Int64"),
                                    "ids": [d.astype(np.int64) for _, d in docs]})

    return spark.read.parquet(path).select("part", "block", "data").mapInPandas(run, "part int, block int, place int, id long, ids array<long>")


_ZEROS = bytes(1 << 20)


def joined_crc(first: int, second: int, n_bytes: int) -> int:
    """crc32 of two byte strings in a row, from those of each and the length of the second."""
    moved, nothing = first, 0
    while n_bytes:
        zeros = _ZEROS[:n_bytes]
        moved, nothing, n_bytes = zlib.crc32(zeros, moved), zlib.crc32(zeros, nothing), n_bytes - len(zeros)
    return moved ^ nothing ^ second


def _joined(pieces: pd.Series) -> pd.Series:
    """crc32 of a document from its pieces' (block, n_tokens, ids_crc32), in order of block."""
    def one(row):
        crc = 0
        for piece in row:
            crc = joined_crc(crc, piece["ids_crc32"], 4 * piece["n_tokens"])
        return crc

    return pieces.map(one)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document under path, from its decoded ids.

    start counts the ids of all documents before it: those of the parts before (one number a part goes
    through a window), of the part's blocks before, and of the block's documents before. The pieces of a
    document that goes over several blocks are put together.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, number, begun, more, data in zip(*(batch[c] for c in ("part", "block", "begun", "more", "data")), strict=True):
                docs = unpack(bytes(data))
                size, place = np.array([len(d) for _, d in docs], np.int64), np.arange(len(docs))
                # A document is named by the block in which it begins and its place there; -1 if it goes on from there.
                first = np.where((place == 0) & (begun < number), begun, number)
                place[(first < number) | (more & (place == len(docs) - 1))] = -1
                yield pd.DataFrame({"part": part, "block": number, "first": first, "place": place, "inside": np.cumsum(size) - size,
                                    "id": pd.array([k for k, _ in docs], "Int64"), "n_tokens": size, "ids_crc32": [zlib.crc32(d.tobytes()) for _, d in docs]})

    files = spark.read.parquet(path)
    rows = files.select("part", "block", "begun", "more", "data").mapInPandas(
        run, "part int, block int, first int, place int, inside long, id long, n_tokens long, ids_crc32 long")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("_before"))
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.select("part", "block", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("_inside"))
    starts = blocks.join(parts, "part").select("part", "block", (F.col("_before") + F.col("_inside")).alias("_start"))
    placed = rows.join(starts, ["part", "block"]).withColumn("start", F.col("_start") + F.col("inside"))
    docs = placed.groupBy("part", "first", "place").agg(F.min("id").alias("id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
                                                         F.sort_array(F.collect_list(F.struct("block", "n_tokens", "ids_crc32"))).alias("pieces"))
    return docs.select("id", "start", "n_tokens", F.pandas_udf(_joined, "long")("pieces").alias("ids_crc32"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files written: a row for each row of docs.

    Null and empty texts have the end id alone; very long texts go over several blocks; rows without an id,
    repeated rows, other columns and an empty table are as in write().
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer or default_tokenizer())
    return digest(spark, path).withColumnRenamed("id", "doc_id")
