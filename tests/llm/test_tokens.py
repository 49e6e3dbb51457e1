import zlib

import numpy as np
import pytest

from keepsake.llm import coder, tokens


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


ODD = ["", " ", "a", "it's  I'LL don't\n\n x\t\ty ", "é ñandú ß ǅ ½²", "日本語 text 😀 🏳️‍🌈", "a\x1cb \x85 c\xa0d   e", "<|endoftext|> in <|x", "12345 67.8e9 --- ***!!", "x" * 3000, "\r\n\r\n  end  ", "A'S B'Re", "z " * 2000, "­ ​"]


def test_encoder_gives_the_library_ids(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    e = tokens.Encoder(tokens.default_tokenizer())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == library(texts)
    e.forget()
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == library(texts)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 511, 700, 70_001])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), np.full(n, 50_256), rng.integers(0, 3, n), np.arange(n) % 50_257):
        lanes, payload = coder.compress(ids, 50_257)
        assert (coder.expand(payload, n, lanes, 50_257) == ids).all()


def test_a_context_tells_more_than_counts():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 4, 300_000)
    for k in range(2, len(ids)):  # the last two ids tell the next, as a rule
        if ids[k]:
            ids[k] = 4 + (ids[k - 1] * 7 + ids[k - 2] * 3) % 60
    block = coder.pack([(1, ids)])
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert 8 * len(block) / len(ids) < 0.6 * entropy
    assert (coder.unpack(block)[0][1] == ids).all()


def test_large_and_rare_ids():
    ids = np.concatenate((np.full(200_000, 2**32 - 1), [0, 5, 2**31]))
    assert (coder.unpack(coder.pack([(None, ids)]))[0][1] == ids).all()


def test_repeats_cost_little_and_damage_is_seen():
    ids = np.tile(np.arange(1000), 300)
    block = coder.pack([(7, ids[:100_000]), (None, ids[:0]), (-3, ids[100_000:])])
    assert len(block) < 0.3 * 2 * len(ids)
    back = coder.unpack(block)
    assert [k for k, _ in back] == [7, None, -3] and all((a == b).all() for (_, a), b in zip(back, (ids[:100_000], ids[:0], ids[100_000:]), strict=True))
    for at in (0, 50, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError, match="token block"):
            coder.unpack(block[:at] + bytes([block[at] ^ 1]) + block[at + 1:])


def check(spark, docs, tmp_path, block_ids):
    path = f"file://{tmp_path}/t{block_ids}"
    tokens.write(docs, path, tokens.default_tokenizer(), block_ids=block_ids)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for (key, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.digest(spark, path).collect()), key=lambda r: r[1]) == want
    back = tokens.read(spark, path).orderBy("part", "block", "place").collect()
    flat = [i for r in back for i in r.ids]
    assert all(zlib.crc32(np.array(flat[s:s + n], "<u4").tobytes()) == c for _, s, n, c in want)
    if block_ids == 1 << 20:
        assert [(r.id, len(r.ids)) for r in back] == [(k, n) for k, _, n, _ in want]


@pytest.mark.parametrize("block_ids", [500, 1 << 20])
def test_whole_table(spark, tmp_path, block_ids):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), tmp_path, block_ids)


def test_odd_rows_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(9, "b"), (9, "a"), (9, "a"), (None, "n"), (-4, None), *enumerate(ODD, 20)], "doc_id long, text string").selectExpr("*", "'x' AS part", "1 AS start")
    check(spark, docs, tmp_path, 100)
    assert tokens.op2_tokens(docs.limit(0)).count() == 0


def test_a_document_of_very_many_ids(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = [f" w{i}" for i in range(300)]
    text = "".join(np.array(words)[rng.integers(0, 300, 500_000)]) + "1" * 300_000 + "\n" * 1_000_000
    docs = spark.createDataFrame([(3, "a b"), (1, text), (2, "c")], "doc_id long, text string")
    path = f"file://{tmp_path}/long"
    tokens.write(docs, path, tokens.default_tokenizer(), block_ids=150_000)
    rows = sorted(tuple(r) for r in tokens.digest(spark, path).collect())
    ids = [[*i, 2] for i in library([text, "c", "a b"])]
    at = np.cumsum([0, *map(len, ids)]).tolist()
    assert len(ids[0]) > 600_000 and spark.read.parquet(path).count() > 3
    assert rows == [(k + 1, at[k], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in enumerate(ids)]


def test_joined_crc():
    a, b = b"some bytes", bytes(range(256)) * 9000
    assert tokens.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and tokens.joined_crc(5, 0, 0) == 5


def test_many_rows_of_one_id_are_dealt_to_several_parts(spark, tmp_path):
    docs = spark.range(4000).selectExpr("if(id < 3990, 7, id) AS doc_id", "concat('text ', id % 997) AS text")
    check(spark, docs, tmp_path, 4096)
    assert spark.read.parquet(f"file://{tmp_path}/t4096").select("part").distinct().count() > 1


def test_texts_become_strings_by_few_rows(spark, monkeypatch):
    """Whatever an Arrow batch holds; the files are the same, and ids beside a row without one stay exact."""
    blocks = tokens._blocks

    def watched(*options):
        run = blocks(*options)

        def few(batches):
            for batch in batches:
                assert len(batch) <= 1024
                yield batch
        return lambda batches: run(few(batches))

    monkeypatch.setattr(tokens, "_blocks", watched)
    rows = [(None, "none")] + [(2**60 + i, f"text {i}") for i in range(3000)]
    got = tokens.op2_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.ids_crc32) for r in sorted(got, key=lambda r: r.start)] == [(k, zlib.crc32(np.array([*ids, tokens.END_ID], "<u4").tobytes())) for (k, _), ids in zip(rows, library([t for _, t in rows]), strict=True)]
