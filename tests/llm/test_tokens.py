import random
import struct
import zlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

from pegwatch.llm import sentencepiece_codec, token_counts, token_frames
from pegwatch.llm.common import tokenizer_file

ODD = [
    None, "", " ", "\n", "  two  spaces ", "a\n\nb", "\n a", " \n", "tab\tand nbsp  x", "ΑΣ Σ ΑΣ", "İstanbul é Å", "don't we'll I'M",
    "<|endoftext|>x <|startoftext|> y<|endoftext|>", "日本語のテキスト と 𝕏 😀", "▁under▁ score", "aaaa" * 50, "x" * 5000, "123 4567 1,000.5", "\x00nul \x1c sep",
]


def texts(seed: int = 3, n: int = 150) -> list:
    rnd = random.Random(seed)
    bits = ["the ", "ing", "  ", "\n", " \n", "Hello", "wörld", ".", "'s ", "\t", "é", "𝕏", "12", "▁", "aaaa", "<|endoftext|>", "　", "Σ"]
    return ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(rows)], "doc_id long, text string, ids string, n_tokens long")


def test_sentencepiece_equals_the_library(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = texts()
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_decode(frame(spark, rows), path).collect()}
    for i, t in enumerate(rows):
        ids = lib.encode(t or "")
        assert list(got[i]["ids"]) == ids
        assert got[i]["decoded"] == lib.decode(ids)


def test_sentencepiece_pairs_follow_the_definition():
    model = sentencepiece_codec.PieceModel(tokenizer_file("piece_bpe_32k.model"))
    rnd, pieces = random.Random(5), [i for i, s in model.piece.items() if model.merged(s) == [s]]
    for _ in range(3000):
        a, b = rnd.choice(pieces), rnd.choice(pieces)
        assert model._pair_fits((a, b)) == (model.merged(model.piece[a] + model.piece[b]) == [model.piece[a], model.piece[b]])


def test_frames_round_trip(spark, tmp_path):
    path, folder = tokenizer_file("byte_bpe_50k.json"), f"{tmp_path}/frames"
    lib = Tokenizer.from_file(path)
    rows = texts()
    docs = frame(spark, rows).unionByName(frame(spark, ["again", "again"])).unionByName(spark.createDataFrame([(None, "no id", "x", 0)], "doc_id long, text string, ids string, n_tokens long"))
    manifest = token_frames.write_shards(docs, folder, path, end_id=2).collect()
    assert sum(r["n_docs"] for r in manifest) == docs.count()
    got = sorted(token_frames.read_shards(spark, folder).collect(), key=lambda r: r["start"])
    want = sorted([(r["doc_id"], r["text"] or "") for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start = 0
    for g, (doc_id, text) in zip(got, want, strict=True):
        ids = lib.encode(text, add_special_tokens=False).ids + [2]
        assert (g["doc_id"], g["start"], bytes(g["ids"])) == (doc_id, start, struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    some = {r["doc_id"]: bytes(r["ids"]) for r in token_frames.read_shards(spark, folder, [7, 9]).collect()}
    assert some == {r["doc_id"]: bytes(r["ids"]) for r in got if r["doc_id"] in (7, 9)}


def test_a_damaged_frame_is_noticed(tmp_path):
    import pyarrow as pa
    from pyarrow import fs

    name = f"{tmp_path}/one"
    with fs.LocalFileSystem().open_output_stream(name) as out:
        w = token_frames.ShardWriter(out)
        for i in range(300):
            w.add(i, struct.pack("<I", i) * 1000)
        w.finish()
    raw = bytearray(open(name, "rb").read())
    whole = token_frames.ShardReader(pa.BufferReader(bytes(raw)))
    assert zlib.crc32(next(whole.documents([299]))[2]) == zlib.crc32(struct.pack("<I", 299) * 1000)
    raw[int(whole.starts[1]) - 1] ^= 1
    hurt = token_frames.ShardReader(pa.BufferReader(bytes(raw)))
    assert len(list(hurt.documents([299]))) == 1
    with pytest.raises(Exception):
        list(hurt.documents([0]))


def test_counts_equal_the_library(spark):
    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = texts()
    got = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, rows), path).collect()}
    for i, t in enumerate(rows):
        assert got[i]["n_tokens"] == len(lib.encode(t or "", add_special_tokens=False))
        assert got[i]["n_bytes"] == len((t or "").encode())


def test_empty_tables(spark, tmp_path):
    none = frame(spark, []).limit(0)
    assert sentencepiece_codec.encode_decode(none, tokenizer_file("piece_bpe_32k.model")).count() == 0
    assert token_counts.count_tokens(none, tokenizer_file("word_bpe_49k.json")).count() == 0
    token_frames.write_shards(none, f"{tmp_path}/none", tokenizer_file("byte_bpe_50k.json"), 2)
    assert token_frames.read_shards(spark, f"{tmp_path}/none").count() == 0


def test_the_queries_digests(spark, tmp_path):
    """The columns that the named queries derive, from the libraries alone."""
    import hashlib
    import zlib

    from pegwatch.llm import queries

    rows = texts(9, 60)
    spark.createDataFrame([(7 * i, t) for i, t in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r["doc_id"]: tuple(r)[1:4] for r in queries.op1_sentencepiece(spark, str(tmp_path)).collect()}
    ids = [piece.encode(t or "") for t in rows]
    assert got == {7 * i: (len(x), sha(",".join(map(str, x))), sha(piece.decode(x))) for i, x in enumerate(ids)}
    byte = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = {r["doc_id"]: tuple(r)[1:4] for r in queries.op2_token_frames(spark, str(tmp_path)).collect()}
    start, want = 0, {}
    for i, t in enumerate(rows):
        x = byte.encode(t or "", add_special_tokens=False).ids + [2]
        want[7 * i] = (start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x)))
        start += len(x)
    assert got == want
    word = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    word.no_truncation()
    got = {r["doc_id"]: tuple(r)[1:4] for r in queries.op10_token_counts(spark, str(tmp_path)).collect()}
    counts = [len(word.encode(t or "", add_special_tokens=False).ids) for t in rows]
    assert got == {7 * i: (len((t or "").encode()), n, n > 2048) for i, (t, n) in enumerate(zip(rows, counts, strict=True))}
