import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import idfile, packing, tokens, warc
from docloom.llm.store import shared_folder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name):
    known = Tokenizer.from_file(public_tokenizers.path(name))
    known.encode_special_tokens = True
    return known


@pytest.mark.parametrize("name", NAMES)
def test_parts_give_the_ids_of_the_whole_text(documents, monkeypatch, name):
    whole, parts = library(name), tokens.PartTokenizer(public_tokenizers.path(name))
    draw = random.Random(1)
    texts = [r.text for r in documents.select("text").collect()]
    texts += [" \n\n x", "don't  stop's!!\n\n\nA", "naïve café, señor… 日本語 テスト 123abc 4 5", "a   b 　c", "<|endoftext|> x <|startoftext|>", " " * 3000, "x'S 'll  a", "ΑΣ ΟΔΟΣ, x́ éy z  q"]
    texts += ["".join(draw.choice(list("ab, .!'\n\t\r0é× 日S") + ["\x00", "'s", "  "]) for _ in range(200)) for _ in range(60)]
    for piece, kept in ((1 << 21, 1_000_000), (64, 50)):
        monkeypatch.setattr(tokens, "PIECE", piece)
        monkeypatch.setattr(tokens, "REMEMBERED", kept)
        some = texts if piece > 64 else [t for t in texts if len(t or "") < 5000]
        ids, counts = parts.encode(some)
        ends = np.cumsum(counts)
        for t, end, n in zip(some, ends.tolist(), counts.tolist(), strict=True):
            assert ids[end - n : end].tolist() == whole.encode(t or "", add_special_tokens=False).ids
    assert parts.encode([])[0].size == 0


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_have_their_own_ids(spark, monkeypatch, name):
    path = public_tokenizers.path(name)
    whole, parts, draw = Tokenizer.from_file(path), tokens.PartTokenizer(path, added=True), random.Random(3)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "a", "b", " ", "  ", "\n", ".", "'s", "é", "日", "\x00", "<|", "|>", "\u0338"]
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext<|endoftext|>|>", "<|endoftext|><|endoftext|>", "<|endof", "text|>"]
    texts += ["".join(draw.choice(bits) for _ in range(30)) for _ in range(500)]
    known = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for piece, kept in ((1 << 21, 1_000_000), (64, 50), (8, 50)):
        monkeypatch.setattr(tokens, "PIECE", piece)
        monkeypatch.setattr(tokens, "REMEMBERED", kept)
        ids, counts = parts.encode(texts)
        assert counts.tolist() == [len(k) for k in known] and ids.tolist() == [i for k in known for i in k]
    monkeypatch.setattr(parts, "uncut", True)
    assert parts.encode(texts)[0].tolist() == [i for k in known for i in k]

    docs = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")
    crcs = {k: zlib.crc32(np.array([*ids, 2], "<u4").tobytes()) for k, ids in enumerate(known[:20])}
    folder = shared_folder(spark, "ids")
    written = idfile.read_token_files(spark, folder, idfile.write_token_files(docs, folder, path, 2))
    assert {r.doc_id: r.ids_crc32 for r in written.collect()} == crcs
    end = packing.pack_documents(docs, path).where("piece = 0").collect()
    assert {r.doc_id: r.length for r in end} == {k: len(ids) + 1 for k, ids in enumerate(known[:20])}


def test_files_hold_any_ids():
    values = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1] * 3, np.uint32)
    for n in range(22):
        keys, counts, ids = idfile.decode_file(idfile.encode_file([-5, None, 2**62], [n, 0, 0], values[:n]))
        assert keys == [-5, None, 2**62] and counts.tolist() == [n, 0, 0] and (ids == values[:n]).all()
    many = np.random.default_rng(2).integers(0, 2**18, 1_500_001).astype(np.uint32)
    assert (idfile.decode_file(idfile.encode_file([1], [len(many)], many))[2] == many).all()


@pytest.mark.parametrize("file_ids", [1 << 22, 100])
def test_token_files_round_trip(spark, documents, nothing, file_ids):
    folder, path = shared_folder(spark, "ids"), public_tokenizers.path(NAMES[1])
    files = idfile.write_token_files(documents, folder, path, 2, file_ids=file_ids)
    got = idfile.read_token_files(spark, folder, files, with_ids=True).orderBy("start").collect()
    whole = library(NAMES[1])
    rows = documents.orderBy("doc_id", F.xxhash64("text")).collect()
    at = 0
    for g, r in zip(got, rows, strict=True):
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32, bytes(g.ids)) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    empty = shared_folder(spark, "ids")
    assert idfile.read_token_files(spark, empty, idfile.write_token_files(nothing, empty, path, 2)).count() == 0


def test_rows_of_one_key_are_spread(spark):
    path, n = public_tokenizers.path(NAMES[1]), 4000
    docs = spark.range(2 * n).selectExpr("if(id % 2 = 0, null, id) as doc_id", "concat('text ', id) as text")
    folder = shared_folder(spark, "ids")
    files = idfile.write_token_files(docs, folder, path, 2)
    assert max(r.n_docs for r in files.groupBy("part").agg(F.sum("n_docs").alias("n_docs")).collect()) < n / 2
    got = [(r.doc_id, r.ids_crc32) for r in idfile.read_token_files(spark, folder, files).orderBy("start").collect()]
    whole, want = library(NAMES[1]), []
    for r in docs.orderBy("doc_id", F.xxhash64("text")).collect():
        want.append((r.doc_id, zlib.crc32(np.array([*whole.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes())))
    assert got == want


def test_plan_is_close_to_the_bound():
    draw = random.Random(4)
    for capacity, most in ((2048, 2048), (2048, 500), (100, 60), (10, 10)):
        counts = {}
        for _ in range(3000):
            n = min(most, max(1, int(draw.expovariate(1 / (most / 4)))))
            counts[n] = counts.get(n, 0) + 1
        used = {}
        placed = dict.fromkeys(counts, 0)
        for length, first, end, per, sequence, offset in packing.plan_packing(counts, capacity):
            assert first == placed[length]
            placed[length] = end
            for k in range(end - first):
                used.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
        assert placed == counts
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        bound = -(-sum(k * v for k, v in counts.items()) // capacity)
        assert len(used) <= bound * 1.02 + 1
    assert packing.plan_packing({}, 10) == []


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing_against_brute_force(documents, nothing, capacity):
    path = public_tokenizers.path(NAMES[0])
    packed = packing.pack_documents(documents, path, capacity=capacity, with_ids=True)
    whole, want = library(NAMES[0]), []
    for r in documents.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = packed.collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=order) == sorted(want, key=order)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, bytes(r.ids)))
    for s in packing.sequences(packed).collect():
        assert b"".join(x for _, x in sorted(held[s.sequence_id])) == bytes(s.ids) and len(s.ids) == 4 * s.n_tokens <= 4 * capacity
    assert packing.pack_documents(nothing, path).count() == 0


def test_bundles_round_trip_and_random_access(spark, monkeypatch):
    same, rows = "x" * 1000, [(k, f"http://h/{k}\r\nX: y", "p" * (50 * k)) for k in range(60)]
    rows += [(None, None, None), (100, "u", same), (101, None, same), (102, "u", same), (102, "u", same), (None, "u", same), (103, "u", same[1:]), (104, "u", same[1:]), (105, "é", "Ünï\r\n\r\n日本"), (None, "v", "z" * 2000), (None, "v", "z" * 2000)]
    pages = spark.createDataFrame([(*r, "taken") for r in rows], "page_id long, url string, html string, payload string")
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(pages, folder)
    got = warc.read_bundles(spark, folder).collect()
    import hashlib

    want = []
    for k, _, text in rows:
        raw = (text or "").encode()
        last = max((i for i, _, t in rows if i is not None and t == text), default=None)
        refers = last if len(raw) >= 1000 and last is not None and last != k else None
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:4], r[4] or 0)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=order) == sorted(want, key=order)
    texts = {r[0]: r[2] for r in rows}
    assert all(bytes(r.payload).decode() == (texts[r.page_id] or "") for r in got if r.record_type == "response" and r.page_id is not None)
    wanted = warc.fetch_records(folder, index.where("key in (3, 101, 102, 105)")).collect()
    assert sorted((r.page_id, r.record_type) for r in wanted) == [(3, "response"), (101, "revisit"), (102, "response"), (102, "response"), (105, "response")]
    empty = shared_folder(spark, "warc")
    assert warc.write_bundles(pages.limit(0), empty).count() == 0 and warc.read_bundles(spark, empty).count() == 0


def test_frames_are_independent_and_plain_zstandard():
    import zstandard

    packer = zstandard.ZstdCompressor()
    parts = [b"a" * 10, b"b" * 5000, b""]
    bundle = warc.seal([(packer.compress(p), len(p)) for p in parts])
    table = warc.seek_table(bundle)
    assert [zstandard.ZstdDecompressor().decompress(bundle[s : s + n]) for s, n in table] == parts
    assert zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read() == b"".join(parts)
    with pytest.raises(ValueError):
        warc.seek_table(b"0" * 20)
