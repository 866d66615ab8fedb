"""The registered queries without SQL, against plain versions over the supplied tables."""

import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from docloom import llm

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


def _rows(spark, name, folder=FOLDER):
    return [r.asDict() for r in llm.QUERIES[name](spark, folder).collect()]


def _ids_crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_op1(spark, docs):
    found = _rows(spark, "op1_sharding")
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    slots, places = defaultdict(list), defaultdict(set)
    for r in found:
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
        places[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in places.values())


def test_op4(spark, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want = Counter()
    for d in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        want[d["doc_id"], len(words), len(places), min(starts, default=None), max(starts, default=None), labels] += 1
    found = _rows(spark, "op4_license_scan")
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == want
    for r in found:
        base, all_labels = (set(r[c].split(",")) - {""} for c in ("base_labels", "labels"))
        assert base <= all_labels and 0 <= r["score"] <= 1 and bool(all_labels) == (r["score"] > 0)
        assert r["labels"] == ",".join(sorted(all_labels))


@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality_classifier", "quality", 0.5), ("op11_toxicity", "toxic", 0.7)])
def test_classifiers(spark, docs, name, label, least):
    found = _rows(spark, name)
    assert Counter(r["doc_id"] for r in found) == Counter(d["doc_id"] for d in docs)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    truth = {r["doc_id"]: int(r[label]) for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist() if r[label] is not None}
    told = [r["predicted"] == truth[r["doc_id"]] for r in found if r["doc_id"] in truth]
    assert sum(told) >= 0.8 * len(told)


def test_op8(spark, docs):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want, start = [], 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        want.append((d["doc_id"], start, len(ids), _ids_crc(ids)))
        start += len(ids)
    found = _rows(spark, "op8_token_id_output")
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found) == want


def test_op10(spark, docs):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in _rows(spark, "op10_best_fit_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {d["doc_id"] for d in docs}
    lengths = []
    for d in docs:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        mine = sorted(pieces[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and len(mine) == -(-len(ids) // 2048)
        at = 0
        for k, r in enumerate(mine):
            assert r["start"] == at and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == _ids_crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
        lengths += [r["length"] for r in mine]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    bins: list[int] = []
    for x in sorted(lengths, reverse=True):  # best fit, longest first
        fits = [i for i, b in enumerate(bins) if b + x <= 2048]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += x
        else:
            bins.append(x)
    assert len(sequences) <= len(bins)
