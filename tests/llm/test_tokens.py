"""Token counts, BPE codec and packing against the tokenizers library."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlstone.llm import bpe_codec, packing, token_counts
from marlstone.llm.packing import deal, difference

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids, t


def noise(seed, n=400):
    """Random texts over alphabets that stress the word split, case folding and normal forms."""
    r = random.Random(seed)
    alphabets = ["ab c'", "sdmtrevl' I", "ÀÉßſ ǅΣσς éö", "中文字 の", "🙂👍🏽 ‍", "0١٢½Ⅷ9 ", " \t\n\r\x0b\x0c\x1c\x1f\x85    　", "<|endoftext|>", "!?.,;:-_()[]{}@#$%", "\x00\x01\x7f﻿�", "İı K Å"]
    for _ in range(n):
        chars = "".join(r.choice(alphabets) for _ in range(r.randint(1, 3)))
        yield "".join(r.choice(chars) for _ in range(r.randint(0, 40)))


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_the_library_on_noise(seed):
    encode, _ = library(WORD)
    counter = token_counts.Counter(WORD)
    for text in noise(seed):
        assert counter.count(text) == len(encode(text)), repr(text)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_chunks_compose_to_the_whole(chunk, monkeypatch):
    encode, _ = library(WORD)
    counter = token_counts.Counter(WORD)
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    for text in noise(9, 120):
        assert counter.count(text) == len(encode(text)), repr(text)


def test_every_code_point_as_the_library_takes_it():
    """Beside letters, digits, word endings and combining marks, whichever Unicode versions Python and the library have."""
    counter, cache = token_counts.Counter(WORD), bpe_codec.codec(BYTE).cache
    words, pieces = library(WORD)[1], library(BYTE)[1]
    planes = (range(1, 0xD800), range(0xE000, 0x40000), range(0x40000, 0x110000, 997), range(0xE0000, 0xE1000))
    texts = [f"a{c}b {c}1{c}'re x \u0345{c}\u0334" for plane in planes for c in map(chr, plane)]
    for at in range(0, len(texts), 20_000):
        some = texts[at : at + 20_000]
        expected = zip(words.encode_batch(some, add_special_tokens=False), pieces.encode_batch(some, add_special_tokens=False), strict=True)
        for text, (w, p), ids in zip(some, expected, cache.ids_of(some), strict=True):
            assert counter.count(text) == len(w.ids), ascii(text)
            assert ids == struct.pack(f"<{len(p.ids)}I", *p.ids), ascii(text)


def test_random_code_points_equal_the_library():
    r = random.Random(11)
    counter, codec = token_counts.Counter(WORD), bpe_codec.codec(BYTE)
    (count, _), (encode, pieces) = library(WORD), library(BYTE)
    packed = packing.library_ids(BYTE)
    planes = [range(1, 0x250), range(0x300, 0x3000), range(0x3000, 0xD800), range(0xE000, 0x20000), range(0x20000, 0x33500)]
    for _ in range(3_000):
        parts = [chr(r.choice(r.choice(planes))) if r.random() < 0.6 else r.choice(["'re", "'s", " ", "a", "1", "\u0e47", "İ"]) for _ in range(r.randint(1, 12))]
        text = "".join(parts)
        assert counter.count(text) == len(count(text)), ascii(text)
        ids = encode(text)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids) == packed.ids(text), ascii(text)
        assert codec.decode(codec.encode(text)) == pieces.decode(ids, skip_special_tokens=False)


def unbroken(seed, n):
    """Texts without white space: letters and digits as in base64, a few letters, Chinese, marks and apostrophes."""
    r = random.Random(seed)
    for alphabet in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghij", "中文字的是在有人我他这", "ab'sre'llv!?-", "é\u0301ßΣσ🙂"):
        yield "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("chunk", [64, 1000])
def test_maps_of_chunks_without_white_space(chunk, monkeypatch):
    encode, _ = library(WORD)
    counter = token_counts.Counter(WORD)
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    for text in unbroken(chunk, 5_000):
        maps = [token_counts.chunk_map(counter.machine, text[i : i + chunk]) for i in range(0, len(text), chunk)]
        assert not any(m.resets for m in maps)
        assert counter.count(text) == len(encode(text))
        assert counter.prefix_counts(text)[-1] == len(encode(text))
        mixed = text[:1500] + " \n" + text[1500:3000] + "\u3000x"
        assert counter.count(mixed) == len(encode(mixed))


def test_states_stay_bounded_within_a_text(monkeypatch):
    encode, _ = library(WORD)
    counter = token_counts.Counter(WORD)
    monkeypatch.setattr(token_counts, "STATES", 3_000)
    for text in unbroken(5, 60_000):
        assert counter.count(text) == len(encode(text))
        assert len(counter.machine.states) <= 3_001 + token_counts.MEETING


@pytest.mark.parametrize("seed", range(3))
def test_ids_and_decoding_equal_the_library_on_noise(seed):
    encode, t = library(BYTE)
    codec = bpe_codec.Codec(BYTE)
    for text in noise(seed + 10):
        ids = encode(text)
        got = codec.encode(text)
        assert got == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        assert codec.decode(got) == t.decode(ids, skip_special_tokens=False)


def test_counts_of_documents(spark, sf, awkward, empty, clashing):
    encode, _ = library(WORD)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(awkward.columns).unionByName(awkward)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(encode(r.text or "")), n > 2048) for r in docs.collect())
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, WORD).collect())
    assert got == want
    assert token_counts.count_tokens(clashing, WORD).count() == awkward.count()
    assert token_counts.count_tokens(empty, WORD).count() == 0


def test_digests_of_documents(spark, sf, awkward, empty, clashing):
    encode, t = library(BYTE)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(awkward.columns).unionByName(awkward)

    def digests(text):
        ids = encode(text)
        whole = t.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(whole.encode()).hexdigest()

    want = sorted((str(r.doc_id), *digests(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe_codec.encode_digests(docs, BYTE).collect()) == want
    assert bpe_codec.encode_digests(clashing, BYTE).count() == awkward.count()
    assert bpe_codec.encode_digests(empty, BYTE).count() == 0
    rows = bpe_codec.encode_documents(awkward.where("doc_id < 5"), BYTE).collect()
    assert all(r.decoded == (awkward.where(f"doc_id = {r.doc_id}").first().text or "") for r in rows)


def test_differencing_gives_near_equal_windows():
    r = random.Random(1)
    for _ in range(50):
        sizes = [r.randint(1, 256) for _ in range(r.randint(1, 400))]
        k = r.randint(1, 40)
        got = difference(sizes, k)
        assert sorted(i for w in got for i in w) == list(range(len(sizes)))
        sums = sorted(sum(sizes[i] for i in w) for w in got)
        assert len(got) == k and sums[-1] - sums[0] <= max(sizes)
        dealt = deal(sizes, 1024)
        assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in w) for w in dealt) <= 1024


def test_packing_covers_every_id_once(spark, sf, awkward, empty, clashing):
    encode, _ = library(BYTE)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(awkward.columns).unionByName(awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", awkward.doc_id + 10_000_000))
    pieces = packing.pack_documents(docs, BYTE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    rows = docs.collect()
    assert set(by_doc) == {r.doc_id for r in rows}
    for r in rows:
        ids, at = [*encode(r.text or ""), 0], 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            own = ids[at : at + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and all(p.sequence_length == at for p in own)
    used = sum(p.length for p in pieces)
    full = len(by_sequence) * 1024
    assert used / full > 0.97
    assert packing.pack_documents(clashing, BYTE).select("sequence_id").distinct().count() > 0
    assert packing.pack_documents(empty, BYTE).count() == 0
    again = packing.pack_documents(awkward.where("doc_id = 6 or doc_id is null"), BYTE).collect()
    assert sum(p.length for p in again) == 2 * (len(encode(awkward.where("doc_id = 6").first().text)) + 1) + sum(len(encode(r.text or "")) + 1 for r in awkward.where("doc_id is null").collect())
