"""Token ids, packing and the range-coded files: exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import packing, range_coder, token_ids
from fleetlens.llm.token_files import read_ids, read_token_files, write_token_files
from fleetlens.llm.token_ids import token_slices

PATH = packing.word_bpe()
ODD = ["", None, "It's a l'homme", "<|endoftext|> hi", "  a1b2²¼ x", "ÉÀİ ß ſ", "日本語 test", "a b\u0085c \x1c d e", "é é", "x\n\n'", "---??!!  ...", "Σας ΟΔΟΣ", "foo_bar-baz", "a" * 5000, "don’t <b>|"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer, sample):
    texts = ODD + [t for _, t in sample[:60]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = [ids[a:b].tolist() for _, ids, bounds in token_slices(batch, PATH) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_new_parts_cost_the_same_with_many_known(monkeypatch):
    """A slice sorts its own new parts, not again all that the worker has met."""
    encoder, handed = token_ids.WordEncoder(PATH), []
    for name in ("argsort", "unique", "sort"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda a, *args, plain=plain, **more: handed.append(np.size(a)) or plain(a, *args, **more))
    letters = np.array(list("abcdefghij"))
    for k in range(20):
        text = " ".join("".join(letters[[int(c) for c in f"{n:06d}"]]) for n in range(500 * k, 500 * k + 500))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        encoder.slice_ids(points, np.array([0, len(points)]))
    assert sum(handed) <= 4 * 20 * 500


def test_ids_with_full_tables(monkeypatch, tokenizer, sample):
    """Parts that share a place, and a pool that starts again."""
    monkeypatch.setattr(token_ids, "SLOT_BITS", 3)
    monkeypatch.setattr(token_ids, "POOL_IDS", 800)
    encoder = token_ids.WordEncoder(PATH)
    for a in range(0, 60, 7):
        texts = [t or "" for _, t in sample[a : a + 7]] + ODD[a // 7 : a // 7 + 3]
        points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
        ids, counts = encoder.slice_ids(points, np.cumsum([0, *(len(t or "") for t in texts)]))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("high", [2, 300, 65536])
@pytest.mark.parametrize("n", [0, 1, 5, 4096, 4097, 9000])
def test_coder_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n)
    blocks = range_coder.encode_blocks(ids)
    assert (range_coder.decode_blocks(blocks) == ids).all()
    # Blocks do not need each other.
    if len(blocks) > 1:
        assert (range_coder.decode_blocks(blocks[1:]) == ids[range_coder.BLOCK :]).all()


def test_coder_takes_one_step_an_id(monkeypatch):
    steps = {"put": 0, "take": 0}
    for kind, name in ((range_coder._Out, "put"), (range_coder._In, "take")):
        plain = getattr(kind, name)

        def counted(self, *args, plain=plain, name=name):
            steps[name] += 1
            return plain(self, *args)

        monkeypatch.setattr(kind, name, counted)
    ids = np.random.default_rng(1).zipf(1.3, 40 * range_coder.BLOCK).clip(0, 49_000)
    assert (range_coder.decode_blocks(range_coder.encode_blocks(ids)) == ids).all()
    assert steps == {"put": range_coder.BLOCK, "take": range_coder.BLOCK}


@pytest.mark.parametrize("seed", range(6))
def test_coder_odd_ids(seed):
    """Long runs, rare ids after sure ones, ids at both ends; blocks of several groups in any order."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(20_000, 60_000))
    ids = [np.full(n, 65_535), np.where(rng.random(n) < 0.001, 65_535, 0), rng.zipf(1.1, n).clip(0, 65_535), np.repeat(rng.integers(0, 65_536, n // 50 + 1), 50)[:n], np.arange(n) & 0xFFFF, rng.choice([0, 31, 32, 1023, 1024, 65_535], n)][seed]
    blocks = range_coder.encode_blocks(ids, [7, 100, 1024, 33, 2048, 500][seed])
    assert (range_coder.decode_blocks(blocks) == ids).all()
    assert (range_coder.decode_blocks(blocks[::-1]) == np.concatenate([ids[a : a + k] for a, k in zip(np.cumsum([0, *(b[0] for b in blocks[:-1])])[::-1], [b[0] for b in blocks[::-1]], strict=True)])).all()


def test_coder_finds_damage():
    rng = np.random.default_rng(2)
    blocks = range_coder.encode_blocks(rng.zipf(1.2, 3000).clip(0, 49_000))
    for _ in range(25):
        k = int(rng.integers(len(blocks)))
        size, crc, payload = blocks[k]
        at = int(rng.integers(len(payload) - 8))
        cut = payload[:at] if rng.random() < 0.3 else payload[:at] + bytes([payload[at] ^ int(rng.integers(1, 256))]) + payload[at + 1 :]
        with pytest.raises(ValueError, match="checksum"):
            range_coder.decode_blocks([*blocks[:k], (size, crc, cut), *blocks[k + 1 :]])


def test_coder_compresses_and_checks():
    ids = np.tile(np.arange(50), 200)
    blocks = range_coder.encode_blocks(ids)
    assert sum(len(p) for _, _, p in blocks) < 0.3 * len(ids)
    size, crc, payload = blocks[0]
    damaged = payload[:40] + bytes([payload[40] ^ 16]) + payload[41:]
    with pytest.raises(ValueError, match="checksum"):
        range_coder.decode_blocks([(size, crc, damaged)])
    with pytest.raises(ValueError, match="16 bits"):
        range_coder.encode_blocks(np.array([70_000]))


def expected(tokenizer, rows, end):
    return [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], "<u4")) for d, t in rows]


def test_token_files(spark, tokenizer, documents, sample, tmp_path):
    write_token_files(documents, PATH, f"{tmp_path}/ids")
    start, want = 0, {}
    for d, ids in expected(tokenizer, sample, 2):
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, f"{tmp_path}/ids").collect()} == want
    first = read_ids(spark, f"{tmp_path}/ids").filter("doc_id = 3").first()
    assert zlib.crc32(np.array(first.ids, "<u4").tobytes()) == want[3][2]


def test_token_files_odd_rows(spark, messy, empty, tmp_path):
    write_token_files(messy, PATH, f"{tmp_path}/odd")
    rows = read_token_files(spark, f"{tmp_path}/odd").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -4, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12, 13]
    assert rows[2].n_tokens == rows[3].n_tokens == rows[4].n_tokens == 1
    write_token_files(empty, PATH, f"{tmp_path}/none")
    assert read_token_files(spark, f"{tmp_path}/none").count() == 0


def check_packed(rows, want, capacity):
    """Every piece once, in its place, sequences gapless and not over full; returns the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    cut = [(-1 if d is None else d, k, k * capacity, len(ids[k * capacity : (k + 1) * capacity]), zlib.crc32(ids[k * capacity : (k + 1) * capacity].tobytes())) for d, ids in want for k in range(-(-len(ids) // capacity))]
    assert pieces == sorted(cut)
    return len(by)


def test_packing(spark, tokenizer, documents, sample):
    rows = packing.pack(documents.repartition(7), PATH).collect()
    want = expected(tokenizer, sample, 0)
    least = -(-sum(len(ids) for _, ids in want) // 2048)
    assert check_packed(rows, want, 2048) <= least * 1.08 + 1


def test_packing_odd_rows(spark, tokenizer, messy, empty):
    rows = packing.pack(messy.repartition(5), PATH, capacity=64).collect()
    check_packed(rows, expected(tokenizer, [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()], 0), 64)
    assert packing.pack(empty, PATH).count() == 0


def test_sequences(spark, documents):
    packed = packing.pack(documents, PATH, with_ids=True)
    assert all(len(r.ids) == 4 * r.length for r in packing.sequences(packed).collect())


def test_merge_rounds(spark):
    """Underfull bins meet in the tree: 40 bins of 30 in 40 partitions become 14 sequences."""
    loads = spark.createDataFrame([(i, 30) for i in range(40)], "bin long, load long").repartition(40, "bin")
    moved = packing.merge_rounds(loads, 100, 40).collect()
    assert len({r.bin for r in moved}) == len(moved)
    sizes = {}
    for b in range(40):
        root = next((r.root for r in moved if r.bin == b), b)
        sizes[root] = sizes.get(root, 0) + 30
    assert max(sizes.values()) <= 100 and len(sizes) <= 16
