"""Tokenizer operators against the libraries, byte for byte."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioflow.llm.bpe_automaton import Automaton, BatchEncoder, Bpe, Transitions, _has_arc, encode_digests
from folioflow.llm.common import read_bytes, stored
from folioflow.llm.packing import difference, pack_documents, windows_of
from folioflow.llm.token_counts import count_tokens, segments
from folioflow.llm.token_files import FrameReader, read_crc, starts, write_tokens

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " \n ", "<|endoftext|>foo<|startoftext|> bar <|ENDOFTEXT|>", "aaaaaaaaaaaaaaaaaaaaaa", "don't I'LL 1234½Ⅷ٣ ΑΣ İstanbul ﬁ é ́x \x1c a\x1db \x85 z", "漢字 かな 😀👩‍👩‍👧 ​", "***!!!###", "x" * 5000, "word " * 3000]


def texts():
    rng = random.Random(1)
    some = ["".join(rng.choice("abcdefgthinersz'AB .!?éèß0123\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    wide = ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0x1FFF), rng.randint(0x2000, 0xD7FF)])) for _ in range(rng.randint(0, 20))) for _ in range(200)]
    return ODD + some + wide


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(10_000, None), (10_001, "repeated row"), (10_001, "repeated row")]
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_tokens int, score string").repartition(3)


def ids_of(docs):
    t = Tokenizer.from_file(WORD)
    return {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}, t


def test_arcs_of_both_forms_agree():
    merges = [(0, 0, 3), (0, 1, 4), (3, 1, 5), (3, 3, 6), (1, 2, 7), (4, 7, 8)]
    a = Automaton.compile(9, merges)
    t = Transitions(a)
    parts = [x.tolist() for x in (a.left, a.rank, a.copied, a.lost, a.made)]
    for q in range(len(a.copied)):
        for k in range(9):
            if q in a.target or q == 0:
                assert t.have(np.array([q]), np.array([k]))[0] == t.has(q, k) == _has_arc(q, k, *parts)


def test_encode_and_decode(docs):
    expected, library = ids_of(docs)
    got = {r["doc_id"]: r for r in encode_digests(docs, WORD).collect()}
    for i, ids in expected.items():
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_digests(docs, WORD).count() == docs.count()
    assert encode_digests(docs.limit(0), WORD).count() == 0


def test_table_of_words_may_overflow(monkeypatch):
    from folioflow.llm import bpe_automaton

    monkeypatch.setattr(bpe_automaton, "WORDS", 5)
    monkeypatch.setattr(bpe_automaton, "WORD_IDS", 20)
    monkeypatch.setattr(bpe_automaton, "TRANSITIONS", 50)
    monkeypatch.setattr(bpe_automaton, "NEW_WORDS", 8)
    monkeypatch.setattr(bpe_automaton, "BATCH_CHARS", 30)
    encoder, library = BatchEncoder(Bpe(read_bytes(WORD))), Tokenizer.from_file(WORD)
    for t in ("one two three, four.", "five six seven one", "two two two", "a much longer text of many words, which is cut in more than two parts", *ODD[:7]):
        assert encoder.encode([t, "", t])[2].tolist() == library.encode(t, add_special_tokens=False).ids


def test_words_by_classes_of_characters():
    encoder, library, rng = BatchEncoder(Bpe(read_bytes(WORD))), Tokenizer.from_file(WORD), random.Random(4)
    some = ["".join(rng.choice("'" * 4 + "strevmdl LDS.!1½²ª éÉßſŸȺİ\x1c\x85\xa0\n<|>") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for t, ids in zip(some, encoder.encode(some), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_long_words():
    bpe, library, rng = Bpe(read_bytes(WORD)), Tokenizer.from_file(WORD), random.Random(6)
    long = ["".join(rng.choice("abcdeginorst") for _ in range(200_000)), "x" * 50_000, "ab" * 20_000, "é" * 3000]
    start = time.time()
    for w in long:
        assert bpe.words([w.encode()])[0] == library.encode(w, add_special_tokens=False).ids
    assert time.time() - start < 60


def test_counts(docs):
    t = Tokenizer.from_file(BYTE)
    for r in count_tokens(docs, BYTE, 10).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 10)
    long = "A sentence, with words. " * 2000
    parts = segments(long, 500)
    assert len(parts) > 50 and "".join(parts) == long and sum(len(t.encode(p).ids) for p in parts) == len(t.encode(long).ids)


def test_files_round_trip(docs, tmp_path):
    expected, _ = ids_of(docs)
    folder = f"file://{tmp_path}/tokens"
    index = stored(write_tokens(docs, WORD, 2, folder))
    got = sorted(map(tuple, read_crc(starts(index), folder).collect()))
    order, start, want = sorted(r["doc_id"] for r in docs.select("doc_id").collect()), 0, []
    for i in order:
        ids = [*expected[i], 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert write_tokens(docs.limit(0), WORD, 2, folder).count() == 0


def test_damage_is_noticed(docs, tmp_path):
    import pyarrow.fs

    folder = tmp_path / "t"
    index = write_tokens(docs, WORD, 2, f"file://{folder}").collect()
    path = folder / index[0]["file"]
    data = bytearray(path.read_bytes())
    data[10] ^= 255
    path.write_bytes(data)
    with pytest.raises(Exception):
        FrameReader(pyarrow.fs.LocalFileSystem(), str(path)).frame(0)


def test_packing(docs):
    expected, _ = ids_of(docs)
    got = pack_documents(docs, WORD, 2, window=256, piece=64).toPandas().sort_values(["sequence_id", "offset"])
    for r in got.itertuples():
        ids = [*expected[r.doc_id], 2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert got.length.sum() == sum(len(expected[r["doc_id"]]) + 1 for r in docs.collect())
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 256
    assert 1 - got.length.sum() / 256 / got.sequence_id.nunique() < 0.05


def test_differencing():
    sets = difference([8, 7, 6, 5, 4], 2)
    assert sorted(i for s in sets for i in s) == [0, 1, 2, 3, 4] and abs(sum([8, 7, 6, 5, 4][i] for i in sets[0]) - 15) <= 1
    assert windows_of([], 4) == [] and len(windows_of([3, 3, 3], 4)) == 3 and len(windows_of([2, 2, 2, 2], 4)) == 2
