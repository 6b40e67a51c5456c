import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from tangoflow.llm import packing as P
from tokenizers import Tokenizer

from conftest_llm import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(4)
    rows = [None, "", " ", "\n\n  \t x", "é𝒜ß漢字", "<|endoftext|>", "a <|endoftext|> b", "a" * 4000, "don't I'LL 123456", "!" * 500, prose(rng, 6000)]
    return rows + [prose(rng, rng.randint(1, 900)) for _ in range(60)]


def test_encoder_equals_the_tokenizer():
    exact = Tokenizer.from_file(PATH)
    for t in texts():
        assert P.encode(t or "", PATH) == exact.encode(t or "", add_special_tokens=False).ids


def test_pieces_cover_every_id_once(docs_of):
    rows = list(enumerate(texts()))
    rows.append(rows[-1])
    docs = docs_of(rows).repartition(5, "doc_id")
    got = P.pack(docs, PATH).collect()
    ids = {i: [*P.encode(t or "", PATH), 1] for i, t in rows}
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        by[r.doc_id].append((r.start, r.length))
        seq[r.sequence_id].append((r.offset, r.length))
    for i, _ in rows[:-2]:
        at = 0
        for start, length in sorted(by[i]):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert sum(n for _, n in by[rows[-1][0]]) == 2 * len(ids[rows[-1][0]])
    for k, spans in seq.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == P.WINDOW or k == max(seq)
    assert sorted(seq) == list(range(len(seq)))


def test_sequences_and_padding(docs_of):
    tokens = P.tokenised(docs_of([(1, "a b c"), (2, "d " * 700)]), PATH)
    out = P.sequences(P.pieces(tokens, 64), 64).collect()
    lengths = {r.sequence_id: r.length for r in out}
    total = sum(len(P.encode(t, PATH)) + 1 for t in ("a b c", "d " * 700))
    assert sum(lengths.values()) == total
    for r in out:
        pads = r.length < 64 and r.length & (r.length - 1)
        assert len(r.ids) == 4 * (64 if pads else r.length)


def test_empty_table(docs_of):
    assert P.pack(docs_of([(1, "")]).where("false"), PATH).count() == 0


def test_null_ids_are_packed(docs_of):
    got = P.pack(docs_of([(None, "a b"), (None, None), (3, "c")]), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == sorted([(0, len(P.encode("a b", PATH)) + 1), (0, 1), (3, len(P.encode("c", PATH)) + 1)])
