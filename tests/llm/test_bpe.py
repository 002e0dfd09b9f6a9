import base64
import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken

from quillon.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab'sdtrevlm  \n\t\xa0　é中1٣½.,!'’😀́​\x85 $\0"


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n):
    rng = random.Random(3)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, "", "  ", "'s", "x's 're''ll", " 's", "\n's", "<|endoftext|>", "".join(rng.choice("abcdefgh") for _ in range(5000))]


def test_pieces_match_the_pattern():
    some = texts(3000)
    found, counts = bpe.pieces(some)
    at = 0
    for text, n in zip(some, counts.tolist()):
        assert found[at : at + n] == regex.findall(P.PATTERN, text), text
        at += n
    assert at == len(found)


def test_texts_with_every_mark():
    some = ["".join(map(chr, range(0x300))), "plain text", ""]
    found, counts = bpe.pieces(some)
    assert counts.tolist() == [len(regex.findall(P.PATTERN, t)) for t in some] and "".join(found) == "".join(some)


def test_ids_match_the_library_and_decode():
    some, coder, other = texts(1500), bpe.codec(PATH), reference()
    for text, ids in zip(some, coder.encode(some)):
        assert ids.tolist() == other.encode_ordinary(text), text
        assert coder.decode(ids.tolist()) == text.encode()


def test_every_code_point_of_the_basic_plane():
    coder, other = bpe.codec(PATH), reference()
    some = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}." for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    assert [x.tolist() for x in coder.encode(some)] == other.encode_ordinary_batch(some, num_threads=2)


def test_table_is_bounded_and_exact(monkeypatch):
    rng, seen = random.Random(8), []
    encode = lambda some: seen.extend(some) or [bytes([len(p) % 200, 1, 0, 0]) + p.ljust(-(-len(p) // 4) * 4, b"\7") for p in some]
    monkeypatch.setattr(bpe.PieceTable, "LIMIT", 300)
    monkeypatch.setattr(bpe.PieceTable, "BITS", 10)
    monkeypatch.setattr(bpe.PieceTable, "RUN", 64)
    table = bpe.PieceTable(encode)
    for _ in range(60):
        some = [" ".join("".join(rng.choice("abcé\0") for _ in range(rng.choice((1, 2, 7, 8, 9, 14, 15, 16, 40)))) for _ in range(20)) for _ in range(5)]
        ids, sizes = table.encode(some)
        at = 0
        for text, n in zip(some, sizes.tolist()):
            want = b"".join(encode([p.encode() for p in bpe.pieces([text])[0]]))
            assert ids[at : at + n].tobytes() == want
            at += n
        assert at == len(ids) and table.size <= 300 + 64


def test_query_on_odd_rows(odd, none, odd_rows):
    other = reference()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, PATH).collect())
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = other.encode_ordinary(text or "")
        want.append((doc_id is None, doc_id or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(none, PATH).count() == 0
    row = bpe.encoded(odd, PATH).where("doc_id = 13").first()
    text, raw = odd_rows[9][1], odd_rows[9][1].encode()
    assert row.ids == other.encode_ordinary(text) and row.offsets[0] == 0 and row.offsets[-1] == len(raw)
    assert all(other.decode_single_token_bytes(i) == raw[a:b] for i, a, b in zip(row.ids, row.offsets, row.offsets[1:]))
