import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from quillon.llm import token_blocks as tb

PATH = P.path("byte_bpe_50k.json")
MARK = "<|endoftext|>"
MARKED = [MARK, f"a {MARK} b", f"{MARK}{MARK} x", f"one{MARK}", f"  {MARK}  it's", "<|endoftext", f"é {MARK[:-1]} {MARK}\n\n{MARK}"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=700))
def test_round_trip(values):
    ids = np.array(values, np.uint32)
    segment = tb.Segment(tb.pack(ids, np.array([7, 9]), np.array([len(ids), 0]), np.array([False, True])))
    assert segment.ids().tolist() == values and segment.doc_ids.tolist() == [7, 9] and segment.lengths.tolist() == [len(ids), 0]
    assert segment.unnamed.tolist() == [False, True]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), min_size=1, max_size=1500), st.data())
def test_one_block_by_its_start(values, data):
    segment = tb.Segment(tb.pack(np.array(values, np.uint32), np.array([1]), np.array([len(values)])))
    first = data.draw(st.integers(0, len(values)))
    stop = data.draw(st.integers(first, len(values)))
    block = data.draw(st.integers(0, segment.blocks - 1))
    # Nothing but this block's bytes is read: the rest of the body may be lost.
    segment.body = segment.body.copy()
    others = np.ones(len(segment.body), bool)
    end = segment.begin[block + 1] if block + 1 < segment.blocks else len(segment.body)
    others[segment.begin[block] : end] = False
    kept = segment.body.copy()
    segment.body[others] = 0xAA
    assert segment.read(np.array([block]))[0].tolist()[: len(values) - block * tb.BLOCK] == values[block * tb.BLOCK : (block + 1) * tb.BLOCK]
    segment.body = kept
    assert segment.ids_between(first, stop).tolist() == values[first:stop]


def test_one_document():
    segment = tb.Segment(tb.pack(np.arange(1000, dtype=np.uint32), np.arange(4), np.array([300, 0, 699, 1])))
    assert [segment.document(i).tolist() for i in range(4)] == [list(range(300)), [], list(range(300, 999)), [999]]


def test_outliers_are_exceptions_not_width():
    ids = np.arange(2560, dtype=np.uint32) % 16
    small = len(tb.pack(ids, np.array([1]), np.array([2560])))
    ids[::256] = 50_000
    assert len(tb.pack(ids, np.array([1]), np.array([2560]))) <= small + 10 * 5


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        tb.Segment(b"nonsense" * 10)


def encoded(encoder, texts):
    ids, sizes = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_special_tokens_as_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["plain", *MARKED, "", "more"]
    assert encoded(tb.library_encoder(PATH), texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [50256] in encoded(tb.library_encoder(PATH), texts)


def test_added_tokens_with_options(tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.add_tokens([AddedToken("<x>", lstrip=True), AddedToken("word", single_word=True)])
    tokenizer.save(str(tmp_path / "t.json"))
    texts = ["a  <x> b", "words word", "", "none of them", *MARKED]
    assert encoded(tb.LibraryEncoder(str(tmp_path / "t.json")), texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_on_odd_rows(spark, odd, none, odd_rows):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(d, t) for d, t, *_ in odd_rows] + [(-1, "minus one"), *((500 + i, t) for i, t in enumerate(MARKED))]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"))
    got = sorted(tb.token_files(docs, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, *sorted(r[0] for r in rows if r[0] is not None)]
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    key = lambda d: (d is None, d or 0)
    want = sorted((key(d), len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for d, ids in ((d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows))
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    assert tb.token_files(none, PATH).count() == 0


def test_segments_hold_whole_documents(spark):
    rows = [(i, "word " * (i * 7 % 90)) for i in range(60)]
    found = [tb.Segment(r.payload) for r in tb.segments(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 3, segment_ids=50).collect()]
    assert sorted(d for s in found for d in s.doc_ids.tolist()) == list(range(60))
    assert all(s.lengths.sum() == s.n and (s.n <= 50 or len(s.lengths) == 1) for s in found) and len(found) > 20


def test_one_id_for_all_rows_is_split(spark):
    from quillon.llm.common import in_doc_order

    docs = spark.createDataFrame([(1, "the same text")] * 400, "doc_id long, text string").repartition(4)
    assert max(len(p) for p in in_doc_order(docs, 4).rdd.glom().collect()) < 300
