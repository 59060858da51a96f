import numpy as np
import pytest
from conftest import SMALL, STRANGE
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from clicktide.llm import packing, seekable
from clicktide.llm.common import open_folder, table
from clicktide.llm.queries import QUERIES
from clicktide.llm.tokens import byte_bpe, encoder

TEXTS = st.text(st.sampled_from(list("ab Z\n\t.,'s1! é <|>\r")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_give_the_ids_of_the_whole(text):
    assert encoder(byte_bpe()).all_ids([text]) == [brute.tokens([text], 9)[0][:-4]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXTS, max_size=8))
def test_texts_together_give_the_ids_of_each(many):
    found = encoder(byte_bpe()).all_ids(many)
    assert found == [x[:-4] for x in brute.tokens(many, 9)]


def test_a_full_store_of_pieces_is_emptied(monkeypatch):
    from clicktide.llm import tokens

    monkeypatch.setattr(tokens, "PIECES", 5)
    e = tokens.Encoder(byte_bpe())
    many = ["one two, three.", "two, four five six seven", "one"]
    for _ in range(2):
        assert e.all_ids(many) == [x[:-4] for x in brute.tokens(many, 9)]


def test_real_texts(spark):
    texts = [r.text for r in table(spark, SMALL, "documents").select("text").collect()]
    e = encoder(byte_bpe())
    assert e.all_ids(texts) == [x[:-4] for x in brute.tokens(texts, 0)]


def check_files(docs, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    import zlib

    for (doc, _), ids in zip(ordered, brute.tokens([t for _, t in ordered], 0)):
        want.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = [tuple(r) for r in seekable.token_files(docs).collect()]
    key = lambda r: r[1]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_files_of_strange_documents(strange):
    check_files(strange, STRANGE)


def test_files_of_the_table(spark):
    df = table(spark, SMALL, "documents")
    check_files(df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_a_small_limit_gives_several_files_and_the_same_rows(spark, strange, tmp_path):
    whole = seekable.token_files(strange).collect()
    files = seekable.write_tokens(strange.repartition(1), str(tmp_path), file=50)
    rows = files.collect()
    assert len(rows) > 5 and sum(r.n_docs for r in rows) == len(STRANGE)
    # all but a document that is longer by itself
    assert sorted(r.n_tokens for r in rows)[-3] < 50 + 700
    got = seekable.read_tokens(spark, str(tmp_path), files).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(map(tuple, whole), key=lambda r: r[1])


def test_empty_table(docs):
    none = docs(STRANGE).where("false")
    assert seekable.token_files(none).count() == 0
    assert packing.pack(none).count() == 0


def test_reader_fetches_only_the_frames_it_needs(tmp_path):
    rows = [(i, np.arange(i * 7, i * 7 + 300 * (1 + i % 3), dtype="<u4").tobytes()) for i in range(40)]
    rows.insert(20, (99, np.arange(5000, dtype="<u4").tobytes()))
    count = []
    (tmp_path / "f").write_bytes(b"".join(seekable.file_chunks(rows, count, frame=1000)))
    fs, path = open_folder(str(tmp_path))
    reader = seekable.Reader(fs, f"{path}/f")
    assert count == [41, sum(len(r[1]) for r in rows) // 4]
    assert [(d, raw) for d, _, raw in reader.documents([7])] == [rows[7]]
    assert reader.frames_read <= 2
    assert [(d, raw) for d, _, raw in reader.documents([99])] == [rows[20]]
    assert [(d, raw) for d, _, raw in seekable.Reader(fs, f"{path}/f").documents()] == rows


def test_frames_are_plain_zstandard_and_checked(tmp_path):
    import zstandard

    count = []
    raw = np.arange(3000, dtype="<u4").tobytes()
    body = b"".join(seekable.file_chunks([(1, raw)], count, frame=1000))
    # a plain decoder skips the tail
    plain = zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True).read()
    assert plain == raw
    (tmp_path / "f").write_bytes(body[:30] + bytes([body[30] ^ 255]) + body[31:])
    fs, path = open_folder(str(tmp_path))
    with pytest.raises(Exception):
        list(seekable.Reader(fs, f"{path}/f").documents())


def check_packing(rows, pieces, window=2048):
    import zlib

    ids = {}
    for (doc, _), raw in zip(rows, brute.tokens([t for _, t in rows], 1)):
        ids.setdefault(doc, []).append(raw)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for doc, raws in ids.items():
        total = sum(len(r) // 4 for r in raws)
        assert sum(p.length for p in by_doc[doc]) == total
        if len(raws) == 1:
            at = 0
            for p in sorted(by_doc[doc], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == total
                assert p.ids_crc32 == zlib.crc32(raws[0][4 * at : 4 * (at + p.length)])
                at += p.length
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(p.length for p in pieces) / (window * len(by_seq))


def test_packing_strange(strange):
    check_packing(STRANGE, packing.pack(strange).collect())


def test_packing_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    assert check_packing(rows, QUERIES["op10_packing"](spark, d).collect()) > 0.985


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_balance_places_each_once_within_capacity(lengths):
    parts = packing.balance(lengths, 50)
    assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in p) <= 50 for p in parts)


def test_windows_rise_when_capacity_is_exceeded():
    assert len(packing.balance([30, 30, 30], 50)) == 3


MARKED = st.lists(st.text(st.sampled_from(list("abzé1',.;:!?#$%&*|\n<>")), max_size=8), max_size=6).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(MARKED)
def test_marks_behind_words_give_the_ids_of_the_whole(text):
    assert encoder(byte_bpe()).all_ids([text]) == [brute.tokens([text], 9)[0][:-4]]


def test_a_word_is_encoded_once_whatever_marks_follow(monkeypatch):
    from clicktide.llm import tokens

    e, asked = tokens.Encoder(byte_bpe()), []
    whole = e.whole
    monkeypatch.setattr(e, "whole", lambda texts: asked.extend(texts) or whole(texts))
    e.all_ids(["so word word&&& word%%% word,### word."])
    assert [t for t in asked if "word" in t] == [" word"]


def test_batches_of_texts_stay_below_a_slice(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from clicktide.llm.common import SLICE

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    df = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    sizes = [r.n for r in df.mapInArrow(run, "n bigint").collect()]
    assert sum(sizes) >= 20_000_000 and max(sizes) <= SLICE


LETTERED = st.text(st.sampled_from(list("abZ  \n\téßñſǅʼƻμЖщ҂×÷ªº²Ⅷ中٣,.'1\x1c\x85\xa0 ")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERED, max_size=4))
def test_letters_of_any_script_give_the_ids_of_the_whole(many):
    assert encoder(byte_bpe()).all_ids(many) == [x[:-4] for x in brute.tokens(many, 9)]


def test_letters_and_spaces_are_those_of_the_library_and_of_python():
    import pyarrow as pa
    import pyarrow.compute as pc

    from clicktide.llm import tokens

    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    spaces = pc.match_substring_regex(pa.array(every), tokens.SPACE).to_pylist()
    assert spaces == [c.isspace() for c in every]
    letters = [c for c in every if tokens.LETTER(c)]
    split = encoder(byte_bpe()).tokenizer.pre_tokenizer.pre_tokenize_str
    assert len(letters) > 700 and all(len(split(f" a{c}a")) == 1 for c in letters)


def test_words_of_letters_go_to_the_model_as_they_stand(monkeypatch):
    from clicktide.llm import tokens

    class Asked:
        def encode_batch_fast(self, texts, **named):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **named)

    monkeypatch.setattr(tokens, "WORDS", 3)
    e, asked = tokens.Encoder(byte_bpe()), []
    library, e.tokenizer = e.tokenizer, Asked()
    many = ["Straße élan 12 the, x-y\nмир the.", "one\ntwo three four five"]
    assert e.all_ids(many) == [x[:-4] for x in brute.tokens(many, 9)]
    assert sorted(asked) == [" 12", " x-y", ",", "."]
