import pytest
from conftest import rows

tokens = pytest.importorskip("tidemark.llm.tokens")
pytest.importorskip("tiktoken")

TEXTS = [None, "", " ", "Hello world", "It's  <|endoftext|>\r\n\t x", "naïve façade Ü 日本語 テスト", "👩‍🔧👍🏽 ☐​", "a" * 5000 + " b" * 3000, "x y  z", "1234567,89 and 3.14", "don't WE'LL", "\n\n\n  end  ", "ё 　 全角", "\x00\x01"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>").repartition(3)


def test_ids_equal_those_of_the_public_library(docs):
    hf = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    hf.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in tokens.encode(docs).collect()}
    assert got == {i: hf.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert got[0] == [] and got[1] == []


def test_decoding_gives_the_texts_back(docs):
    assert dict(rows(tokens.decode(tokens.encode(docs)))) == {i: t or "" for i, t in enumerate(TEXTS)}
    assert dict(rows(tokens.count_tokens(docs))) == {r.doc_id: len(r.ids) for r in tokens.encode(docs).collect()}


def test_merges_in_the_jvm_give_the_same_ids(docs):
    short = docs.where("doc_id <> 7")
    assert {r.doc_id: r.ids for r in tokens.encode_by_words(short).collect()} == {r.doc_id: r.ids for r in tokens.encode(short).collect()}


def test_distinct_words(docs, spark):
    words = tokens.distinct_words(spark.createDataFrame([("a a b",), (None,), ("",)], "text string"))
    assert rows(words) == [(" a", 1), (" b", 1), ("a", 1)]
    assert tokens.vocabulary_size(spark) == 50_256


def test_no_texts(docs):
    assert rows(tokens.encode(docs.limit(0))) == [] and rows(tokens.encode_by_words(docs.limit(0))) == []


def test_slices_keep_rows_and_order():
    import pyarrow as pa

    from tidemark.llm import batches

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["x" * (i % 7) * 5000 for i in range(2000)])], ["i", "t"])
    out = list(batches.sliced(iter([batch, batch.slice(0, 0)])))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(2000))
    assert all(b.num_rows <= batches.ROWS and (b.num_rows == 1 or b.column(1).nbytes <= batches.BYTES) for b in out)


def test_long_runs_of_blanks(spark):
    import random

    own = tokens.encoder(tokens.read_ranks())
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice([" ", "\n", "\u3000", "\x1c", "a", "bc", "'s", "7"]) * rnd.randrange(1, 9) for _ in range(rnd.randrange(8)))
        assert tokens.encode_text(own, text, 3) == own.encode_ordinary(text)
    docs = spark.createDataFrame([(1, " " * 1_200_000 + "x"), (2, "\n" * 1_200_000)], "doc_id long, text string")
    sizes = dict(rows(tokens.count_tokens(docs)))
    assert sizes[1] > 1 and sizes[2] > 1
    assert dict(rows(tokens.decode(tokens.encode(docs)))) == {r.doc_id: r.text for r in docs.collect()}
