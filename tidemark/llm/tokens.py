"""Token ids of whole texts by a public byte-level tokenizer, and back."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import sliced

#: Where the vocabulary files are unless the caller says so.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for java.util.regex, whose \s is ASCII alone.
JAVA_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


def read_ranks(path: str | None = None) -> bytes:
    """A rank file: base64 of the piece, its rank, one per line. About 1 MB, fixed by the vocabulary."""
    with open(path or f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, raw.splitlines())}


@lru_cache(maxsize=4)
def encoder(raw: bytes):
    """The encoder of a rank file; one for each Python worker."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=_ranks(raw), special_tokens={})


#: A run of blanks from this length on is split off before the pattern sees it, which would run out of stack.
LONG_BLANK = 100_000
#: What the pattern takes for white space.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def encode_text(own, text: str, long_blank: int = LONG_BLANK) -> list[int]:
    """The ids of one text of any length.

    Of a run of blanks before something else the pattern takes all but the last as a word,
    of one at the end all: a long run is that word, and the texts around it are encoded by
    themselves.
    """
    if len(text) < long_blank:
        return own.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in re.finditer(f"[{_BLANK}]{{{long_blank},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += own.encode_ordinary(text[at : run.start()])
        out += own._encode_single_piece(text[run.start() : end])
        at = end
    return out + own.encode_ordinary(text[at:])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(ident, ids): the token ids of each text, without special tokens.

    A null or empty text has the empty list. What looks like a special token is text.
    Rows stay where they are: no exchange, and whole texts of any length are encoded one
    by one. The ranks go to the executors as one broadcast of the vocabulary's fixed size.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(path))
    rows = docs.select(F.col(ident), F.col(text))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in sliced(batches):
            ids = pa.array([encode_text(own, t) for t in _texts(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [ident, "ids"])

    return rows.mapInArrow(run, f"`{ident}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(ident, n_tokens): the length of each text in tokens; 0 for a null or empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = docs.select(F.col(ident), F.col(text))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in sliced(batches):
            sizes = pa.array([len(encode_text(own, t)) for t in _texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], [ident, "n_tokens"])

    return rows.mapInArrow(run, f"`{ident}` {kind}, n_tokens long")


def _pieces(path: str | None) -> list[str]:
    """Hex of each piece at its rank."""
    ranks = _ranks(read_ranks(path))
    out = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece.hex().upper()
    return out


def decode(tokens: DataFrame, ident: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(ident, text): the text of each list of ids, by concatenating the pieces' bytes. An empty or null list gives ''."""
    pieces = F.from_json(F.lit(json.dumps(_pieces(path))), "array<string>")
    parts = F.transform(F.coalesce(F.col(ids), F.array().cast("array<int>")), lambda i: F.element_at(pieces, i + 1))
    return tokens.select(ident, F.decode(F.unhex(F.array_join(parts, "")), "UTF-8").alias("text"))


class LiteralRanks:
    """The rank map as a literal, in buckets by hash, as a map's lookup in Spark reads all its entries."""

    BUCKETS = 8192

    def __init__(self, path: str | None = None):
        from zlib import crc32

        buckets: list[dict[str, int]] = [{} for _ in range(self.BUCKETS)]
        for piece, rank in _ranks(read_ranks(path)).items():
            name = piece.hex().upper()
            buckets[crc32(name.encode()) % self.BUCKETS][name] = rank
        self.map = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")

    def of(self, name: Column) -> Column:
        """The rank of the piece with this hex; null if it is none."""
        bucket = (F.crc32(name.cast("binary")) % self.BUCKETS + 1).cast("int")
        return F.try_element_at(F.element_at(self.map, bucket), name)


def encode_words(words: DataFrame, word: str = "word", path: str | None = None) -> DataFrame:
    """(word, ids): ids of distinct words by a fold of ranked merges over their bytes, in the JVM alone.

    Bytes are held as hex, two characters each. Every round joins the leftmost pair of
    lowest rank, until none has a rank.
    """
    ranks = LiteralRanks(path)
    name = F.hex(F.encode(F.col(word), "UTF-8"))

    def merged(acc: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(acc) - 1), lambda i: F.struct(F.coalesce(ranks.of(F.concat(F.element_at(acc, i), F.element_at(acc, i + 1))), F.lit(2**31 - 1)).alias("r"), i.alias("i")))
        joined = F.transform(
            F.array(F.array_min(pairs)),
            lambda b: F.when(b["r"] == 2**31 - 1, acc).otherwise(
                F.concat(F.slice(acc, F.lit(1), b["i"] - 1), F.array(F.concat(F.element_at(acc, b["i"]), F.element_at(acc, b["i"] + 1))), F.slice(acc, b["i"] + 2, F.size(acc)))
            ),
        )
        return F.when(F.size(acc) > 1, F.element_at(joined, 1)).otherwise(acc)

    length = (F.length(name) / 2).cast("int")
    single = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.substr(name, i * 2 + 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), single, lambda acc, _: merged(acc))
    whole = ranks.of(name)
    ids = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, ranks.of))
    return words.where(F.length(word) > 0).select(word, ids.alias("ids"))


def encode_by_words(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The same result as `encode`, by way of the corpus's distinct words and a join back to the texts.

    Kept beside `encode` for its figures (README): the join back moves every word of the corpus.
    """
    split = F.regexp_extract_all(F.col("t"), F.lit(JAVA_PATTERN), F.lit(0))
    rows = docs.select(F.col(ident), F.coalesce(F.col(text), F.lit("")).alias("t"))
    at = rows.select(ident, F.posexplode(split).alias("pos", "word"))
    table = encode_words(at.select("word").distinct(), path=path)
    found = at.join(table, "word").groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("w"))
    ids = F.flatten(F.transform("w", lambda x: x["ids"]))
    return rows.join(found, ident, "left").select(ident, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the words that the tokenizer's pattern finds, and how often."""
    split = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(JAVA_PATTERN), F.lit(0))
    return docs.select(F.explode(split).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary_size(spark: SparkSession, path: str | None = None) -> int:
    return len(_ranks(read_ranks(path)))
