import random

from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import codec

# Hashes of texts.
HASHES = {
    "": 0xBC9F1D34,
    "g": 0xD04A8BDA,
    "go": 0x3E0B0745,
    "gop": 0x0C326610,
    "goph": 0x8C9D6390,
    "gophe": 0x9BFD4B0A,
    "gopher": 0xA78EDC7C,
    "I had a dream it would end this way.": 0xE14A9DB9,
}


def test_bloom_hash_of_known_texts(spark):
    df = spark.createDataFrame([(t.encode(),) for t in HASHES], "k binary")
    got = {bytes(k).decode(): h for k, h in df.select("k", codec.bloom_hash(F.col("k"))).collect()}
    assert got == HASHES


def test_crc32c(spark):
    texts = [b"123456789", b"", None, b"a" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "k binary")
    got = [r[0] for r in df.coalesce(1).select(codec.crc32c("k")).collect()]
    assert got[0] == 0xE3069283 and got[1] == 0 and got[2] is None
    assert codec.crc32c_of([b"123456789", b"x", b""]).tolist()[0] == 0xE3069283


def test_internal_keys_sort_newest_first_and_come_apart(spark):
    data = [(b"a", 0), (b"a", 5), (b"ab", (1 << 63) - 1), (b"", 7), (None, 1)]
    df = spark.createDataFrame(data, "k binary, v long").withColumn("i", codec.key_with_version(F.col("k"), F.col("v")))
    got = df.select("k", "v", codec.user_key(F.col("i")).alias("k2"), codec.version_of(F.col("i")).alias("v2"), "i").collect()
    for r in got:
        assert (r.k is None and r.i is None) or (r.k == r.k2 and r.v == r.v2 and bytes(r.i)[-8:] == (2**64 - 1 - r.v).to_bytes(8, "big"))
    short = spark.createDataFrame([(b"abc",)], "k binary").select(codec.user_key(F.col("k")), codec.version_of(F.col("k"))).first()
    assert bytes(short[0]) == b"" and short[1] == 0


def test_varints_and_stored_values(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, (1 << 63) - 1, 1_750_000_000]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = df.select("n", codec.varint_bytes(F.col("n")).alias("s"), codec.varint(F.col("n")).alias("b"), codec.unstored_value(codec.stored_value(F.lit(65), F.lit(3), F.col("n"), F.lit(b"xy"))).alias("v")).collect()
    for r in got:
        want, n = bytearray(), r.n
        while n >= 128:
            want.append(n & 127 | 128)
            n >>= 7
        want.append(n)
        assert bytes(r.b) == bytes(want) and r.s == len(want)
        assert (r.v.meta, r.v.user_meta, r.v.expires_at, bytes(r.v.value)) == (65, 3, r.n, b"xy")


def test_prefixes(spark):
    rnd = random.Random(1)
    pairs = [(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(6))), bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(6)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a binary, b binary").select("a", "b", codec.common_prefix(F.col("a"), F.col("b")).alias("n"), codec.overlap(F.col("a"), F.col("b")).alias("o"))
    for r in df.collect():
        a, b = bytes(r.a), bytes(r.b)
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert r.n == n and r.o == (n if n < min(len(a), len(b)) else 0)
    back = df.select("a", codec.restored_key(F.col("b"), F.col("o"), F.substr("a", F.col("o") + 1, F.octet_length("a"))).alias("k"))
    assert all(bytes(r.a) == bytes(r.k) for r in back.collect())


def test_file_names(spark):
    df = spark.createDataFrame([("/x/00007.sst",), ("12.sst",), ("a.sst",), ("00000.sst",), ("7.mem",)], "p string")
    assert rows(df.select(codec.file_id(F.col("p"), ".sst"))) == rows(spark.createDataFrame([(7,), (12,), (None,), (None,), (None,)], "x long"))
    assert df.limit(1).select(codec.file_name(F.lit(7), ".sst")).first()[0] == "00007.sst"


def test_filter_shape(spark):
    row = spark.range(1).select(codec.bloom_bits_per_key(F.lit(1000), 0.01).alias("b")).select("b", codec.bloom_probes(F.col("b")), codec.bloom_size(F.lit(3), F.col("b"))).first()
    assert tuple(row) == (7, 4, 64)


def test_too_long_message(spark):
    text = spark.range(1).select(codec.too_long("Key", F.lit(b"k" * 2000), 1500)).first()[0]
    assert text.startswith("Key with size 2000 exceeded 1500 limit. Key:\nkkk") and len(text) == len("Key with size 2000 exceeded 1500 limit. Key:\n") + 1024
    odd = spark.range(1).select(codec.too_long("Value", F.lit(b"\xff" * 40), 30)).first()[0]
    assert odd == "Value with size 40 exceeded 30 limit. Value:\n(convert bytes to string failed)"


def test_checksums_of_long_and_short_strings():
    import random

    rnd = random.Random(4)
    values = [b"", None, b"123456789", *(rnd.randbytes(n) for n in (1, 63, 64, 65, 127, 128, 129, 1000, 4096)), *(rnd.randbytes(rnd.randrange(300)) for _ in range(50))]

    def plain(data):
        crc = 0xFFFFFFFF
        for b in data or b"":
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert codec.crc32c_of(values).tolist() == [plain(v) for v in values] and plain(b"123456789") == 0xE3069283
    assert codec.crc32c_of([]).tolist() == []
