import struct

import pytest
from conftest import rows

from tidemark.functions.codec import crc32c_of
from tidemark.operators import manifest
from tidemark.sources import binary


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def checksum(data):
    return field(2, int(crc32c_of([data])[0]))


def block(entries):
    out, starts, base = b"", [], entries[0][0]
    for key, value in entries:
        shared = 0 if key is base else next((i for i in range(min(len(key), len(base))) if key[i] != base[i]), 0)
        starts.append(len(out))
        out += struct.pack("<HH", shared, len(key) - shared) + key[shared:] + value
    out += b"".join(struct.pack(">I", s) for s in starts) + struct.pack(">I", len(starts))
    return out + checksum(out) + struct.pack(">I", len(checksum(out)))


def flat(blocks, bloom, max_version, key_count):
    """An index: root offset, two shapes, the root table, then what it points to."""
    shape = struct.pack("<9H", 18, 40, 4, 8, 12, 20, 0, 24, 0)
    part = struct.pack("<5H", 10, 16, 4, 8, 12)
    head = struct.pack("<I", 4 + len(shape) + len(part)) + shape + part
    root = len(head)
    tail, at = b"", root + 40
    vector = at
    at += 4 + 4 * len(blocks)
    offsets, tables = b"", b""
    for i, (key, offset, length) in enumerate(blocks):
        place = at + len(tables)
        offsets += struct.pack("<I", place - (vector + 4 + 4 * i))
        tables += struct.pack("<iIII", place - (4 + len(shape)), 12, offset, length) + struct.pack("<I", len(key)) + key
    filter_at = at + len(tables)
    tail = struct.pack("<I", len(blocks)) + offsets + tables + struct.pack("<I", len(bloom)) + bloom
    table = struct.pack("<iIIQII", root - 4, vector - (root + 4), filter_at - (root + 8), max_version, key_count, 77) + bytes(40 - 28)
    return head + table + tail


def internal(key, version):
    return key + (2**64 - 1 - version).to_bytes(8, "big")


def stored(value, meta=0, user_meta=0, expires_at=0):
    return bytes([meta, user_meta]) + varint(expires_at) + value


@pytest.fixture
def folder(tmp_path):
    entries = [(internal(b"key%03d" % i, i + 1), stored(b"v%d" % i, i % 2, 7, i * 1000)) for i in range(50)]
    blocks, data = [], b""
    for part in (entries[:20], entries[20:45], entries[45:]):
        b = block(part)
        blocks.append((part[0][0], len(data), len(b)))
        data += b
    index = flat(blocks, b"\x01\x02\x04", 50, 50)
    (tmp_path / "00007.sst").write_bytes(data + index + struct.pack(">I", len(index)) + checksum(index) + struct.pack(">I", len(checksum(index))))
    return tmp_path


def test_tables(spark, folder):
    got = rows(binary.read_tables(spark, str(folder), verify_blocks=True))
    assert got == sorted(((7, 0 if i < 20 else 1 if i < 45 else 2, b"key%03d" % i, i + 1, i % 2, 7, i * 1000, b"v%d" % i) for i in range(50)), key=repr)
    index = rows(binary.read_indexes(spark, str(folder)))
    assert [(r[1], r[2][:-8]) for r in index] == [(0, b"key000"), (1, b"key020"), (2, b"key045")] and index[0][5:] == (50, 50, 77, b"\x01\x02\x04")


def test_broken_tables(folder):
    good = (folder / "00007.sst").read_bytes()
    spoilt = good[:10] + bytes([good[10] ^ 1]) + good[11:]
    assert len(list(binary.table_rows(spoilt, verify=False))) == 50
    with pytest.raises(binary.Broken, match="block"):
        list(binary.table_rows(spoilt))
    for bad in (b"", b"1234567", good[:-9] + good[-8:], good[:-60] + b"!" + good[-59:]):
        with pytest.raises(binary.Broken):
            binary.table_index(bad)


def manifest_file(sets, magic=b"Test", version=8, external=0):
    out = magic + struct.pack(">HH", external, version)
    for changes in sets:
        body = b"".join(field(1, b"".join(field(n, v) for n, v in c)) for c in changes)
        out += struct.pack(">II", len(body), int(crc32c_of([body])[0])) + body
    return out


SETS = [[[(1, 5), (3, 2), (6, 1)], [(1, 6), (2, 0)]], [[(1, 5), (2, 1)]], [[(1, 300), (3, 1), (4, 9)]]]


def test_manifests(spark, tmp_path):
    (tmp_path / "MANIFEST").write_bytes(manifest_file(SETS) + b"\x00\x00")
    got = binary.read_manifest(spark, str(tmp_path), b"Test", 8)
    assert rows(got) == [(0, 0, "CREATE", 5, 2, 0, 1), (0, 1, "CREATE", 6, 0, 0, 0), (1, 0, "DELETE", 5, 0, 0, 0), (2, 0, "CREATE", 300, 1, 9, 0)]
    log = got.selectExpr("change_set * 1000 + number as seq", "op", "table_id", "level", "key_id")
    assert [r[0] for r in rows(manifest.state(log))] == [300, 6]
    good = manifest_file(SETS)
    longer = good[:8] + struct.pack(">I", len(good) + 1) + good[12:]
    for bad, why in ((longer, "bytes in a file"), (b"x" + good[1:], "magic"), (manifest_file(SETS, version=7), "version"), (manifest_file(SETS, external=3), "external"), (good[:20] + b"!" + good[21:], "checksum")):
        with pytest.raises(binary.Broken, match=why):
            list(binary.change_sets(bad, b"Test", 8))
    assert len(list(binary.change_sets(good[:-1], b"Test", 8))) == 3


def test_discards(spark, tmp_path):
    (tmp_path / "DISCARD").write_bytes(struct.pack(">QQQQQQ", 1, 100, 2, 0, 0, 0) + bytes(100))
    assert rows(binary.read_discards(spark, str(tmp_path))) == [(1, 100), (2, 0)]


def test_block_checksums_are_of_whole_blocks(spark, tmp_path):
    from tidemark.operators import greedy
    from tidemark.plans import store

    log = [(b"key%04d" % (i // 2), 100 - i, b"value%d" % i, i % 3, i % 5, i * 70, 1, 20 + 10 * i, i, 7 + i // 250 if i % 50 else None) for i in range(400)]

    def sums(writes, name):
        folder = tmp_path / name
        schema = "user_key binary, version long, value binary, meta int, user_meta int, expires_at long, fid long, log_offset long, seq long, table_id long"
        spark.createDataFrame(writes, schema).repartition(3).write.parquet(str(folder / "entry_log.parquet"))
        return rows(store.block_checksums(spark, str(folder)))

    log = [(k, 1000 + v, *r) for k, v, *r in log]
    want, held = [], {}
    for table in (7, 8):
        entries = sorted((k, -v, internal(k, v), stored(x, m, u, e)) for k, v, x, m, u, e, _, _, _, t in log if t == table)
        cuts, end, n, base = [[]], 0, 0, b""
        for _, _, key, value in entries:
            if n and end + 6 + len(key) + len(value) + (n + 1) * 4 + 16 > 4096:
                cuts.append([])
                end, n = 0, 0
            base = base if n else key
            shared = next((i for i in range(min(len(key), len(base))) if key[i] != base[i]), 0) if n else 0
            cuts[-1].append((key, value))
            end, n = end + 4 + len(key) - shared + len(value), n + 1
        for number, part in enumerate(cuts):
            whole = block(part)
            data = whole[: len(whole) - 4 - int.from_bytes(whole[-4:], "big")]
            held[table, number] = data, part
            want.append((table, number, len(data), int(crc32c_of([data])[0])))
    assert len(want) > 3 and sums(log, "log") == sorted(want, key=repr)
    for at, value in ((2, b"Value9"), (3, 2), (4, 1), (5, 631)):
        other = [(*r[:at], value, *r[at + 1 :]) if r[8] == 9 else r for r in log]
        assert other != log and len([a for a, b in zip(sums(other, f"other{at}"), sorted(want, key=repr)) if a != b]) == 1
    df = spark.createDataFrame([(t, i, k, v) for (t, _), (_, part) in held.items() for i, (k, v) in enumerate(part)], "t long, i long, key binary, stored binary")
    laid = greedy.laid_out(df.where("t = 7"), "t", ["key"], "key", "stored").orderBy("block").collect()
    for r in laid:
        data, part = held[7, r.block]
        assert bytes(r.data) == data and list(binary.block_entries(data + checksum(data) + struct.pack(">I", len(checksum(data))))) == part
    assert greedy.laid_out(df.limit(0), "t", ["key"], "key", "stored").count() == 0


ENTRY = "table_id long, user_key binary, version long, seq long, value binary, meta int, user_meta int, expires_at long"


def test_written_tables(spark, tmp_path):
    """Ten thousand keys in one table, another with one, rows of none; the index by a reader of its own."""
    from tidemark.operators import checksums
    from tidemark.sources import writing

    data = [(3, b"%016x" % i, i + 1, i, b"%d" % i, 0x40, 7, 0) for i in range(10_000)] + [(4, b"one", 5, 1, b"", 1, 0, 1 << 40), (None, b"none", 1, 2, b"", 0, 0, 0)]
    log = spark.createDataFrame(data, ENTRY).repartition(7)
    assert writing.write_files(writing.table_files(log), str(tmp_path), "{:05d}.sst") == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["00003.sst", "00004.sst"]
    got = rows(binary.read_tables(spark, str(tmp_path), verify_blocks=True).drop("block"))
    assert got == sorted(((t, k, v, m, u, e, x) for t, k, v, _, x, m, u, e in data if t), key=repr)
    index = binary.table_index((tmp_path / "00003.sst").read_bytes())
    blocks = index["blocks"]
    assert index["max_version"] == 10_000 and index["key_count"] == 10_000 and len(blocks) > 50
    assert [b[1] for b in blocks] == [sum(x[2] for x in blocks[:i]) for i in range(len(blocks))] and max(b[2] for b in blocks) <= 4096
    probes, bits = index["bloom"][-1], (len(index["bloom"]) - 1) * 8
    assert (probes, bits) == (4, 70_000)
    assert {r.fault for r in binary.verify_tables(spark, str(tmp_path), "both").collect()} == {None}
    spoilt = bytearray((tmp_path / "00003.sst").read_bytes())
    spoilt[blocks[7][1] + 9] ^= 1
    (tmp_path / "00003.sst").write_bytes(spoilt)
    for mode in checksums.MODES:
        assert rows(binary.verify_tables(spark, str(tmp_path), mode)) == ([] if mode == "none" else [(3, "block: wrong checksum"), (4, None)])
    assert writing.write_files(writing.table_files(log.limit(0)), str(tmp_path / "no"), "{}.sst") == 0


def test_written_manifests_and_discards(spark, tmp_path):
    from tidemark.sources import writing

    assert writing.manifest_file([[("CREATE", 5, 2, 0, 1), ("CREATE", 6, 0, 0, 0)], [("DELETE", 5, 0, 0, 0)], [("CREATE", 300, 1, 9, 0)]], b"Test", 8) == manifest_file(
        [[[(1, 5), (3, 2), (6, 1)], [(1, 6)]], [[(1, 5), (2, 1)]], [[(1, 300), (3, 1), (4, 9)]]]
    )
    stats = spark.createDataFrame([(9, 5), (2, 1 << 40), (3, 0)], "fid long, discarded long")
    writing.write_files(writing.discard_files(stats, 100), str(tmp_path), "DISCARD")
    assert (tmp_path / "DISCARD").stat().st_size == 1600 and rows(binary.read_discards(spark, str(tmp_path))) == [(2, 1 << 40), (3, 0), (9, 5)]


def test_written_logs(spark, tmp_path):
    from tidemark.sources import files, writing

    frames = [(2, 60, b"b", 7, b"x" * 300, 64, 0, 5), (2, 20, b"a", 9, b"", 0, 1, 0), (9, 20, b"k", 1 << 62, b"v", 128, 0, 1 << 50)]
    df = spark.createDataFrame(frames, "fid long, offset long, user_key binary, version long, value binary, meta int, user_meta int, expires_at long")
    assert writing.write_files(writing.log_files(df), f"file://{tmp_path}", "{:05d}.mem") == 2
    got = files.read_log_files(spark, str(tmp_path)).drop("path", "len")
    first = 2 + 1 + 1 + 1 + 9 + 4 + 20
    assert rows(got) == sorted([(2, 20, b"a", 9, b"", 0, 1, 0), (2, first, b"b", 7, b"x" * 300, 64, 0, 5), (9, 20, b"k", 1 << 62, b"v", 128, 0, 1 << 50)], key=repr)
    whole = (tmp_path / "00002.mem").read_bytes()
    assert len(list(files.decoded(whole[:-1]))) == 1 and list(files.decoded(b"")) == []


def test_kv_messages(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import messages

    schema = "key binary, value binary, user_meta binary, version long, expires_at long, meta binary, stream_id long, stream_done boolean, seq long"
    data = [(b"k", b"v" * 200, b"u", 300, 1 << 40, b"\x41", 7, True, 1), (None,) * 8 + (2,), (b"", b"", b"", 0, 0, b"", 0, False, 3)]
    df = spark.createDataFrame(data, schema).withColumn("m", messages.kv())
    got = rows(messages.read_kv(df.select("seq", "m", "key"), "m"))
    nothing = (b"", b"", b"", b"", 0, 0, 0, False)
    assert got == sorted([(1, b"k", b"v" * 200, b"u", b"\x41", 300, 1 << 40, 7, True), (2, *nothing), (3, *nothing)], key=repr)
    wire = {r.seq: bytes(r.m) for r in df.collect()}
    assert wire[1] == field(1, b"k") + field(2, b"v" * 200) + field(3, b"u") + field(4, 300) + field(5, 1 << 40) + field(6, b"\x41") + field(10, 7) + field(11, 1) and wire[2] == b""
    lists = df.groupBy().agg(messages.kv_list(F.array_sort(F.collect_list("m"))).alias("l"))
    assert messages.read_kv(lists, "l", listed=True).count() == 3 and messages.read_kv(df.limit(0), "m").count() == 0


def test_matching_keys(spark):
    from tidemark.streaming import feed

    df = spark.createDataFrame([(b"abcdef",), (b"abXdef",), (b"aXcdef",), (b"abc",), (None,), (b"",)], "user_key binary")
    assert feed.ignored_places("1, 2-3, 9") == {1, 2, 3, 9} and feed.ignored_places("") == set()
    assert rows(feed.matching(df, [(b"ab?d", "2")])) == [(b"abXdef",), (b"abcdef",)]
    assert rows(feed.matching(df, [(b"zzz", "0-2")])) == [(b"aXcdef",), (b"abXdef",), (b"abc",), (b"abcdef",)]
    assert rows(feed.matching(df, [])) == []
