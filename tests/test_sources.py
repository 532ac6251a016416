import struct

import pytest

from sessionloom.sources import datasource, decode, files


def record(payload=b"pay", topic="orders", version=3, partition=0, key=""):
    return decode.wal_record(1_700_000_000_123_456_789, topic, key, partition, payload, version)


def test_crc32c_golden():
    assert decode.crc32c(b"123456789") == 0xE3069283


def test_versions_and_order():
    data = record(b"1") + record(b"2", version=2, partition=2) + record(b"legacy", "legacy-topic", 1)
    assert [(r[0], r[2], r[4], r[5]) for r in decode.read_wal(data)] == [(3, "orders", 0, b"1"), (2, "orders", 2, b"2"), (1, "legacy-topic", -1, b"legacy")]


@pytest.mark.parametrize("cut", range(1, 30))
def test_cut_tail(cut):
    data = record(b"1") + record(b"2")[: -min(cut, 30)]
    assert [r[5] for r in decode.read_wal(data)] == [b"1"]
    with pytest.raises(decode.Truncated):
        list(decode.read_wal(data, partial_tail=False))


def test_corruption():
    bad = bytearray(record(b"payload"))
    bad[2 + 22 + 6] ^= 1
    with pytest.raises(decode.CorruptRecord):
        list(decode.read_wal(bytes(bad)))
    huge = bytearray(record(b"payload"))
    huge[20:24] = b"\xff" * 4
    with pytest.raises(decode.CorruptRecord):
        list(decode.read_wal(bytes(huge)))


def test_codecs():
    assert decode.read_batch(decode.batch([b"a", b"", b"ccc"])) == [b"a", b"", b"ccc"]
    with pytest.raises(decode.CorruptRecord):
        decode.read_batch(decode.batch([b"a"]) + b"x")
    assert decode.read_fetch_request(decode.fetch_request(7, 9)) == (7, 9)
    assert decode.read_batch_ack(decode.batch_ack(1, 3, 3)) == (1, 3, 3)
    assert decode.read_keyed_payload(decode.keyed_payload("k", b"v")) == ("k", b"v")
    assert decode.read_fetch_response(decode.fetch_response([(5, b"x"), (6, b"")])) == [(5, b"x"), (6, b"")]
    assert list(decode.read_frames(decode.frame(1, "t", b"p") + decode.frame(4, "u", b""))) == [(1, "t", b"p"), (4, "u", b"")]
    with pytest.raises(decode.CorruptRecord):
        list(decode.read_frames(struct.pack(">HBBI", 1, 1, 0, 0)))


def test_wal_tables(spark, tmp_path):
    (tmp_path / "a.wal").write_bytes(b"".join(record(bytes([k]), partition=-1, key="user-42" if k % 2 else "") for k in range(10)))
    df = files.wal(spark, str(tmp_path))
    assert df.count() == 10 and files.wal(spark, str(tmp_path / "none")).count() == 0
    log = files.rebuilt_log(df, 8)
    assert sorted((r.partition, r.offset, r.payload[0]) for r in log.collect()) == [(0, k, 2 * k) for k in range(5)] + [(3, k, 2 * k + 1) for k in range(5)]
    datasource.register(spark)
    via = spark.read.format("wal").load(str(tmp_path))
    assert [(r.seq, bytes(r.payload)) for r in via.orderBy("seq").collect()] == [(k, bytes([k])) for k in range(10)]
    assert via.where("topic = 'none'").count() == 0
    files.write_wal(df, str(tmp_path / "out"))
    assert files.wal(spark, str(tmp_path / "out")).count() == 10


def test_shard_catch_up_and_stream(spark, tmp_path):
    path = tmp_path / "shard-7.wal"
    path.write_bytes(b"".join(decode.shard_record(x) for x in (b"a", b"b", b"c", b"d", b"e")) + b"\0\0")
    assert [(r.shard_id, r.offset, bytes(r.payload)) for r in files.shard_wal(spark, str(tmp_path), 2).orderBy("offset").collect()] == [(7, 2, b"c"), (7, 3, b"d"), (7, 4, b"e")]
    datasource.register(spark)
    q = spark.readStream.format("shardwal").load(str(tmp_path)).writeStream.format("memory").queryName("shard_rows").start()
    q.processAllAvailable()
    path.write_bytes(b"".join(decode.shard_record(x) for x in (b"a", b"b", b"c", b"d", b"e", b"f")))
    q.processAllAvailable()
    q.stop()
    assert [r.offset for r in spark.sql("select offset from shard_rows order by offset").collect()] == [0, 1, 2, 3, 4, 5]


def test_offsets_and_snapshot(spark, tmp_path):
    (tmp_path / "offsets.json").write_text('{"events::worker::p0":42,"events::worker::p1":100}')
    assert sorted(map(tuple, files.group_offsets(spark, str(tmp_path / "offsets.json")).collect())) == [("events", "worker", 0, 42), ("events", "worker", 1, 100)]
    (tmp_path / "v1.json").write_text('{"members":{"n1":"a:1"},"shard_leaders":{"7":"n1"}}')
    members, leaders, count = files.cluster_snapshot(spark, str(tmp_path / "v1.json"))
    assert (list(map(tuple, members.collect())), list(map(tuple, leaders.collect())), count.first()[0]) == ([("n1", "a:1", None)], [(7, "n1")], 0)
    (tmp_path / "v2.json").write_text('{"version":2,"members":{"n1":{"addr":"a:1","client_addr":"c:1"}},"shard_leaders":{},"shard_count":32}')
    members, leaders, count = files.cluster_snapshot(spark, str(tmp_path / "v2.json"))
    assert (list(map(tuple, members.collect())), leaders.count(), count.first()[0]) == ([("n1", "a:1", "c:1")], 0, 32)


def test_checksum_of_any_length():
    import random

    rng = random.Random(3)
    for n in (0, 1, 9, 63, 64, 65, 1023, 1024, 1027, 1088, 5000):
        data, plain = rng.randbytes(n), 0xFFFFFFFF
        for byte in data:
            plain ^= byte
            for _ in range(8):
                plain = plain >> 1 ^ (decode.CASTAGNOLI if plain & 1 else 0)
        assert decode.crc32c(data) == plain ^ 0xFFFFFFFF
    assert decode.crc32c(b"123456789") == 0xE3069283
