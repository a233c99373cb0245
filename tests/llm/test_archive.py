import pytest
import zstandard as zstd
from wordloom.llm import archive


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, URL2 string")


def test_round_trip_with_revisits(spark):
    big = "ä" * 60
    rows = [(3, "http://a", big, "x"), (1, None, big, None), (2, "u\n v", "short", "x"), (4, "u", "short", "x"),
            (5, "u", None, "x"), (6, "u", "", "x"), (7, "u", "z" * 200_000, "x"), (1, None, big, None),
            (None, "u", big, None), (None, "u", "q" * 300, None)]
    rows += [(100 + i, f"u{i}", f"<p>{i}</p>" * 40, None) for i in range(50)]
    got = archive.round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [r.record_type for r in by[1]] == ["response"] * 2
    assert by[3][0].record_type == "revisit" and by[3][0].refers_to == 1 and by[3][0].block is None
    assert by[2][0].record_type == by[4][0].record_type == "response"
    assert by[5][0].payload_bytes == by[6][0].payload_bytes == 0
    assert by[7][0].block == b"z" * 200_000
    assert sorted(r.record_type for r in by[None]) == ["response", "revisit"]
    for i, _, html, _ in rows:
        text = (html or "").encode()
        assert all(r.payload_bytes == len(text) and (r.block is None or r.block == text)
                   for r in by[i] if i is not None)


def test_empty_table(spark):
    assert archive.round_trip(pages(spark, [])).count() == 0


def frame(data):
    return zstd.ZstdCompressor(write_content_size=True).compress(data)


def record(n="5", block=b"hello", kind="response"):
    return (b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: d\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n"
            % (kind.encode(), n.encode(), block))


def test_reader_takes_plain_archives_and_several_frames():
    got = list(archive.records_of(frame(record()) + frame(record("0", b"")), "f"))
    assert [b for _, b in got] == [b"hello", b""]


def test_dictionary_frame_is_used():
    import struct
    samples = [record("5", b"h%04d" % i) for i in range(2000)]
    d = zstd.train_dictionary(4096, samples)
    for inside in (d.as_bytes(), frame(d.as_bytes())):
        data = struct.pack("<II", archive.DICTIONARY_MAGIC, len(inside)) + inside
        data += zstd.ZstdCompressor(dict_data=d).compress(samples[7])
        assert [b for _, b in archive.records_of(data, "f")] == [b"h0007"]


@pytest.mark.parametrize("data", [
    frame(record("6")), frame(record("4")), frame(b"WARC/1.0\r\n\r\n"), frame(record())[:-3], b"junk-junk-junk",
    frame(record().replace(b"WARC-Date", b"X-Date")), frame(record("x")), frame(record()) + b"abc",
    frame(record()) + (0x184D2A5D).to_bytes(4, "little") + b"\0\0\0\0", (0x184D2A50).to_bytes(4, "little") + b"\xff\0\0\0"])
def test_broken_archives_are_refused(data):
    with pytest.raises(archive.ArchiveError):
        list(archive.records_of(data, "f"))
