import hashlib
import io

import pytest

from scriptorium.llm import warc as W
from scriptorium.llm.common import table_path


class Sink(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_frames_are_independent_and_the_footer_finds_them(monkeypatch):
    monkeypatch.setattr(W, "FRAME", 1000)
    sink = Sink()
    bundle = W.Bundle(sink)
    spots = [bundle.add(W.make_record(i, f"http://x/{i}\r\nEvil: 1", b"payload %d" % i * (i % 30), None if i % 3 else 0)) for i in range(50)]
    bundle.close()
    table = W.seek_table(sink)
    assert len(table) > 5 and sum(p for _, p, _ in table) < sink.size()
    for i, (frame, offset) in enumerate(spots):
        record, _ = W.parse_record(W.read_frame(sink, table[frame]), offset)
        assert record["page_id"] == i and record["url"] == f"http://x/{i}%0D%0AEvil: 1" and record["payload_bytes"] == len(b"payload %d" % i * (i % 30))
        assert record["refers_to"] == (None if i % 3 else 0) and record["payload"] == (b"payload %d" % i * (i % 30) if i % 3 else None)


def test_the_whole_file_is_plain_zstandard():
    import zstandard

    sink = Sink()
    bundle = W.Bundle(sink)
    records = [W.make_record(i, None, b"p" * i, None) for i in range(5)]
    for r in records:
        bundle.add(r)
    bundle.close()
    sink.seek(0)
    assert zstandard.ZstdDecompressor().stream_reader(sink, read_across_frames=True).read() == b"".join(records)


def test_damage_is_seen():
    record = W.make_record(1, None, b"abc", None)
    with pytest.raises(ValueError):
        W.parse_record(record.replace(b"abc", b"abd"))


def test_round_trip(spark):
    rows = [(1, "u1", "<p>a</p>", "x"), (2, None, "<p>a</p>", "x"), (3, "u3", None, "x"), (4, "u4", "", "x"), (5, "u5", "ü" * 100_000, None), (5, "u5", "ü" * 100_000, None), (None, "n", "<p>a</p>", "x"), (0, "z", "a\r\n\r\nb", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha string").repartition(3)
    index = W.write_archives(spark, pages, table_path(spark, "warc-test")).cache()
    assert index.count() == len(rows)
    got = W.read_archives(index).collect()
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, u, h, _ in rows:
        own = [r for r in got if r["page_id"] == i and r["url"] == u]
        assert own
        for r in own:
            data = (h or "").encode()
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == W.base32_sha1(data)
            refers = None if first[h or ""] == i else first[h or ""]
            assert (r["record_type"], r["refers_to"]) == ("response" if refers is None else "revisit", refers)
            assert r["payload"] is None if refers is not None else bytes(r["payload"]) == data
    for r in index.collect():  # by place, one frame alone
        assert W.read_record(r["archive"], r["frame"], r["offset"])["page_id"] == r["page_id"]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    index = W.write_archives(spark, pages, table_path(spark, "warc-test")).cache()
    assert index.count() == 0 and W.read_archives(index).count() == 0


def test_digest_is_bare_base32():
    assert W.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20


