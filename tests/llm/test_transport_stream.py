import hashlib
import random

from gradeloom.llm import transport_stream as ts
from helpers import awkward, table


def test_round_trip_of_many_lengths():
    rng = random.Random(3)
    for n in [0, 1, 191, 192, 193, 384, 11520, 11521, 50000, 200000]:
        payload = ts.payload_of(rng.randbytes(n))
        media = ts.mux(payload)
        assert len(media) % 188 == 0
        stream = ts.demux(media)[ts.STREAM_PID]
        assert stream.data == payload and stream.continuity_errors == 0
        assert stream.times == [i * 60 * 2160 for i in range(len(stream.packets))]
        assert stream.random_access == list(range(0, len(stream.packets), 8))


def test_reader_finds_the_grid_and_counts_gaps():
    payload = ts.payload_of(bytes(range(256)) * 300)
    media = ts.mux(payload)
    assert ts.demux(b"noise" + media)[ts.STREAM_PID].data == payload
    lost = media[: 188 * 10] + media[188 * 11 :]
    stream = ts.demux(lost)[ts.STREAM_PID]
    assert stream.continuity_errors == 1 and stream.data != payload
    twice = media[: 188 * 11] + media[188 * 10 :]
    again = ts.demux(twice)[ts.STREAM_PID]
    assert again.data == payload and again.continuity_errors == 0
    assert ts.demux(b"") == {} and ts.demux(b"short") == {}
    broken = bytearray(media)
    broken[188 + 10] ^= 1  # the program map's checksum fails, so no stream is announced
    assert ts.demux(bytes(broken)) == {}


def test_table(spark):
    rows = awkward()
    got = ts.media_table(table(spark, rows)).collect()
    want = sorted((r[0] if r[0] is not None else -1, len(raw), hashlib.sha256(ts.payload_of(raw)).hexdigest()) for r in rows for raw in [(r[1] or "").encode()])
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.n_bytes, g.payload_sha256) for g in got) == want
    by_payload = {}
    for g in got:
        assert g.payload_bytes % 192 == 0 and g.payload_bytes > 0 and g.continuity_errors == 0
        assert by_payload.setdefault((g.n_bytes, g.payload_sha256), (g.media_sha256, g.feature)) == (g.media_sha256, g.feature)
    assert ts.media_table(table(spark, [])).count() == 0
