"""A gzip stream that inflates to far more than it holds is read in bounded steps."""

from __future__ import annotations

import gzip
import io
import tracemalloc

import pytest

from verspan.llm import warc


def record(body: bytes) -> bytes:
    return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_bounded_inflation():
    one = record(b"\0" * 1_000_000)
    whole = gzip.compress(one * 60)
    assert len(whole) < 100_000
    tracemalloc.start()
    n = sum(len(r) == len(one) for r in warc.records_of(io.BytesIO(whole)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60 and peak < 20 * warc.STEP + 8 * len(one)


def test_members_of_any_cut():
    parts = [record(b"a" * k) for k in (0, 1, 70_000, 5)]
    for stream in (gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts)), gzip.compress(parts[0] + parts[1]) + gzip.compress(parts[2] + parts[3])):
        assert list(warc.records_of(io.BytesIO(stream))) == parts
        with pytest.raises(ValueError):
            list(warc.records_of(io.BytesIO(stream[:-12])))
    assert list(warc.records_of(io.BytesIO(b""))) == []
