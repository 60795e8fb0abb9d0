"""Dictionaries of the quality classifier learn from whole texts."""

from millrace.llm.compression_quality import dictionary


def test_late_parts_of_long_texts_are_learnt():
    long = b"a" * 50_000 + b"LATE" * 20_000
    assert b"LATE" * 10 in dictionary([long] + [b"b" * 50_000] * 9, 8192)
    assert long[-100:] in dictionary([long, long], 4096)


def test_unused_shares_go_to_longer_texts():
    short, long = b"s" * 10, bytes(range(256)) * 20
    got = dictionary([short] * 9 + [long], 6000)
    assert long in got and len(got) <= 6000
    assert len(dictionary([b"x" * 9000] * 400)) >= 0.95 * (400 << 10)


def test_edges():
    assert dictionary([]) == b"" and dictionary([b""]) == b""
    assert len(dictionary([b"y" * 100] * 1000, 4096)) == 4096
