"""Byte ranges against lines cut by Python, over odd block and range sizes."""

import random

import pytest

from turnledger.sources import ranges


@pytest.mark.parametrize("seed", range(40))
def test_ranges_tile_what_was_appended(tmp_path, monkeypatch, seed):
    draw = random.Random(seed)
    path = tmp_path / "a b%20+é.log"
    lines = [bytes(draw.choice(b"ab{ \xc3\xa9") for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(0, 20))]
    data = b"".join(line + b"\n" for line in lines) + draw.choice([b"", b"unfinished"])
    path.write_bytes(data)
    begin = draw.choice([0] + [i + 1 for i, c in enumerate(data) if c == 10])
    monkeypatch.setattr(ranges, "BLOCK_BYTES", draw.randint(1, 12))
    step = draw.randint(1, 15)
    found = []
    for first in range(begin, len(data), step):
        last = min(first + step, len(data))
        for texts, sizes in ranges._lines(f"file:{path}", begin, first, last, len(data)):
            found += zip(texts.to_pylist(), sizes.tolist(), strict=True)
    *whole, rest = data[begin:].split(b"\n")
    want = [(x + b"\n").decode("utf-8", "replace") for x in whole] + ([rest.decode()] if rest else [])
    assert [text for text, _ in found] == want
    assert sum(n for _, n in found) == len(data) - begin + bool(rest)


def test_stores(tmp_path):
    assert ranges.open_store("file:/a b/c%20")[1] == "/a b/c%20"
    assert ranges.open_store("file:///a")[1] == "/a"
    assert ranges.can_open(f"file:{tmp_path}/absent") and not ranges.can_open("viewfs://store/a")
    with pytest.raises(ValueError):
        ranges.open_store("relative/path")
