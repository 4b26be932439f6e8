"""Which charset a text is in: marks, zero bytes, UTF-8, scores, and wide units that nothing else explains."""

from __future__ import annotations

import pytest

from lectern.sources import books

PROSE = "他们说的是一样的话，正文的内容在这里。林动手中的石符，忽然有了一点光。\n" * 20
MIXED = "Chapter 12: the 第一章 begins here, and most of it is English prose that goes on.\n" * 20


@pytest.mark.parametrize("charset", ["utf-8", "gb18030", "big5", "utf-16-le", "utf-16-be"])
def test_prose(charset):
    text = PROSE.replace("们", "門").replace("说", "說").replace("样", "樣").replace("话", "話").replace("这", "這").replace("里", "裡").replace("内", "內").replace("动", "動").replace("点", "點") if charset == "big5" else PROSE
    assert books.detect(text.encode(charset)) == (charset, 0)


@pytest.mark.parametrize("charset", ["utf-8", "gb18030", "utf-16-le", "utf-16-be"])
def test_mostly_english(charset):
    assert books.detect(MIXED.encode(charset)) == (charset, 0)


def test_short_and_broken():
    assert books.detect(b"") == ("utf-8", 0) and books.detect(b"abc\n") == ("utf-8", 0)
    assert books.detect(b"\xff\xfea\x00") == ("utf-16-le", 2) and books.detect(b"\xef\xbb\xbfabc") == ("utf-8", 3)
    assert books.detect(bytes(range(128, 256)) * 30)[0] in ("gb18030", "big5", "utf-16-le", "utf-16-be")
    assert books.detect("第一章 石符".encode("gb18030")) == ("gb18030", 0)


def test_scores():
    score = books.plausibility("的\n的".encode("gb18030"), "gb18030")
    assert score == ((37 + 6 + 37) / 3, 0) and books.plausibility(b"\x80", "utf-8") == (-120.0, -1) and books.plausibility(b"", "utf-8")[0] == float("-inf")
