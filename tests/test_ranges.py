"""Parts of files: lines of any split are those of the whole file, and little else is read than what is asked for."""

from __future__ import annotations

import io
import random

import pytest

from lectern.operators import chapters as H
from lectern.sources import books, ranges


class Counted(io.BytesIO):
    """A file that knows how many bytes have been read."""

    done = 0

    def read(self, size: int = -1) -> bytes:
        out = super().read(size)
        self.done += len(out)
        return out


def _bodies() -> list[str]:
    rng = random.Random(1)
    some = "".join(rng.choice("字符。ab \n\r") for _ in range(400))
    return ["", "\n", "\r\n\r\n", "one", "a\r\nb\rc\n\nd", "尾行没有换行", some, "长" * 300 + "\r\n短", "\r\r\n\n\r", "上਍ഊ下\nਊ"]


@pytest.mark.parametrize("charset", ["utf-8", "gb18030", "big5", "utf-16-le", "utf-16-be", "utf-32-le"])
def test_any_split_gives_the_same_lines(charset, monkeypatch):
    monkeypatch.setattr(ranges, "STEP", 8)
    for body in _bodies():
        raw = body.encode(charset, "ignore")
        for mark in (0, 4) if charset == "utf-32-le" else (0,):
            content = b"\xff\xfe\0\0"[:mark] + raw
            whole = [(a, b, line) for _, a, b, line in books.lines_of(content, charset, mark)]
            for size in (1, 2, 3, 7, 10, 64, 10**6):
                found = []
                for start in range(0, len(content), size):
                    rows = list(ranges.split_lines(io.BytesIO(content), len(content), charset, mark, start, start + size))
                    assert [n for n, *_ in rows] == list(range(len(rows)))
                    found += [row[1:] for row in rows]
                assert found == whole, (charset, mark, size, body)


def test_broken_bytes_and_ends_in_the_middle_of_a_unit():
    content = "a\nb\r\n字".encode("utf-16-le") + b"x"
    for size in (1, 3, 100):
        found = [r[1:] for start in range(0, len(content), size) for r in ranges.split_lines(io.BytesIO(content), len(content), "utf-16-le", 0, start, start + size)]
        assert found == [(a, b, line) for _, a, b, line in books.lines_of(content, "utf-16-le", 0)]


def test_bytes_read_are_near_those_asked_for():
    line = "正文里的一句话写得长一点，好认出文字来。\n".encode("gb18030")
    content = line * 200_000
    file = Counted(content)
    rows = list(ranges.split_lines(file, len(content), "gb18030", 0, 4_000_000, 4_100_000))
    assert rows and file.done < 100_000 + 2 * ranges.STEP
    file = Counted(content)
    assert len(ranges.chapter_text(file, len(content), "gb18030", 0, 2_000_000 // len(line) * len(line), 2_000_000 // len(line) * len(line) + 10 * len(line)).split("\n")) == 10
    assert file.done == 10 * len(line)


@pytest.mark.parametrize("charset", ["gb18030", "utf-16-le"])
def test_files(spark, tmp_path, charset):
    body = "开头的话，写上三十个字以上的内容，好让这一段自己成为一章，不然就没有了，对不对。\r\n" + "".join(f"第{n}章 标题{n}\r\n正文的内容在这里，他们说的是一样的话。\n" * 3 for n in "一二三四") + "ABC def ghi jkl mno pqr stu vwx yz 0123456789 " * 40
    (tmp_path / "一 本.txt").write_bytes(body.encode(charset))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.TXT.txt").write_text("plain\n" * 100)
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / ".hidden.txt").write_text("x")
    folder = str(tmp_path)
    whole = sorted(map(tuple, books.read_lines(spark, folder).filter("line <> 'x'").collect()))
    for size in (40, 1000, 1 << 20):
        assert sorted(map(tuple, ranges.lines(spark, folder, size).collect())) == whole
    heads = {r.path.rpartition("/")[2]: r.head for r in ranges.heads(spark, folder).collect()}
    assert heads["b.TXT.txt"] == "plain\n" * 100 and heads["empty.txt"] == "" and heads["一 本.txt"].startswith("开头的话") and len(heads) == 3
    chapters = H.split(books.read_lines(spark, folder)).cache()
    table = ranges.chapter_ranges(spark, folder, chapters)
    texts = {(r.book_id, r.chapter_index): r.text for r in books.chapter_texts(books.read_lines(spark, folder), chapters).collect()}
    assert {(r.book_id, r.chapter_index): r.text for r in ranges.chapters(spark, table).collect()} == texts
    book = next(b for b, n in texts if n == 2)
    one = ranges.chapters(spark, table).filter(f"book_id = '{book}' and chapter_index in (1, 2)")
    assert {r.chapter_index: r.text for r in one.collect()} == {n: texts[book, n] for n in (1, 2)}
    assert ranges.heads(spark, folder).filter(f"book_id = '{book}'").count() == 1


def test_filters_leave_other_files_closed(tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text("x\n" * 100)
    reader = ranges._Reader({"read": "lines", "path": str(tmp_path), "split_bytes": "50"})
    wanted = ranges.book_id(f"file:{tmp_path}/b.txt")
    assert list(reader.pushFilters([ranges.EqualTo(("book_id",), wanted), ranges.EqualTo(("line",), "x")])) == [ranges.EqualTo(("line",), "x")]
    assert [(p.path[-5:], p.start, p.stop) for p in reader.partitions()] == [("b.txt", 0, 50), ("b.txt", 50, 100), ("b.txt", 100, 150), ("b.txt", 150, 200)]
