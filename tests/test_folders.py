"""A folder that changes between runs: the index is that of a fresh one each time."""

from __future__ import annotations

import os

from lectern.operators import index as I
from lectern.streaming import folders


def _book(words: str) -> str:
    return "".join(f"第{n}章 标题\n{words}，正文的内容在这里。\n" for n in "一二三四")


def test_add_change_delete(spark, tmp_path):
    folder, path = tmp_path / "books", str(tmp_path / "index")
    (folder / "sub").mkdir(parents=True)
    found = lambda at, q: sorted((r.book_id, r.chapter_index) for r in I.candidates(spark, at, q).collect())

    def check(step: tuple, *queries: str, fresh: str = "") -> None:
        done = folders.sync(spark, str(folder), path)
        assert (done.indexed, done.dropped, done.unchanged) == step
        if fresh:
            folders.sync(spark, str(folder), fresh)
        for q in queries if fresh else ():
            assert found(path, q) == found(fresh, q)

    for name, words in (("a.txt", "石符"), ("sub/b.txt", "云岚宗"), ("c.txt", "石符在此")):
        (folder / name).write_bytes(_book(words).encode("gb18030"))
    check((3, 0, 0))
    assert len(found(path, "石符")) == 8 and len({b for b, _ in found(path, "云岚宗")}) == 1
    commits_made = len(os.listdir(f"{path}/log"))
    check((0, 0, 3))
    assert len(os.listdir(f"{path}/log")) == commits_made
    (folder / "a.txt").write_bytes(_book("药老来了").encode("gb18030"))
    (folder / "sub/b.txt").unlink()
    (folder / "d.txt").write_text(_book("石符"))
    check((2, 1, 1), "石符", "云岚宗", "药老", fresh=str(tmp_path / "fresh"))
    assert len(found(path, "石符")) == 8 and found(path, "云岚宗") == [] and len(found(path, "药老")) == 4
