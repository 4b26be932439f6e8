"""Images of EPUB books: one file for each content, however often a task runs, and none outside the folder."""

from __future__ import annotations

import zipfile

from lectern.sources import images


def test_extract(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    with zipfile.ZipFile(source / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.xhtml", "<html><body><p>x<img src='i/p 1.png'/></p><img src='../../../etc/passwd'/><img src='i/big.png'/></body></html>")
        z.writestr("O/b.xhtml", "<html><body><img src='I/P%201.png'/><img src='gone.png'/></body></html>")
        z.writestr("O/i/p 1.png", b"\x89PNG small")
        z.writestr("O/i/big.png", b"x" * (9 << 20))
        z.writestr("etc/passwd", b"no secret")
    (source / "bad.epub").write_bytes(b"no archive")
    for _ in range(2):
        rows = sorted((r.chapter_index, r.n, r.resource, r.path and r.path.rpartition("/")[2][17:], r.size) for r in images.extract(spark, str(source), str(target)).collect())
    assert [r[3:] for r in rows if r[2].startswith("O/i/p")] == [("O_i_p_1.png", 10)]
    assert [(r[2], r[3]) for r in rows if r[4] is None] == [("../../etc/passwd", None), ("O/i/big.png", None), ("O/gone.png", None)]
    written = [p for p in target.rglob("*") if p.is_file()]
    # the image that two chapters have in two spellings is two names of one content at most
    assert {p.read_bytes() for p in written} == {b"\x89PNG small"} and len(written) == len({r[3] for r in rows if r[3]})
    assert all(target in p.parents and not p.name.startswith(".") for p in written)
