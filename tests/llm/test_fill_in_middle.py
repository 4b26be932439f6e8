"""Cuts and forms against a plain loop, exact round trips over frames of a few characters, and what is decompressed."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import pytest

from lectern.llm import fill_in_middle as M


def expected(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    spm = h4 % 100 < spm
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def _rows():
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("ab <>PSM林é😀\t\r") for _ in range(rng.randrange(40)))
    texts = ["\n".join(line() for _ in range(rng.randrange(30))) for _ in range(150)]
    texts += [None, "", "\n", "\n\n\n", "one line", "one line\n", "with <M> inside\nand more", "ends in <", "<S\n>P<", "x" * 5000, "\n" * 300, "long\n" * 900]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[0]), (3, "other\nlines")]


@pytest.mark.parametrize("frame_chars", [1, 7, 64, M.FRAME_CHARS])
def test_plain_loop(spark, frame_chars):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, form long, _row string")
    out = M.with_texts(M.with_digests(M.transformed(M.framed(docs, frame_chars=frame_chars), frame_chars))).collect()
    assert len(out) == len(rows)
    for r in out:
        doc_id, text = rows[r._row.form]
        n, form, prefix, middle, output = expected(doc_id, text)
        assert (r._row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_text, r.restored_text) == (doc_id, n, form, prefix, middle, output, text or "")
        assert (r.output_sha256, r.restored_sha256) == (sha256(output.encode()).hexdigest(), sha256((text or "").encode()).hexdigest())
        assert all(len(M.Reader(r.output).text(i)) <= frame_chars for i in range(len(r.output)))


def test_rates(spark):
    docs = spark.createDataFrame([(i, f"a\nb {i}\nc") for i in range(300)], "doc_id long, text string")
    for rate, spm in ((0, 50), (40, 0), (100, 100)):
        forms = {r._row.doc_id: r.form for r in M.transformed(M.framed(docs, rate=rate, spm_rate=spm)).collect()}
        assert forms == {i: expected(i, f"a\nb {i}\nc", rate, spm)[1] for i in range(300)}


def test_cuts_open_their_frames_only():
    text = "".join(f"line {i}\n" for i in range(5000))
    frames, lines, chars = M.frames_of(text, 500)
    reader = M.Reader(frames)
    for n in (1, 77, 2500, 4999):
        reader.opened = 0
        assert reader.after_lines(n, lines, chars) == len("".join(f"line {i}\n" for i in range(n))) and reader.opened == 1
    reader.opened = 0
    assert (reader.after_lines(0, lines, chars), reader.after_lines(5001, lines, chars), reader.opened) == (0, chars, 0)
    assert "".join(reader.parts(1234, 1300)) == text[1234:1300] and reader.opened <= 2
    assert [f["bytes"] for f in frames] == [len(text[: f["chars"]].encode()) for f in frames]


def test_a_marker_over_frames_is_found():
    for size in (1, 2, 3, 4, 5):
        frames, *_ = M.frames_of("<<S<S>x<M", size)
        assert M.Reader(frames).find("<S>") == 3
        with pytest.raises(ValueError):
            M.Reader(frames).find("<M>")


def test_empty(spark):
    assert M.with_digests(M.transformed(M.framed(spark.createDataFrame([], "doc_id long, text string")))).collect() == []
