"""The pipeline's SimHash stage links what the SimHash query links, and near copies besides."""

from __future__ import annotations

from lectern.llm import simhash_dedup as S

DOCS = "doc_id long, text string"


def test_stage_links_fingerprints_and_near_copies(spark):
    line = "one two three four five six seven eight nine ten eleven "
    ends = [" ".join(f"{name}{i}" for i in range(20)) for name in "abc"]
    long = [f"word{i}" for i in range(200)]
    near = " ".join([*long[:100], "other", *long[101:]])
    # the first two share few of their different shingles, but most of all they have; 4 is a near copy of 3 by shingles only
    docs = [(1, line * 100 + ends[0]), (2, line * 100 + ends[1]), (3, " ".join(long)), (4, near), (5, ends[2]), (6, None), (7, "")]
    table = spark.createDataFrame(docs, DOCS)
    prints = {r.doc_id: r.fp for r in S.fingerprints(table).collect()}
    assert (prints[1] ^ prints[2]).bit_count() <= S.RADIUS
    assert sorted(r.doc_id for r in S.stage(spark, table, "").collect()) == [1, 3, 5, 6]


def test_groups_are_joined_over_both_kinds_of_links(spark):
    """b is linked to a by its fingerprint, c to b by its shingles: one group."""
    line = "one two three four five six seven eight nine ten eleven "
    tail = [f"t{i}" for i in range(200)]
    a, b, c = line * 1000 + "only a", line * 1000 + " ".join(tail), line + " ".join(tail)
    table = spark.createDataFrame([(3, a), (2, b), (1, c), (4, "another text that is like none of them")], DOCS)
    prints = {r.doc_id: r.fp for r in S.fingerprints(table).collect()}
    far = lambda x, y: (prints[x] ^ prints[y]).bit_count()
    assert far(3, 2) <= S.RADIUS < min(far(3, 1), far(2, 1))
    assert sorted(r.doc_id for r in S.stage(spark, table, "").collect()) == [1, 4]
