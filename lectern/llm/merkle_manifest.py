"""Merkle manifest of a dataset: a hash tree over rows, their proofs, and the check of rows against the root.

A row's leaf is the hash of its values, each as `-` if null, else as its UTF-8 byte count, `:` and
the value. Within a group (lang) leaves stand in ascending order of their id; while a group has
more than one node, every FAN consecutive nodes become their hash, and what remains is the group's
subroot. Subroots in bytewise order of their groups, null first, become the root in the same way.
A hash is the lower-case hexadecimal SHA-256 of its inputs one after the other.

Leaves are put in order by one range partitioning, so a leaf's rank in its group is its place in
its partition and what lies before. The digits of the rank, base FAN, name the tree's levels: within
blocks of FAN ** DIGITS leaves the digits are grouped away one after the other, each group's rows
nested into its node as an array of child structs, with one shuffle for all digits of a block.
Roots of blocks are the nodes of the next tier, which is as many times smaller as a block has leaves,
and so on. Siblings on the way down are then handed to children by one nested transform, and one
explode gives the leaves with their proofs. Leaves are not joined: the upper part of a proof comes
to a block as a whole, a row for FAN ** DIGITS leaves.

However large a group is, a task holds blocks of FAN ** DIGITS leaves at a time.

Defined cases: a null id comes first, and counts as the empty text where its decimal form is hashed
(not in its leaf, where it is `-`); rows that repeat an id are ordered by their leaf; equal rows have
equal leaves and a place each; a null group is a group of its own, before the empty one; a group of
one leaf has that leaf as its subroot and no siblings there; no rows give no tree and no rows;
columns that are not named take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import crc32_mod, documents, written

FAN, DIGITS = 8, 4
BLOCK = FAN**DIGITS
#: The values of a document's leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The query tampers with rows whose crc32 of the decimal id is divisible by this.
TAMPERED = 3


_PATH = "array<struct<before:string,after:string>>"


def leaf(*values: Column) -> Column:
    """The hash of a row's values."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _hash(nodes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(nodes, lambda n: n["digest"]), ""), 256)


def _placed(leaves: DataFrame) -> DataFrame:
    """_key, _n (leaves of the key), _place (rank in it), digest and payload of each leaf: key, id, leaf, payload."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_key", F.col("_id").asc_nulls_first(), "digest"]
    dealt = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the place in the partition is the lower part of the number that Spark gives
    rows = written(dealt.select("_key", "digest", "payload", F.spark_partition_id().alias("_shard"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "leaves")
    runs = rows.groupBy("_key", "_shard").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_key").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    # a row for each key and partition that has it
    starts = runs.select("_key", "_shard", shift.alias("_shift"), F.sum("_rows").over(Window.partitionBy("_key")).alias("_n"))
    return rows.join(starts, ["_key", "_shard"]).select("_key", "_n", (F.col("_at") + F.col("_shift")).alias("_place"), "digest", "payload")


def _rolled(nodes: DataFrame) -> DataFrame:
    """_key, _n, _block, digest and kids of each block of nodes: digit after digit is grouped away, children nested in their node.

    A key's single node is passed up as it is, without a hash.
    """
    rows = nodes.select("_key", "_n", F.expr(f"_place div {BLOCK}").alias("_block"), F.expr(f"cast(_place % {BLOCK} as int)").alias("_place"), "digest", F.col("payload").alias("below"))
    rows = rows.repartition("_key", "_block")
    for level in range(DIGITS):
        kid = F.struct(F.expr(f"_place % {FAN}").alias("digit"), "digest", "below")
        grouped = rows.groupBy("_key", "_n", "_block", F.expr(f"_place div {FAN}").alias("_place")).agg(F.array_sort(F.collect_list(kid)).alias("below"))
        many = F.col("_n") > FAN**level
        rows = grouped.withColumn("digest", F.when(many, _hash(F.col("below"))).otherwise(F.col("below")[0]["digest"]))
    return rows.select("_key", "_n", "_block", "digest", F.col("below").alias("kids"))


def _unrolled(blocks: DataFrame) -> DataFrame:
    """_key, digest, payload and path of each node of the blocks (with `upper`, the block's own path): its siblings before and after, level by level up to the root."""

    def descend(kids: Column, level: int, above: Column) -> Column:
        some = lambda first, n: F.array_join(F.transform(F.slice(kids, first, n), lambda k: k["digest"]), "")
        step = lambda i: F.when(F.col("_n") > FAN**level, F.array(F.struct(some(F.lit(1), i).alias("before"), some(i + 2, F.lit(FAN)).alias("after")))).otherwise(F.array().cast(_PATH))
        if level:
            return F.flatten(F.transform(kids, lambda k, i: descend(k["below"], level - 1, F.concat(step(i), above))))
        return F.transform(kids, lambda k, i: F.struct(k["digest"].alias("digest"), k["below"].alias("payload"), F.concat(step(i), above).alias("path")))

    return blocks.select("_key", "subroot", "root", F.explode(descend(F.col("kids"), DIGITS - 1, F.col("upper"))).alias("_node")).select("_key", "subroot", "root", "_node.*")


def _tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The tables of blocks, from the nodes up to one block for each key."""
    tiers = [written(_rolled(nodes), name)]
    while (tiers[-1].agg(F.max("_n")).first()[0] or 0) > BLOCK:
        last = tiers[-1].select("_key", F.expr(f"(_n + {BLOCK - 1}) div {BLOCK}").alias("_n"), F.col("_block").alias("_place"), "digest", F.struct("_block").alias("payload"))
        tiers.append(written(_rolled(last), name))
    return tiers


def proofs(leaves: DataFrame, key: str, order: str) -> DataFrame:
    """payload, digest (the leaf), path, subroot and root of each leaf.

    leaves: digest and payload (a struct of what is to come along), the group's column and the id's.
    """
    own = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_key"), F.col(order).alias("_id"), "digest", "payload")
    tiers = _tiers(_placed(own), "blocks")
    # a row for each group, ranked and grouped in the same way
    over = _tiers(_placed(tiers[-1].select(F.lit("").alias("_key"), F.col("_key").alias("_id"), "digest", F.struct("_key").alias("payload"))), "groups")
    top = over[-1].select("_key", F.lit(0).cast("long").alias("_block"), F.array().cast(_PATH).alias("upper"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    groups = _down(over, top)
    subroots = groups.select(F.col("payload._key").alias("_key"), F.lit(0).cast("long").alias("_block"), F.col("path").alias("upper"), F.col("digest").alias("subroot"), "root")
    return _down(tiers, subroots).drop("_key")


def _down(tiers: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The lowest tier's nodes with their paths. upper: the paths of the highest tier's blocks."""
    for blocks in reversed(tiers[1:]):
        upper = _unrolled(blocks.join(upper, ["_key", "_block"])).select("_key", F.col("payload._block").alias("_block"), F.col("path").alias("upper"), "subroot", "root")
    return _unrolled(tiers[0].join(upper, ["_key", "_block"]))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_hash(path: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS, key: str = "lang", order: str = "doc_id") -> DataFrame:
    """id, leaf, now (the leaf with `changed` in place of the text; null where nothing changes), path, subroot and root of each row.

    changed: null for rows that are as they were.
    """
    values = lambda text: [text if c == "text" else F.col(c) for c in columns]
    own = leaf(*values(F.col("text"))) if "text" in columns else leaf(*values(None))
    now = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf(*values(changed)))
    rows = docs.select(F.col(key).alias("_group"), F.col(order).alias("_order"), own.alias("digest"), F.struct(F.col(order).alias("id"), now.alias("now")).alias("payload"))
    return proofs(written(rows, "hashed"), "_group", "_order").select("payload.id", F.col("digest").alias("leaf"), "payload.now", "path", "subroot", "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether it passes after some texts have been lower-cased."""
    changed = F.when(crc32_mod("doc_id", TAMPERED) == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = manifest(documents(spark, sf_dir), changed)
    again = folded(F.coalesce("now", "leaf"), F.col("path"))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op12_merkle_manifest": query}

#: Levels that the SQL works out: enough for FAN ** _LEVELS leaves of a group.
_LEVELS = 8


def _sql() -> str:
    value = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    of = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"
    parts = [
        f"""leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS key, {of("text")} AS digest,
                   {of("CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS now
            FROM (SELECT *, {crc} AS crc FROM documents))""",
        "a0 AS (SELECT key, digest, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY key) AS n, doc_id, now FROM leaves)",
    ]

    def tree(t: str) -> None:
        """Nodes of every level; and before and after, the siblings of each."""
        for k in range(_LEVELS):
            parts.append(f"{t}{k + 1} AS (SELECT key, n, place // {FAN} AS place, CASE WHEN any_value(n) > {FAN**k} THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest FROM {t}{k} GROUP BY key, n, place // {FAN})")
            run = f"PARTITION BY key, place // {FAN} ORDER BY place ROWS BETWEEN"
            parts.append(f"{t}s{k} AS (SELECT key, place, n > {FAN**k} AS hashed, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {t}{k})")

    tree("a")
    parts.append(f"b0 AS (SELECT '' AS key, key AS of_key, digest, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS n FROM a{_LEVELS})")
    tree("b")
    parts.append(f"f0 AS (SELECT a.key, a.place, b.place AS key_place, doc_id, a.digest AS leaf, b.digest AS subroot, (SELECT digest FROM b{_LEVELS}) AS root, '' AS proof, now AS acc FROM a0 a JOIN b0 b ON b.of_key = a.key)")
    step = 0
    for t, key, place in (("a", "f.key", "f.place"), ("b", "''", "f.key_place")):
        for k in range(_LEVELS):
            parts.append(f"f{step + 1} AS (SELECT f.* REPLACE (CASE WHEN hashed THEN proof || before || after ELSE proof END AS proof, CASE WHEN hashed THEN sha256(before || acc || after) ELSE acc END AS acc) FROM f{step} f JOIN {t}s{k} s ON s.key = {key} AND s.place = {place} // {FAN**k})")
            step += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM f{step}"


ORACLE_SQL = {"op12_merkle_manifest": _sql()}
