"""Merkle manifest of a dataset: leaves, subroots per source, a root, and a proof for every row.

H is SHA-256 in lower-case hex over its inputs put together, digests as hex
text.  A leaf is H of some columns of a row, each ``-`` if NULL, else its UTF-8
byte count, ``:`` and its value.  Per group (source) leaves ascend by id; while
more than one node remains, every ``arity`` consecutive ones (the last run may
be shorter, even one) become their H.  What remains is the group's subroot; the
subroots, ordered by group (NULL first, then bytewise), become the root likewise.

*Places.*  A leaf's place in its group comes from one range partitioning by
(group, id): the place within the partition plus the sizes of the group's
earlier partitions.  A group of any size is spread over as many partitions as
it needs; no window runs over a group.

*Levels: sibling-shift self-joins.*  Nodes are rows (tree, place, hash).  At every
level the slot-zero rows (place divisible by the arity) work out the places of
their siblings, by slot offsets 1 to ``arity - 1`` (for two: place XOR 1), and an
equijoin on (tree, place) fetches them; the slot-zero row then holds its
run's hashes in order and emits their parent.  All trees climb at the same time, one
with a single node left is done, and the number of levels is the logarithm of
the largest group.

*Proofs* go down the same tables: a run's path (for each level up to the root, the
hashes to the left and to the right) is joined to the run below it, once per run
and not once per row.  A row's proof and its folded root are folds over its
path, in SQL functions alone.

Each level is written to the shared folder, which ends lineage, in a file per
10,000 leaves at most and not in one per shuffle partition.  Only the root, the
number of leaves and the sizes of the largest tree reach the driver.  Nothing is broadcast.

Defined cases: NULL ids come first in their group; rows equal in group and id
are ordered by their leaf, and rows equal in that too have the same leaf and are
interchangeable; an empty text counts as 0 bytes, which differs from NULL; a
group of one row has its leaf as subroot; a single group's subroot is the root;
a row without any sibling has the H of nothing as proof; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.llm.common import discard, few, named, stage, table

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5  # rows whose crc32(id) this divides are tampered with
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _placed(rows: DataFrame, tree: str, order: list[str], name: str, most: int) -> tuple[DataFrame, list[str]]:
    """``rows`` plus ``place`` in its tree (by ``order``), ``n`` of its tree, and ``rank`` of the tree; and scratch paths."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    ranged, path = stage(few(ranged.withColumn("at", F.monotonically_increasing_id()), most), f"{name}-ordered")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    sizes = ranged.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    # A window over parts of trees: a row per tree and partition, never per node.
    before = "coalesce(sum(size) over (partition by {t} order by part rows between unbounded preceding and 1 preceding), 0)".format(t=tree)
    sizes = sizes.select(tree, "part", F.expr(f"{before} - first").alias("shift"), F.expr(f"sum(size) over (partition by {tree})").alias("n"))
    sizes, path2 = stage(few(sizes, most), f"{name}-parts")
    out = ranged.join(sizes, [tree, "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    return out, [path, path2]


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes(tree, place, n, node)``, ``node.hash`` -> ``tree, run, n, members`` (the run's nodes in order)."""
    zero = nodes.where(F.col("place") % arity == 0)
    slots = F.explode(F.sequence(F.lit(0), F.least(F.lit(arity), F.col("n") - F.col("place")).cast("int") - 1))
    wanted = zero.select("tree", F.col("place").alias("zero"), "n", slots.alias("slot"))
    sibling = F.col("zero").bitwiseXOR(F.col("slot").cast("long")) if arity == 2 else F.col("zero") + F.col("slot")
    wanted = wanted.withColumn("place", sibling)
    met = wanted.join(nodes.select("tree", "place", "node"), ["tree", "place"])
    run = F.expr(f"zero div {arity}").alias("run")
    gathered = met.groupBy("tree", run).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("slot", "node"))).alias("m"))
    return gathered.select("tree", "run", "n", F.transform("m", lambda x: x["node"]).alias("members"))


def _hashes(members: str | Column) -> Column:
    return F.transform(members, lambda x: x["hash"])


def _parents(runs: DataFrame, arity: int) -> DataFrame:
    above = F.ceil(F.col("n") / arity).cast("long").alias("n")
    node = F.struct(F.sha2(F.array_join(_hashes("members"), ""), 256).alias("hash")).alias("node")
    return runs.select("tree", F.col("run").alias("place"), above, node)


def _members(runs: DataFrame, above: DataFrame) -> DataFrame:
    """Each node of ``runs`` with its path, from the paths of their parents: ``tree, place, node, path, subroot``."""
    met = runs.join(above.select("tree", F.col("place").alias("run"), "path", "subroot"), ["tree", "run"])
    each = met.select("tree", "run", "path", "subroot", "members", F.posexplode("members").alias("slot", "node"))
    left = F.array_join(_hashes(F.slice("members", F.lit(1), F.col("slot"))), "")
    right = F.array_join(_hashes(F.slice("members", F.col("slot") + 2, F.size("members"))), "")
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return each.select("tree", "run", "slot", "node", F.concat(step, "path").alias("path"), "subroot")


_PATH = "array<struct<left:string,right:string>>"


def _climb(nodes: DataFrame, arity: int, name: str, most: int) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """Runs of each level from the lowest up, the last node of every tree (``tree, level, node``), scratch paths."""
    levels, tops, paths = [], None, []
    nodes, path = stage(few(nodes, most), f"{name}-nodes")
    paths.append(path)
    while True:
        done = nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "node.hash")
        tops = done if tops is None else tops.unionByName(done)
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return levels, tops, paths
        runs, path = stage(few(_runs(nodes.where("n > 1"), arity), most), f"{name}-level-{len(levels)}")
        levels.append(runs)
        nodes, path2 = stage(few(_parents(runs, arity), most), f"{name}-nodes")
        paths += [path, path2]


def _descend(levels: list[DataFrame], tops: DataFrame, arity: int, most: int) -> DataFrame:
    """Paths of the leaves: ``tree, place, node, path, subroot``; ``tops(tree, level, hash, path)``.

    ``node`` is NULL for trees that are a single leaf.
    """

    def ending(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("place"), "path", F.col("hash").alias("subroot"))

    above = ending(len(levels))
    for level in range(len(levels) - 1, 0, -1):
        below = _members(levels[level], above)
        place = (F.col("run") * arity + F.col("slot")).alias("place")
        below = below.select("tree", place, "path", "subroot").unionByName(ending(level))
        above, _ = stage(few(below, most), "merkle-paths")
    return _members(levels[0], above) if levels else above


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id: str = "doc_id",
    group: str = "source",
    text: str = "text",
    arity: int = ARITY,
    tamper: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``tamper`` says whose ``text`` is put in lower case (A-Z) before its proof
    is checked; nobody's, where it is not given.
    """
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    changed = [F.translate(named(f).cast("string"), _UPPER, _LOWER) if f == text else named(f) for f in fields]
    given = F.coalesce(tamper, F.lit(False)) if tamper is not None else F.lit(False)
    key = F.coalesce(F.concat(F.lit("+"), named(group).cast("string")), F.lit(""))  # NULL before every value
    leaves = docs.select(
        named(id).alias("id"), key.alias("tree"), leaf_of([named(f) for f in fields]).alias("hash"),
        F.when(given, leaf_of(changed)).alias("shown"),
    )
    leaves, path = stage(leaves, "merkle-leaves")
    most = leaves.count()  # rows of the largest table; levels and subroots have fewer
    placed, paths = _placed(leaves, "tree", ["id", "hash"], "merkle", most)
    nodes = placed.select("tree", "place", "n", F.struct("hash", "id", "shown").alias("node"))
    levels, tops, more = _climb(nodes, arity, "merkle", most)
    spark = docs.sparkSession
    single = spark.read.parquet(more[0]).where("n = 1")
    subroots, path2 = stage(few(tops, most), "merkle-subroots")
    discard(spark, path, *paths)

    # The tree over the subroots: one tree, whose leaves are the groups in order.
    ordered, paths2 = _placed(subroots.select("tree", "level", "hash", F.lit("").alias("all")), "all", ["tree"], "merkle-top", most)
    top_nodes = ordered.select(F.col("all").alias("tree"), "place", "n", F.struct("hash", F.col("tree").alias("of"), "level").alias("node"))
    top_levels, last, paths3 = _climb(top_nodes, arity, "merkle-top", most)
    row = last.first()
    root = row["hash"] if row else None
    empty = F.array().cast(_PATH)
    if top_levels:
        of = _descend(top_levels, last.withColumn("path", empty), arity, most)
        of = of.select(F.col("node.of").alias("tree"), F.col("node.level").alias("level"), F.col("node.hash").alias("hash"), "path")
    else:
        of = subroots.select("tree", "level", "hash", empty.alias("path"))
    of, path3 = stage(few(of, most), "merkle-tops")
    discard(spark, path2, *paths2, *paths3)

    # Down to the leaves.
    alone = single.join(of.where("level = 0").select("tree", "path", F.col("hash").alias("subroot")), "tree").select("node", "path", "subroot")
    out = alone
    if levels:
        out = _descend(levels, of, arity, most).select("node", "path", "subroot").unionByName(alone)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    shown = F.coalesce("node.shown", "node.hash")
    folded = F.aggregate("path", shown, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))
    out = out.select(
        F.col("node.id").alias(id), F.col("node.hash").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return few(out.withColumn("verified", F.col("folded_root") == F.col("root")), most)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all ``documents`` by source, 16 nodes a run: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 5 divides crc32(doc_id), the text is put in lower case before the check.
    """
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, tamper=F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0)


_PIECE = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_PIECE.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC_SQL = """
  SELECT doc_id AS key, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) AS c
  FROM documents
"""

#: The same in DuckDB: level by level upwards, and every leaf's fold, level by level.
OP13_SQL = f"""
WITH RECURSIVE crc AS ({_CRC_SQL}), leaves AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN xor(c, 4294967295) % {TAMPER} = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")}
    ELSE {_leaf_sql('text')} END AS shown
  FROM documents LEFT JOIN crc ON key = doc_id
), base AS (
  SELECT coalesce('+' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n, * FROM leaves
), low(level, tree, place, n, h) AS (
  SELECT 0, tree, place, n, leaf FROM base
  UNION ALL
  SELECT level + 1, tree, place // {ARITY}, (max(n) + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY place))
  FROM low WHERE n > 1 GROUP BY level, tree, place // {ARITY}
), sub AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), high(level, place, n, h) AS (
  SELECT 0, place, n, subroot FROM sub
  UNION ALL
  SELECT level + 1, place // {ARITY}, (max(n) + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY place))
  FROM high WHERE n > 1 GROUP BY level, place // {ARITY}
), lowsides AS (
  SELECT a.level, a.tree, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM low a JOIN low b ON a.level = b.level AND a.tree = b.tree AND a.place // {ARITY} = b.place // {ARITY} WHERE a.n > 1
  GROUP BY a.level, a.tree, a.place
), highsides AS (
  SELECT a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM high a JOIN high b ON a.level = b.level AND a.place // {ARITY} = b.place // {ARITY} WHERE a.n > 1
  GROUP BY a.level, a.place
), lowfold(doc_id, tree, level, place, h, proof) AS (
  SELECT doc_id, tree, 0, place, shown, '' FROM base
  UNION ALL
  SELECT f.doc_id, f.tree, f.level + 1, f.place // {ARITY}, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM lowfold f JOIN lowsides s ON s.level = f.level AND s.tree = f.tree AND s.place = f.place
), ended AS (
  SELECT doc_id, tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM lowfold GROUP BY doc_id, tree
), highfold(doc_id, tree, level, place, h, proof) AS (
  SELECT doc_id, ended.tree, 0, sub.place, h, proof FROM ended JOIN sub ON sub.tree = ended.tree
  UNION ALL
  SELECT f.doc_id, f.tree, f.level + 1, f.place // {ARITY}, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM highfold f JOIN highsides s ON s.level = f.level AND s.place = f.place
), folded AS (
  SELECT doc_id, arg_max(h, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM highfold GROUP BY doc_id
), top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT base.doc_id, base.leaf, sub.subroot, top.root, proof_sha256, folded_root, folded_root = top.root AS verified
FROM base JOIN sub ON sub.tree = base.tree JOIN folded ON folded.doc_id = base.doc_id, top
"""
