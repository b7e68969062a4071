"""A Merkle manifest of a table of documents: digests of rows, of sources and of the whole.

A row's leaf is the SHA-256 of its fields. The leaves of a source, in order of
``doc_id``, are dealt to parents of ``FANOUT`` consecutive children each. One
aggregation with a condition for each slot spreads the children of a parent into
as many columns: the columns concatenated and hashed are the parent, the columns
without the own one are a child's siblings. Parents are children of the next
level until one is left; the roots of the sources are the leaves of one more
tree. Coming down again, each parent hands its children their siblings and its
own way to the root, so that a proof costs one join with the parents of a level.
Texts are read once and never shuffled; levels shrink by the fanout, so rounds
are the logarithm of the largest source.

Defined results: a null field is ``-``; null and empty texts differ. Null ids
come first in a source and a null source first of all; ``doc_id`` in decimal is
the empty text for a null id where its checksum is asked for, so such rows are
tampered with. Rows that repeat an id are leaves in order of their digests, and
equal rows are as many equal leaves. Texts of any length are hashed in whole. An
empty table has no rows, and ``Manifest.root`` is None. A single row has no
siblings: its proof is empty. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold_of, materialize
from .mixing import source_key
from .ranking import places

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, with ``text`` in place of its own text."""
    return F.sha2(F.concat(*[field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _pivot(nodes: DataFrame, child: Column, fanout: int) -> DataFrame:
    """(g, depth, i, c0, c1, ...): the children of each parent, a column for each slot."""
    slot = F.pmod("i", F.lit(fanout))
    columns = [F.max(F.when(slot == j, child)).alias(f"c{j}") for j in range(fanout)]
    return nodes.groupBy("g", "depth", F.expr(f"i div {fanout}").alias("i")).agg(*columns)


def _digests(fanout: int) -> Column:
    return F.array(*[F.col(f"c{j}.h") for j in range(fanout)])


def _depth(n: Column, fanout: int) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(F.lit(float(fanout)), k) < n))


def _rise(leaves: DataFrame, payload: list[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The parents of each level, and (g, depth, h), the last node of each group, of leaves (g, depth, i, h, payload)."""
    levels: list[DataFrame] = []
    nodes, tops = leaves, leaves.where("depth = 0").select("g", "depth", "h")
    deepest = leaves.agg(F.max("depth").alias("d")).first()["d"] or 0
    for level in range(deepest):
        child = F.struct("h", *(payload if level == 0 else []))
        parents = materialize(_pivot(nodes.where(F.col("depth") > level), child, fanout), f"merkle-{level}")
        levels.append(parents)
        nodes = parents.select("g", "depth", "i", F.sha2(F.array_join(_digests(fanout), ""), 256).alias("h"))
        tops = tops.unionByName(nodes.where(F.col("depth") == level + 1).select("g", "depth", "h"))
    return levels, materialize(tops, "merkle-tops")


def _descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame | None:
    """(g, child, path) of every leaf below a parent, from (g, depth, path) of each group's last node."""
    below = None
    for level in reversed(range(len(levels))):
        here = tops.where(F.col("depth") == level + 1).select("g", F.lit(0).cast("long").alias("i"), "path")
        if below is not None:
            here = here.unionByName(below.select("g", "i", "path"))
        kids = F.array(*[F.col(f"c{j}") for j in range(fanout)])
        rows = levels[level].select("g", "i", kids.alias("kids"), _digests(fanout).alias("hs")).join(here, ["g", "i"])
        each = rows.select("g", "i", "hs", "path", F.posexplode("kids").alias("slot", "child")).where("child IS NOT NULL")
        own = F.struct(F.array_join(F.slice("hs", F.lit(1), F.col("slot")), "").alias("l"), F.array_join(F.slice("hs", F.col("slot") + 2, F.lit(fanout)), "").alias("r"))
        below = each.select("g", (F.col("i") * fanout + F.col("slot")).alias("i"), "child", F.concat(F.array(own), F.col("path")).alias("path"))
    return below


def siblings_of(path: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def fold(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


@dataclass
class Manifest:
    """``leaves`` (doc_id, source, leaf, altered), ``sources`` (source key g, leaves n, subroot, path to the root), ``root``, and the parents of each level."""

    leaves: DataFrame
    levels: list[DataFrame]
    sources: DataFrame
    root: str | None
    fanout: int

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, altered, subroot, path) of every row; path holds what stands left and right of it at each level."""
        subs = self.sources.select("g", "depth", "subroot", "path")
        out = self.leaves.where("depth = 0").join(subs, ["g", "depth"]).select("g", "doc_id", F.col("h").alias("leaf"), "altered", "subroot", "path")
        below = _descend(self.levels, self.sources, self.fanout)
        if below is not None:
            deep = below.select("g", F.col("child.doc_id").alias("doc_id"), F.col("child.h").alias("leaf"), F.col("child.altered").alias("altered"), "path")
            out = out.unionByName(deep.join(subs.select("g", "subroot"), "g").select(*out.columns))
        return out.drop("g")


def manifest(docs: DataFrame, altered: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of a table. ``altered`` is a text that stands for the own one in the leaf of that name (null where that leaf is the same)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("g"), leaf().alias("h"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    placed = places(rows, ["g"], ["doc_id", "h"], "i", "n", "merkle-leaves")
    leaves = placed.withColumn("depth", _depth(F.col("n"), fanout))
    levels, tops = _rise(leaves, ["doc_id", "altered"], fanout)
    above = places(tops.select(F.lit("").alias("all"), F.col("g").alias("of"), "h", F.col("depth").alias("levels")), ["all"], ["of"], "i", "n", "merkle-subroots")
    above = above.select(F.col("all").alias("g"), _depth(F.col("n"), fanout).alias("depth"), "i", "h", "of", "levels")
    upper, last = _rise(above, ["of", "levels"], fanout)
    found = last.first()  # one row: the root
    path = F.array().cast(PATH)
    sources = above.where("depth = 0").select(F.col("of").alias("g"), F.col("levels").alias("depth"), F.col("h").alias("subroot"), path.alias("path"))
    below = _descend(upper, last.withColumn("path", path), fanout)
    if below is not None:
        sources = below.select(F.col("child.of").alias("g"), F.col("child.levels").alias("depth"), F.col("child.h").alias("subroot"), "path")
    return Manifest(leaves, levels, materialize(sources, "merkle-sources"), found["h"] if found else None, fanout)


def changed_sources(old: Manifest, new: Manifest) -> DataFrame:
    """(g, old, new): sources whose subroots differ or that one side lacks. Only these need their leaves compared."""
    a, b = old.sources.select("g", F.col("subroot").alias("old")), new.sources.select("g", F.col("subroot").alias("new"))
    return a.join(b, "g", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def changed_rows(old: Manifest, new: Manifest) -> DataFrame:
    """(doc_id, leaf, n): leaves of changed sources that the new side has n times more (less, if n is negative) often."""
    where = changed_sources(old, new).select("g")
    count = lambda m, sign: m.leaves.join(where, "g", "left_semi").select("doc_id", F.col("h").alias("leaf"), F.lit(sign).alias("n"))
    return count(old, -1).unionByName(count(new, 1)).groupBy("doc_id", "leaf").agg(F.sum("n").alias("n")).where("n <> 0")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    m = manifest(docs, F.when(fold_of(F.col("doc_id")) == 0, leaf(lowered(F.col("text")))))
    out = m.proofs().select("doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(siblings_of(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL unrolls: sources of up to 16^5 rows, 16^2 sources.
SQL_LEVELS, SQL_UPPER = 5, 2


def _oracle() -> str:
    """The same trees in SQL, level by level; digests of children are gathered in order of their places."""
    crc = "xor(list_reduce(list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"
    f = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    whole = "sha256(" + " || ".join(f.format(c) for c in FIELDS) + ")"
    other = "sha256(" + " || ".join(f.format(c if c != "text" else f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')") for c in FIELDS) + ")"
    steps = [
        "bytes AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab)",
        f"leaves AS (SELECT doc_id, source, {whole} AS h, CASE WHEN {crc.format('doc_id')} % 5 = 0 THEN {other} ELSE {whole} END AS used FROM documents, bytes)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, h AS node, used AS mine, '' AS path FROM leaves)",
    ]

    def climb(name: str, levels: int, group: str) -> None:
        """Each row keeps its node of the level (node, i, n), the digest folded so far (mine) and the siblings so far (path)."""
        for k in range(levels):
            a, u, p = f"{name}{k}", f"{name}u{k}", f"{name}p{k}"
            steps.append(f"{u} AS (SELECT DISTINCT {group} AS g, i, n, node FROM {a})")
            steps.append(f"{p} AS (SELECT g, i // 16 AS parent, sha256(string_agg(node, '' ORDER BY i)) AS h FROM {u} WHERE n > 1 GROUP BY 1, 2)")
            steps.append(f"{name}s{k} AS (SELECT x.g, x.i, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r FROM {u} x JOIN {u} y ON x.g IS NOT DISTINCT FROM y.g AND x.i // 16 = y.i // 16 GROUP BY 1, 2)")
            kept = ", ".join(c for c in ("doc_id", "source", "h", "subroot") if c != "subroot" or name == "b")
            steps.append(
                f"{name}{k + 1} AS (SELECT {', '.join('a.' + c for c in kept.split(', '))}, CASE WHEN a.n > 1 THEN a.i // 16 ELSE a.i END AS i, CASE WHEN a.n > 1 THEN (a.n + 15) // 16 ELSE a.n END AS n, CASE WHEN a.n > 1 THEN p.h ELSE a.node END AS node, "
                f"CASE WHEN a.n > 1 THEN sha256(s.l || a.mine || s.r) ELSE a.mine END AS mine, CASE WHEN a.n > 1 THEN a.path || s.l || s.r ELSE a.path END AS path "
                f"FROM {a} a LEFT JOIN {p} p ON p.g IS NOT DISTINCT FROM {group.replace('source', 'a.source')} AND p.parent = a.i // 16 LEFT JOIN {name}s{k} s ON s.g IS NOT DISTINCT FROM {group.replace('source', 'a.source')} AND s.i = a.i)"
            )

    climb("a", SQL_LEVELS, "source")
    steps.append("subs AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))")
    steps.append(f"b0 AS (SELECT a.doc_id, a.source, a.h, a.node AS subroot, s.i, s.n, a.node, a.mine, a.path FROM a{SQL_LEVELS} a JOIN subs s ON a.source IS NOT DISTINCT FROM s.source)")
    climb("b", SQL_UPPER, "0")
    end = f"b{SQL_UPPER}"
    return f"WITH {', '.join(steps)} SELECT doc_id, h AS leaf, subroot, node AS root, sha256(path) AS proof_sha256, mine AS folded_root, mine = node AS verified FROM {end}"


ORACLE = _oracle()
