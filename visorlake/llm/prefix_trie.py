"""The prefix trie of conversations, peeled from its deepest turns to the root."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from visorlake.llm.common import WHITE
from visorlake.session import settle

#: Turns a path array holds; turns a prefix hash runs over before totals of whole slices take over.
SEGMENT, SLICE = 16, 4_096
#: Where so few conversations are that long, several levels are peeled in one step, over so many turns at most.
NARROW, BLOCK_TURNS = 1_000, 100_000
#: Nodes with more than a thousandth of all nodes as children are at most a thousand.
HOT_PARENTS = 1_000
#: log2 of the ids that one piece of a node's id list can span.
ID_PIECE = 10
NODE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WHITE.replace("[", "[^"))).cast("long")


# ---------------------------------------------------------------- turns
def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv_id, pos (from 1), t1, t2 (two 64-bit hashes of role and text) and words of every turn of every conversation.

    Order: turn (null first), then role, then text. Null role or text counts as empty, rows with a null conversation are left out.
    Rows are sorted by ranges, so a conversation of any length is spread over tasks; its position is that in its range plus the
    rows of the ranges before.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("conv_id").isNotNull())
    order = ["conv_id", "turn", "role", "text"]
    ranged = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("t1"),
        F.xxhash64(F.lit("second"), "role", "text").alias("t2"), n_words(F.col("text")).alias("words")))
    parts = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return ranged.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("start") + 1).alias("pos"), "t1", "t2", "words")


def share_openings(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of conversation c - c % `every`; h = crc32(decimal c) % `most`.

    `turns` as from `numbered_turns`. Returns the conversations (conv_id, n: turns it has now) and their turns. If the other
    conversation has fewer turns, it gives all; if there is none, none. A conversation may end up without turns.
    """
    turns = settle(turns)
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_n")).where(F.col("base") % every == 0)
    convs = settle(sizes.withColumn("h", h).withColumn("base", base).join(heads, "base", "left")
                   .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
                   .select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    opening = (turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
               .join(convs.select("conv_id", "base", "taken"), "base").where(F.col("pos") <= F.col("taken")).select("conv_id", "pos", "t1", "t2", "words"))
    # Only conversations whose partner is too short move up by other than nothing; the rest keep their positions.
    short = convs.where(F.col("taken") < F.col("h")).select("conv_id", (F.col("h") - F.col("taken")).alias("up"))
    rest = (turns.where(F.col("pos") > h).join(short, "conv_id", "left")
            .select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), "t1", "t2", "words"))
    return convs.select("conv_id", "n"), opening.unionByName(rest)


def paths(turns: DataFrame) -> DataFrame:
    """Columns conv_id, seg, path: the turns of each conversation in arrays of up to `SEGMENT`.

    An element holds pos, a and b (hashes of the turn at its place), k1 and k2 (those of the whole prefix: all a or b so far by
    exclusive or, so that a turn is stripped by applying it once more) and words. The prefix hash runs in slices of a conversation.
    """
    rows = settle(turns.select("conv_id", "pos", F.floor((F.col("pos") - 1) / SLICE).alias("slice"), F.xxhash64("pos", "t1").alias("a"),
                               F.xxhash64("t2", "pos").alias("b"), "words"))
    totals = rows.groupBy("conv_id", "slice").agg(F.expr("bit_xor(a)").alias("ta"), F.expr("bit_xor(b)").alias("tb"), F.max("slice").alias("last"))
    long = totals.join(totals.where(F.col("slice") > 0).select("conv_id").distinct(), "conv_id", "left_semi")
    before = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = long.select("conv_id", "slice", F.expr("bit_xor(ta)").over(before).alias("sa"), F.expr("bit_xor(tb)").over(before).alias("sb"))
    inside = W.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    keyed = rows.withColumn("k1", F.expr("bit_xor(a)").over(inside)).withColumn("k2", F.expr("bit_xor(b)").over(inside))
    whole = keyed.join(starts, ["conv_id", "slice"], "left").select(
        "conv_id", "slice", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg"), "pos", "a", "b",
        F.col("k1").bitwiseXOR(F.coalesce("sa", F.lit(0))).alias("k1"), F.col("k2").bitwiseXOR(F.coalesce("sb", F.lit(0))).alias("k2"), "words")
    step = F.struct("pos", "a", "b", "k1", "k2", "words")
    return whole.groupBy("conv_id", "slice", "seg").agg(F.sort_array(F.collect_list(step)).alias("path")).drop("slice")


# ---------------------------------------------------------------- peeling
def _stripped(nodes: DataFrame) -> DataFrame:
    """Nodes as children: without their last turn."""
    return nodes.select("conv_id", "n_convs", "n_leaves", "saved_tokens", F.expr("slice(path, 1, size(path) - 1)").alias("path"))


def _grouped(level: DataFrame, depth: int, keys: list[str]) -> DataFrame:
    """Nodes of one depth from rows that stand for a child (`child` = 1) or for a conversation that ends here (0)."""
    nodes = level.groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("n_leaves").alias("below"),
        F.sum("saved_tokens").alias("saved_below"), *([F.first("path").alias("path")] if keys else []))
    words = F.element_at("path", -1)["words"] if keys else F.lit(0)
    return (nodes.where(F.col("n_convs") > 0).withColumn("depth", F.lit(depth).cast("long"))
            .withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("below")).cast("long"))
            .withColumn("saved_tokens", F.col("saved_below") + (F.col("n_convs") - 1) * words).drop("below", "saved_below"))


def _ends(convs: DataFrame) -> list[Column]:
    return [F.lit(1).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")]


def _peel_segment(segs: DataFrame, convs: DataFrame, front: DataFrame | None, low: int, high: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels high to low + 1, all inside one segment, a step each. Returns their nodes and the children of level `low`."""
    here = segs.where(F.col("seg") == low // SEGMENT)
    ended = settle(here.join(convs.where((F.col("n") > low) & (F.col("n") <= high)), "conv_id").select("conv_id", "n", *_ends(convs), "path"))
    rows = None if front is None else here.join(front, "conv_id").select(*front.columns, F.expr(f"slice(path, 1, {high - low})").alias("path"))
    done = []
    for depth in range(high, low, -1):
        level = ended.where(F.col("n") == depth).drop("n").withColumn("child", F.lit(0).cast("long"))
        if rows is not None:
            level = level.unionByName(rows.withColumn("child", F.lit(1).cast("long")))
        keyed = level.withColumn("k1", F.element_at("path", -1)["k1"]).withColumn("k2", F.element_at("path", -1)["k2"])
        last = F.element_at("path", -1)
        nodes = settle(_grouped(keyed, depth, ["k1", "k2"]).withColumn("p1", F.col("k1").bitwiseXOR(last["a"])).withColumn("p2", F.col("k2").bitwiseXOR(last["b"])))
        done.append(nodes.select(*[c.split()[0] for c in NODE.split(", ")]))
        rows = _stripped(nodes)
    return done, rows.drop("path")


def _peel_block(segs: DataFrame, convs: DataFrame, front: DataFrame | None, low: int, high: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels high to low + 1 where few conversations are left, by prefix at `low`: each task peels whole subtrees of a bounded block."""
    near = convs.where((F.col("n") > low) & (F.col("n") <= high)).select("conv_id", "n", *[F.lit(None).cast("long").alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")])
    if front is not None:
        near = near.unionByName(front.withColumn("n", F.lit(None).cast("long")))
    turns = (segs.where((F.col("seg") >= low // SEGMENT) & (F.col("seg") <= (high - 1) // SEGMENT)).join(near, "conv_id")
             .select("conv_id", "n", "n_convs", "n_leaves", "saved_tokens", F.explode("path").alias("turn")).select("*", "turn.*").drop("turn")
             .where((F.col("pos") > low) & (F.col("pos") <= high)))
    turns = settle(turns)
    top = turns.where(F.col("pos") == low + 1).select("conv_id", F.col("k1").bitwiseXOR(F.col("a")).alias("f1"), F.col("k2").bitwiseXOR(F.col("b")).alias("f2"))
    nodes = settle(turns.join(top, "conv_id").groupBy("f1", "f2").applyInPandas(_subtrees, NODE))
    return [nodes], nodes.where(F.col("depth") == low + 1).select("conv_id", "n_convs", "n_leaves", "saved_tokens")


def _subtrees(turns: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the subtrees below one prefix. A conversation ends at `n`, or brings what its node's subtree holds further down."""
    turns = turns.sort_values(["pos", "conv_id"], ascending=[False, True], kind="stable")
    out, alive, level, depth = [], {}, {}, None
    deep = turns["n"].isna().to_numpy()
    columns = [turns[c].fillna(0).astype("int64").tolist() for c in ("pos", "conv_id", "n", "n_convs", "n_leaves", "saved_tokens", "a", "b", "k1", "k2", "words")]

    def close() -> None:
        alive.clear()
        for (k1, k2), (conv, convs, children, leaves, saved, a, b, words) in level.items():
            leaves, saved = leaves if children else 1, saved + (convs - 1) * words
            alive[conv] = (convs, leaves, saved)
            out.append((depth, k1, k2, k1 ^ a, k2 ^ b, conv, convs, children, leaves, saved))
        level.clear()

    opened = set()
    for further, pos, conv, n, n_convs, n_leaves, saved, a, b, k1, k2, words in zip(deep, *columns, strict=True):
        if pos != depth:
            close()
            depth = pos
        if further and conv not in opened:
            opened.add(conv)
            child = (n_convs, n_leaves, saved)
        elif n == pos and not further:
            child = None
        elif conv in alive:
            child = alive[conv]
        else:
            continue                                                     # another conversation speaks for its node
        node = level.setdefault((k1, k2), [conv, 0, 0, 0, 0, a, b, words])
        node[0] = min(node[0], conv)
        node[1] += child[0] if child else 1
        if child:
            node[2] += 1
            node[3] += child[1]
            node[4] += child[2]
    close()
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])


def _steps(lengths: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """(low, high, narrow) of every step from the deepest level up. `lengths`: (turns, conversations), from the longest."""
    if not lengths:
        return
    depth, at, reach = lengths[0][0], 0, 0
    while depth > 0:
        while at < len(lengths) and lengths[at][0] >= depth:
            reach, at = reach + lengths[at][1], at + 1
        if reach > NARROW:
            low = (depth - 1) // SEGMENT * SEGMENT
            yield low, depth, False
            depth = low
            continue
        high, turns = depth, 0
        while depth > 0 and reach <= NARROW and (turns + reach <= BLOCK_TURNS or depth == high):
            turns, depth = turns + reach, depth - 1
            while at < len(lengths) and lengths[at][0] >= depth:
                reach, at = reach + lengths[at][1], at + 1
        yield depth, high, True


# ---------------------------------------------------------------- names of parents, ids that end
def _with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id. Parents of very many children, of whom there are few, are broadcast; the rest meet by key."""
    key = lambda d: (F.col("depth") == F.col("_depth") + 1) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2"))
    names = nodes.select(F.col("depth").alias("_depth"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    most = nodes.count() // HOT_PARENTS
    hot = F.broadcast(names.where(F.col("n_children") > most).drop("n_children").withColumnRenamed("parent_conv_id", "hot"))
    met = nodes.join(hot, key(0), "left").drop("_depth", "_k1", "_k2")
    few = names.where(F.col("n_children").between(1, most)).drop("n_children")
    rest = met.where(F.col("hot").isNull()).drop("hot").join(few, key(0), "left").drop("_depth", "_k1", "_k2")
    return met.where(F.col("hot").isNotNull()).withColumnRenamed("hot", "parent_conv_id").unionByName(rest)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """ends_sha256 of the conversations (conv_id, depth, k1, k2) that end at each node: their ids in order, as one text.

    Ids are sorted and written out in pieces; the pieces of a node then stream, in order, through one hash.
    """
    pieces = ends.groupBy("depth", "k1", "k2", F.shiftright("conv_id", ID_PIECE).alias("piece")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))).alias("ids"))
    key = ["depth", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield _batch(out)
                out = []
        if now is not None:
            yield _batch([(*now, sha.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:3]), pa.array([r[3] for r in rows])], names=[*key, "ends_sha256"])

    return pieces.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "ids").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def build_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of all prefixes of the conversations, the empty one (the root) included.

    `convs`: conv_id, n (number of turns, 0 allowed); `turns`: conv_id, pos (1 to n), t1, t2, words. Equal prefixes are those
    with equal 128-bit hashes of their turns.

    The trie is peeled from its deepest level: the conversations that end at a level join the nodes that came up from below, equal
    ones merge, each loses its last turn, and so on to the root. Counts, leaves and saved words come up with the nodes; conversations
    are represented by the smallest of each node, whose path is read a segment at a time. A level is one step of map-side
    combined sums. Where few conversations are long enough, a step takes as many levels as fit a bounded number of turns.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without
    conversations there is no root and no row.
    """
    convs, segs = settle(convs), settle(paths(turns))
    # A thousand different lengths need half a million turns: there are at most sqrt(2 * turns) of them.
    lengths = [tuple(r) for r in convs.groupBy("n").count().orderBy(F.desc("n")).collect()]
    levels: list[DataFrame] = []
    front: DataFrame | None = None
    for low, high, narrow in _steps(lengths):
        done, front = (_peel_block if narrow else _peel_segment)(segs, convs, front, low, high)
        levels += done
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    level = convs.where(F.col("n") == 0).select("conv_id", *_ends(convs), *zero("child"))
    if front is not None:
        level = level.unionByName(front.withColumn("child", F.lit(1).cast("long")))
    root = _grouped(level, 0, []).select("*", *zero("k1", "k2"), *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])
    nodes = root.select(*[c.split()[0] for c in NODE.split(", ")])
    for one in levels:
        nodes = nodes.unionByName(one)
    last = segs.select("conv_id", F.element_at("path", -1).alias("turn")).select("conv_id", "turn.pos", "turn.k1", "turn.k2")
    ends = (convs.join(last, (convs["conv_id"] == last["conv_id"]) & (convs["n"] == last["pos"])).select(convs["conv_id"], F.col("n").alias("depth"), "k1", "k2")
            .unionByName(convs.where(F.col("n") == 0).select("conv_id", F.col("n").alias("depth"), *zero("k1", "k2"))))
    return (_with_parents(settle(nodes)).join(_end_hashes(ends), ["depth", "k1", "k2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations that share openings: numbered turns, openings taken from each twentieth, then `build_trie`.

    Turns are ordered by turn (null first), role and text; null role or text is empty; rows with a null conversation are left out;
    repeated rows are turns of their own. An empty table gives no rows. Other columns are ignored.
    """
    return build_trie(*share_openings(numbered_turns(conversations, conv, turn, role, text)))


#: crc32 of a number's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda r, c: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(r, c)), CAST(4294967295 AS BIGINT)), 4294967295)"""
TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)
), mixed AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs AS c JOIN own AS o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs AS c JOIN own AS o USING (conv_id) WHERE o.pos > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos, role, text FROM mixed
), chain AS (
  SELECT conv_id, pos AS depth, text, list([role, text]) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM turns
  UNION ALL
  SELECT conv_id, 0, '', [] FROM convs
), sizes AS (
  SELECT conv_id, max(depth) AS n FROM chain GROUP BY conv_id
), marked AS (
  SELECT conv_id, n, depth, text, md5(CAST(to_json(prefix) AS VARCHAR)) AS k FROM chain JOIN sizes USING (conv_id)
), plain AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM marked GROUP BY depth, k
), parents AS (
  SELECT DISTINCT c.depth, c.k, p.k AS parent FROM marked AS c JOIN marked AS p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1
), kids AS (
  SELECT depth - 1 AS depth, parent AS k, count(*) AS n_children FROM parents GROUP BY ALL
), nodes AS (
  SELECT plain.*, coalesce(n_children, 0) AS n_children FROM plain LEFT JOIN kids USING (depth, k)
), sums AS (
  SELECT a.depth, a.k, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens
  FROM nodes AS n JOIN marked AS a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.k
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes AS n JOIN sums AS s USING (depth, k) LEFT JOIN parents AS u USING (depth, k) LEFT JOIN plain AS p ON p.depth = n.depth - 1 AND p.k = u.parent
"""
