"""A prefix trie of conversations, by digests of fixed-length blocks of turns.

A node is a distinct sequence of first turns. Each turn is digested where it is read; texts go no further. Turns are
numbered in their conversation by two-level prefix sums, BLOCK consecutive turns make a block, and a conversation's
digest up to a block is the running xor of hashes of the blocks' places and contents. So neither a conversation of any
length nor a sequence that any number of conversations share is gathered in a task.

Grouping goes by whole blocks first: equal (digest before, digest after) pairs are one path, summed before anything is
cut into turns. Where the paths that follow a digest are one alone, its turns are a chain of nodes with the same members;
only where siblings diverge the paths are refined to turns, each with the digest after the turn as its node's key.

What holds for subtrees is summed over members instead of descendants. A leaf is counted by its smallest member. A
node's saved words are counted by its smallest member too, so a member that isn't the smallest adds all that it stands
for below, and the smallest adds its nodes from there on, a running sum along its own path.

Edge cases: null roles and texts are empty; turns of one number are ordered by role and the text's digest, null numbers
come first; rows without a conversation id are no turns of any conversation and are left out; repeated rows are turns;
empty texts have no words; an empty table has no node, not even a root; very long texts are digested where they are read;
only the four columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import running
from .common import join_hot, named, scratch, table, whole_text, written

#: Turns that a block has.
BLOCK = 4
#: Ids that one piece of a node's list of ends holds.
IDS_A_PIECE = 4096


def digested(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, t, words): t the digest of role and text, of 16 bytes."""
    role, text = whole_text(role_col), whole_text(text_col)
    t = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.filter(named(conv_col).isNotNull()).select(named(conv_col).cast("long").alias("conv"), named(turn_col).alias("turn"), role.alias("role"), t.alias("t"), words.alias("words"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, t, words): turns numbered from 1 in their conversation; a written table."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("t").asc()]
    return written(running(written(turns, "turns"), ["conv"], order, {"pos": F.lit(1).cast("long")}).select("conv", "pos", "t", "words"), "numbered-turns")


def rebuilt(turns: DataFrame, shared: Callable[[Column], Column], base: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """(conv) of all conversations, and (conv, pos, t, words) of their turns after the first h = shared(conv) <= most became those of base(conv)."""
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    heads = turns.filter((F.col("pos") <= most) & (F.col("conv") == base(F.col("conv")))).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "t", "words"))).alias("head"))
    convs = convs.withColumn("base", base(F.col("conv"))).withColumn("h", shared(F.col("conv"))).join(heads, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,t:binary,words:bigint>>")), 1, F.col("h")))
    convs = written(convs.select("conv", "n", "h", "head"), "conversations")
    first = convs.select("conv", F.inline("head"))
    own = turns.filter(F.col("pos") > shared(F.col("conv")))
    moved = join_hot(own, convs.select("conv", "n", (F.size("head") - F.col("h")).alias("shift")), ["conv"], "n", turns.count())
    return convs.select("conv"), first.unionByName(moved.select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "t", "words"))


def _lanes(p0: Column, p1: Column, j: Column, ts: Column) -> list[Column]:
    """The digest (two longs) after some turns of block j, from that before the block."""
    content = F.array_join(F.transform(ts, lambda x: F.hex(x)), "")
    return [p.bitwiseXOR(F.xxhash64(F.lit(f"lane{i}"), j, content)) for i, p in enumerate((p0, p1))]


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv, j, p0, p1, q0, q1, ts, ws): a conversation's blocks with the digests before and after each; a written table."""
    j = F.floor((F.col("pos") - 1) / BLOCK).cast("long")
    own = turns.groupBy("conv", j.alias("j")).agg(F.sort_array(F.collect_list(F.struct("pos", "t", "words"))).alias("x"))  # BLOCK turns at most
    own = own.select("conv", "j", F.transform("x", lambda v: v["t"]).alias("ts"), F.transform("x", lambda v: v["words"]).alias("ws"))
    zero = F.lit(0).cast("long")
    own = own.withColumns({f"d{i}": c for i, c in enumerate(_lanes(zero, zero, F.col("j"), F.col("ts")))})
    chained = running(written(own, "blocks"), ["conv"], [F.asc("j")], xors={f"q{i}": F.col(f"d{i}") for i in range(2)})
    return written(chained.select("conv", "j", *(F.col(f"q{i}").bitwiseXOR(F.col(f"d{i}")).alias(f"p{i}") for i in range(2)), "q0", "q1", "ts", "ws"), "chained-blocks")


def nodes_of(blocks: DataFrame, **measures: Column) -> DataFrame:
    """(depth, k0, k1, u0, u1, words, ...) of every node but the root: its key, its parent's key, the words of its last turn, and measures over its members.

    measures: conv is a smallest member, all others are counts or sums over the members.
    """
    again = {k: (F.min if k == "conv" else F.sum)(k) for k in measures}
    paths = blocks.groupBy("j", "p0", "p1", "q0", "q1").agg(F.first("ts").alias("ts"), F.first("ws").alias("ws"), *(c.alias(k) for k, c in measures.items()))
    paths = written(paths, "paths")
    siblings = written(paths.groupBy("j", "p0", "p1").agg(F.count("*").alias("paths")), "siblings")
    told = join_hot(paths, siblings.withColumn("diverge", F.col("paths") > 1), ["j", "p0", "p1"], "paths", paths.count())
    size = told.select("*", F.size("ts").alias("size"))
    steps = size.select(*size.columns, F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i"))
    after = lambda i: _lanes(F.col("p0"), F.col("p1"), F.col("j"), F.slice("ts", 1, i))
    k, u = after(F.col("i")), after(F.col("i") - 1)
    whole, first = F.col("i") == F.col("size"), F.col("i") == 1
    keys = [F.when(whole, F.col(f"q{i}")).otherwise(c).alias(f"k{i}") for i, c in enumerate(k)] + [F.when(first, F.col(f"p{i}")).otherwise(c).alias(f"u{i}") for i, c in enumerate(u)]
    turns = steps.select("diverge", (F.col("j") * BLOCK + F.col("i")).alias("depth"), *keys, F.get("ws", F.col("i") - 1).alias("words"), *measures)
    chains = turns.filter(~F.col("diverge")).drop("diverge")
    refined = turns.filter("diverge").groupBy("depth", "k0", "k1").agg(*(F.first(c).alias(c) for c in ("u0", "u1", "words")), *(c.alias(k) for k, c in again.items()))
    return chains.unionByName(refined)


NODE = ["depth", "k0", "k1"]


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k0, k1, ends_sha256) of ends (conv, depth, k0, k1): the ids that end at a node, in ascending order, joined by commas.

    The digest of a node needs its ids one after the other; ranges of them are joined to pieces of text first, so what
    goes through the node's task is a row for IDS_A_PIECE ids, streamed, never a list of ids.
    """
    placed = running(ends, NODE, [F.asc("conv")], {"place": F.lit(1).cast("long")})
    piece = F.floor((F.col("place") - 1) / IDS_A_PIECE)
    pieces = placed.groupBy(*NODE, piece.alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        key, state = None, None
        row = lambda: pa.RecordBatch.from_pydict({**{c: pa.array([x], pa.int64()) for c, x in zip(NODE, key, strict=True)}, "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            out = []
            for *k, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append(row())
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield from out
        if key is not None:
            yield row()

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_pieces = pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return sorted_pieces.mapInArrow(run, "depth long, k0 long, k1 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shared: Callable[[Column], Column] = lambda c: F.lit(0), base: Callable[[Column], Column] = lambda c: c, most: int = 0) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    shared, base, most: the first shared(c) <= most turns of conversation c are taken from conversation base(c) instead.
    """
    spark = conversations.sparkSession
    empty_sha = F.sha2(F.lit("").cast("binary"), 256)
    with scratch(spark):
        convs, turns = rebuilt(numbered_turns(digested(conversations)), shared, base, most)
        blocks = blocks_of(turns)
        last = blocks.groupBy("conv").agg(F.max_by(F.struct((F.col("j") * BLOCK + F.size("ts")).alias("depth"), F.col("q0").alias("k0"), F.col("q1").alias("k1")), "j").alias("e"), F.count("*").alias("n"))
        zero = F.lit(0).cast("long")
        ends = written(convs.join(last, "conv", "left").select("conv", F.coalesce("e.depth", zero).alias("depth"), F.coalesce("e.k0", zero).alias("k0"), F.coalesce("e.k1", zero).alias("k1"), F.coalesce("n", zero).alias("n")), "ends")
        root = ends.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).filter("n > 0").select(*(zero.alias(c) for c in NODE), *(F.lit(None).cast("long").alias(c) for c in ("u0", "u1")), zero.alias("words"), "n", "conv")
        nodes = written(nodes_of(blocks, n=F.count("*"), conv=F.min("conv")).unionByName(root), "nodes")
        children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u0").alias("k0"), F.col("u1").alias("k1")).agg(F.count("*").alias("n_children"))
        family = written(nodes.join(children, NODE, "left").select(*NODE, "u0", "u1", "words", "n", "conv", F.coalesce("n_children", zero).alias("n_children")), "family")
        # what a conversation stands for as the smallest member of nodes: saved words, and whether its end is a leaf
        own = family.withColumn("saved", (F.col("n") - 1) * F.col("words"))
        stands = own.groupBy("conv").agg(F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
        stands = written(ends.select("conv", "n").join(stands, "conv", "left").na.fill(0, ["saved", "leaf"]), "members")
        summed = nodes_of(join_hot(blocks, stands, ["conv"], "n", blocks.count()), saved=F.sum("saved"), leaf=F.sum("leaf")).select(*NODE, F.col("saved").alias("of_members"), F.col("leaf").alias("n_leaves"))
        summed = summed.unionByName(stands.agg(F.sum("saved").alias("of_members"), F.sum("leaf").alias("n_leaves")).filter("n_leaves is not null").select(*(zero.alias(c) for c in NODE), "of_members", "n_leaves"))
        # the smallest member's nodes from each on: all of its nodes' words but those above
        so_far = running(written(own, "own-nodes"), ["conv"], [F.asc("depth")], {"down_to": F.col("saved")})
        above = so_far.withColumn("above", F.col("down_to") - F.col("saved"))
        full = written(above.join(summed, NODE).withColumn("saved_tokens", F.col("of_members") - F.col("above")), "subtrees")
        parents = full.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("u0"), F.col("k1").alias("u1"), F.col("conv").alias("parent_conv_id"), "n_children")
        below = full.filter("depth > 0").withColumnRenamed("n_children", "own_children")
        with_parent = join_hot(below, parents, ["depth", "u0", "u1"], "n_children", full.count()).withColumnRenamed("own_children", "n_children")
        top = full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
        sha = ends_digests(ends.select("conv", *NODE))
        rows = with_parent.unionByName(top).join(sha, NODE, "left")
        out = rows.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty_sha).alias("ends_sha256"))
        return written(out, "trie", keep=True)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations, each after up to 3 first turns of the conversation of its twenty."""
    h = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)).cast("int")
    return prefix_trie(table(spark, sf_dir, "conversations"), h, lambda c: c - c % 20, 3)
