"""A trie of conversation prefixes, by smallest-member ownership.

A conversation's turns are put in order (turn, role, MD5 of the text; null turns first), then it is rebuilt: the first
h turns of its base conversation (conv_id - conv_id % 20), then its own after its first h, where h is the crc32 of its
number modulo 4.  Texts are read once; afterwards a turn is 128 bits and a number of words.

A prefix is named by the exclusive or of the MD5 sums of (depth, role, text) of its turns, 128 bits, so prefixes are
running sums and never need a conversation in one row or task: rows are dealt by range over (conversation, depth), the
running sum inside a block is a window over block and conversation, and what earlier blocks hold is added from a table
of one row for each block and conversation that goes on there.

Ownership: each node belongs to its smallest member.  As members only get fewer along a path, a conversation owns
a suffix of its path.  Windows mark the owned nodes: first over (node, salt), so a first turn that a third of all
conversations share is dealt over as many tasks as there are shuffle partitions, then over the nodes' winners.  One
group-by of prefixes gives the rest: the tokens that sharing saves below a node are the tokens of all its members'
occurrences there less those of owned nodes, leaves are owned ends without children, children are owned next nodes.

The ids of a node's ends are joined in order inside range blocks, up to CHUNK_IDS to a row; SHA-256 is
sequential, so the chunks of a node meet in one task, which holds a hash state and one batch, not the list.

Defined cases: null role and text are empty, rows without conv_id are no conversation's and are left out; equal turns are
ordered as above and repeated rows are turns of their own; a conversation whose rebuilt turns are none is an end of
the root; conv_id % 20 has the sign of conv_id; very long texts are read whole; other columns, whatever their names,
are ignored; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm.base import discard, on, written
from quarrystone.llm.ordered import in_blocks, running

FAMILY, SHARED_TURNS = 20, 4
CHUNK_IDS = 1024
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_WORD = r"[^\x20\x09-\x0D]+"
_NONE = hashlib.sha256(b"").hexdigest()


def _halves(of: Column) -> tuple[Column, Column]:
    """An MD5 sum as two longs."""
    h = F.md5(of)
    return tuple(F.conv(F.substring(h, a, 16), 16, -10).cast("long") for a in (1, 17))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv, depth, role, text's hash a and b, words) and all conversations (conv)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    a, b = _halves(text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), a.alias("a"), b.alias("b"), F.md5(text).alias("name"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")
    )
    blocks = in_blocks(rows, "conv", "turn", "role", "name")
    turns = written(running(blocks.withColumn("one", F.lit(1).cast("long")), "conv", {"at": ("sum", "one")}).select("conv", "at", "role", "a", "b", "words"), "turns")
    discard(blocks)
    borrowed = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED_TURNS
    convs = turns.where("at = 1").select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), borrowed.alias("h"))
    # A base has at most SHARED_TURNS - 1 of its turns here, a family at most 2 * FAMILY - 1 conversations.
    lent = turns.where(F.col("at") < SHARED_TURNS).withColumnRenamed("conv", "base")
    first = convs.where("h > 0").join(lent, "base").where("at <= h")
    held = first.groupBy("conv").agg(F.count("*").alias("n_base"))
    own = turns.where(F.col("at") > F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED_TURNS).withColumn("h", borrowed)
    # A conversation that holds a third of all rows meets its one row here; Spark splits it.
    own = own.join(held, "conv", "left").withColumn("at", F.col("at") - F.col("h") + F.coalesce("n_base", F.lit(0)))
    columns = ["conv", F.col("at").alias("depth"), "role", "a", "b", "words"]
    return on(first.select(*columns).unionByName(own.select(*columns)), turns), convs.select("conv")


def _ends_hash(ends: DataFrame) -> DataFrame:
    """(node columns x and y, ends_sha256) of ends (x, y, conv)."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, mine = None, []
        out: list[tuple] = []
        for batch in batches:
            for x, y, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if mine and ((x, y) != node or len(mine) == CHUNK_IDS):
                    out.append((*node, mine[0], ",".join(map(str, mine))))
                    mine = []
                node = x, y
                mine.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if mine:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, mine[0], ",".join(map(str, mine))), schema, strict=True)], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
        node, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for x, y, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (x, y) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (x, y), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, state.hexdigest()), target, strict=True)], schema=target)

    joined = ends.repartitionByRange("x", "y", "conv").sortWithinPartitions("x", "y", "conv").mapInArrow(chunks, "x long, y long, first long, ids string")
    # Chunks of a node that one block cut follow each other by their first ids.
    return joined.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(hashed, "x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    place = F.concat_ws("\0", F.col("depth"), F.col("role"), F.hex("a"), F.hex("b"))
    p, q = _halves(place)
    blocks = in_blocks(turns.select("conv", "depth", "words", p.alias("p"), q.alias("q")), "conv", "depth")
    path = running(blocks, "conv", {"x": ("xor", "p"), "y": ("xor", "q")})
    path = path.select("conv", "depth", "words", "x", "y", F.col("x").bitwiseXOR(F.col("p")).alias("up_x"), F.col("y").bitwiseXOR(F.col("q")).alias("up_y"))
    path = written(path.join(blocks.groupBy("conv").agg(F.max("depth").alias("length")), "conv"), "path")
    discard(blocks)

    # Who owns a node, and whether a member goes on below it.
    node = ["x", "y", "depth"]
    salt = F.pmod(F.xxhash64("conv"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    near = Window.partitionBy(*node, salt)
    marked = path.select("*", (F.row_number().over(near.orderBy("conv")) == 1).alias("first"), F.max(F.col("length") > F.col("depth")).over(near).alias("goes_on"))
    marked = written(marked, "marked")
    of = Window.partitionBy(*node)
    winners = marked.where("first").select("conv", "depth", (F.row_number().over(of.orderBy("conv")) == 1).alias("owned"), F.max("goes_on").over(of).alias("goes_on"), "length")
    owners = winners.where("owned").groupBy("conv").agg(F.min("depth").alias("own_from"), F.max(((F.col("depth") == F.col("length")) & ~F.col("goes_on")).cast("int")).alias("leaf"))
    owners = written(owners, "owners")  # one row for a conversation that owns anything

    # What sharing saves along each path, from a depth to its end; own_from is beyond the end for those who own nothing.
    beyond = F.coalesce("own_from", F.col("length") + 1)
    occurrences = marked.drop("first", "goes_on").join(owners, "conv", "left").withColumn("own_from", beyond).withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    occurrences = occurrences.withColumn("given", F.when(F.col("depth") < F.col("own_from"), F.col("words")).otherwise(0)).withColumn("back", -F.col("depth"))
    blocks = in_blocks(occurrences, "conv", "back")
    saved = written(running(blocks, "conv", {"saved": ("sum", "given")}), "saved")
    discard(path, marked, blocks, owners)
    next_owned = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("own_from"))
    nodes = saved.groupBy(*node).agg(
        F.min("conv").alias("conv_id"),
        F.min("up_x").alias("up_x"),
        F.min("up_y").alias("up_y"),
        F.count("*").alias("n_convs"),
        F.sum(next_owned.cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    nodes = written(nodes, "nodes")
    ends = written(_ends_hash(saved.where("depth = length").select("x", "y", "conv")), "ends")
    above = nodes.select(F.col("x").alias("up_x"), F.col("y").alias("up_y"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_up"))
    # The root, which all conversations share, is some numbers instead of a key.
    everyone = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n")).first()
    top = saved.where("depth = 1").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.sum((F.col("own_from") <= 1).cast("long")).alias("children")).first()
    turnless = convs.join(saved.where("depth = 1").select("conv"), "conv", "left_anti").select(*(F.lit(0).cast("long").alias(c) for c in ("x", "y")), "conv")
    ended = _ends_hash(turnless).first()
    values = everyone["least"], 0, None, everyone["n"], top["children"] or 0, top["leaves"] or 1, top["saved"] or 0, ended["ends_sha256"] if ended else _NONE
    root = spark.createDataFrame([values] if everyone["n"] else [], NODE)
    parent = F.when(F.col("depth") == 1, F.lit(everyone["least"])).otherwise(F.col("_up"))
    out = nodes.join(above.where("depth > 1"), ["up_x", "up_y", "depth"], "left").join(ends, ["x", "y"], "left")
    out = out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
    discard(saved, turns)
    return on(out.unionByName(root), nodes, ends)
