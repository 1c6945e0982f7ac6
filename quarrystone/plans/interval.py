"""Runs at intervals that match only what has changed.

A batch of vendor records is standardised and meets the members of its own blocks; only those pairs are scored.  A block
that grows beyond the limit takes its pairs away unless they share another one, a block that shrinks back gives its pairs
again.  Components take new edges between the components' names; only those that lost an edge or a record are
found again from their own edges.  Golden vendors of the components that took part are built again, all others stay.
So after any number of batches the tables hold what one run over all records gives, up to the master keys' numbers.

Each batch is one commit and is marked with the stream's name and its number in it, so a batch that Spark hands over
again changes nothing.  If the library or the stewards' decisions have changed since the batch before, old records
may read differently, and all landed records count as new.  Rows that go are few, so tables are appended to where nothing
goes and rewritten where something does; none of the work between is done on rows that don't take part.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrystone import config
from quarrystone.operators import components, golden, library, matching, standardize
from quarrystone.plans.engine import Engine
from quarrystone.sources.scratch import discard, written

BATCHES = "stream string, number long, version string, records long, pairs long, at timestamp"
BLOCKS, LABELS = "block string, record_key string", "record_key string, component string"
HISTORY = "master_key string, record_key string, run_no long"


def match_batch(engine: Engine, raw: DataFrame, number: int, stream: str = "vendors", max_block: int = config.MAX_BLOCK) -> int:
    """Take a batch of canonical vendor extracts in; gives the number of pairs that were scored.  A record that is
    there already is replaced; of several in one batch the last by all columns counts."""
    done = engine.store.read("match_batches", BATCHES)
    if not done.where((F.col("stream") == stream) & (F.col("number") == number)).isEmpty():
        return 0
    with engine.store.commit():
        return _match_batch(engine, raw, number, stream, max_block, done)


def _match_batch(engine: Engine, raw: DataFrame, number: int, stream: str, max_block: int, done: DataFrame) -> int:
    store, spark = engine.store, engine.spark
    state = f"{library.version(engine.history())}/{engine.store.read('steward_decisions', library.DECISIONS).count()}"
    at = done.count()  # one row for a batch
    store.append("landed_vendors", matching.latest(raw, ["record_key"], sorted(c for c in raw.columns if c != "record_key")).select(raw.columns).withColumn("_batch", F.lit(at).cast("long")))
    landed = store.read("landed_vendors")
    last = done.orderBy(F.desc("at"), F.desc("number")).first()
    again = last is not None and last["version"] != state
    rows = matching.latest(landed, ["record_key"], ["_batch"]) if again else landed.where(F.col("_batch") == at)
    new = written(standardize.vendors(rows.drop("_batch"), engine.mappings()), "new")
    held = [new]

    def old(name: str, schema) -> DataFrame:
        """A table before this batch: none of it if everything counts as new."""
        return spark.createDataFrame([], schema) if again else store.read(name, schema)

    def keep(df: DataFrame, name: str) -> DataFrame:
        held.append(written(df, name))
        return held[-1]

    def put(name: str, before: DataFrame, gone: DataFrame, on: list[str], add: DataFrame) -> None:
        """Take the rows with keys in gone out of a table, and add others."""
        if again or not before.join(gone, on, "left_semi").isEmpty():
            store.write(name, before.join(gone, on, "left_anti").select(add.columns).unionByName(add))
        else:
            store.append(name, add)

    # Blocks that a new, changed or moved record is or was in.
    keys = new.select("record_key")
    vendors, blocks = old("silver_vendor", new.schema), old("vendor_blocks", BLOCKS)
    changed = keep(vendors.join(keys, "record_key", "left_semi").select("record_key").distinct(), "changed")
    mine = keep(matching.block_keys(new), "mine")
    gone = blocks.join(changed, "record_key", "left_semi")
    touched = keep(mine.select("block").unionByName(gone.select("block")).distinct(), "touched")
    before = blocks.join(touched, "block", "left_semi").groupBy("block").agg(F.count("*").alias("was"))
    around = blocks.join(touched, "block", "left_semi").join(changed, "record_key", "left_anti").select("block", "record_key", F.lit(False).alias("new"))
    around = keep(around.unionByName(mine.select("block", "record_key", F.lit(True).alias("new"))), "around")
    sizes = touched.join(before, "block", "left").join(around.groupBy("block").agg(F.count("*").alias("now")), "block", "left")
    usable = lambda c: F.coalesce(F.col(c).between(2, max_block), F.lit(False))
    sizes = keep(sizes.select("block", usable("was").alias("was"), usable("now").alias("now")), "sizes")

    # Pairs: with a new record, or in a block that has just become usable.
    inside = around.join(sizes.where("now"), "block")
    side = lambda df, s: df.select("block", F.col("record_key").alias(f"{s}_key"), F.col("new").alias(f"{s}_new"), "was")
    pairs = side(inside, "left").join(side(inside, "right").drop("was"), "block").where("left_key < right_key AND (left_new OR right_new OR NOT was)")
    pairs = keep(pairs.select("left_key", "right_key").distinct(), "pairs")
    # Pairs of a block that has become too large go, unless they share a block that is usable still.
    put("vendor_blocks", blocks, changed, ["record_key"], mine)
    every = store.read("vendor_blocks", BLOCKS)
    over = around.join(sizes.where("was AND NOT now"), "block").where("NOT new").select("block", "record_key")
    apart = over.withColumnRenamed("record_key", "left_key").join(over.withColumnRenamed("record_key", "right_key"), "block").where("left_key < right_key").select("left_key", "right_key").distinct()
    theirs = keep(every.join(over.select("record_key").distinct(), "record_key", "left_semi"), "theirs")
    fit = every.join(theirs.select("block").distinct(), "block", "left_semi").groupBy("block").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_block)).select("block")
    fitting = theirs.join(fit, "block")
    shared = fitting.withColumnRenamed("record_key", "left_key").join(fitting.withColumnRenamed("record_key", "right_key"), "block").where("left_key < right_key").select("left_key", "right_key").distinct()
    lost = apart.join(shared, ["left_key", "right_key"], "left_anti")

    put("silver_vendor", vendors, changed, ["record_key"], new)
    vendors = store.read("silver_vendor")
    taking_part = pairs.select(F.explode(F.array("left_key", "right_key")).alias("record_key")).distinct()
    scored = keep(engine.judged(vendors.join(taking_part, "record_key", "left_semi").select(vendors.columns), pairs), "scored")
    had = old("silver_match_pairs", scored.schema)
    of = lambda s: had.join(changed.withColumnRenamed("record_key", s), s, "left_semi")
    two = ["left_key", "right_key"]
    out = keep(of("left_key").unionByName(of("right_key")).select(*two, "merge").unionByName(had.join(lost, two, "left_semi").select(*two, "merge")).distinct(), "out")
    replaced = out.select(two).unionByName(pairs).distinct()
    put("silver_match_pairs", had, replaced, two, scored)
    merges = store.read("silver_match_pairs").where("merge").select(*two, F.col("decided_by").alias("reason"), "score")

    # Components: those that lost something are found again from their own edges, the others by their names.
    labels = old("vendor_components", LABELS)
    ended = out.where("merge").select(F.explode(F.array("left_key", "right_key")).alias("record_key")).unionByName(changed)
    unmerged = had.where("merge").join(pairs, two, "left_semi").select(F.explode(F.array("left_key", "right_key")).alias("record_key"))
    broken = keep(labels.join(ended.unionByName(unmerged).distinct(), "record_key", "left_semi").select("component").distinct(), "broken")
    loose = keep(labels.join(broken, "component", "left_semi").select("record_key"), "loose")
    named = labels.join(broken, "component", "left_anti").join(changed, "record_key", "left_anti")
    own = merges.join(loose.withColumnRenamed("record_key", "left_key"), "left_key", "left_semi").select(two)
    added = scored.where("merge").select(two)
    edges = own.unionByName(added).distinct()
    for s in two:
        edges = edges.join(named.select(F.col("record_key").alias(s), F.col("component").alias("_name")), s, "left").withColumn(s, F.coalesce("_name", s)).drop("_name")
    found = components.components(edges.select(F.col("left_key").alias("a"), F.col("right_key").alias("b")))
    held.append(found)
    here = found.withColumnRenamed("component", "_new")
    moved = named.join(here.withColumnRenamed("node", "component"), "component").select("record_key", F.col("_new").alias("component"))
    single = loose.unionByName(keys).distinct().join(here.withColumnRenamed("node", "record_key"), "record_key", "left")
    fresh = keep(moved.unionByName(single.select("record_key", F.coalesce("_new", "record_key").alias("component"))), "fresh")
    put("vendor_components", labels, fresh.select("record_key"), ["record_key"], fresh)

    # Golden vendors of these components.
    clusters = fresh.withColumnRenamed("component", "cluster")
    if engine.profile.constrained:
        inner = merges.join(fresh.select(F.col("record_key").alias("left_key")), "left_key", "left_semi").select(*two, "score")
        clusters, _ = components.constrained_clusters(fresh.select("record_key"), inner, library.cannot_links(engine.history()))
    past = store.read("gold_vendor_xref_history", HISTORY)
    previous = matching.latest(past, ["record_key"], ["run_no", "master_key"]) if store.exists("gold_vendor_xref_history") else None
    gold, xref = golden.build(vendors.join(fresh.select("record_key"), "record_key", "left_semi").select(vendors.columns), clusters, previous, past)
    gold, xref = keep(gold, "gold"), keep(xref, "xref")
    golds, xrefs = old("gold_vendor", gold.schema), old("gold_vendor_xref", xref.schema)
    rebuilt = keep(xrefs.join(fresh.select("record_key"), "record_key", "left_semi").select("master_key").distinct(), "rebuilt")
    put("gold_vendor", golds, rebuilt, ["master_key"], gold)
    put("gold_vendor_xref", xrefs, rebuilt, ["master_key"], xref)
    run_no = int(past.agg(F.coalesce(F.max("run_no"), F.lit(0).cast("long"))).first()[0]) + 1
    store.append("gold_vendor_xref_history", xref.select("master_key", "record_key", F.lit(run_no).cast("long").alias("run_no")))
    n = pairs.count()
    store.append("match_batches", spark.createDataFrame([(stream, number, state, new.count(), n, datetime.now(timezone.utc).replace(tzinfo=None))], BATCHES))
    discard(*held)
    return n


def at_intervals(engine: Engine, stream: DataFrame, checkpoint: str, name: str = "vendors", every: str | None = None) -> StreamingQuery:
    """Batches of a stream of canonical vendor extracts, at an interval (like "10 minutes"), or what is there if none
    is given.  The numbers are those of the checkpoint, so a stream keeps its name and its checkpoint together."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(lambda df, number: match_batch(engine, df, number, name)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
