"""Parent links of unknown depth as full hierarchies, by heavy-path decomposition.

Everything is done in rounds of joins and partial aggregates over the whole
forest; no tree, however large, is gathered in one task:

1. *Pointer doubling* over the links. After k rounds a node knows its ancestor
   2^k above, and ``size`` counts its descendants less than 2^k below, so the
   same rounds give subtree sizes. The smallest key among the ancestors passed
   so far shows loops: a node that meets itself is on one. *Cycle separation*
   then takes out the loops and all that leads into them.
2. *Heavy paths*: each node's heavy child is the one with the largest subtree
   (ties: the smaller key). Heavy links form chains; doubling along them finds
   every node's chain head.
3. *Chain tree*: a root path crosses at most log2(n) chains, so doubling over
   chains needs a few rounds. It concatenates the chain segments of the path and
   adds up positions: depth, topmost ancestor and the preorder number.
4. Descendants of a node are the nodes of its tree with preorder numbers from
   ``pre`` to ``pre + size - 1``: an interval instead of a list of pairs.

Defined results: NULL and empty ids are no nodes; an empty parent is no link; a
link to oneself is a loop; repeated rows count once; of several parents the
latest counts; a parent that does not exist makes its child a top; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.runtime import blank_to_null, running_total, stage, unstage


def links(df: DataFrame, node: str, parent: str, order: list[str], keep: str | None = None) -> DataFrame:
    """One row per node: ``node``, ``parent`` (NULL without), ``named`` (it has a parent in some row) and the latest value of ``keep``.

    The latest non-empty parent by ``order`` counts, as later states may leave it empty.
    """
    n, p = blank_to_null(F.col(node)), blank_to_null(F.col(parent))
    at = F.struct(*[F.col(c) for c in order])
    return (
        df.select(n.alias("node"), F.when(p.isNotNull(), F.struct(at, p)).alias("by"), p.alias("p"), at.alias("at"), (F.col(keep) if keep else F.lit(None).cast("string")).alias("kept"))
        .where("node is not null")
        .groupBy("node")
        .agg(F.max_by("p", "by").alias("parent"), F.max_by("kept", "at").alias("kept"))
        .withColumn("named", F.col("parent").isNotNull())
    )


_SEGMENTS = "array<struct<chain:string,upto:bigint>>"


def resolve(forest: DataFrame) -> DataFrame:
    """The hierarchy of (node, parent, ...); what else ``forest`` has is passed on.

    Returns node, parent (NULL if it does not exist), top (NULL in loops),
    depth (-1 in loops), in_loop, size (nodes in the subtree, itself included),
    chain (head of the heavy path), chain_pos, pre, segments: array of
    (chain, upto) from the top down; joined, they are the full path.
    """
    keep = [c for c in forest.columns if c not in ("node", "parent")]
    known = forest.select(F.col("node").alias("known"))
    base = stage(forest.join(known, forest["parent"] == known["known"], "left").select("node", F.col("known").alias("parent"), *keep))
    doubled = _double(base)
    unstage(base)
    good = doubled.where("not in_loop")
    # heavy child of each parent, with map-side partial aggregation
    heavy = (
        good.where("parent is not null")
        .groupBy("parent")
        .agg(F.min_by("node", F.struct(-F.col("size"), "node")).alias("heavy"), F.max("size").alias("heavy_size"))
        .withColumnRenamed("parent", "of")
    )
    marked = stage(
        good.join(heavy, good["parent"] == heavy["of"], "left").select(
            "node",
            "parent",
            *keep,
            "size",
            (F.col("node") == F.coalesce(F.col("heavy"), F.lit(""))).alias("is_heavy"),
            F.coalesce("heavy_size", F.lit(0)).alias("heavy_size"),
        )
    )
    chained = _chains(marked)
    # preorder offset of a light child: behind its parent, the heavy subtree and its earlier siblings
    light = marked.where("parent is not null and not is_heavy").select("node", "parent", "size", "heavy_size")
    shift = running_total(light, ["parent"], ["node"], "size", "before").select(
        F.col("node").alias("head"), (1 + F.col("heavy_size") + F.col("before")).alias("shift")
    )
    nodes = stage(chained)
    unstage(marked)
    # one row per chain: where it hangs (the chain of its head's parent and the position there)
    heads = nodes.where("node = chain").select(F.col("node").alias("head"), "parent")
    at = nodes.select(F.col("node").alias("at"), F.col("chain").alias("up"), F.col("chain_pos").alias("up_pos"))
    hangs = F.col("up").isNotNull()
    tree = (
        heads.join(at, heads["parent"] == at["at"], "left")
        .join(shift, "head", "left")
        .select(
            "head",
            "up",
            F.when(hangs, F.col("up_pos") + 1).otherwise(0).alias("depth"),
            F.when(hangs, F.col("up_pos") + F.col("shift")).otherwise(0).alias("pre"),
            F.when(hangs, F.array(F.struct(F.col("up").alias("chain"), F.col("up_pos").alias("upto")))).otherwise(F.array().cast(_SEGMENTS)).alias("above"),
            F.coalesce("up", "head").alias("top"),
        )
    )
    tree = _compose(tree)
    out = nodes.join(tree, nodes["chain"] == tree["head"], "inner").select(
        "node",
        "parent",
        *keep,
        F.col("top"),
        (F.col("depth") + F.col("chain_pos")).alias("depth"),
        F.lit(False).alias("in_loop"),
        "size",
        "chain",
        "chain_pos",
        (F.col("pre") + F.col("chain_pos")).alias("pre"),
        F.concat("above", F.array(F.struct("chain", F.col("chain_pos").alias("upto")))).alias("segments"),
    )
    no = lambda c, t: F.lit(None).cast(t).alias(c)
    lost = doubled.where("in_loop").select(
        "node", "parent", *keep, no("top", "string"), F.lit(-1).cast("bigint").alias("depth"), F.lit(True).alias("in_loop"), no("size", "bigint"), no("chain", "string"),
        no("chain_pos", "bigint"), no("pre", "bigint"), F.array().cast(_SEGMENTS).alias("segments"),
    )
    return out.unionByName(lost)


def _double(base: DataFrame) -> DataFrame:
    """Adds size and in_loop.

    ``ptr`` is the ancestor 2^k above, ``least`` the smallest key among the
    ancestors up to there, ``size`` the descendants less than 2^k below, the node
    included. A node whose ancestor 2^k above doesn't exist is done and leaves the
    rounds; what later rounds still find below it is added up once at the end, from the
    rounds' tables, so a round costs no more than the nodes deeper than 2^k. A loop's
    smallest node meets itself in round log2(loop length); then the whole loop
    is marked, and marks travel down to all that leads into it.
    """
    cur = stage(
        base.where("parent is not null").select(
            "node",
            F.col("parent").alias("ptr"),
            F.col("parent").alias("least"),
            F.lit(1).cast("bigint").alias("size"),
            (F.col("parent") == F.col("node")).alias("looped"),
        )
    )
    spent: list[DataFrame] = []
    grown = lambda t: t.where("not looped").groupBy(F.col("ptr").alias("at")).agg(F.sum("size").alias("more"))
    while not cur.where("not looped").isEmpty():
        spent.append(cur)
        below = grown(cur)
        up = cur.select(
            F.col("node").alias("u"), F.col("ptr").alias("u_ptr"), F.col("least").alias("u_least"), F.col("looped").alias("u_looped")
        )
        cur = stage(
            cur.join(up, (cur["ptr"] == up["u"]) & ~cur["looped"], "left")
            .join(below, cur["node"] == below["at"], "left")
            .select(
                "node",
                F.when(~F.col("looped"), F.col("u_ptr")).alias("ptr"),
                F.least("least", "u_least").alias("least"),
                (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
                (F.col("looped") | F.coalesce("u_looped", F.lit(False))).alias("looped"),
            )
            .where("looped or ptr is not null")
        )
        met = cur.where("least = node and not looped").select(F.col("node").alias("met"))
        if not met.isEmpty():
            # all windows of a loop's nodes now span the loop and share its smallest key
            marked = stage(
                cur.join(met, cur["least"] == met["met"], "left").select("node", "ptr", "least", "size", (F.col("looped") | F.col("met").isNotNull()).alias("looped"))
            )
            unstage(cur)
            cur = marked
    gains = base.select(F.col("node").alias("at"), F.lit(1).cast("bigint").alias("more"))
    for t in spent:
        gains = gains.unionByName(grown(t))
    sizes = gains.groupBy(F.col("at").alias("node")).agg(F.sum("more").alias("size"))
    lost = cur.select(F.col("node").alias("lost"))
    out = base.join(sizes, "node").join(lost, F.col("node") == F.col("lost"), "left")
    out = stage(out.select("node", *[c for c in base.columns if c != "node"], "size", F.col("lost").isNotNull().alias("in_loop")))
    for t in (*spent, cur):
        unstage(t)
    return out


def _chains(marked: DataFrame) -> DataFrame:
    """Adds chain (the head) and chain_pos by doubling along heavy links.

    Only heavy nodes take part; what a heavy link leads to and is none itself is a head.
    """
    cur = stage(
        marked.where("is_heavy").select(
            "node", F.col("parent").alias("chain"), F.lit(1).cast("bigint").alias("chain_pos"), F.lit(True).alias("moving")
        )
    )
    while not cur.where("moving").isEmpty():
        up = cur.select(F.col("node").alias("u"), F.col("chain").alias("u_chain"), F.col("chain_pos").alias("u_pos"), F.col("moving").alias("u_moving"))
        nxt = stage(
            cur.join(up, cur["moving"] & (cur["chain"] == up["u"]), "left").select(
                "node",
                F.coalesce("u_chain", "chain").alias("chain"),
                (F.col("chain_pos") + F.coalesce("u_pos", F.lit(0))).alias("chain_pos"),
                F.coalesce("u_moving", F.lit(False)).alias("moving"),
            )
        )
        unstage(cur)
        cur = nxt
    on_chain = cur.select(F.col("node").alias("_n"), "chain", "chain_pos")
    keep = [c for c in marked.columns if c not in ("is_heavy", "heavy_size")]
    return marked.join(on_chain, marked["node"] == on_chain["_n"], "left").select(
        *keep, F.coalesce("chain", "node").alias("chain"), F.coalesce("chain_pos", F.lit(0)).alias("chain_pos")
    )


def _compose(tree: DataFrame) -> DataFrame:
    """Adds up depth and pre and joins the segments along the chain tree."""
    cur = stage(tree)
    while not cur.where("up is not null").isEmpty():
        above = cur.select(*[F.col(c).alias(f"a_{c}") for c in cur.columns])
        nxt = cur.join(above, cur["up"] == above["a_head"], "left").select(
            "head",
            F.col("a_up").alias("up"),
            (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"),
            (F.col("pre") + F.coalesce("a_pre", F.lit(0))).alias("pre"),
            F.concat(F.coalesce("a_above", F.array().cast("array<struct<chain:string,upto:bigint>>")), "above").alias("above"),
            F.coalesce("a_top", "top").alias("top"),
        )
        nxt = stage(nxt)
        unstage(cur)
        cur = nxt
    return cur


def full_paths(resolved: DataFrame) -> DataFrame:
    """(node, path): all ancestors from the top down to the node itself.

    Each segment is cut from its chain, whose nodes are put in order once; a chain
    is no longer than the longest path of the output. Nodes in loops have none.
    """
    chains = resolved.where("not in_loop").groupBy("chain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chain_pos", "node"))), lambda x: x["node"]).alias("members")
    )
    parts = resolved.where("not in_loop").select("node", F.posexplode("segments").alias("k", "seg"))
    cut = parts.join(chains, parts["seg"]["chain"] == chains["chain"]).select(
        "node", "k", F.slice("members", F.lit(1), (F.col("seg")["upto"] + 1).cast("int")).alias("piece")
    )
    return cut.groupBy("node").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"])).alias("path")
    )


#: Preorder numbers of one bucket in the search for descendants.
BUCKET = 1024


def descendants(resolved: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ancestor, node, below) for the ``wanted`` nodes (column node).

    A range join in buckets of preorder numbers: a wanted node's interval is cut at the buckets' borders, so
    a join key never has more than BUCKET nodes and the work is that of the output, however large one tree is.
    """
    bucket = lambda c: F.floor(c / BUCKET).cast("bigint")
    a = resolved.where("not in_loop").join(wanted.select("node").distinct(), "node", "left_semi").select(
        F.col("node").alias("ancestor"), F.col("top").alias("a_top"), F.col("pre").alias("a_pre"), F.col("size").alias("a_size"), F.col("depth").alias("a_depth"),
        F.explode(F.sequence(bucket(F.col("pre")), bucket(F.col("pre") + F.col("size") - 1))).alias("a_bucket"),
    )
    d = resolved.where("not in_loop").select("node", "top", "pre", "depth", bucket(F.col("pre")).alias("bucket"))
    inside = (F.col("pre") > F.col("a_pre")) & (F.col("pre") < F.col("a_pre") + F.col("a_size"))
    return a.join(d, (F.col("top") == F.col("a_top")) & (F.col("bucket") == F.col("a_bucket")) & inside).select(
        "ancestor", "node", (F.col("depth") - F.col("a_depth")).alias("below")
    )


SEP = "\x1f"


def session_links(sessions: DataFrame) -> DataFrame:
    return links(sessions, "id", "parent_session_id", ["ingested_at", "row_id"], "source_id")


def event_links(events: DataFrame) -> DataFrame:
    """Links of session_started events; a key is SourceID and NativeID together."""
    j = lambda k: blank_to_null(F.get_json_object("payload", f"$.{k}"))
    src = F.coalesce(j("SourceID"), F.lit(""))
    started = events.where("kind = 'session_started'").select(
        F.concat(src, F.lit(SEP), j("NativeID")).alias("n"),
        F.concat(src, F.lit(SEP), j("ParentNativeID")).alias("p"),
        F.coalesce(j("Ts").cast("bigint"), F.lit(0)).alias("ts"),
        "event_id",
    )
    return links(started, "n", "p", ["ts", "event_id"])


def session_forest(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Both forests in one pass: keys carry their table, so the rounds are shared.

    Columns of ``resolve`` and src_table, source_id, node_id, top_id.
    """
    mark = lambda c, t: F.concat(F.lit(t + SEP), F.col(c))
    s = session_links(sessions).select(mark("node", "s").alias("node"), mark("parent", "s").alias("parent"), "named", "kept")
    e = event_links(events).select(mark("node", "e").alias("node"), mark("parent", "e").alias("parent"), "named", "kept")
    r = resolve(s.unionByName(e))
    is_s = F.col("node").startswith("s" + SEP)
    last = lambda c: F.element_at(F.split(F.col(c), SEP), -1)
    return r.select(
        F.when(is_s, "sessions").otherwise("expected_events").alias("src_table"),
        F.when(is_s, F.col("kept")).otherwise(F.split(F.col("node"), SEP)[1]).alias("source_id"),
        last("node").alias("node_id"),
        F.coalesce(last("top"), F.lit("")).alias("top_id"),
        *[c for c in r.columns if c != "kept"],
    )
