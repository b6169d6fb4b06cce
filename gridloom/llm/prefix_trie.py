"""A trie over the prefixes of rebuilt conversations, merged family by family first.

A family is the conversations of one base id. Its rows meet in one task, the base conversation first, so the turns
that members take over from it are at hand; each member's turns are folded into the family's trie in order. Only the
family's combined nodes leave the task, and nodes of the same prefix are merged over all families.

A node's key is a chain of SHA-256 over its turns, so equal prefixes have equal keys wherever they are made. Texts
are not shuffled: a turn travels as its digest and its number of words.

What lies below a node is summed over nodes with two members or more. Below a node with one member stands a single
chain: one leaf, and nothing saved. The shared nodes are summed by pointer doubling, so that rounds grow with the
logarithm of the depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pick, skew_safe_join, stored

#: Conversations c with the same c - c % FAMILY are a family; a member takes over crc32(c) % HEADS turns of its base.
FAMILY, HEADS = 20, 4
#: Nodes of one family that a task holds before it sends what it has of them.
FLUSH_NODES = 1 << 14
ROOT = b""
NODES = "key binary, parent binary, depth long, words long, conv_id long, n_convs long, ends array<long>"
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORDS = r"[^\x20\x09-\x0D]+"
MOST_ROUNDS = 62


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


class Family:
    """The combined nodes of one family, as far as they are not sent yet."""

    def __init__(self, number):
        self.number, self.nodes = number, {}

    def member(self, key: bytes, parent: bytes | None, depth: int, words: int, conv: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = [parent, depth, words, conv, 0, []]
        node[3] = min(node[3], conv)
        node[4] += 1

    def batch(self) -> pa.RecordBatch:
        rows = [(key, *node) for key, node in self.nodes.items()]
        self.nodes = {}
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=["key", "parent", "depth", "words", "conv_id", "n_convs", "ends"])


def _families(batches):
    """(family, conv_id, head, turn's digest, words), sorted by family, base first, conversation and turn -> nodes.

    A conversation's ends are noted when its last turn is known, which may be after an earlier part of its nodes left.
    """
    family, conv, head, base, own, path = None, None, 0, [], 0, (ROOT, None, 0, 0)

    def step(digest: bytes, words: int) -> None:
        nonlocal path
        key = hashlib.sha256(path[0] + digest).digest()
        path = (key, path[0], path[2] + 1, words)
        family.member(*path, conv)

    def close() -> None:
        if conv is None:
            return
        if path[0] not in family.nodes:  # sent already: a row that adds an end and no member
            family.nodes[path[0]] = [path[1], path[2], path[3], conv, 0, []]
        family.nodes[path[0]][5].append(conv)

    for batch in batches:
        for f, c, h, digest, words in zip(*(x.to_pylist() for x in batch.columns)):
            if c != conv:
                close()
                if family is None or f != family.number:
                    if family is not None:
                        yield family.batch()
                    family, base = Family(f), []
                conv, head, own, path = c, h, 0, (ROOT, None, 0, 0)
                family.member(*path, conv)
                for d, w in [] if c == f else base[:h]:
                    step(d, w)
            if c == f and len(base) < HEADS - 1:
                base.append((digest, words))
            own += 1
            if c == f or own > head:
                step(digest, words)
                if len(family.nodes) >= FLUSH_NODES:
                    yield family.batch()
    if family is not None:
        close()
        yield family.batch()


def _ends(batches):
    """(key, end) sorted -> (key, digest of all its ends, comma-joined); holds one batch at a time."""
    key, digest = None, None
    for batch in batches:
        rows = []
        for k, end in zip(*(x.to_pylist() for x in batch.columns)):
            if digest is not None and k == key:
                digest.update(b",")
            else:
                if digest is not None:
                    rows.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            digest.update(str(end).encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def family_nodes(conversations: DataFrame) -> DataFrame:
    """Each family's own combined nodes: rows of NODES; a node of a large family may come in several rows."""
    c = pick(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    role, text, conv = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("conv_id")
    turns = c.select(
        (conv - conv % FAMILY).alias("family"), "conv_id", F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS)).cast("int").alias("head"), "turn",
        F.unhex(turn_digest(role, text)).alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    met = turns.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", "turn", "digest")
    return met.select("family", "conv_id", "head", "digest", "words").mapInArrow(_families, NODES)


def below(shared: DataFrame) -> DataFrame:
    """Sums over what lies below each node, itself included: rows (key, n_leaves, saved_tokens).

    ``shared``: (key, to, n_leaves, saved_tokens), ``to`` the parent's key or null. Doubling: after k rounds the sums
    take in all that lies less than 2**k levels below, and ``to`` is 2**k levels up. A node that a third of all
    others point to is joined without being one task's.
    """
    s = stored(shared)
    for _ in range(MOST_ROUNDS):
        pointing = s.where(F.col("to").isNotNull())
        total = pointing.count()
        if not total:
            return s.select("key", "n_leaves", "saved_tokens")
        gets = pointing.groupBy("to").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        # Of each node that is pointed to: where it points itself, and what it gets.
        targets = gets.join(s.select(F.col("key").alias("to"), F.col("to").alias("far")), "to")
        moved = skew_safe_join(pointing.select("to", "key", "n_leaves", "saved_tokens"), targets.select("to", "far", "n"), ["to"], "n", total, "inner").select("key", F.col("far").alias("to"), "n_leaves", "saved_tokens")
        done = s.where(F.col("to").isNull())
        more = gets.select(F.col("to").alias("key"), "more_leaves", "more_saved")
        s = stored(
            moved.unionByName(done).join(more, "key", "left")
            .select("key", "to", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
        )
    raise RuntimeError("prefixes deeper than 2**62")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations of ``conversations`` (conv_id, turn, role, text), one row a node.

    A conversation c is rebuilt as the first crc32(c) % HEADS turns of its base c - c % FAMILY (as many as there are)
    and its own turns after as many. Columns: conv_id (the node's smallest member), depth, parent_conv_id (the parent's
    conv_id, null for the root), n_convs (members), n_children, n_leaves (childless nodes in its subtree),
    saved_tokens (over its subtree, (members - 1) times the words of a node's last text), ends_sha256 (of the ids of
    members that end there, ascending, comma-joined).

    Turns come in ascending order, null first; rows of one turn in the order of their digests, repeated rows each. A
    null role or text counts as empty. A null conv_id names no conversation, so such rows have no part. An empty table
    gives no nodes. Other columns are ignored. A family is folded in one task that holds FLUSH_NODES of its nodes at
    most; a node's ends pass through one task in order, since a digest is sequential, and are not held there.
    """
    nodes = stored(family_nodes(conversations))
    merged = stored(nodes.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")))
    ends = nodes.select("key", F.explode("ends").alias("end")).repartition("key").sortWithinPartitions("key", "end").mapInArrow(_ends, "key binary, ends_sha256 string")
    # Of each parent: how many children, and how many of them one conversation has to itself.
    above = merged.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single")).withColumnRenamed("parent", "key")
    known = stored(merged.join(above, "key", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_children", "n_single")}))
    many = known.where("n_convs > 1 or depth = 0")
    # The root is everybody's ancestor: it sums up the others at the end, and nobody's pointer goes to it.
    own = [F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.when(F.col("depth") == 0, 0).otherwise(F.col("words"))).alias("saved_tokens")]
    shared = many.where("depth > 0").select("key", F.when(F.col("depth") > 1, F.col("parent")).alias("to"), *own)
    sums = below(shared)
    whole = many.select("depth", "key", *own).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).select(F.lit(ROOT).alias("key"), "n_leaves", "saved_tokens")
    parents = known.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("fan"))
    total = known.count()
    rows = known.join(sums.unionByName(whole), "key", "left").join(ends, "key", "left")
    top, rest = rows.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")), rows.where("depth > 0")
    placed = skew_safe_join(rest, parents, ["parent"], "fan", total, "inner").drop("fan")
    return placed.unionByName(top, allowMissingColumns=True).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )
