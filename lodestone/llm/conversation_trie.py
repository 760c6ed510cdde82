"""The trie of conversations' prefixes, by the Euler-tour technique.

A prefix is known by a polynomial hash of its turns' digests modulo a prime of 127 bits, kept as a running value over the
sorted turns, so no task needs a whole conversation. Nodes are groups of equal prefixes, named by their smallest
conversation and their depth. Sorted beside their parents, nodes learn their parent's name and their next sibling, which
gives each node an arc that enters it and one that leaves it, and each arc the one after it: a tour of the whole trie as a
linked list. The list is ranked in tasks that follow links (``scans.list_ranks``) with running sums of leaves and savings;
a subtree's sums are what the sums grow by from a node's entering arc to its leaving arc. However deep or wide the trie,
no step walks it level by level or gathers a node's children or members.

Defined results: rows without a conv_id are left out; null role and text are empty; turns are taken by turn, null first,
and by their digest where turns tie, so repeated rows are turns of their own; a conversation without turns is a member of
the root alone; very long texts are hashed and counted by Spark's own functions; an empty table has no node, not even a
root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .scans import as_long, list_ranks, running

#: A Mersenne prime, and a number below it drawn once.
PRIME = (1 << 127) - 1
BASE = 0x5A3C1F8E9D7B2460C8E1A4B3F7D29651
#: The prefix without turns.
ROOT = (0).to_bytes(17, "big")
#: Bytes of ids that are joined into one piece of a digest's input.
PIECE_BYTES = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), digest and words of every turn, in a stored table."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(_WORD)).cast("long")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(digest, 1, 15).alias("digest"), words.alias("words"))
    numbered = running(turns, ["conv_id"], ["turn", "digest"], {"position": (lambda r: (1, 1), None)}, name="turns")
    return numbered.select("conv_id", as_long("position").alias("position"), "digest", "words")


def reopened(turns: DataFrame, members: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt: each takes its first h turns from the conversation at the start of its group of ids, h being
    a checksum of its id modulo ``most``, and goes on with its own turns after its first h."""
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    opening = turns.where((F.col("conv_id") % group == 0) & (F.col("position") < most)).select(F.col("conv_id").alias("start"), "position", "digest", "words")
    lent = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("start"), heads.alias("h")).join(opening, "start").where("position <= h")
    return lent.select("conv_id", "position", "digest", "words").unionByName(turns.where(F.col("position") > heads))


def _prefix(row: dict) -> tuple[int, int]:
    return BASE, int.from_bytes(row["digest"], "big") + 1


def prefixes(turns: DataFrame) -> DataFrame:
    """node (of the prefix that ends with the turn), parent, depth, conv_id, words and last (nothing follows) of every turn."""
    found = running(turns, ["conv_id"], ["position"], {"node": (_prefix, PRIME), "depth": (lambda r: (1, 1), None)}, ahead=["position"], name="prefixes")
    # the hash before a turn follows from the hash after it: (node - digest) / BASE
    inverse = pow(BASE, -1, PRIME)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, own = batch["node"].to_pylist(), batch["digest"].to_pylist()
            parents = [((int.from_bytes(n, "big") - int.from_bytes(d, "big") - 1) * inverse % PRIME).to_bytes(17, "big") for n, d in zip(now, own)]
            yield pa.record_batch([batch["node"], pa.array(parents, pa.binary()), *(batch[c] for c in ("depth", "conv_id", "words", "last"))], names=["node", "parent", "depth", "conv_id", "words", "last"])

    kept = found.select("node", "digest", as_long("depth").alias("depth"), "conv_id", "words", (~F.col("has_next")).alias("last"))
    return kept.mapInArrow(back, "node binary, parent binary, depth long, conv_id long, words long, last boolean")


def _families(nodes: DataFrame) -> DataFrame:
    """Two rows for each node, one beside its children and one among its siblings: what comes next there, and the parent's conv_id."""
    own = nodes.select(F.col("node").alias("family"), F.lit(0).alias("kind"), "conv_id", "depth")
    among = nodes.where("depth > 0").select(F.col("parent").alias("family"), F.lit(1).alias("kind"), "conv_id", "depth")
    named = running(own.unionByName(among), ["family"], ["kind", "conv_id"], {"above": (lambda r: (1, 0) if r["kind"] else (0, r["conv_id"]), None)}, ahead=["conv_id"], name="families")
    return named.select("kind", "conv_id", "depth", "has_next", "next_conv_id", as_long("above").alias("above"))


def _digests(ends: DataFrame) -> DataFrame:
    """node and SHA-256 of its conv_ids in rising order, joined by commas. Ids of a node come in pieces, so a node where a
    great part of all conversations ends is a few long rows, hashed one after the other."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out = None, [], 0, []

        def close() -> None:
            if ids:
                out.append((node, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for n, c in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist()):
                if n != node or size > PIECE_BYTES:
                    close()
                    node, ids, size = n, [], 0
                ids.append(c)
                size += len(str(c)) + 1
            if len(out) > 1000:
                yield pa.record_batch([pa.array(x) for x in zip(*out)], names=["node", "first", "ids"])
                out.clear()
        close()
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out)], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for batch in batches:
            for n, x in zip(batch["node"].to_pylist(), batch["ids"].to_pylist()):
                if n != node:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256(x.encode())
                else:
                    digest.update(f",{x}".encode())
            if len(out) > 1000:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["node", "ends_sha256"])
                out.clear()
        if node is not None:
            out.append((node, digest.hexdigest()))
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["node", "ends_sha256"])

    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Every node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, position, digest and words of turns, ``members`` a row for each conv_id, with turns or without.
    """
    rows = stored(prefixes(turns), "trie-rows")
    grouped = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = root.select(F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = stored(grouped.unionByName(top), "trie-nodes")
    ends = rows.where("last").select("node", "conv_id").unionByName(members.join(rows.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit(ROOT).alias("node"), "conv_id"))

    families = stored(_families(nodes), "trie-families")
    # an arc is (conv_id, 2 * depth) into a node and (conv_id, 2 * depth + 1) out of it
    into, out = families.where("kind = 0"), families.where("kind = 1")
    leaf = ~F.col("has_next")
    entering = into.select("conv_id", "depth", F.when(leaf, F.col("conv_id")).otherwise(F.col("next_conv_id")).alias("next_x"), F.when(leaf, 2 * F.col("depth") + 1).otherwise(2 * F.col("depth") + 2).alias("next_y"), leaf.cast("long").alias("leaves"))
    weighed = entering.join(nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), ["conv_id", "depth"])
    leaving = out.select("conv_id", "depth", F.when(leaf, F.col("above")).otherwise(F.col("next_conv_id")).alias("next_x"), F.when(leaf, 2 * F.col("depth") - 1).otherwise(2 * F.col("depth")).alias("next_y"))
    last = into.where("depth = 0").select("conv_id", "depth", F.lit(None).cast("long").alias("next_x"), F.lit(None).cast("long").alias("next_y"))
    zero = F.lit(0).cast("long")
    arcs = weighed.select(F.col("conv_id").alias("x"), (2 * F.col("depth")).alias("y"), "next_x", "next_y", "leaves", "saved").unionByName(
        leaving.unionByName(last).select(F.col("conv_id").alias("x"), (2 * F.col("depth") + 1).alias("y"), "next_x", "next_y", zero.alias("leaves"), zero.alias("saved"))
    )
    ranks = list_ranks(arcs, ["leaves", "saved"], block)
    sign = F.when(F.col("y") % 2 == 1, 1).otherwise(-1)
    grown = ranks.groupBy(F.col("x").alias("conv_id"), F.floor(F.col("y") / 2).alias("depth")).agg(F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))

    parents = out.select("conv_id", "depth", F.col("above").alias("parent_conv_id"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(children, "node", "left").join(_digests(ends), "node", "left").join(parents, ["conv_id", "depth"], "left").join(grown, ["conv_id", "depth"])
    none = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
