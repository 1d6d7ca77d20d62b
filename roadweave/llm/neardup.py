"""Near-duplicates by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import SMALL_IDS, bounded, released, slices, stored
from roadweave.llm.components import components
from roadweave.llm.shingles import mixed, shingle_set

#: Independent trees. A pair at the threshold misses one first level with probability 0.13.
TREES = 8
#: A node of at most this many documents is compared exhaustively.
SMALL = 2_000
#: Bins of a sketch, and by how many standard deviations a pair may stay behind the threshold
#: before full sets are fetched. That loses one pair of some ten millions.
BINS, ROOM = 64, 5.5
#: Levels of branching; nodes that are still larger are dense and are cut into blocks.
LEVELS = 4
#: Members of a dense node that all its blocks are compared with.
HUBS = 8


def tokens(items: np.ndarray, path: int, similarity: float) -> Iterator[int]:
    """The nodes below ``path`` that a set goes to: the path and a selected minwise token.

    One hash function is always selected and a second one by chance of the path, so that a
    set has 1 / similarity children on average, the same functions for all sets of a node.
    """
    chance = xxhash.xxh64_intdigest(path.to_bytes(8, "little", signed=True)) / 2**64
    for j in range(2 if chance < 1 / similarity - 1 else 1):
        seed = np.uint64(xxhash.xxh64_intdigest(f"{path}/{j}"))
        least = mixed(items ^ seed).min()
        yield xxhash.xxh64_intdigest(f"{path}/{j}/{least}") - (1 << 63)


def sketch(items: np.ndarray) -> bytes:
    """A byte of the least shingle of each bin of hashes, 0 for an empty bin."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    at = np.searchsorted(items, edges)
    there = at < np.append(at[1:], len(items))
    out = np.zeros(BINS, dtype=np.uint8)
    out[there] = items[at[there]] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def promising(n: np.ndarray, sketches: np.ndarray, similarity: float) -> np.ndarray:
    """Members of a node that may be similar to another one, by sizes and sketches."""
    out = np.zeros(len(n), dtype=bool)
    order = np.argsort(n, kind="stable")
    n, sketches = n[order], sketches[order]
    full = sketches > 0
    for x in range(len(n) - 1):
        end = np.searchsorted(n, n[x] / similarity, "right")  # larger sets cannot be similar
        if end <= x + 1:
            continue
        others = sketches[x + 1 : end]
        used = (full[x + 1 : end] | full[x]).sum(axis=1)
        same = ((others == sketches[x]) & full[x]).sum(axis=1)
        close = np.nonzero(same >= similarity * used - ROOM * np.sqrt(similarity * (1 - similarity) * used))[0]
        if len(close):
            out[order[x]] = True
            out[order[x + 1 + close]] = True
    return out


def described(docs: DataFrame, key: str, text: str, k: int, trees: int, similarity: float) -> DataFrame:
    """(doc_id, n, digest, sketch, nodes) of each row; nodes are those of the first level."""

    def work(batches):
        for batch in slices(batches):
            n, digest, drawn, nodes = [], [], [], []
            for t in batch["text"].to_pylist():
                items = shingle_set(t, k)
                n.append(len(items))
                drawn.append(sketch(items) if len(items) else None)
                digest.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                nodes.append([x for tree in range(trees) for x in tokens(items, tree, similarity)] if len(items) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(drawn, pa.binary()),
                    pa.array(nodes, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "digest", "sketch", "nodes"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda batches: released(work(batches)), "doc_id long, n long, digest binary, sketch binary, nodes array<long>"
    )


def with_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, items) of the named documents, their shingle sets as bytes."""

    def work(batches):
        for batch in slices(batches):
            items = [shingle_set(t, k).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(items, pa.binary())], names=["id", "items"])

    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    ids = bounded(stored(ids, "neardup-ids"), SMALL_IDS)
    once = named.join(ids, "id", "left_semi").dropDuplicates(["id", "text"])  # repeated rows go
    return once.mapInArrow(lambda batches: released(work(batches)), "id long, items binary").filter(F.length("items") > 0)


def branched(members: DataFrame, similarity: float) -> DataFrame:
    """Members (node, id, items) one level further down: (node, id)."""

    def work(batches):
        for batch in batches:
            nodes, ids = [], []
            for node, i, raw in zip(*(batch[c].to_pylist() for c in ("node", "id", "items")), strict=True):
                below = list(tokens(np.frombuffer(raw, dtype=np.uint64), node, similarity))
                nodes += below
                ids += [i] * len(below)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids, pa.int64())], names=["node", "id"])

    return members.mapInArrow(work, "node long, id long")


def linked(ids: np.ndarray, sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of one node, every pair compared on full sets.

    An index from shingles to members counts the intersections of a member with all others
    at once. ``joined`` names the components known so far; pairs inside one are not counted.
    """
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    owner_of, values = owner[order], flat[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    starts = np.nonzero(new)[0]
    lengths = np.diff(np.concatenate([starts, [len(values)]]))
    group = np.empty(len(values), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    ends = np.cumsum(n)
    root = np.arange(len(sets)) if joined is None else np.unique(joined, return_inverse=True)[1]
    out = []
    for x in range(len(sets) - 1):
        if (root[x + 1 :] == root[x]).all():
            continue
        own = group[ends[x] - n[x] : ends[x]]
        own = own[lengths[own] > 1]
        if not len(own):
            continue
        size = lengths[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        common = np.bincount(owner_of[at], minlength=len(sets))
        common[: x + 1] = 0
        close = 100 * common >= percent * (n + n[x] - common)
        for y in np.nonzero(close & (common > 0) & (root != root[x]))[0]:
            if root[y] != root[x]:
                out.append((int(ids[x]), int(ids[y])))
                root[root == root[y]] = root[x]
    return out


def compared(members: DataFrame, percent: int, keys: list[str], known: bool = False) -> DataFrame:
    """Links (a, b) inside each group of members, by exhaustive comparison."""

    def work(data: pa.Table) -> pa.Table:
        ids = data["id"].to_numpy()
        sets = [np.frombuffer(raw, dtype=np.uint64) for raw in data["items"].to_pylist()]
        joined = data["component"].to_numpy() if known else None
        found = linked(ids, sets, percent, joined) if len(sets) > 1 else []
        return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return members.groupBy(*keys).applyInArrow(work, "a long, b long").distinct()


def sifted(leaves: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Members (node, id) of small nodes whose full sets have to be compared."""

    def work(data: pa.Table) -> pa.Table:
        if data.num_rows < 2:
            return data.select(["node", "id"]).slice(0, 0)
        raw = np.frombuffer(b"".join(data["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        keep = promising(data["n"].to_numpy(), raw, similarity)
        return data.select(["node", "id"]).filter(pa.array(keep))

    return leaves.join(sketches, "id").select("node", "id", "n", "sketch").groupBy("node").applyInArrow(work, "node long, id long")


def by_size(members: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Members (node, id) of nodes of two to ``small`` documents, one of each equal node, and of larger ones."""
    nodes = members.groupBy("node").agg(
        F.count("*").alias("_n"),
        F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("_same"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("_also"),
    )
    few = nodes.filter(F.col("_n").between(2, small)).groupBy("_n", "_same", "_also").agg(F.min("node").alias("node"))
    return members.join(few.select("node"), "node", "left_semi"), members.join(
        nodes.filter(F.col("_n") > small).select("node"), "node", "left_semi"
    )


def dense(members: DataFrame, percent: int, small: int, hubs: int) -> DataFrame:
    """Links inside nodes above ``small`` whose documents stay together: (a, b).

    The members are cut into blocks, each compared with itself and the node's hubs. That
    joins nearly all of a dense node. The members outside the node's largest component
    are then compared with all others, block by block, so no link is lost.
    """
    least = [F.min(F.struct(F.xxhash64("id", F.lit(j)).alias("h"), "id"))["id"] for j in range(hubs)]
    count = stored(
        members.groupBy("node").agg(
            F.ceil(F.count("*") / F.lit(small)).cast("int").alias("blocks"), F.array_distinct(F.array(*least)).alias("hubs")
        ),
        "neardup-dense",
    )
    cut = members.join(count, "node").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    hub = F.array_contains("hubs", F.col("id"))
    everywhere = cut.filter(hub).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = cut.filter(~hub).select("node", "block", "id", "items").unionByName(
        everywhere.select("node", "block", "id", "items")
    )
    links = stored(compared(first, percent, ["node", "block"]), "neardup-links")
    labels = components(links)
    named = cut.drop("hubs").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = stored(named, "neardup-named")
    sizes = named.groupBy("node", "component").count()
    largest = sizes.groupBy("node").agg(F.max(F.struct("count", "component")).alias("_l"))
    odd = (
        named.join(largest.select("node", F.col("_l.component").alias("main")), "node")
        .filter(F.col("component") != F.col("main"))
        .select("node", "block", "id", "items", "component")
    )
    rest = stored(odd, "neardup-odd")
    odd_blocks = rest.groupBy("node", "block").count().select("node", F.col("block").alias("odd"))
    left = named.join(odd_blocks, "node").select("node", "block", "odd", "id", "items", "component")
    right = (
        rest.withColumnRenamed("block", "odd")
        .join(count.select("node", "blocks"), "node")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .filter(F.col("block") != F.col("odd"))  # there it is one of the block already
        .select("node", "block", "odd", "id", "items", "component")
    )
    pairs = left.unionByName(right)
    return links.unionByName(compared(pairs, percent, ["node", "block", "odd"], known=True))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 3,
    percent: int = 85,
    trees: int = TREES,
    small: int = SMALL,
    levels: int = LEVELS,
    hubs: int = HUBS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    Two rows are linked if 100 times the common shingles are at least ``percent`` times all
    of theirs. Equal sets are one vertex, so copies cost nothing further. Rows without text
    or words have an empty set, link with nothing and are kept. Rows of one id count as one
    document. Rows without id are kept and have no component. Ties and an empty table need
    no rule. Other columns of ``docs`` are not read.

    Every link that is found is confirmed on the full sets; what the trees may miss is a
    pair that shares no small node in any of them.
    """
    similarity = percent / 100
    rows = stored(described(docs, key, text, k, trees, similarity), "neardup-rows")
    full = rows.filter("digest is not null and doc_id is not null")
    classes = stored(
        full.groupBy("digest").agg(
            F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes")
        ),
        "neardup-classes",
    )
    sketches = classes.select("id", "n", "sketch")
    leaves, large = by_size(classes.select("id", F.explode(F.array_distinct("nodes")).alias("node")), small)
    leaves, large = stored(sifted(leaves, sketches, similarity), "neardup-sifted"), stored(large, "neardup-large")
    leaves = stored(by_size(leaves, small)[0], "neardup-leaves")  # what is left of many nodes is equal
    sets = stored(
        with_sets(docs, leaves.select("id").union(large.select("id")).distinct(), key, text, k), "neardup-sets"
    )
    found = [stored(compared(leaves.join(sets, "id").select("node", "id", "items"), percent, ["node"]), "neardup-links")]
    for level in range(2, levels + 1):
        if large.isEmpty():
            break
        below = branched(large.join(sets, "id").select("node", "id", "items"), similarity)
        below = stored(below, f"neardup-level{level}")
        leaves, large = by_size(below, small)
        leaves = sifted(leaves, sketches, similarity)
        links = compared(leaves.join(sets, "id").select("node", "id", "items"), percent, ["node"])
        found.append(stored(links, "neardup-links"))
        large = stored(large, "neardup-large")
    if not large.isEmpty():
        found.append(dense(large.join(sets, "id").select("node", "id", "items"), percent, small, hubs))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    labels = components(links)
    named = classes.select("digest", "id").join(labels, "id", "left")
    named = named.select("digest", F.coalesce("component", "id").alias("component_id"))
    return (
        rows.select("doc_id", "n", "digest")
        .join(named, "digest", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


