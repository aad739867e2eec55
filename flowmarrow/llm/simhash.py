"""SimHash near-duplicates with vantage-point trees.

Fingerprints of 64 bits link when at most three bits differ; then one of their 32-bit halves differs in at most one
bit. So each half has its own vantage-point tree: a node splits the halves by Hamming distance from a vantage point,
and the triangle bound says which side a half, give or take one bit, can be on. A fingerprint is a member of one leaf of
each tree and a visitor of every leaf that its ball touches; the leaves are the shards in which members meet visitors
and whole fingerprints are compared, so all links are found. The top of a tree (at most 4096 leaves) is built from a
bounded sample of distinct fingerprints and only steers the work; a crowded leaf is cut into blocks of members by
blocks of visitors. A shard returns a star for each group it finds, never all pairs, and the stars are joined into
components. Copies are one fingerprint from the start.

Null and empty texts have fingerprint zero and link like any other. Rows without an id are never the smallest id of a
component; a component without ids has a null one. Repeated rows each get the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.graph import components
from flowmarrow.llm.text import query, rows_only, table, whole, with_row
from flowmarrow.session import frozen

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Wanted members of a leaf, most leaves of a tree, sampled fingerprints for each leaf.
LEAF, MAX_LEAVES, SAMPLE = 1000, 4096, 64
#: Most members and visitors that meet in one task.
MEMBERS, VISITORS = 20_000, 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text; bytes.lower and bytes.split know ASCII only, as wanted."""
    words = text.lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in runs], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): the fingerprint as a signed long; ``key`` is the digest of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.pop("text")], dtype=np.uint64).view(np.int64)
            yield b.assign(fp=fp)

    kind = dict(docs.dtypes)["doc_id"]
    d = docs.select("doc_id", F.md5(whole(F.col("text"))).alias("key"), whole(F.col("text")).cast("binary").alias("text"))
    d = d.select("doc_id", F.col("doc_id").cast("string").alias("id"), "key", "text")
    return (
        d.select("id", "key", "text").mapInPandas(run, "id string, key string, fp long")
        .select(F.col("id").cast(kind).alias("doc_id"), "key", "fp")
    )


def _half(fp: np.ndarray, side: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(32 * side)).astype(np.uint32)


def grow(sample: np.ndarray, leaves: int, reach: int) -> list[tuple[int, int, int, int]]:
    """A vantage-point tree over 32-bit halves as rows (vantage, radius, inside, outside); leaf k is -1 - k.

    The radius has the least expected work: members times visitors of both sides.
    """
    nodes: list = []
    n_leaves = 0

    def build(part: np.ndarray, budget: int) -> int:
        nonlocal n_leaves
        best = None
        if budget > 1 and len(part) > 1:
            for v in part[:: max(1, len(part) // 8)][:8]:
                near = np.bincount(np.bitwise_count(part ^ v), minlength=34).cumsum()
                for r in range(32):
                    inside, outside = near[r], len(part) - near[r]
                    if inside and outside:
                        visits_in, visits_out = near[min(r + reach, 33)], len(part) - (near[r - reach] if r >= reach else 0)
                        cost = inside * visits_in + outside * visits_out
                        if best is None or cost < best[0]:
                            best = (cost, int(v), r, inside)
        if best is None:
            n_leaves += 1
            return -n_leaves
        _, v, r, inside = best
        at = len(nodes)
        nodes.append(None)
        d = np.bitwise_count(part ^ np.uint32(v))
        share = min(budget - 1, max(1, round(budget * inside / len(part))))
        nodes[at] = (v, r, build(part[d <= r], share), build(part[d > r], budget - share))
        return at

    build(sample, leaves)
    return nodes


def route(nodes: list, halves: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, whether at home) for all leaves that the balls around the halves touch."""
    todo = [(0 if nodes else -1, np.arange(len(halves)), np.ones(len(halves), bool))]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -1 - at, rows, home
            continue
        v, r, inside, outside = nodes[at]
        d = np.bitwise_count(halves[rows] ^ np.uint32(v)).astype(np.int16)
        a, b = d - reach <= r, d + reach > r
        todo.append((inside, rows[a], (home & (d <= r))[a]))
        todo.append((outside, rows[b], (home & (d > r))[b]))


def stars(members: np.ndarray, visitors: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Groups of fingerprints linked by member-visitor pairs, as edges from every fingerprint to one of its group."""
    ends: list[int] = []
    roots: list[int] = []
    left, open_members = visitors, members
    while len(open_members):
        root, open_members = open_members[0], open_members[1:]
        todo = [(root, True)]
        while todo:
            x, member = todo.pop()
            if member and len(left):
                hit = np.bitwise_count(left ^ x) <= bits
                if hit.any():
                    found, left = left[hit], left[~hit]
                    todo += [(y, False) for y in found if y != x]
                    ends += found.tolist()
                    roots += [int(root)] * len(found)
            elif not member and len(open_members):
                hit = np.bitwise_count(open_members ^ x) <= bits
                if hit.any():
                    found, open_members = open_members[hit], open_members[~hit]
                    todo += [(y, True) for y in found]
                    ends += found.tolist()
                    roots += [int(root)] * len(found)
    return ends, roots


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct fingerprints that differ in few bits."""
    reach = bits // 2
    n = fps.count()
    leaves = int(min(MAX_LEAVES, max(1, n // LEAF)))
    picked = fps.orderBy(F.xxhash64("fp"), "fp").limit(leaves * SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    trees = [grow(_half(picked, side), leaves, reach) for side in (0, 1)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for side, nodes in enumerate(trees):
                for leaf, rows, home in route(nodes, _half(fp, side), reach):
                    yield pd.DataFrame({"shard": 2 * leaf + side, "fp": fp[rows], "home": home})

    dealt = frozen(fps.select("fp").mapInPandas(deal, "shard int, fp long, home boolean"), "fingerprint-shards")
    # one row for each leaf: at most twice MAX_LEAVES
    sizes = dealt.groupBy("shard").agg(
        F.ceil(F.count_if("home") / MEMBERS).alias("m"), F.ceil(F.count(F.lit(1)) / VISITORS).alias("v")
    )
    block = lambda count, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.greatest(count, F.lit(1))).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1))
    d = dealt.join(F.broadcast(sizes), "shard")
    visitors = d.select("shard", every(F.col("m")).alias("i"), block(F.col("v"), 1).alias("j"), "fp", F.lit(False).alias("member"))
    members = d.where("home").select("shard", block(F.col("m"), 2).alias("i"), every(F.col("v")).alias("j"), "fp", F.lit(True).alias("member"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, member = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["member"].to_numpy(bool)
        a, b = stars(fp[member], fp[~member], bits)
        out = pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})
        return out[out.a != out.b]

    return visitors.union(members).groupBy("shard", "i", "j").applyInPandas(meet, "a long, b long")


def near_groups(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for every distinct fingerprint."""
    fps = frozen(prints.select("fp").distinct(), "fingerprints")
    linked = components(frozen(links(fps, bits), "fingerprint-links"))
    return fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    prints = frozen(fingerprints(docs, shingle), "document-fingerprints")
    groups = frozen(near_groups(prints, bits), "fingerprint-groups")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(groups, "fp")
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = frozen(groups.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(ids, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The document of smallest id of every group, with all its columns; equal rows count as one."""
    prints = frozen(fingerprints(docs, shingle), "document-fingerprints")
    groups = frozen(near_groups(prints, bits), "fingerprint-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    per_print = prints.groupBy("fp").agg(F.min(order).alias("o")).join(groups, "fp")
    kept = per_print.groupBy("root").agg(F.min("o").alias("o")).select("o.doc_id", "o.key")
    kept = frozen(kept.withColumnRenamed("doc_id", "kept_id").withColumnRenamed("key", "kept_key"), "kept-documents")
    rows = with_row(docs, id=F.col("doc_id"), key=F.md5(whole(F.col("text"))))
    same = rows.id.eqNullSafe(kept.kept_id) & (rows.key == kept.kept_key)
    found = prints.join(kept, prints.doc_id.eqNullSafe(kept.kept_id) & (prints.key == kept.kept_key), "left_semi").count()
    rows = rows.join(kept, same, "left_semi")
    if found > kept.count():  # rows with the same id and text
        rows = rows.dropDuplicates(["id", "key"])
    return rows_only(rows)


@query()
def op6_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
