"""Removal of repeated passages, byte by byte, with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Every such
string holds an anchor: the place of the smallest hash among its short byte strings, which is the same wherever the
string occurs. Anchors that occur in two documents are found by an aggregation over all documents, as packed numbers. Around each of
their places the bytes of all strings whose smallest hash stands there are cut out, and all cuts of one anchor meet in
one shard, to which a task sends them packed and compressed. There, distinct cuts that have a rival for their anchor are joined to one text and sorted by external induced
sorting (``induced``); neighbours in that order with ``LENGTH`` equal bytes are one class, whose smallest document id
decides. A cut without a rival is a class of its own. Cuts are identified by their bytes, so copies are sorted once.

Null texts are empty; texts shorter than ``LENGTH`` lose nothing. Rows without an id come last and never remove anything
from each other. Rows with equal id and text have equal results; rows with one id never remove from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.induced import suffix_order
from flowmarrow.llm.text import query, table, whole
from flowmarrow.session import frozen

LENGTH = 50
GRAM = 24
#: The id of rows without one.
LAST = 2**63 - 1
#: Bits of the filter for repeated anchors, which goes to all executors (16 MB); up to four times as many for larger tables.
FILTER_BITS = 2**27
#: Bytes of text for a bit of the filter, until it has reached its largest size.
FILTER_BYTES = 8
#: Level of compression of what tasks send.
LEVEL = 9
#: Bytes of text whose anchors are counted in one group, about; there are 64 groups at least.
GROUP_BYTES = 2**26
#: Anchors, and places with their cuts, that a task gathers before it sends them.
BUFFERED, PLACES = 1_000_000, 300_000
#: Documents with removals that are sent to all executors at most, and bytes of these; more are joined by shuffle.
BROADCAST_DOCS, BROADCAST_BYTES = 500_000, 2**26
#: Places of anchors that meet in a task, and in a shard of these that is sorted at once, about.
GROUP, SHARD = 400_000, 30_000
#: Strings that can hold an anchor.
STARTS = LENGTH - GRAM + 1
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * MIX[0]
    return h ^ (h >> np.uint64(29))


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash for the 24 bytes at each place, by doubling."""
    h = text.astype(np.uint64) + np.uint64(1)
    for k, m in zip((1, 2, 4, 8), MIX[1:]):
        eight = h if k == 8 else None
        h = _mixed(h[:-k] * m + h[k:])
    return _mixed(h[:-8] * MIX[2] + eight[16:])


def _over(f, x: np.ndarray, width: int) -> np.ndarray:
    """f over every window of this width."""
    k = 1
    while 2 * k <= width:
        x, k = f(x[:-k], x[k:]), 2 * k
    return f(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a text of at least LENGTH bytes, and the smallest hash of every string in it."""
    h = _gram_hashes(text)
    edge = np.zeros(STARTS - 1, np.uint64)
    least = _over(np.minimum, h, STARTS)
    at = np.flatnonzero(h == _over(np.maximum, np.concatenate([edge, least, edge]), STARTS))
    return at, h[at].view(np.int64), least.view(np.int64)


def _surroundings(at: np.ndarray, h: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose smallest hash is that of the anchor; those between are such strings too."""
    first, last = np.empty_like(at), np.empty_like(at)
    for lo in range(0, len(at), 50_000):
        block = slice(lo, lo + 50_000)
        start = at[block, None] - np.arange(STARTS)
        mine = (start >= 0) & (start < len(least))
        mine &= least[np.clip(start, 0, len(least) - 1)] == h[block, None]
        last[block] = at[block] - mine.argmax(1)
        first[block] = at[block] - (STARTS - 1) + mine[:, ::-1].argmax(1)
    return first, last


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second bytes and so on, which compresses better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _packed(columns: list[np.ndarray], more: bytes = b"") -> bytes:
    """Number columns and bytes, compressed; ``_unpacked`` gives them back."""
    head = np.array([[len(x), x.itemsize] for x in columns], np.int64)
    raw = b"".join([head.tobytes(), *[_planes(x) for x in columns], more])
    return np.int64([len(raw), len(columns)]).tobytes() + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _unpacked(packed: bytes) -> tuple[list[np.ndarray], bytes]:
    size, k = np.frombuffer(packed[:16], np.int64).tolist()
    raw = pa.decompress(packed[16:], size, codec="zstd", asbytes=True)
    columns, at = [], 16 * k
    for n, width in np.frombuffer(raw[:at], np.int64).reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        columns.append(np.ascontiguousarray(planes.T).view({1: np.uint8, 4: np.int32, 8: np.int64}[width]).reshape(n))
        at += n * width
    return columns, raw[at:]


def _packed_places(doc: np.ndarray, key: np.ndarray, at: np.ndarray, cuts: list[bytes]) -> bytes:
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    times = np.diff(np.append(first, len(doc))).astype(np.int32)
    size = np.fromiter(map(len, cuts), np.uint8, len(cuts))
    return _packed([doc[first], key[first], times, at.astype(np.int32), size], b"".join(cuts))


def _places(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    (doc, key, times, at, size), text = _unpacked(packed)
    end = np.cumsum(size, dtype=np.int64)
    cuts = [text[a:b] for a, b in zip((end - size).tolist(), end.tolist())]
    return np.repeat(doc, times), np.repeat(key, times), at.astype(np.int64), cuts


def _bytes(docs: DataFrame) -> DataFrame:
    t = whole(F.col("text"))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(t).alias("key"), t.cast("binary").alias("text")
    )


def anchor_bits(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, places): a bitmap of FILTER_BITS bits or more with a bit for every anchor of two or more rows, and how many places
    these anchors have, not counting repetitions inside one buffer.

    A task sends each anchor of a buffer once, as 32 bits in a group of anchors; these numbers are sorted, and their differences
    are packed. The group number adds six bits or more. Equal numbers of different anchors only bring places that match nothing.
    """
    size = docs.agg(F.sum(F.octet_length(whole(F.col("text"))).cast("long"))).first()[0] or 0
    width = FILTER_BITS.bit_length() - 1 + sum(k * FILTER_BITS * FILTER_BYTES < size for k in (1, 2))
    low = width - min(width - 3, max(6, (size // GROUP_BYTES).bit_length()))

    def packed(held: list[np.ndarray]) -> pd.DataFrame:
        h = np.concatenate(held).view(np.uint64)
        part = (h & np.uint64((1 << width) - 1)) >> np.uint64(low)
        value = (h & np.uint64((1 << low) - 1)) | (h >> np.uint64(width) << np.uint64(low))
        key, times = np.unique(part << np.uint64(32) | value & np.uint64(2**32 - 1), return_counts=True)
        part, value, twice = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32), times > 1
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        cut = list(zip(first.tolist(), first[1:].tolist() + [len(part)]))
        strings = [[_packed([np.diff(value[a:b][twice[a:b] == t], prepend=np.uint32(0))]) for a, b in cut] for t in (False, True)]
        return pd.DataFrame({"part": part[first], "once": strings[0], "twice": strings[1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for t in b["text"]:
                if len(t) >= LENGTH:
                    held.append(np.unique(anchors(np.frombuffer(t, np.uint8))[1]))
                    n += len(held[-1])
                if n > BUFFERED:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = (np.concatenate([np.cumsum(_unpacked(b)[0][0].view(np.uint32), dtype=np.uint32) for b in pdf[c]]) for c in ("once", "twice"))
        once.sort()
        hit = np.union1d(once[1:][once[1:] == once[:-1]], twice)
        bits = np.zeros(1 << low, bool)
        bits[hit & np.uint32((1 << low) - 1)] = True
        n = int(np.isin(once, hit).sum()) + len(twice)
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "bits": [np.packbits(bits, bitorder="little").tobytes()], "n": [n]})

    sent = _bytes(docs).select("text").mapInPandas(run, "part long, once binary, twice binary")
    out, places = np.zeros((1 << width - low, (1 << low) // 8), np.uint8), 0
    for r in sent.groupBy("part").applyInPandas(merged, "part long, bits binary, n long").collect():  # the bitmap, 64 MB at most
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        places += r["n"]
    return out.ravel(), places


def _joined(runs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, key, start, stop) arrays with overlapping and touching runs of a text joined."""
    doc, key, start, stop = runs.T
    order = np.lexsort((start, key, doc))
    doc, key, start, stop = doc[order], key[order], start[order], stop[order]
    if not len(doc):
        return doc, key, start, stop
    text = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))]) << 32  # texts are shorter
    reach = np.maximum.accumulate(stop + text)
    first = np.concatenate([[True], (start + text)[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(doc) - 1)
    return doc[first], key[first], start[first], reach[last] - text[last]


def cuts(docs: DataFrame, bits: np.ndarray, groups: int) -> DataFrame:
    """(part, cuts, runs): the surroundings of repeated anchors, packed by task and group of anchors.

    A place is (doc, key, at, cut): ``cut`` starts at ``at`` and has one more byte, which tells how far the anchor is from there.
    Of equal cuts in a buffer only those of the smallest document are sent. The others are in a later document, so all
    their strings go: they come as runs without a cut. A passage that very many documents share
    thus sends a few cuts for each buffer, not for each document. Anchors are looked up in a bitmap of bounded size, so a few
    others come along, more of them in very large tables; they match nothing.
    """
    known, mask = docs.sparkSession.sparkContext.broadcast(bits), 8 * len(bits) - 1
    lead = [bytes([n]) for n in range(STARTS)]

    def sent(held: list[tuple], cut: list[bytes]) -> pd.DataFrame:
        times = [len(x[2]) for x in held]
        doc, key = (np.repeat(np.array([x[k] for x in held], np.int64), times) for k in (0, 1))
        at, part = (np.concatenate([x[k] for x in held]) for k in (2, 3))
        every = np.empty(len(cut), object)
        every[:] = cut
        kind, kinds = pd.factorize(every)
        least = np.full(len(kinds), LAST)
        np.minimum.at(least, kind, doc)
        later = np.flatnonzero(doc != least[kind])
        size = np.array([len(cut[i]) - 1 for i in later], np.int64)
        rows = []
        if len(later):
            done = _joined(np.stack([doc[later], key[later], at[later], at[later] + size], axis=1))
            rows.append((int(part[later[0]]), None, _packed(list(done))))
        mine = np.flatnonzero(doc == least[kind])
        mine = mine[np.argsort(part[mine], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], part[mine][1:] != part[mine][:-1]]))
        for x in np.split(mine, first[1:]):
            rows.append((int(part[x[0]]), _packed_places(doc[x], key[x], at[x], every[x].tolist()), None))
        return pd.DataFrame(rows, columns=["part", "cuts", "runs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        cut: list[bytes] = []
        for b in batches:
            for doc, key, t in zip(b["doc"], b["key"], b["text"]):
                if len(t) < LENGTH:
                    continue
                at, h, least = anchors(np.frombuffer(t, np.uint8))
                bit = h & mask
                there = (known.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                if not there.any():
                    continue
                at, h = at[there], h[there]
                first, last = _surroundings(at, h, least)
                held.append((doc, key, first, (_mixed(h.view(np.uint64)) % np.uint64(groups)).astype(np.int64)))
                cut += [t[x : y + LENGTH] + lead[n] for x, y, n in zip(first.tolist(), last.tolist(), (at - first).tolist())]
                if len(cut) > PLACES:
                    yield sent(held, cut)
                    held, cut = [], []
        if cut:
            yield sent(held, cut)

    return _bytes(docs).mapInPandas(run, "part long, cuts binary, runs binary")


def classes(texts: list[bytes], least: np.ndarray, folder: str | None = None) -> np.ndarray:
    """(texts x starts): for each start of LENGTH bytes the least id of all texts with the same bytes anywhere."""
    out = np.full((len(texts), STARTS), LAST)
    size = np.array([len(t) for t in texts])
    symbols = np.frombuffer(b"\x00".join(texts) + b"\x00\x00", np.uint8).astype(np.int16) + 2
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    symbols[first[1:] - 1] = 1  # between texts
    symbols[-2:] = 1, 0
    order = suffix_order(symbols, LENGTH, folder)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    order = order[order < len(owner)]
    start = order - first[owner[order]]
    order, start = (x[start + LENGTH <= size[owner[order]]] for x in (order, start))
    if not len(order):
        return out
    text = symbols.astype(np.uint8)  # marks and bytes 254 and 255 may meet, but no compared place is a mark
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    pairs = np.arange(len(a))
    for k in range(LENGTH):
        pairs = pairs[text[a[pairs] + k] == text[b[pairs] + k]]
    same[:] = False
    same[pairs] = True
    group = np.concatenate([[0], np.cumsum(~same)])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    out[owner[order], start] = np.minimum.reduceat(least[owner[order]], head)[group]
    return out


def _removed(doc: np.ndarray, least: np.ndarray, kind: np.ndarray, texts: list[bytes], rivals: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, start, stop) of the runs to remove, from the start of the cut, for places with these kinds of cuts."""
    low = np.repeat(least[:, None], STARTS, axis=1)
    if rivals.any():
        low[rivals] = classes([t for t, r in zip(texts, rivals) if r], least[rivals])
    fits = np.arange(STARTS) <= (np.array([len(t) for t in texts]) - LENGTH)[:, None]
    hit = (low[kind] < doc[:, None]) & fits[kind]
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    place, start = np.nonzero(edge == 1)
    return place, start, np.nonzero(edge == -1)[1] - 1 + LENGTH


def removed_in_group(blobs: list[bytes]) -> pd.DataFrame:
    """(doc, key, start, stop) of the runs to remove, from all cuts of some anchors, shard by shard."""
    found = [_places(b) for b in blobs]
    doc, key, at = (np.concatenate([f[k] for f in found]) for k in range(3))
    every = np.empty(len(doc), object)
    every[:] = [c for f in found for c in f[3]]
    del found
    kind, cuts_ = pd.factorize(every)
    least = np.full(len(cuts_), LAST)
    np.minimum.at(least, kind, doc)
    grams = np.empty(len(cuts_), object)
    grams[:] = [c[c[-1] : c[-1] + GRAM] for c in cuts_]
    anchor, _ = pd.factorize(grams)
    rivals = np.bincount(anchor)[anchor] > 1
    # the places of an anchor stay together
    size = np.bincount(anchor[kind])
    shard = (np.cumsum(size) - size) // SHARD
    order = np.argsort(shard[anchor[kind]], kind="stable")
    edges = np.flatnonzero(np.diff(shard[anchor[kind[order]]])) + 1
    out = []
    for places in np.split(order, edges):
        mine, own = np.unique(kind[places], return_inverse=True)
        place, start, stop = _removed(doc[places], least[mine], own, [c[:-1] for c in cuts_[mine]], rivals[mine])
        place = places[place]
        out.append(np.stack([doc[place], key[place], at[place] + start, at[place] + stop], axis=1))
    return pd.DataFrame(np.concatenate(out), columns=["doc", "key", "start", "stop"])


def _runs_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of all cuts of some anchors, and those that came without a cut."""
    blobs = pdf["cuts"].dropna().tolist()
    runs = [removed_in_group(blobs)] if blobs else []
    runs += [pd.DataFrame(dict(zip(("doc", "key", "start", "stop"), _unpacked(b)[0]))) for b in pdf["runs"].dropna()]
    return pd.concat(runs, ignore_index=True)


def removed_runs(docs: DataFrame) -> DataFrame:
    """(doc, key, spans): the maximal byte runs to remove, start << 32 | stop, for every document that loses some."""
    bits, places = anchor_bits(docs)
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), places // GROUP + 1)
    runs = cuts(docs, bits, groups).groupBy("part").applyInPandas(_runs_of_group, "doc long, key long, start long, stop long")
    spans = F.collect_set(F.shiftleft("start", 32) + F.col("stop"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(spans=[start << 32 | stop for start, stop in (_merged(np.array(x, np.int64)) for x in b["spans"])])

    return runs.groupBy("doc", "key").agg(F.sort_array(spans).alias("spans")).mapInPandas(run, "doc long, key long, spans array<long>")


def _merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs; the spans are sorted by start."""
    if not len(spans):
        return spans, spans
    start, stop = spans >> 32, spans & 0xFFFFFFFF
    reach = np.maximum.accumulate(stop)
    first = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[first], np.append(reach[np.flatnonzero(first)[1:] - 1], reach[-1])


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, text, kept, n_bytes, n_removed, n_spans): ``kept`` holds the remaining bytes of every document."""
    gone = frozen(removed_runs(docs), "passages").select(F.col("doc").alias("gone_doc"), F.col("key").alias("gone_key"), "spans")
    # a document can have any number of spans, so bytes are counted, not only rows
    found = gone.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(64 + 8 * F.size("spans").cast("long")), F.lit(0)).alias("bytes")).first()
    if found["docs"] <= BROADCAST_DOCS and found["bytes"] <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, spans in zip(b["text"], b["spans"]):
                start, stop = _merged(np.array([] if spans is None else spans, np.int64))
                keep = np.ones(len(t), bool)
                for x, y in zip(start.tolist(), stop.tolist()):
                    keep[x:y] = False
                kept = np.frombuffer(t, np.uint8)[keep].tobytes()
                out.append((kept, len(t), len(t) - len(kept), len(start), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(none=b["none"], doc=b["doc"])

    d = _bytes(docs.select("doc_id", "text")).join(gone, (F.col("doc") == F.col("gone_doc")) & (F.col("key") == F.col("gone_key")), "left")
    out = d.select((F.col("doc") == LAST).alias("none"), "doc", "text", "spans").mapInPandas(
        run, "none boolean, doc long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    doc_id = F.when(~F.col("none"), F.col("doc")).cast(kind).alias("doc_id")
    return out.select(doc_id, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, doc_id, i AS pos, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT rid, unnest(range(pos, pos + 50)) AS b FROM w JOIN f USING (s) WHERE doc_id > first),
r AS (SELECT rid, count(*) AS n, sum(CASE WHEN prev IS NULL OR prev < b - 1 THEN 1 ELSE 0 END) AS spans
  FROM (SELECT rid, b, lag(b) OVER (PARTITION BY rid ORDER BY b) AS prev FROM c) GROUP BY rid),
k AS (SELECT rid, string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i) AS kept
  FROM (SELECT *, unnest(range(length(h) // 2)) AS i FROM d) x ANTI JOIN c ON c.rid = x.rid AND c.b = x.i GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (rid) LEFT JOIN k USING (rid)""")
def op7_passage_dedup(spark, sf_dir):
    return remove(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
