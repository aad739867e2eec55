"""Sampled segmentation into the pieces of a SentencePiece model, and lossless decoding.

The lattice of a text has an edge for every piece that stands at a place, and an edge of UTF-8 byte pieces for a
character that is no piece. Forward filtering gives every place the log of the total weight of the ways to it; backward
sampling draws the last piece by its share of that total, then the one before, down to the start. Each draw takes its
random number from the row key, the word and the step, so a row has the same segmentation on every run, in any
partitioning, and rows with another key (or another seed) have another one.

No piece holds a space mark after another character, so the lattice falls apart at each run of space marks and words
are sampled independently, which is the same distribution. The forward pass runs once for each distinct word of a
block of texts, for all words at once; memory follows the block (about ``BLOCK`` characters, or one longer text).

Weights are ``(rank + 1) ** -alpha`` with the rank of the piece in the model, a Zipf law in place of the frequencies
that a merge model does not keep. Nothing is trained.

A null text has null ids and decodes to null; an empty text has no ids. A null key is a key of its own. Rows with equal
key and text have equal ids. Space marks that occur in the text itself are written as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.text import query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a space mark of the text itself; no valid text holds it.
OWN_MARK = "\udc81"
ALPHA = 1.0
BLOCK = 1_000_000
BYTE_WEIGHT = 1e-9


@dataclass
class Pieces:
    """A piece model as arrays: a trie in an open hash table, piece weights and piece bytes."""

    keys: np.ndarray
    nexts: np.ndarray
    ends: np.ndarray
    weights: np.ndarray
    raw: list[bytes]
    byte_ids: np.ndarray

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The children of trie nodes, -1 where there is none."""
        mask = len(self.keys) - 1
        want = nodes * 2**21 + chars
        slots = _slot(want, mask)
        out = np.full(len(want), -1, np.int64)
        open_rows = np.arange(len(want))
        while len(open_rows):
            held = self.keys[slots]
            hit = held == want[open_rows]
            out[open_rows[hit]] = self.nexts[slots[hit]]
            on = ~hit & (held >= 0)
            open_rows, slots = open_rows[on], (slots[on] + 1) & mask
        return out


def _slot(keys: np.ndarray, mask: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) & np.uint64(mask)).astype(np.int64)


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    children: dict[int, int] = {}
    ends, weights, raw = [-1], [], []
    byte_ids = np.zeros(256, np.int32)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        weights.append(max(0.0, -model.get_score(i)) + 1)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            raw.append(bytes([int(piece[3:-1], 16)]))
            continue
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
            continue
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {piece!r} crosses a word")
        raw.append(piece.replace(SPACE, " ").encode())
        node = 0
        for c in piece:
            node = children.setdefault(node * 2**21 + ord(c), len(ends))
            if node == len(ends):
                ends.append(-1)
        ends[node] = i
    mask = 2 ** (2 * len(children)).bit_length() - 1
    keys, nexts = np.full(mask + 1, -1, np.int64), np.zeros(mask + 1, np.int64)
    for k, n in children.items():
        s = int(_slot(np.array([k]), mask)[0])
        while keys[s] >= 0:
            s = (s + 1) & mask
        keys[s], nexts[s] = k, n
    return Pieces(keys, nexts, np.array(ends), -np.log(np.array(weights)), raw, byte_ids)


WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SPACE)) if text else []


@dataclass
class Lattice:
    """The edges of distinct words, by end place; ``bound`` is the share up to the edge, of 2**32."""

    edges: np.ndarray  # the first edge of each place
    bound: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    first: np.ndarray
    last: np.ndarray


def filter_forward(pieces: Pieces, words: list[str], alpha: float) -> Lattice:
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(w) for w in words])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = np.repeat(np.arange(len(words)), size)
    stop = (first + size)[word]
    starts, ends, ids = [], [], []
    at, node, length = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
    single = np.zeros(len(chars), bool)
    while len(at):
        node = pieces.step(node, chars[at + length])
        at, node = at[node >= 0], node[node >= 0]
        hit = pieces.ends[node] >= 0
        starts.append(at[hit])
        ends.append(at[hit] + length)
        ids.append(pieces.ends[node[hit]])
        if not length:
            single[at[hit]] = True
        length += 1
        on = at + length < stop[at]
        at, node = at[on], node[on]
    bare = np.flatnonzero(~single)
    depth = np.arange(len(chars)) - first[word]
    order = np.argsort(depth.astype(np.uint16) if depth.max() < 2**16 else depth, kind="stable")
    place = np.empty(len(chars), np.int64)
    place[order] = np.arange(len(chars))
    # the edges of a place stand together, longest first; one length has one edge for a place at most
    degree = np.bincount(np.concatenate([*ends, bare]), minlength=len(chars))
    group = np.cumsum(degree[order]) - degree[order]
    free = group[place]
    n_edges = int(degree.sum())
    edge_start, edge_id = np.empty(n_edges, np.int64), np.empty(n_edges, np.int64)
    lists = [*zip(starts, ends, ids), (bare, bare, len(pieces.raw) + chars[bare])]
    for list_starts, list_ends, list_ids in reversed(lists):
        to = free[list_ends]
        edge_start[to], edge_id[to] = list_starts, list_ids
        free[list_ends] += 1
    starts, ids = edge_start, edge_id
    number = np.repeat(np.arange(len(chars)), degree[order])
    ends = order[number]
    weight = np.full(n_edges, np.log(BYTE_WEIGHT))
    known = ids < len(pieces.raw)
    weight[known] = pieces.weights[ids[known]] * alpha
    at_start = starts == first[word[starts]]
    total = np.zeros(len(chars))
    share = np.empty(len(ids))
    sizes = np.cumsum(np.bincount(depth))
    for a, b in zip(np.concatenate([[0], sizes[:-1]]), sizes):  # all places that are equally far into their word
        lo, hi = group[a], group[b] if b < len(group) else n_edges
        way = weight[lo:hi] + np.where(at_start[lo:hi], 0.0, total[starts[lo:hi] - 1])
        g, n = group[a:b] - lo, number[lo:hi] - a
        top = np.maximum.reduceat(way, g)
        mass = np.exp(way - top[n])
        sums = np.add.reduceat(mass, g)
        total[order[a:b]] = top + np.log(sums)
        share[lo:hi] = mass / sums[n]
    nth = np.arange(n_edges) - group[number]
    for k in range(1, int(nth.max()) + 1):  # sums inside a place, the same in every block
        later = np.flatnonzero(nth == k)
        share[later] += share[later - 1]
    bound = np.minimum(share * 2.0**32, 2.0**32 - 1).astype(np.int64)
    bound[group + degree[order] - 1] = 2**32  # the last edge takes the rest
    return Lattice(group[place], bound, ids, starts, first, first + size - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sample_backward(lattice: Lattice, kinds: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, words): the sampled pieces of words in order, and the number of pieces of each."""
    rows, place = np.arange(len(kinds)), lattice.last[kinds]
    taken, counts, step = [], np.zeros(len(kinds), np.int64), 0
    while len(rows):
        step += 1
        draw = (_mix(seeds[rows] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)).astype(np.int64)
        edge, later = lattice.edges[place], np.arange(len(rows))
        while len(later := later[lattice.bound[edge[later]] <= draw[later]]):
            edge[later] += 1
        taken.append((rows, lattice.piece[edge]))
        counts[rows] = step
        on = lattice.start[edge] != lattice.first[kinds[rows]]
        rows, place = rows[on], lattice.start[edge[on]] - 1
    out = np.empty(int(counts.sum()), np.int64)
    last = np.cumsum(counts) - 1
    for k, (r, p) in enumerate(taken):
        out[last[r] - k] = p
    return out, counts


def encode_block(pieces: Pieces, texts: list[str], keys: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): the sampled ids of the texts, one after another, and the number of ids of each."""
    number: dict[str, int] = {}
    kinds, sizes = [], []
    for t in texts:
        words = words_of(t)
        kinds += [number.setdefault(w, len(number)) for w in words]
        sizes.append(len(words))
    if not kinds:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    kinds, sizes = np.array(kinds), np.array(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    nth = np.arange(len(kinds)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seeds = _mix(keys[text] ^ _mix(nth.astype(np.uint64) + np.uint64(1)))
    ids, counts = sample_backward(filter_forward(pieces, list(number), alpha), kinds, seeds)
    text = np.repeat(text, counts)
    bare = np.flatnonzero(ids >= len(pieces.raw))
    if len(bare):  # characters without a piece become bytes
        spelled = [chr(c).replace(OWN_MARK, SPACE).encode() for c in (ids[bare] - len(pieces.raw)).tolist()]
        width = np.ones(len(ids), np.int64)
        width[bare] = [len(s) for s in spelled]
        to = np.cumsum(width) - width
        ids, text = np.repeat(ids, width), np.repeat(text, width)
        for k, s in zip(to[bare].tolist(), spelled):
            ids[k : k + len(s)] = pieces.byte_ids[list(s)]
    return ids.astype(np.int32), np.bincount(text, minlength=len(texts))


def encode(docs: DataFrame, key: Column, model: str = MODEL, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """(doc_id, text, ids): sampled piece ids of every row."""
    pieces = load(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            keys = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            blocks = (np.cumsum(lengths) - lengths) // BLOCK
            cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = b.slice(lo, hi - lo)
                words = ["" if t is None else t for t in part.column("text").to_pylist()]
                ids, sizes = encode_block(pieces, words, keys[lo:hi], alpha)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                empty = pa.compute.is_null(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=empty)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), lists], ["id", "text", "ids"])

    d = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text"), F.xxhash64(key, F.lit(seed)).alias("key"))
    out = d.mapInArrow(run, "id string, text string, ids array<int>")
    return out.select(F.col("id").cast(kind).alias("doc_id"), "text", "ids")


def decode_ids(raw: list[bytes], ids: np.ndarray) -> str:
    return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows with the text of their ids in a column ``decoded``."""
    raw = load(model).raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [decode_ids(raw, values[x:y]) if ok else None for x, y, ok in zip(offsets[:-1], offsets[1:], there)]
            yield b.append_column("decoded", pa.array(texts, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, schema + ", decoded string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless) for every row, keyed by its id."""
    back = decode(encode(docs.select("doc_id", "text"), F.col("doc_id"), model), model)
    return back.select(
        "doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


@query()
def op2_sentencepiece(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
