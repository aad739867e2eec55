"""Codes for vectors: parts of whole numbers, each replaced by the nearest entry of its part's codebook.

Codebooks are fitted by Lloyd rounds over all vectors. Every part of every vector keeps, in a written table, the entries
closest to it with a lower bound of their distance each, in order, and one outer bound for all other entries
(adaptive bounds). In the next round the bounds shrink by how far the entries moved. The distance to the
part's own entry is computed in whole numbers; entries whose bound lies above it are out, the others are verified in whole
numbers, and if the outer bound does not exclude the rest, all entries are compared. Bounds are rounded down,
so they only save work; every decision is made in whole numbers, and ties go to the lower index. How many entries are kept
follows what the rounds needed: few when the first bounds exclude the rest, more when the outer bound often fails.

Two written tables take turns, each round reads one and replaces the other. Sums are added up in the tasks and by Spark;
the driver gets the codebooks only, whose size depends on the vectors' length, not on their number.

Vectors that are null or hold a null or a number that is not finite are left out. All vectors are taken as long as the longest
one, rounded up to a multiple of the number of parts, with zeros at the end. Components are limited so that
distances fit 64 bits (16 384 at least for up to 256 of them). Null ids come last, ties by the vector; repeated rows count
as often as they stand there. With fewer rows than entries there is an entry a row. An empty table has no codes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.text import query, table
from flowmarrow.operators.ordered import with_group_stats
from flowmarrow.session import frozen, scratch_path

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: The list of kept entries grows when more than this share of parts needed all entries, and is cut to what all but
#: this share of parts needed.
TOO_MANY, SPARE = 0.05, 0.01
#: Numbers in one block of distances.
BLOCK = 1 << 21
SAFE = 1e-9
#: What every part carries from round to round: its closest entries, their lower bounds, the bound of all others.
LISTS = {"near": np.int16, "low": np.float32, "outer": np.float32}


@dataclass(frozen=True)
class Round:
    """What the tasks of a round need: entries by part, how far each moved, entries to keep."""

    books: np.ndarray
    moves: np.ndarray
    keep: int


def _down(x: np.ndarray) -> np.ndarray:
    """A bound as a 32-bit number that is not above it."""
    return np.nextafter((x * (1 - SAFE)).astype(np.float32), np.float32(-np.inf))


def _ranked(parts: np.ndarray, of: np.ndarray, r: Round) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances) of all entries of parts ``of``, closest first, ties by index."""
    d = ((parts[:, None, :] - r.books[of]) ** 2).sum(-1)
    order = np.argsort(d, axis=1, kind="stable")
    return order, np.take_along_axis(d, order, 1)


def first_lists(x: np.ndarray, of: np.ndarray, r: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(near, low, outer, distance) of parts without bounds: all entries are compared."""
    order, d = _ranked(x, of, r)
    root = np.sqrt(d.astype(np.float64))
    outer = _down(root[:, r.keep]) if r.keep < order.shape[1] else np.full(len(x), np.inf, np.float32)
    return order[:, : r.keep].astype(np.int32), _down(root[:, : r.keep]), outer, d[:, 0]


def next_lists(
    x: np.ndarray, of: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, r: Round
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(near, low, outer, distance, need) from the lists of the round before; ``need`` is how many entries besides the
    own one were verified, one more than the list has if all were. The first entry of a list is the own one."""
    low = np.where(near >= 0, low - r.moves[of[:, None], near], np.inf)
    outer = outer - r.moves.max(1)[of]
    best, at = ((x - r.books[of, near[:, 0]]) ** 2).sum(-1), near[:, 0].copy()
    limit = np.sqrt(best.astype(np.float64)) * (1 + SAFE)
    low[:, 0] = limit * (1 - 3 * SAFE)
    rest = np.argsort(low[:, 1:], axis=1, kind="stable") + 1
    near = np.concatenate([near[:, :1], np.take_along_axis(near, rest, 1)], 1)
    low = np.concatenate([low[:, :1], np.take_along_axis(low, rest, 1)], 1)
    need = (low[:, 1:] <= limit[:, None]).sum(1)
    wide = outer <= limit
    for z in range(1, near.shape[1]):
        rows = np.flatnonzero((need >= z) & ~wide)
        if not len(rows):
            break
        entry = near[rows, z]
        d = ((x[rows] - r.books[of[rows], entry]) ** 2).sum(-1)
        low[rows, z] = np.sqrt(d.astype(np.float64)) * (1 - SAFE)
        closer = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
        best[rows[closer]], at[rows[closer]] = d[closer], entry[closer]
    own = np.where(near == at[:, None], -np.inf, low)
    order = np.argsort(own, axis=1, kind="stable")
    near, low = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
    if r.keep < near.shape[1]:
        outer = np.minimum(outer, low[:, r.keep :].min(1))
        near, low = near[:, : r.keep], low[:, : r.keep]
    elif r.keep > near.shape[1]:
        more = ((0, 0), (0, r.keep - near.shape[1]))
        near, low = np.pad(near, more, constant_values=-1), np.pad(low, more, constant_values=np.inf)
    low, outer = _down(low), _down(outer)
    rows = np.flatnonzero(wide)
    if len(rows):
        near[rows], low[rows], outer[rows], best[rows] = first_lists(x[rows], of[rows], r)
        need[rows] = r.books.shape[1]
    return near, low, outer, best, need


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """The numbers of a column of lists or of packed rows of one length, as a matrix."""
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _packed(values: np.ndarray) -> pa.Array:
    """A matrix as rows of bytes, which neither Spark nor the file format takes apart."""
    n = len(values)
    values = np.ascontiguousarray(values).reshape(n, -1)
    offsets = np.arange(n + 1, dtype=np.int32) * (values.shape[1] * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), pa.int64()))


def _stepper(r: Round, last: bool):
    """A function of batches: one round for every vector, with new lists, or with codes and errors if it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts, n_entries, size = r.books.shape
        block = max(1, BLOCK // max(1, n_parts * n_entries * size))
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                b = whole.slice(start, block)
                n = b.num_rows
                plain = _numbers(b.column("v"), np.int32)
                x = plain.astype(np.int64).reshape(n * n_parts, size)
                of = np.tile(np.arange(n_parts), n)
                if "near" in b.schema.names:
                    near, low, outer = (_numbers(b.column(c), k) for c, k in LISTS.items())
                    near, low, outer = (a.reshape(n * n_parts, -1) for a in (near, low, outer))
                    near, low, outer = near.astype(np.int32), low.astype(np.float64), outer[:, 0].astype(np.float64)
                    near, low, outer, d, need = next_lists(x, of, near, low, outer, r)
                else:
                    near, low, outer, d = first_lists(x, of, r)
                    need = np.full(len(of), -1)
                same = [b.column("vec_id"), b.column("label")]
                if last:
                    code = [bytes(c.tolist()).hex() for c in near[:, 0].reshape(n, n_parts)]
                    more = {"code": pa.array(code, pa.string()), "error": pa.array(d.reshape(n, n_parts).sum(1), pa.int64())}
                else:
                    lists = zip(LISTS.items(), (near, low, outer))
                    more = {"v": _packed(plain), "need": _packed(need.astype(np.int16).reshape(n, -1))}
                    more |= {c: _packed(a.astype(kind).reshape(n, -1)) for (c, kind), a in lists}
                yield pa.RecordBatch.from_arrays([*same, *more.values()], ["vec_id", "label", *more])

    return run


def _adder(n_parts: int, n_entries: int, size: int, keep: int):
    """A function of batches: sums and counts of the parts of every entry, and how often each ``need`` was met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_parts * n_entries, size), np.int64)
        counts, needs = np.zeros(n_parts * n_entries, np.int64), np.zeros(n_entries + 1, np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = _numbers(b.column("v"), np.int32).astype(np.int64).reshape(n * n_parts, size)
            entry = _numbers(b.column("near"), np.int16).reshape(n * n_parts, keep)[:, 0]
            slot = np.tile(np.arange(n_parts) * n_entries, n) + entry
            counts += np.bincount(slot, minlength=len(counts))
            order = np.argsort(slot, kind="stable")
            at, begin = np.unique(slot[order], return_index=True)
            sums[at] += np.add.reduceat(x[order], begin, axis=0)
            need = _numbers(b.column("need"), np.int16).reshape(-1)
            needs += np.bincount(need[need >= 0], minlength=len(needs))
        part = np.repeat(np.arange(n_parts), n_entries)
        entry = np.tile(np.arange(n_entries), n_parts)
        rows = np.concatenate([counts, needs])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([part, np.full(n_entries + 1, -1)]), pa.int32()),
                pa.array(np.concatenate([entry, np.arange(n_entries + 1)]), pa.int32()), pa.array(rows, pa.int64()),
                _lists(np.concatenate([sums, np.zeros((n_entries + 1, size), np.int64)])),
            ],
            ["part", "entry", "n", "sums"],
        )

    return run


def whole_vectors(df: DataFrame, vec: str, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the vectors that count, as whole numbers of one length, and that length."""
    x = F.col(vec).cast("array<double>")
    good = F.col(vec).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.where(good).select("vec_id", "label", x.alias("x"))
    length = kept.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0
    length = -(-length // parts) * parts
    most = math.isqrt((1 << 61) // max(length, 1)) // 2
    number = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(most))), F.lit(float(-most)))).cast("int")
    v = F.concat(F.transform("x", number), F.array_repeat(F.lit(0), F.lit(length) - F.size("x")))
    return kept.select("vec_id", "label", v.alias("v")), length


def fitted_keep(needs: np.ndarray, keep: int, entries: int) -> int:
    """How many entries the next lists hold, from how often 0, 1, ... or all of the others had to be verified."""
    total = needs.sum()
    if not total:
        return keep
    if needs[entries] > TOO_MANY * total:
        return min(entries, 2 * keep)
    beyond = total - np.cumsum(needs)
    used = int(np.flatnonzero(beyond <= SPARE * total + needs[entries])[0]) + 1
    return min(entries, max(2, entries // 8, min(keep, used)))


def compress(
    df: DataFrame, vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of a table with columns ``vec_id``, ``label`` and the vectors.

    A code has two hex digits a part; ``error`` is the squared distance of the vector to its entries. Codebooks are indexed
    by part, entry and position.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 256 entries at most")
    spark = df.sparkSession
    kept, length = whole_vectors(df, vec, parts)
    rows = frozen(kept, "codes-vectors")
    size = length // parts
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    same = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    if not start:
        return spark.createDataFrame([], f"{same}, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, size).transpose(1, 0, 2)
    entries = len(start)
    now = Round(books, np.zeros(books.shape[:2]), min(entries, max(2, entries // 4)))
    turn = [scratch_path(spark, "codes"), scratch_path(spark, "codes")]
    state = f"{same}, v binary, need binary, " + ", ".join(f"{c} binary" for c in LISTS)
    for k in range(rounds):
        rows.mapInArrow(_stepper(now, False), state).write.mode("overwrite").parquet(turn[k % 2])
        rows = spark.read.schema(state).parquet(turn[k % 2])
        told = rows.mapInArrow(_adder(parts, entries, size, now.keep), "part int, entry int, n long, sums array<long>")
        sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]
        books, needs = now.books.copy(), np.zeros(entries + 1, np.int64)
        for r in told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            if r["part"] < 0:
                needs[r["entry"]] = r["n"]
            elif r["n"]:
                books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
        moved = np.sqrt(((books - now.books) ** 2).sum(-1).astype(np.float64)) * (1 + SAFE)
        now = Round(books, moved, fitted_keep(needs, now.keep, entries))
    coded = rows.mapInArrow(_stepper(now, True), f"{same}, code string, error long")
    return frozen(coded, "codes-done"), books


def decoded(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows with ``vector``, what their codes stand for."""
    words = [[(entry / SCALE).tolist() for entry in part] for part in books]
    kind = "array<array<double>>"
    tables = [F.from_json(F.lit(str(part)), kind) for part in words]
    at = lambda i: F.conv(F.substring("code", 2 * i + 1, 2), 16, 10).cast("int")
    return coded.withColumn("vector", F.concat(*[F.get(t, at(i)) for i, t in enumerate(tables)]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _round_sql(k: int) -> str:
    """Assignment ``a<k>`` to the entries ``c<k>``, and the entries after it."""
    return f"""
a{k} AS MATERIALIZED (SELECT rid, p.part, min(d) AS d, arg_min(entry, d * 1000 + entry) AS entry FROM (
  SELECT p.rid, p.part, c.entry, CAST(coalesce(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), 0) AS BIGINT) AS d
  FROM p JOIN c{k} c ON c.part = p.part) p GROUP BY rid, p.part),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (
  SELECT part, entry, list(m ORDER BY i) AS x FROM (
    SELECT part, entry, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (
      SELECT a.part, a.entry, unnest(p.x) AS y, unnest(range(len(p.x))) AS i FROM a{k} a JOIN p ON p.rid = a.rid AND p.part = a.part)
    GROUP BY part, entry, i) GROUP BY part, entry) n ON n.part = c.part AND n.entry = c.entry)"""


@query(
    f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM e, range(8) t(part)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM e QUALIFY entry < {ENTRIES}),
c0 AS MATERIALIZED (SELECT part, entry, x FROM f JOIN p USING (rid)),"""
    + ",".join(_round_sql(k) for k in range(ROUNDS + 1))
    + f""",
r AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid),
h AS (SELECT sha256(string_agg(y, ',' ORDER BY part, entry)) AS sha FROM (SELECT part, entry, array_to_string(x, ',') AS y FROM c{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM r JOIN e USING (rid), h"""
)
def op12_vector_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = compress(rows)
    # a null label is a label of its own
    coded = coded.withColumns({"none": F.col("label").isNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    keys = ["none", "name"]
    stats = coded.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    done = with_group_stats(coded, stats, keys, "n", ["vec_id", "code"])
    return done.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
