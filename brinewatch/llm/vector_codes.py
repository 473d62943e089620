"""Vector compression by product codes, with memoised grid cells.

Vectors of integers are cut into parts; each part is coded as the nearest entry of its codebook, and the
codebooks are improved by a few rounds of assignment and averaging. To find the nearest entry, space is cut
into a grid. For each cell that holds a part it is worked out once, and remembered under the cell, which
entries can be nearest to any point of it: those whose least distance to the cell's box is within the
smallest of all greatest distances. Only these are then compared exactly. What is remembered follows from cell and
codebooks alone, so results do not depend on how rows are dealt out or on how much is remembered.

Codebooks (``entries`` x vector) and their sums are the only things that leave the executors; they do not
grow with the rows.

Cases: rows whose vector is null or holds a null, NaN or infinite component are dropped; a null id comes
after all others, and equal ids are ordered by their components; fewer rows than entries give smaller
codebooks; the shape is that of the row of the least id, and rows of another length, or of one that does not part
evenly, keep a row with null code and errors; components beyond 2^27 in magnitude count as 2^27, so that
errors fit 64 bits; a sum of errors over only such rows is null; an empty table gives no rows; other columns pass through, except those with
the name of a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewatch.llm.tables import fresh
from brinewatch.session import checked_broadcast, checkpointed

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Side of a grid cell.
CELL = 64
#: Cells that a task remembers at most for each part; beyond, it starts afresh.
REMEMBERED = 100_000
#: Parts that are worked on at once.
ROWS = 2048
LARGEST = 1 << 27
#: A label of more than one in so many rows is not dealt out by label.
HOT_SHARE = 10_000

RESULT = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers; null if the vector is null or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = F.lit(float(LARGEST))
    whole = F.transform(vector, lambda x: F.greatest(-limit, F.least(limit, F.floor(x.cast("double") * scale).cast("double"))).cast("long"))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


class Nearest:
    """Nearest entries of one codebook, ``[entry, dimension]``; ties go to the lower entry."""

    def __init__(self, book: np.ndarray, cell: int = CELL, remembered: int = REMEMBERED):
        self.book, self.cell, self.remembered = book, cell, remembered
        self.known: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def _possible(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries not dominated across its box, ascending."""
        least = np.zeros((len(cells), len(self.book)), np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            # Cells share few places along a dimension: distances are looked up by place.
            places, back = np.unique(cells[:, d], return_inverse=True)
            below = places[:, None] * self.cell - self.book[None, :, d]
            above = -below - (self.cell - 1)
            least += (np.maximum(np.maximum(below, above), 0) ** 2)[back]
            most += (np.maximum(np.abs(below), np.abs(above)) ** 2)[back]
        inside = least <= most.min(axis=1)[:, None]
        which = np.nonzero(inside)[1].astype(np.int32)
        return np.split(which, np.cumsum(inside.sum(axis=1))[:-1])

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, and its squared distance."""
        cells = points // self.cell
        key = np.ascontiguousarray(cells.astype(np.int32)).view(np.dtype((np.void, 4 * cells.shape[1]))).reshape(-1)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        names = [key[i].tobytes() for i in first]
        found = [self.known.get(name) for name in names]
        new = [i for i, entries in enumerate(found) if entries is None]
        if new:
            if len(self.known) + len(new) > self.remembered:
                self.known.clear()
            for i, entries in zip(new, self._possible(cells[first[new]])):
                found[i] = self.known[names[i]] = entries
        size = np.array([len(entries) for entries in found])
        flat, start = np.concatenate(found), np.cumsum(size) - size
        count = size[back]
        at = np.cumsum(count) - count
        entry = flat[np.repeat(start[back] - at, count) + np.arange(int(count.sum()))]
        self.evaluated += len(entry)
        far = ((np.repeat(points, count, axis=0) - self.book[entry]) ** 2).sum(axis=1)
        error = np.minimum.reduceat(far, at)
        hit = np.flatnonzero(far == np.repeat(error, count))
        return entry[hit[np.searchsorted(hit, at)]], error


def _points(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the right width, and their components."""
    rows = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == width)
    return rows, np.asarray(column.take(pa.array(rows)).flatten()).astype(np.int64).reshape(len(rows), width)


def _assigned(batch: pa.RecordBatch, name: str, books: np.ndarray, nearest: list[Nearest]):
    """Slices of the batch's coded rows: row numbers, components, entries and errors by part."""
    parts, _, width = books.shape
    rows, points = _points(batch.column(name), parts * width)
    for k in range(0, len(rows), ROWS):
        x = points[k : k + ROWS].reshape(-1, parts, width)
        found = [nearest[p](np.ascontiguousarray(x[:, p])) for p in range(parts)]
        yield rows[k : k + ROWS], x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def first_books(vectors: DataFrame, name: str, id_col: str, parts: int, entries: int) -> np.ndarray:
    """Codebooks ``[part, entry, dimension]`` of the rows of the least ids; no entry if no row can be coded."""
    rows = vectors.select(id_col, name).orderBy(F.col(id_col).asc_nulls_last(), name).limit(entries).collect()
    width = len(rows[0][name]) if rows else 0
    if not width or width % parts:
        return np.zeros((parts, 0, 0), np.int64)
    kept = np.array([r[name] for r in rows if len(r[name]) == width], np.int64)
    return np.ascontiguousarray(kept.reshape(len(kept), parts, width // parts).transpose(1, 0, 2))


def improved(vectors: DataFrame, name: str, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: floored means of the parts assigned to each entry; unused entries stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        nearest = [Nearest(book) for book in books]
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, x, entry, _ in _assigned(batch, name, books, nearest):
                for p in range(len(books)):
                    np.add.at(total[p], entry[:, p], x[:, p])
                    count[p] += np.bincount(entry[:, p], minlength=books.shape[1])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((part * books.shape[1] + entry).astype(np.int64)),
                pa.array(count[part, entry]),
                pa.array(list(total[part, entry]), pa.list_(pa.int64())),
            ],
            ["place", "n", "sums"],
        )

    # As many numbers a task as the codebooks hold; they are added up by entry and dimension.
    each = vectors.select(name).mapInArrow(sums, "place bigint, n bigint, sums array<bigint>")
    rows = (
        each.select("place", "n", F.posexplode("sums").alias("d", "s"))
        .groupBy("place", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    )
    out = books.copy().reshape(-1, books.shape[2])
    for r in rows:
        out[r.place, r.d] = r.s // r.n
    return out.reshape(books.shape)


def codebooks(
    vectors: DataFrame, name: str, id_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray:
    """Codebooks for a written table of integer vectors."""
    books = first_books(vectors, name, id_col, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = improved(vectors, name, books)
    return books


def coded(vectors: DataFrame, name: str, books: np.ndarray) -> DataFrame:
    """``vectors`` with ``code``, two hex digits a part (more for larger codebooks), and ``error``."""
    kept = [f for f in vectors.schema if f.name not in RESULT.names]
    if not books.size:
        nothing = (F.lit(None).cast(f.dataType).alias(f.name) for f in RESULT.fields)
        return vectors.select(*(f.name for f in kept), *nothing)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        nearest = [Nearest(book) for book in books]
        digits = max(2, len(f"{books.shape[1] - 1:x}"))
        hexes = np.array([f"{e:0{digits}x}" for e in range(books.shape[1])], object)
        for batch in batches:
            codes, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            for rows, _, entry, error in _assigned(batch, name, books, nearest):
                codes[rows] = hexes[entry].sum(axis=1)
                errors[rows] = error.sum(axis=1)
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *RESULT.names])

    return vectors.select(*(f.name for f in kept)).mapInArrow(code, T.StructType([*kept, *RESULT.fields]))


def decoded(codes: DataFrame, books: np.ndarray, name: str = "decoded") -> DataFrame:
    """``codes`` with the integer vectors that their ``code`` stands for; null codes stand for null."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    kept = [f for f in codes.schema if f.name != name]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))
        for batch in batches:
            found = [
                code and [v for p, book in enumerate(books) for v in book[int(code[p * digits : (p + 1) * digits], 16)].tolist()]
                for code in batch.column("code").to_pylist()
            ]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], [*(f.name for f in kept), name])

    return codes.select(*(f.name for f in kept)).mapInArrow(decode, T.StructType([*kept, T.StructField(name, T.ArrayType(T.LongType()))]))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame, label: str) -> DataFrame:
    """Written ``rows`` with ``label_error``, the sum of ``error`` over equal labels, nulls together."""
    key, n = fresh(rows, "key"), fresh(rows, "n")
    total = rows.groupBy(F.col(label).alias(key)).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias(n))
    small, fits = checked_broadcast(total.drop(n))
    same = F.col(label).eqNullSafe(F.col(key))
    if fits:
        return rows.join(small, same, "left").drop(key)
    # Labels of many rows are few: they are broadcast, and only rows of the others are dealt out by label.
    total = checkpointed(total)
    many = (total.agg(F.sum(n)).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(total.where(F.col(n) > many).drop(n))
    others = rows.join(hot, same, "left_anti").join(total.where(F.col(n) <= many).drop(n), same, "left")
    return rows.join(hot, same).unionByName(others).drop(key)


def compress(
    vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Rows of good vectors without the vector, with ``code`` and ``error``, and the codebooks."""
    name = fresh(vectors, "whole")
    whole = checkpointed(vectors.withColumn(name, integers(F.col(vector))).where(F.col(name).isNotNull()).drop(vector))
    books = codebooks(whole, name, id_col, parts, entries, rounds)
    return coded(whole, name, books).drop(name), books


def compression_report(vectors: DataFrame) -> DataFrame:
    """One row per good vector: its code and error, its label's error and a digest of the codebooks."""
    done, books = compress(vectors.select("vec_id", "embedding", "label"))
    rows = with_label_error(checkpointed(done), "label")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def report_sql(rounds: int = ROUNDS) -> str:
    """SQL for ``compression_report``: every part against every entry, for tables whose vectors part evenly."""
    sql = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x
  FROM kept, (SELECT unnest(range({PARTS})) AS p)),
book0 AS MATERIALIZED (
  SELECT p, e, x AS b FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM points)
  WHERE e < {ENTRIES})"""
    for k in range(rounds + 1):
        sql += f""",
near{k} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(x) AS x,
    min((list_inner_product(x, x) - 2 * list_inner_product(x, b) + list_inner_product(b, b))::BIGINT * {ENTRIES} + e) AS m
  FROM points JOIN book{k} USING (p) GROUP BY vec_id, label, p)"""
        if k < rounds:
            sql += f""",
book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.b, o.b) AS b FROM book{k} o LEFT JOIN (
    SELECT p, e, list(mean ORDER BY d) AS b FROM (
      SELECT p, m % {ENTRIES} AS e, d, floor(sum(x[d]) / count(*)) AS mean
      FROM near{k}, unnest(range(1, len(x) + 1)) AS places(d) GROUP BY ALL) GROUP BY p, e) m USING (p, e))"""
    return sql + f""",
digest AS (
  SELECT sha256(string_agg(list_aggregate(list_transform(b, lambda y: y::BIGINT), 'string_agg', ','), ',' ORDER BY p, e)) AS h
  FROM book{rounds}),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded, digest"""
