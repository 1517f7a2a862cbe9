"""Vector code compression: product codes by Lloyd's algorithm with Yinyang bounds.

Vectors are cut into equal consecutive parts, every part position has a codebook,
and a vector's code is the index of the nearest entry for each part.  Codebooks
start from the vectors with the smallest ids; a round assigns all parts and then
moves every entry to the componentwise floor of its parts' mean.

Entries are clustered into groups once.  Each part keeps one lower bound a group,
of its distance to the group's entries (but for its own entry), less what the
group's entries have moved since.  Its own entry's distance is computed anew; only
groups whose bound isn't above it are scanned.  Components are integers, so
distances are too, and ties are decided among exact integers, never by bounds: a
bound that is equal fails.

The vectors with their codes and bounds are rows that a round reads and writes in
the shared folder, so a lost executor costs the running round's tasks alone; the
driver sees codebooks and their sums, whose size is parts x entries.

Defined cases: vectors that are null or hold a null, NaN or infinite component
and rows with a null vec_id are dropped; components are floor(scale * x) in double
precision and end at +-LIMIT, so that an error fits a long; vectors shorter than
the longest, and a last part that is shorter, end in zeros; of repeated ids the
vectors are ordered by their components; with fewer vectors than entries there is
an entry each; unused entries stay; ties go to the lower index; extra columns are
kept in a struct, so that names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.common import arrow_map, forget, join_counted, settle, table
from rankforge.llm.topk import to_integers
from rankforge.llm.vectors import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 27
#: Entries in a group, about.
GROUP = 16
_EXACT = float(1 << 53)


def grouped(entries: np.ndarray, size: int = GROUP, rounds: int = 5) -> list[np.ndarray]:
    """Indices of the entries by group: a few rounds of Lloyd over the entries; any grouping gives the same codes."""
    centres = entries[:: max(1, size)].astype(np.float64)
    for _ in range(rounds):
        near = squares(entries.astype(np.float64), centres).argmin(1)
        centres = np.stack([entries[near == g].mean(0) if (near == g).any() else c for g, c in enumerate(centres)])
    return [own for g in range(len(centres)) if len(own := np.flatnonzero(near == g))]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same of integer rows, exactly: in floats where no sum can leave their exact range."""
    most = float(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    if 4 * most * most * x.shape[1] < _EXACT:
        return squares(x.astype(np.float64), y.astype(np.float64)).astype(np.int64)
    return squares(x, y)


def assign(x: np.ndarray, entries: np.ndarray, groups: list[np.ndarray], code: np.ndarray | None = None, lower: np.ndarray | None = None, scanned: list[int] | None = None):
    """(code, squared distance, lower bounds by group) of each row of x.

    `code` and `lower` are those of the last round, the bounds already less the
    groups' drift; without them every group is scanned.  The numbers of distances
    computed go to `scanned`.
    """
    n = len(x)
    lower = np.full((n, len(groups)), -np.inf) if code is None else lower.astype(np.float64)
    old = np.full(n, -1) if code is None else code.astype(np.int64)
    code = np.maximum(old, 0)
    best = ((x - entries[code]) ** 2).sum(1)
    old_best = best.copy()
    # the two smallest distances to each scanned group, and who has the smallest
    who = np.full((n, len(groups)), -1)
    second = np.zeros((n, len(groups)))
    for g, members in enumerate(groups):
        rows = np.flatnonzero(lower[:, g] <= np.sqrt(best) * (1 + 1e-12))
        if not len(rows):
            continue
        apart = distances(x[rows], entries[members])
        if scanned is not None:
            scanned.append(apart.size)
        first = apart.argmin(1)  # members ascend: ties to the lower index
        nearest, index = apart[np.arange(len(rows)), first], members[first]
        apart[np.arange(len(rows)), first] = np.iinfo(np.int64).max
        who[rows, g], lower[rows, g] = index, np.sqrt(nearest)
        second[rows, g] = np.sqrt(apart.min(1)) if len(members) > 1 else np.inf
        closer = (nearest < best[rows]) | ((nearest == best[rows]) & (index < code[rows]))
        best[rows[closer]], code[rows[closer]] = nearest[closer], index[closer]
    lower = np.where((who == code[:, None]) & (who >= 0), second, lower)
    moved = np.flatnonzero((old >= 0) & (old != code))
    if len(moved):  # the last round's entry is one of its group's others now
        of = np.empty(len(entries), np.int64)
        for g, members in enumerate(groups):
            of[members] = g
        left = of[old[moved]]
        lower[moved, left] = np.minimum(lower[moved, left], np.sqrt(old_best[moved]))
    return code, best, np.nextafter(lower.astype(np.float32), np.float32(-np.inf))


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(row, codes and error for each row with a usable vector, codebooks as parts x entries x components).

    `rows` has vec_id and an integer vector in `ints`; its other columns are in the struct `row`.
    """
    known = rows.where("vec_id IS NOT NULL AND ints IS NOT NULL")
    kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "ints"]).alias("row")
    bounded = F.transform("ints", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x)).cast("int"))
    known = known.select("vec_id", kept, bounded.alias("ints"))
    first = known.select("vec_id", "ints").orderBy("vec_id", "ints").limit(entries).collect()
    width = -(-max(1, known.agg(F.max(F.size("ints"))).first()[0] or 1) // parts)
    books = np.zeros((parts, len(first), width), np.int64)
    for k, r in enumerate(first):
        books[:, k] = np.pad(r["ints"], (0, parts * width - len(r["ints"]))).reshape(parts, width)
    if not first:
        return known.select("row", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    groups = [grouped(book) for book in books]
    most = max(map(len, groups))
    kind = known.schema["row"].dataType.simpleString()
    state, drift = known.select("row", "ints"), None
    for round_ in range(rounds + 1):
        shared = rows.sparkSession.sparkContext.broadcast((books, groups, drift))

        def step(batches: Iterator[pa.RecordBatch], shared=shared, last=round_ == rounds) -> Iterator[pa.RecordBatch]:
            books, groups, drift = shared.value
            for batch in batches:
                x = matrix(batch.column(1), parts * width, np.int64).reshape(len(batch), parts, width)
                codes, error, lower = np.zeros((len(x), parts), np.int32), np.zeros(len(x), np.int64), np.zeros((len(x), parts, most), np.float32)
                old = None if drift is None else (_fixed(batch.column(2), parts), _fixed(batch.column(4), parts * most).reshape(len(x), parts, most))
                for p in range(parts):
                    n = len(groups[p])
                    before = () if old is None else (old[0][:, p], old[1][:, p, :n] - drift[p])
                    codes[:, p], squared, lower[:, p, :n] = assign(x[:, p], books[p], groups[p], *before)
                    error += squared
                kept = [batch.column(0), batch.column(1), _lists(codes), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*kept, _lists(lower.reshape(len(x), -1)[:, : 0 if last else None])], names=["row", "ints", "codes", "error", "bounds"])

        after = settle(arrow_map(state, step, f"row {kind}, ints array<int>, codes array<int>, error long, bounds array<float>"))
        if round_:
            forget(state)
        state = after
        if round_ == rounds:
            break
        moved = _means(state, books)
        # rounded up: what a group's bound loses is the largest move of its entries
        far = [np.sqrt(((moved[p] - books[p]) ** 2).sum(1).astype(np.float64)) * (1 + 1e-12) for p in range(parts)]
        drift = [np.array([far[p][g].max() for g in groups[p]]) for p in range(parts)]
        books = moved
    return state.select("row", "codes", "error"), books


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: tasks add their rows up, one partial sum a component."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)  # the last one counts
        for batch in batches:
            x = matrix(batch.column(0), parts * width, np.int64).reshape(len(batch), parts, width)
            code = _fixed(batch.column(1), parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, start = np.unique(code[order, p], return_index=True)
                if len(used):
                    total[p, used, :width] += np.add.reduceat(x[order, p], start, axis=0)
                    total[p, used, width] += np.diff(np.append(start, len(order)))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(total.ravel()[slot], pa.int64())], names=["slot", "total"])

    sums = arrow_map(state.select("ints", "codes"), add, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros(parts * entries * (width + 1), np.int64)
    total[sums["slot"].to_numpy()] = sums["total"].to_numpy()
    total = total.reshape(parts, entries, width + 1)
    used = total[:, :, width:] > 0
    return np.where(used, total[:, :, :width] // np.maximum(total[:, :, width:], 1), books)


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def integers(vector: Column) -> Column:
    return to_integers(vector, SCALE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", integers(F.col("embedding")).alias("ints"))
    found, books = compress(rows)
    found = found.select("row.vec_id", "row.label", "codes", "error")
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    found = join_counted(found, settle(totals), "label", "n", "vec_id")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    parts = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, p, ints[p * (len(ints) // 4) + 1 : (p + 1) * (len(ints) // 4)] AS part FROM v, range(4) t(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, part AS centre FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)
)"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""near{r} AS MATERIALIZED (
  SELECT x.vec_id, any_value(x.label) AS label, x.p, any_value(x.part) AS part,
         min(CAST(list_inner_product(x.part, x.part) - 2 * list_inner_product(x.part, b.centre) + list_inner_product(b.centre, b.centre) AS BIGINT) * 256 + b.entry) AS found
  FROM x JOIN book{r} b ON x.p = b.p GROUP BY x.vec_id, x.p
)""")
        if r < ROUNDS:
            parts.append(f"""sum{r} AS (
  SELECT p, found % 256 AS entry, i, floor(sum(part[i + 1]) / count(*)) AS value FROM near{r}, range(len(part)) t(i) GROUP BY ALL
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.entry, coalesce(any_value(m.centre), any_value(b.centre)) AS centre
  FROM book{r} b LEFT JOIN (SELECT p, entry, list(value ORDER BY i) AS centre FROM sum{r} GROUP BY p, entry) m ON b.p = m.p AND b.entry = m.entry GROUP BY b.p, b.entry
)""")
    ctes = ",\n".join(parts)
    return f"""WITH {ctes}, coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', found % 256)), '' ORDER BY p) AS code, CAST(sum(found // 256) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id
), text AS (
  SELECT sha256(string_agg(CAST(CAST(centre[i + 1] AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, i)) AS digest FROM book{ROUNDS}, range(len(centre)) t(i)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM coded, text"""


ORACLE_SQL = _oracle()
