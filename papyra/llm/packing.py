"""Length buckets with the least padding, and batches of bounded size inside them.

The histogram of lengths, which is small, comes to the driver; dynamic programming chooses the bucket boundaries
that minimise the padding of the whole table. Inside a bucket every row is padded to the bucket's boundary, and
batches take rows until the token budget is full. Ranks come from counts by slice and running sums of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.common import text_or_empty, written

BUCKETS = 16
BUDGET = 65_536
#: Rows that share a slice, about; and slices that share a running sum.
SLICE, SPAN = 256, 1024


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The boundaries, ascending, of at most so many buckets that give the least padding in total.

    A row of length n goes to the first boundary of at least n. With lengths l and running counts C and sums S, the
    cost of a bucket that ends at j after one that ended at i is l[j] (C[j] - C[i]) - (S[j] - S[i]); for each
    number of buckets this is a lower envelope of lines, so a round costs time in proportion to the distinct lengths.
    """
    lengths = sorted(n for n, rows in histogram.items() if rows > 0)
    if not lengths:
        return []
    rows, total = [0], [0]
    for n in lengths:
        rows.append(rows[-1] + histogram[n])
        total.append(total[-1] + n * histogram[n])
    m = len(lengths)
    best: list[int | None] = [0] + [None] * m
    back: list[list[int]] = []
    for _ in range(min(buckets, m)):
        lines: list[tuple[int, int, int]] = []  # slope, height, i
        first, now, came = 0, [None] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                slope, height = -rows[j - 1], best[j - 1] + total[j - 1]
                while len(lines) - first >= 2:
                    (s1, h1, _), (s2, h2, _) = lines[-2], lines[-1]
                    if (height - h1) * (s1 - s2) <= (h2 - h1) * (s1 - slope):
                        lines.pop()
                    else:
                        break
                lines.append((slope, height, j - 1))
            x = lengths[j - 1]
            while len(lines) - first >= 2 and lines[first + 1][0] * x + lines[first + 1][1] <= lines[first][0] * x + lines[first][1]:
                first += 1
            if len(lines) > first:
                slope, height, i = lines[first]
                now[j], came[j] = slope * x + height + x * rows[j] - total[j], i
        back.append(came)
        best = now
    bounds, j = [], m
    for came in reversed(back):
        bounds.append(lengths[j - 1])
        j = came[j]
    return bounds[::-1]


def n_words(text_col: str = "text") -> Column:
    """Runs of characters other than ASCII white space; 0 for a null text."""
    return F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _bucket(n: Column, bounds: list[int], low: int = 0) -> Column:
    """The position of the first boundary of at least n, by halving."""
    if len(bounds) == 1:
        return F.lit(low)
    half = len(bounds) // 2
    return F.when(n <= bounds[half - 1], _bucket(n, bounds[:half], low)).otherwise(_bucket(n, bounds[half:], low + half))


def pack(df: DataFrame, length: Column | None = None, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """A row per row of df: id_col, n_tokens, bucket, padded_tokens, batch, slot.

    length: tokens of a row, the words of ``text`` by default; null counts as 0. A batch belongs to one bucket and
    holds max(1, budget // padded length) rows, the bucket's last one what is left, so a row longer than the budget
    is a batch of its own. Every row, of whatever length, null or repeated id included, is in one batch at one slot.
    Rows of a bucket come in the order of a hash of id and text (or length), which mixes neighbours and is the same
    however the table lies in files; rows that are equal in both are interchangeable. Ids go through as they are; other columns
    are ignored. An empty table gives no rows.

    To the driver come the distinct lengths and their counts: no more than the square root of twice the tokens.
    Texts are read once; what moves is ids and lengths. Slices keep a bucket that holds most rows spread out.
    """
    size = F.coalesce(n_words() if length is None else length.cast("long"), F.lit(0).cast("long"))
    own = df.select(F.col(id_col).alias("id"), size.alias("n_tokens"), F.xxhash64(F.col(id_col), text_or_empty() if length is None else size).alias("place"))
    rows = written(own, "lengths")
    histogram = {r["n_tokens"]: r["n"] for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = bucket_bounds(histogram, buckets) or [0]
    slices = max(1, sum(histogram.values()) // SLICE)
    placed = rows.withColumn("bucket", _bucket(F.col("n_tokens"), bounds)).withColumn("slice", F.pmod(F.xxhash64("place"), F.lit(slices)))

    counts = placed.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.floor(F.col("slice") / SPAN))
    before = lambda *order: F.coalesce(F.sum("n").over(Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy("bucket", "span").agg(F.sum("n").alias("n")).select("bucket", "span", before("bucket", "span").alias("span_start"))
    starts = counts.select("bucket", "span", "slice", before("bucket", "span", "slice").alias("start")).join(spans, ["bucket", "span"])

    nth = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("place", "id", "n_tokens"))
    ranked = placed.withColumn("r", nth - 1).join(starts, ["bucket", "slice"])
    rank = F.col("r") + F.col("start") + F.col("span_start")
    padded = F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("bucket") + 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("padded_tokens"), F.lit(1))))
    return (
        ranked.withColumn("rank", rank)
        .withColumn("padded_tokens", padded)
        .withColumn("room", room)
        .select(F.col("id").alias(id_col), "n_tokens", "bucket", "padded_tokens", F.floor(F.col("rank") / F.col("room")).alias("batch"), (F.col("rank") % F.col("room")).alias("slot"))
    )
