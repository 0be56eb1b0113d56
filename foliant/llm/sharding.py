"""Shards along a Hilbert curve over document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialize, text_of

#: Bits for each of the three dimensions: language, source and size.
BITS = 8
#: Rows of a cell that are ranked in one task; larger cells are split by hash.
RANKED = 256
#: Cells and values of a dimension are broadcast up to this many (some 16 bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000


def hilbert_steps(dims: int = 3) -> list[tuple[int, int]]:
    """By state * 2**dims + corner: (digit, next state) of the Hilbert curve (Hamilton and Rau-Chaplin 2008).

    A state is entry * dims + direction; a corner has a bit of each coordinate, the first one highest.
    """
    top = (1 << dims) - 1
    right = lambda x, n: ((x >> n) | (x << (dims - n))) & top if n else x
    left = lambda x, n: ((x << n) | (x >> (dims - n))) & top if n else x
    gray = lambda x: x ^ (x >> 1)
    ranks = {gray(w): w for w in range(1 << dims)}
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing one bits
    entry = lambda w: gray(2 * ((w - 1) // 2)) if w else 0
    way = lambda w: 0 if not w else ones(w - 1 if w % 2 == 0 else w) % dims
    out = []
    for e in range(1 << dims):
        for d in range(dims):
            for corner in range(1 << dims):
                w = ranks[right(corner ^ e, (d + 1) % dims)]
                out.append((w, (e ^ left(entry(w), (d + 1) % dims)) * dims + (d + way(w) + 1) % dims))
    return out


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """The place of a cell on the curve: a digit per bit, from the table of steps."""
    dims, steps = len(coordinates), hilbert_steps(len(coordinates))
    table = F.array(*[F.lit(w * 1024 + s) for w, s in steps])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("state"))

    def step(acc: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for c in coordinates:
            corner = corner * 2 + F.call_function("getbit", c.cast("long"), bit).cast("int")
        found = F.get(table, acc.state * (1 << dims) + corner)
        return F.struct((acc.at * (1 << dims) + F.floor(found / 1024)).cast("long").alias("at"), (found % 1024).cast("int").alias("state"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc.at)


def text_size(column: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0)).cast("long") + 1


def text_checksum(column: str = "text") -> Column:
    return F.crc32(F.encode(text_of(column), "UTF-8"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_CELLS else table


def with_cells(rows: DataFrame) -> DataFrame:
    """Adds _cell, the curve's index, to rows (lang, source, _size).

    Each dimension is quantised by its own values, in their order (sizes by eighths of their logarithm; null last): a value's coordinate is the share of the
    rows before it, in 2 ** BITS steps, so that the bits are spent where rows differ. The values are counted first and joined.
    """
    octave = F.floor(F.log2(F.col("_size").cast("double")) * 8)
    counts = materialize(rows.groupBy("lang", "source", octave.alias("octave")).agg(F.count("*").alias("n")), "shard-values")
    placed = rows.withColumn("_octave", octave)
    for name, own in (("lang", "lang"), ("source", "source"), ("octave", "_octave")):
        before = Window.orderBy(F.col(name).isNull(), name)  # a row for each value
        known = counts.groupBy(name).agg(F.sum("n").alias("n"))
        share = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.sum("n").over(Window.partitionBy())
        known = materialize(known.select(F.col(name).alias(f"_of_{name}"), F.floor(share * (1 << BITS)).alias(f"_at_{name}")), "shard-places")
        placed = placed.join(_small(known), F.col(own).eqNullSafe(F.col(f"_of_{name}")))
    index = hilbert_index([F.col(f"_at_{n}") for n in ("lang", "source", "octave")])
    return placed.select(*rows.columns, index.alias("_cell"))


def shard_rows(docs: DataFrame, shards: int = 8, size: Column | None = None, checksum: Column | None = None) -> DataFrame:
    """Adds shard and slot to documents (doc_id, lang, source, and text, or size and checksum where the text isn't at hand).

    Rows go by cell, then hash, id and checksum, and are cut into runs whose counts are at most one apart;
    slots number a shard's rows from 0. Cells, and parts of large cells, are counted first, so that ranks need no
    sort in one task. Null metadata sorts last on its axis; a null text is empty; rows that tie are
    equal in doc_id and checksum and are ranked in any order; very long texts count by their size like any other; an empty table gives no rows; other columns
    stay, but for shard and slot, which are replaced.
    """
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*kept).alias("row"), "doc_id", "lang", "source", (text_size() if size is None else size).alias("_size"), (text_checksum() if checksum is None else checksum).alias("_crc"))
    rows = with_cells(rows).withColumn("_mix", F.xxhash64("doc_id", "_crc"))
    narrow = materialize(rows.select("_cell", "_mix"), "shard-cells")
    parts = narrow.groupBy("_cell").agg(F.ceil(F.count("*") / RANKED).alias("_parts"))
    parts = materialize(parts.select(F.col("_cell").alias("_c"), "_parts"), "shard-parts")
    parts = _small(parts)
    part = F.pmod(F.col("_mix"), F.col("_parts"))
    counts = narrow.join(parts, F.col("_cell") == F.col("_c")).groupBy("_cell", part.alias("_part")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_high", F.shiftright("_cell", 3 * BITS // 2))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = counts.withColumn("_near", before(Window.partitionBy("_high").orderBy("_cell", "_part")))
    far = counts.groupBy("_high").agg(F.sum("_n").alias("_n"))  # at most 2 ** (3 * BITS / 2) = 4,096 rows, here in one task
    far = far.select(F.col("_high").alias("_h"), before(Window.orderBy("_high")).alias("_far"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    starts = near.join(far, F.col("_high") == F.col("_h")).select(F.col("_cell").alias("_c2"), F.col("_part").alias("_p2"), (F.col("_near") + F.col("_far")).alias("_start"), "_all")
    starts = materialize(starts, "shard-starts")
    placed = rows.join(parts, F.col("_cell") == F.col("_c")).withColumn("_part", part)
    order = Window.partitionBy("_cell", "_part").orderBy("_mix", "doc_id", "_crc", "_size")
    ranked = placed.withColumn("_row", F.row_number().over(order) - 1).join(starts, (F.col("_cell") == F.col("_c2")) & (F.col("_part") == F.col("_p2")))
    rank = F.col("_start") + F.col("_row")
    ranked = ranked.withColumn("_rank", rank).withColumn("shard", F.expr(f"CAST(_rank * {shards} DIV _all AS INT)"))
    ranked = ranked.withColumn("slot", F.expr(f"_rank - (CAST(shard AS LONG) * _all + {shards - 1}) DIV {shards}"))
    return ranked.select("row.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """Writes rows with shard and slot as Parquet, in the curve's order: a folder for each shard, cut into files of so many slots.

    Neighbours on the curve are alike in each dimension, so that a file's least and greatest values, which Parquet keeps, rule most files out for a filter on any.
    """
    cut = sharded.withColumn("run", F.expr(f"slot div {rows_per_file}"))
    cut.repartition("shard", "run").sortWithinPartitions("shard", "run", "slot").write.partitionBy("shard", "run").parquet(path)


def op8_sharding(docs: DataFrame) -> DataFrame:
    """The thin query over shard_rows: the law is rows."""
    slim = materialize(docs.select("doc_id", "lang", "source", text_size().alias("size"), text_checksum().alias("text_crc32")), "shard-rows")
    found = shard_rows(slim, size=F.col("size"), checksum=F.col("text_crc32"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
