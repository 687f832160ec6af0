"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension; native.

Only metadata moves: sizes, checksums and dimensions, never texts. Each row carries its leaf and how many shards that leaf
becomes, so all leaves of a level are split at once, in a fixed number of steps whatever their number: a level finds each
leaf's widest dimension, sorts the rows by (leaf, that dimension, text checksum, doc_id) into ranges, sums the bytes of each
range, and looks for the median's row in the one range where a leaf's sum crosses its share. Tables of a row for each leaf
(and range) are joined beside the rows; they are broadcast up to ``BROADCAST`` bytes and joined by leaf beyond.
Equal texts stand together in that order, and are parted only where the median falls among many of them; so a group of
copies of any size leaves the shards near equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.llm.common import discard, save

#: Metadata that is the same for equal texts, so that these stay together: characters, language, UTF-8 bytes of the text.
DIMENSIONS = ("n_chars", "lang", "size")
#: A cut may stand this share of a leaf's bytes off the median to fall between two texts rather than among equal ones.
SLACK = 0.005
#: Tables of leaves are broadcast up to this size, at ``_ROW`` bytes a row.
BROADCAST, _ROW = 16 << 20, 128
ORDER = ["leaf", "along", "text_crc32", "place", "row"]


def _number(docs: DataFrame, name: str, size: Column) -> Column:
    """A metadata column as a number that keeps its order (strings: their first six bytes); null is least."""
    if name == "size":
        return size.cast("double")
    if name not in docs.columns:
        return F.lit(0.0)
    if dict(docs.dtypes)[name] == "string":
        head = F.hex(F.rpad(F.substring(F.encode(name, "UTF-8"), 1, 6), 6, F.unhex(F.lit("00"))))
        return F.coalesce(F.conv(head, 16, 10).cast("double") + 1, F.lit(0.0))
    return F.coalesce(F.col(name).cast("double"), F.lit(-1.0))


def _half(of: str) -> Column:
    return F.floor(F.col(of) / 2).cast("int")


class _Splitter:
    def __init__(self, rows: DataFrame, dims: list[str], shards: int, whole):
        self.rows, self.dims, self.whole = rows, dims, whole
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.small = (shards + parts) * _ROW <= BROADCAST

    def beside(self, table: DataFrame) -> DataFrame:
        """A table of a row for each leaf, or leaf and range, as the small side of a join."""
        return F.broadcast(table) if self.small else table

    def level(self) -> None:
        """Split every leaf that becomes several shards."""
        spans = [(F.max(d) - F.min(d)) / F.lit(float(every)) if (every := self.whole[d]["hi"] - self.whole[d]["lo"]) else F.lit(0.0) for d in self.dims]
        open_ = self.rows.where("parts > 1").groupBy("leaf").agg(F.sum("size").alias("bytes"), F.array(*spans).alias("spans"), F.max("parts").alias("into"))
        leaves = save(open_.select("leaf", "bytes", "into", F.array_position("spans", F.array_max("spans")).cast("int").alias("widest")))
        along = F.coalesce(F.element_at(F.array(*[F.col(d) for d in self.dims]), F.col("widest")), F.lit(0.0))
        sided = self.rows.join(self.beside(leaves), "leaf", "left").withColumn("along", along).drop("bytes", "into")
        ranges = save(sided.repartitionByRange(*ORDER).withColumn("range", F.spark_partition_id()))
        upto = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # a row for each leaf and range
        sums = ranges.where("widest is not null").groupBy("leaf", "range").agg(F.sum("size").alias("held")).join(self.beside(leaves), "leaf")
        sums = sums.withColumns({"wanted": F.col("bytes") * _half("into") / F.col("into"), "reached": F.sum("held").over(upto)})
        crossing = sums.where("reached >= wanted and reached - held < wanted").select("leaf", "range", "bytes", (F.col("wanted") - F.col("reached") + F.col("held")).alias("wanted"))
        by = Window.partitionBy("leaf").orderBy(*ORDER[1:])  # the rows of one range
        inside = F.lead("text_crc32").over(by).eqNullSafe(F.col("text_crc32"))  # not a text's last row
        off = F.abs(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("wanted")) + F.when(inside, F.col("bytes") * SLACK).otherwise(0.0)
        near = ranges.join(self.beside(crossing), ["leaf", "range"]).withColumn("off", off)
        cuts = save(near.groupBy("leaf").agg(F.min_by(F.struct(*ORDER[1:]), F.struct("off", *ORDER[1:])).alias("cut")))
        split = ranges.join(self.beside(cuts), "leaf", "left")
        beyond = F.coalesce(F.struct(*ORDER[1:]) > F.col("cut"), F.lit(False))
        parts = F.when(F.col("cut").isNull(), F.col("parts")).when(beyond, F.col("parts") - _half("parts")).otherwise(_half("parts"))
        leaf = F.when(beyond, F.col("leaf") + _half("parts")).otherwise(F.col("leaf"))
        last = self.held if hasattr(self, "held") else ()
        self.rows = split.withColumns({"leaf": leaf, "parts": parts}).drop("along", "range", "widest", "cut")
        self.held = (ranges, cuts)
        discard(leaves, *last)


def shard(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 1. Leaves are split until there are ``shards`` of them, or until they hold
    ``target_bytes``. A null text has size 1 and checksum 0; null metadata stands lowest; repeated rows are placed one by
    one; with fewer rows than shards some shards are empty; an empty table gives none.
    """
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    dims = [f"d{i}" for i in range(len(dimensions))]
    rows = docs.select(
        F.col("doc_id").cast("long"),
        size.alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("place"),
        *[_number(docs, name, size).alias(d) for name, d in zip(dimensions, dims, strict=True)],
        F.lit(0).alias("leaf"),
    )
    rows = save(rows.withColumn("row", F.monotonically_increasing_id()))
    whole = rows.agg(F.sum("size").alias("bytes"), *[F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")).alias(d) for d in dims]).first()
    if shards is None:
        shards = max(1, -(-(whole["bytes"] or 0) // target_bytes))
    tree = _Splitter(rows.withColumn("parts", F.lit(shards)), dims, shards, whole)
    for _ in range((shards - 1).bit_length() if whole["bytes"] else 0):
        tree.level()
    order = ["leaf", "text_crc32", "place", "row"]
    placed = tree.rows.select("doc_id", "size", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = save(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()))
    held = placed.groupBy("leaf", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each leaf and range
    offsets = held.select("leaf", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return placed.join(tree.beside(offsets), ["leaf", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("leaf").cast("int").alias("shard"), (F.col("at") + F.col("offset")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
