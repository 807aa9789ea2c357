"""Exact dedup by an extendible-hash index on shared files, DataFrame operations only.

1. *Hashes.* Each text, white space normalised, gets a 64-bit hash; (id, hash, SHA-256, bytes) goes to
   files in the shared folder.
2. *Directory.* The top ``max_depth`` bits of the hash name a slot. The bytes a slot come to the
   driver (at most ``2 ** max_depth`` numbers, whatever the input) and the directory doubles until
   no bucket holds more than ``bucket_bytes`` of texts.
3. *Owners.* A row finds its bucket through the directory (hash bits to cell to bucket), and the
   bucket its owner: owners are contiguous hash ranges of about equal bytes. Each owner task gets
   its buckets whole, groups them by hash, compares the bytes of the texts that share one - the
   collision chain, numbered by text - and decides which row stays and how many there are. The
   index, one entry for each row that reached it, is written to the shared folder.
4. *Hot texts.* Hashes with one row in ``HOT_SHARE`` are at most ``HOT_SHARE``. Their rows are
   aggregated by hash and text before the shuffle and reach the owner as one entry for each text,
   with their number; the owner's answers, as few, are broadcast to their rows.

Texts are told apart by their bytes. A row of a hot text names its entry by hash and SHA-256.

Defined results: a null text counts as empty; rows with the same id and text are one document
and get the same values; a null id never wins over a number, and if all ids of a group are null
the group has no kept row. Columns of the input other than id and text play no part, whatever
their names. An empty table gives an empty result. ``first_of_each`` keeps one whole row of each
text: the smallest id, a null id only if there is no other, any one of rows with equal ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import persist_table
from .common import HOT_SHARE, SPACE, shuffle_width, table

BUCKET_BYTES = 1 << 20


@dataclass
class Directory:
    """Extendible-hash directory: ``cells[i]`` is the bucket of prefix ``i`` of ``depth`` bits.
    A bucket is (local depth, prefix)."""

    depth: int
    cells: list[tuple[int, int]]

    @classmethod
    def build(cls, loads: dict[int, int], slot_bits: int, capacity: int) -> Directory:
        """``loads``: load by slot, a slot being the first ``slot_bits`` bits."""
        total = [0] * (1 << slot_bits)
        for slot, n in loads.items():
            total[slot] = n
        sums = [0]
        for n in total:
            sums.append(sums[-1] + n)

        def load(local: int, prefix: int) -> int:
            width = slot_bits - local
            return sums[(prefix + 1) << width] - sums[prefix << width]

        out = cls(0, [(0, 0)])
        work = [(0, 0)]
        while work:
            local, prefix = work.pop()
            if load(local, prefix) <= capacity or local == slot_bits:
                continue
            if local == out.depth:  # no spare bit: the directory doubles
                out.cells = [b for b in out.cells for _ in (0, 1)]
                out.depth += 1
            halves = [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
            for half in halves:
                width = out.depth - half[0]
                out.cells[half[1] << width : (half[1] + 1) << width] = [half] * (1 << width)
            work += halves
        return out

    def owners(self, loads: dict[int, int], slot_bits: int, most: int) -> dict[int, tuple[int, int]]:
        """(bucket number, owner) by cell: at most ``most`` owners, ranges of buckets of about equal load."""
        by_cell = [0] * len(self.cells)
        for slot, n in loads.items():
            by_cell[slot >> (slot_bits - self.depth)] += n
        numbers = self.buckets()
        most = max(1, min(most, len(set(numbers.values()))))
        share = max(1, sum(by_cell)) / most
        owner: dict[int, int] = {}
        before = 0
        for cell, bucket in numbers.items():
            owner.setdefault(bucket, min(most - 1, int(before / share)))
            before += by_cell[cell]
        return {cell: (bucket, owner[bucket]) for cell, bucket in numbers.items()}

    def buckets(self) -> dict[int, int]:
        """Bucket number by cell; numbers follow the hash ranges."""
        number: dict[tuple[int, int], int] = {}
        return {i: number.setdefault(b, len(number)) for i, b in enumerate(self.cells)}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _slot(h: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - bits).cast("int") if bits else F.lit(0)


class _Index:
    """The owners' rows: owner, bucket, h, t, id, n (rows that an entry stands for), record, hot."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, max_depth: int, whole: bool):
        """``whole``: records are whole rows; else id and text, for hot texts the normalised one."""
        spark = docs.sparkSession
        text = F.col(f"`{text_col}`")
        t = normalised(text)
        self.hashes = persist_table(
            docs.select(F.col(f"`{id_col}`").alias("id"), t.alias("t")).select(
                "id", F.xxhash64("t").alias("h"), F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("bytes")
            ),
            "dedup-hashes",
        )
        sizes = persist_table(self.hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")), "dedup-sizes")
        rows = sizes.agg(F.sum("n")).first()[0] or 0
        is_hot = F.col("n") * HOT_SHARE >= rows
        self.hot = sizes.where(is_hot).select("h")
        self.any_hot = bool(self.hot.limit(1).count())
        arriving = (F.col("bytes").cast("long") + 64) * F.when(is_hot, 1).otherwise(F.col("n"))
        loads = {r[0]: r[1] for r in sizes.groupBy(_slot("h", max_depth).alias("s")).agg(F.sum(arriving)).collect()}
        self.directory = Directory.build(loads, max_depth, bucket_bytes)
        owners = self.directory.owners(loads, max_depth, shuffle_width(spark))
        cells = spark.createDataFrame([(c, b, o) for c, (b, o) in sorted(owners.items())], "cell int, bucket int, owner int")

        columns = docs.columns if whole else [id_col, text_col]
        record = F.struct(*[F.col(f"`{c}`") for c in columns])
        self.rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("h"), record.alias("record"))
        self.text_of = lambda r: normalised(r[text_col])
        cold = self.rows.join(F.broadcast(self.hot), "h", "left_anti") if self.any_hot else self.rows
        cold = cold.select("h", "id", F.lit(1).cast("long").alias("n"), "record", F.lit(False).alias("hot"))
        if self.any_hot:
            cold = cold.unionByName(self._hot_entries(whole))
        self.owned = (
            cold.withColumn("cell", _slot("h", self.directory.depth))
            .join(F.broadcast(cells), "cell")
            .drop("cell")
            .repartitionById(1 + max(o for _, o in owners.values()), "owner")
            .withColumn("t", self.text_of(F.col("record")))
        )

    def _hot_entries(self, whole: bool) -> DataFrame:
        """One row for each hot text, combined before the shuffle: smallest id, rows, the record that stays."""
        record_type = self.rows.schema["record"].dataType
        rows = self.rows.join(F.broadcast(self.hot), "h", "left_semi").withColumn("t", self.text_of(F.col("record")))
        # without a record to carry along this is a hash aggregation over the text
        first = F.min_by("record", F.struct(F.col("id").isNull(), "id")) if whole else F.first(F.lit(None))
        entries = rows.groupBy("h", "t").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), first.alias("record"))
        record = F.col("record") if whole else F.struct("id", "t").cast(record_type)
        return entries.select("h", "id", "n", record.alias("record"), F.lit(True).alias("hot"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    max_depth: int = 16,
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    ``bucket_bytes``: bytes of texts that a bucket may hold before it splits. ``max_depth``: most bits of
    the directory; beyond it a bucket overflows into a longer owner task, never into lost rows."""
    index = _Index(docs, id_col, text_col, bucket_bytes, max_depth, whole=False)
    texts = Window.partitionBy("owner", "bucket", "h", "t")
    chain = Window.partitionBy("owner", "bucket", "h").orderBy("t")
    pages = index.owned.withColumns(
        {
            "chain": (F.dense_rank().over(chain) - 1).cast("int"),
            "keep_id": F.min("id").over(texts),
            "group_size": F.sum("n").over(texts),
        }
    )
    pages = pages.select("bucket", "h", "chain", F.unhex(F.sha2("t", 256)).alias("sha"), "id", "keep_id", "group_size", "hot")
    pages = persist_table(pages, "dedup-index")
    answers = ["keep_id", "group_size", "bucket", "chain"]
    found = pages.where("NOT hot").select("id", "sha", *answers)
    if index.any_hot:
        entries = F.broadcast(pages.where("hot").select("h", "sha", *answers))
        found = found.unionByName(index.hashes.select("id", "h", "sha").join(entries, ["h", "sha"]).drop("h"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "chain",
    )


def first_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    max_depth: int = 16,
) -> DataFrame:
    """Whole rows of ``docs``, one of each text."""
    index = _Index(docs, id_col, text_col, bucket_bytes, max_depth, whole=True)
    order = Window.partitionBy("owner", "bucket", "h", "t").orderBy(F.col("id").asc_nulls_last())
    first = index.owned.withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.select(*[F.col("record")[c].alias(c) for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
}
