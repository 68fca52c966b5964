"""Duplicates that differ in layout only: canonical key, range partitions, sorted runs.

Records get a canonical key (case, blanks, punctuation and the order of the fields taken out).
They are partitioned by range over (key, id) and sorted inside each partition by Spark's external
sorter; one scan then compares neighbouring full keys and reports each run. Because the range
runs over (key, id), a key that a third of all rows share is spread over many partitions; a run
that touches a partition's edge is joined up afterwards from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from setlore.session import materialise

#: Runs up to this length are turned into pairs inside the scan; longer ones by a salted join.
RUN_IN_MEMORY = 512
#: Members a side in one cell of the salted join.
CELL = 512


@arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Canonical composition (NFC); null stays null."""
    return pc.utf8_normalize(text, form="NFC")


def letters_and_digits(text: Column) -> Column:
    """The letters, marks and digits of a text in order, without case. Null and empty give ''."""
    folded = F.replace(F.lower(F.upper(F.coalesce(nfc(text.cast("string")), F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}]+", "")


def with_layout_key(df: DataFrame, id_col: str, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """(id, key, *keep): the key joins the fields' letters and digits, fields sorted; rows with a field without any are left out.

    The separator is a character that no key holds, so different records never share a key by chance.
    """
    parts = [letters_and_digits(F.col(f)) for f in fields]
    cut = df.select(F.col(id_col).cast("string").alias("id"), F.array(*parts).alias("parts"), *(keep or []))
    return cut.where(F.forall("parts", lambda p: p.rlike(r"[\p{L}\p{N}]"))).select("id", F.concat_ws("\x1f", F.array_sort("parts")).alias("key"), *(keep or []))


def _sorted(keyed: DataFrame) -> DataFrame:
    """The keys are stored first: the range partitioner reads its input twice, once for a sample."""
    return materialise(keyed.select("key", "id")).repartitionByRange("key", "id").sortWithinPartitions("key", "id")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], bool]]:
    """(key, ids, at_edge) of every run; long runs come in pieces, each piece marked as an edge."""
    key, ids, edge = None, [], True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, values = batch["key"], batch["id"]
        starts = [0, *(pc.indices_nonzero(pc.not_equal(keys[1:], keys[:-1])).to_numpy() + 1), batch.num_rows]
        names = values.to_pylist()
        for a, b in zip(starts, starts[1:]):
            here = keys[a].as_py()
            if here != key:
                if key is not None:
                    yield key, ids, edge
                    edge = False
                key, ids = here, []
            ids += names[a:b]
            if len(ids) > RUN_IN_MEMORY:
                edge = True
                yield key, ids, True
                ids = []
    if key is not None:
        yield key, ids, True


def copies(df: DataFrame, id_col: str, fields: list[str], least: int = 2) -> DataFrame:
    """(group_id, copies): one representative, the smallest id, and the exact number of rows of every group.

    Groups of fewer than `least` rows are left out. Repeated ids count as rows. A null id sorts first and
    counts as a row. Null, empty or wordless fields: the row is in no group. Empty table: empty result.
    """
    schema = pa.schema([("key", pa.string()), ("group_id", pa.string()), ("copies", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows: list[tuple[str | None, str | None, int]] = []
        for key, ids, edge in _runs(batches):
            if ids and (edge or len(ids) >= least):
                rows.append((key if edge else None, min((i for i in ids if i is not None), default=None), len(ids)))
            if len(rows) >= 20_000:
                yield _batch(rows, schema)
                rows = []
        yield _batch(rows, schema)

    runs = materialise(_sorted(with_layout_key(df, id_col, fields)).mapInArrow(scan, "key string, group_id string, copies long"))
    whole = runs.where("key is null").select("group_id", "copies")
    joined = runs.where("key is not null").groupBy("key").agg(F.min("group_id").alias("group_id"), F.sum("copies").alias("copies")).where(F.col("copies") >= least)
    return whole.unionByName(joined.select("group_id", "copies"))


def pairs(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of different ids whose rows share the canonical key.

    Runs inside a partition give their pairs in the scan. Long runs and those at an edge go through a join
    on (key, row, column) in which no cell meets more than CELL members a side, so a group of any size
    is spread. Null ids and repeated rows give no pair of their own; each pair comes once.
    """
    schema = pa.schema([("key", pa.string()), ("id_a", pa.string()), ("id_b", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows: list[tuple[str | None, str, str | None]] = []
        for key, ids, edge in _runs(batches):
            if edge:
                rows += [(key, i, None) for i in ids if i is not None]
            elif len(ids) > 1:
                ids = [i for i in dict.fromkeys(ids) if i is not None]
                rows += [(None, a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]]
            if len(rows) >= 20_000:
                yield _batch(rows, schema)
                rows = []
        yield _batch(rows, schema)

    found = materialise(_sorted(with_layout_key(df, id_col, fields)).mapInArrow(scan, "key string, id_a string, id_b string"))
    members = found.where("key is not null").select("key", F.col("id_a").alias("id")).distinct()
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cells = members.join(sizes, "key").withColumn("cells", F.ceil(F.col("n") / CELL)).withColumn("cell", F.pmod(F.xxhash64("id"), "cells"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    left = cells.select("key", F.col("id").alias("id_a"), F.col("cell").alias("row"), every.alias("column"))
    right = cells.select("key", F.col("id").alias("id_b"), every.alias("row"), F.col("cell").alias("column"))
    return found.where("key is null").select("id_a", "id_b").unionByName(left.join(right, ["key", "row", "column"]).where("id_a < id_b").select("id_a", "id_b"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
