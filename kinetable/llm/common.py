"""What the corpus operators share: word patterns, whole-row keys, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of anything but these six white-space characters.
SPACES = " \t\n\x0b\f\r"
WORD = rb"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(
        F.split(core, "[\\x20\\x09-\\x0D]+"))


def small_batches(df: DataFrame) -> DataFrame:
    """Let Spark hand texts to Python in batches of bounded size, however long they are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def map_texts(
    df: DataFrame,
    columns: list[str],
    schema: str,
    start: Callable[[], Callable[[list[list]], list[list]]],
    chars: int = 1 << 20,
) -> DataFrame:
    """Run a function over the columns of all rows in Arrow batches.

    ``start`` is called once in each task and returns the function; it gets one
    list for each column, with rows of about ``chars`` characters in all, and
    returns one list or Arrow array for each column of ``schema``. The last of
    ``columns`` is the text that is measured. Only the rows of one call are Python
    objects at a time, and what a task no longer uses goes back to the system: the
    worker waits for further tasks, and its memory counts as the executor's.
    """
    out = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in T._parse_datatype_string(schema)])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            begin = size = 0
            for i, length in enumerate(_sizes(batch.columns[-1])):
                size += length + 50
                if size >= chars or i + 1 == batch.num_rows:
                    made = work([c.slice(begin, i + 1 - begin).to_pylist() for c in batch.columns])
                    yield pa.RecordBatch.from_arrays(
                        [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(made, out)],
                        schema=out)
                    begin, size = i + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from parts(batches)
        hand_back()

    return small_batches(df).select(*columns).mapInArrow(run, schema)


def _sizes(column: pa.Array) -> list[int]:
    """Length of each value, 0 for null: characters of a string, bytes of a binary, elements of a list."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        sizes = pc.utf8_length(column)
    elif pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        sizes = pc.binary_length(column)
    else:
        sizes = pc.list_value_length(column)
    return pc.fill_null(sizes, 0).to_pylist()


def hand_back() -> None:
    """Give memory that Arrow and the C library hold but don't use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def identified(docs: DataFrame, order: str, text: str, carry: list[str]) -> tuple[DataFrame, str]:
    """``null_id``, ``id``, ``tie`` (a hash of the text), ``carried`` (a struct) and ``text``; the struct's type.

    A row is known by id and tie; one without id goes by its tie, after all others.
    """
    given = F.col(f"`{order}`").cast("long")
    tie = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    kinds = dict(docs.dtypes)
    return docs.select(
        given.isNull().alias("null_id"), F.coalesce(given, tie).alias("id"), tie.alias("tie"),
        F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("__")).alias("carried"),
        F.col(f"`{text}`").alias("text"),
    ), "struct<" + ", ".join([f"`{c}`: {kinds[c]}" for c in carry] + ["__: int"]) + ">"


def packed(rows: DataFrame, carried: str) -> DataFrame:
    """Identified rows with the texts as zstandard frames, in which they take less of the network and the disks."""

    def start():
        pack = zstandard.ZstdCompressor(level=3).compress
        return lambda columns: [*columns[:-1], [pack(utf8(t)) for t in columns[-1]]]

    out = map_texts(rows, ["null_id", "id", "tie", "carried", "text"],
                    f"null_id boolean, id long, tie long, carried {carried}, packed_text binary", start)
    # never null, and Spark is to know it: else one of two joins would filter, and not share the other's exchange
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("id", "tie")})
