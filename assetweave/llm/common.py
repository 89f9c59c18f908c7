"""Shared pieces of the training-data operators.

Every operator reads only the columns it names, so further columns of a table, whatever they are
called, neither clash nor matter. Columns that an operator adds replace columns of the same name.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Tasks that count the rows of a table that lies ready.
COUNTERS = 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset, as in tests,
    a temporary one is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="assetweave-"))
    return df.checkpoint(eager=True)


def count_of(df: DataFrame) -> int:
    """Rows of a table that lies ready, counted in few tasks."""
    return df.coalesce(COUNTERS).count()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def null_key(col: str) -> Column:
    """A join key for a nullable string: null gets a key of its own, after all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("~"))


def sample_of(df: DataFrame, by: Sequence[str], bound: int) -> DataFrame:
    """About ``bound`` rows, or all where there are no more: those whose hash of ``by`` lies below
    the share that is wanted. Rows equal in ``by`` are in or out together; reruns agree.
    """
    n = df.count()
    below = 1 << 30 if n <= bound else int(bound / n * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(1 << 30)) < below)


_caches: dict[str, dict] = {}


def cache_of(name: str) -> dict:
    """What a worker process keeps between tasks under ``name``. Asking for another name drops it, so
    that a process, which outlives many stages, never holds the caches of two operators."""
    if name not in _caches:
        _caches.clear()
        pa.default_memory_pool().release_unused()
        _caches[name] = {}
    return _caches[name]


def stretches(texts: pa.Array, rows: int = 256, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of at most ``rows`` texts and, but for single texts, ``size`` bytes."""
    begin = held = 0
    for i, many in enumerate(pc.binary_length(texts).to_pylist()):
        if i > begin and (i - begin >= rows or held + (many or 0) > size):
            yield begin, i
            begin, held = i, 0
        held += many or 0
    if len(texts) > begin:
        yield begin, len(texts)


def map_texts(docs: DataFrame, carry: Sequence[str], fields: Sequence[tuple[str, str]], make: Callable[[], Callable[..., list]], *, several: bool = False, extra: Sequence[str] = (), cache: str = "") -> DataFrame:
    """Apply a Python function to whole texts, in Arrow batches, and carry columns along unchanged.

    ``make()`` runs once a task and returns a function from a list of texts (null is "") to a list
    of tuples, one value for each of ``fields`` (name, SQL type); with ``several``, to a list of
    lists of such tuples, one output row each. Lists of the ``extra`` columns' values follow the
    texts. ``carry`` must not hold a name of ``fields``. ``cache`` names the cache that ``make`` uses.
    """
    carried = docs.select(*[F.col(f"`{c}`") for c in carry]).schema.fields
    # Names of its own, so that no carried name clashes on the way in.
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], text_or_empty().alias("t"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)])
    schema = StructType([*carried, *[StructField(name, _parse(kind)) for name, kind in fields]])
    arrow = to_arrow_schema(schema)
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of(cache)
        apply = make()
        for batch in batches:
            for at, end in stretches(batch.column(n)):
                part = batch.slice(at, end - at)
                made = apply(*(part.column(i).to_pylist() for i in range(n, part.num_columns)))
                columns = [part.column(i) for i in range(n)]
                if several:
                    places = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int64())
                    columns = [c.take(places) for c in columns]
                    made = [row for rows in made for row in rows]
                values = zip(*made, strict=True) if made else [()] * len(fields)
                columns += [pa.array(v, arrow.field(n + i).type) for i, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return kept.mapInArrow(run, schema)


def _parse(kind: str):
    return StructType.fromDDL(f"x {kind}")["x"].dataType
