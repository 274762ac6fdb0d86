"""What the operators of this subpackage share: words, stored tables, input tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.session import stored

__all__ = ["BLANKS", "named", "per_batch", "per_task", "stored", "table", "text_of", "words_of"]

SLICE_BYTES = 12_000_000
BLANKS = " \t\n\u000b\f\r"  # the characters between words, everywhere in this subpackage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the directory may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text; null reads as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def per_batch(df: DataFrame, work, schema: str | T.StructType, reads: Sequence[str] = (),
              arrays: bool = False) -> DataFrame:
    """Python on Arrow batches: work(columns as lists) gives the new columns as lists, or as Arrow arrays.

    Spark bounds a batch by rows and by bytes; it is worked on in slices of about
    SLICE_BYTES, so that lists of texts stay small.  With `reads`, only these columns become lists, and columns that
    work does not make are passed on as they are.  With `arrays`, work gets Arrow arrays instead of lists.
    """
    out = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    reads, columns = list(reads or df.columns), df.columns

    def run(batches):
        step = work() if getattr(work, "per_task", False) else work
        for batch in batches:
            rows = max(1, int(SLICE_BYTES * batch.num_rows / max(batch.nbytes, 1)))
            for at in range(0, max(batch.num_rows, 1), rows):
                given = dict(zip(columns, batch.slice(at, rows).columns))
                made = step({name: given[name] if arrays else given[name].to_pylist() for name in reads})
                made = {c: v.cast(out.field(c).type) if isinstance(v, pa.Array) else pa.array(v, out.field(c).type)
                        for c, v in made.items() if c in out.names}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else given[f.name] for f in out], schema=out)

    # names with dots cannot be passed: columns go by their place
    return df.toDF(*(f"c{i}" for i in range(len(columns)))).mapInArrow(run, schema)


def per_task(make):
    """Marks a function that makes the batch function once per task, with what it keeps between batches."""
    make.per_task = True
    return make
