"""Adding columns to frames of unknown shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def adding(docs: DataFrame, **kinds: str) -> tuple[DataFrame, list[str], T.StructType]:
    """docs without columns that new ones replace, its names, and its schema with the new columns after them."""
    old = [f for f in docs.schema.fields if f.name.lower() not in {k.lower() for k in kinds}]
    kept = docs.select(*[quoted(f.name) for f in old])
    new = [T.StructField(k, T.StructType.fromDDL(f"x {kind}")[0].dataType, True) for k, kind in kinds.items()]
    return kept, [f.name for f in old], T.StructType(old + new)


def restored(kind: type, shared) -> object:
    """An object of a class whose attributes were broadcast as a dict; executors needn't know the class."""
    found = kind.__new__(kind)
    found.__dict__.update(shared.value)
    return found


def quoted(name: str) -> str:
    """A column's name as it must be written where dots and spaces have a meaning."""
    return "`" + name.replace("`", "``") + "`"


def free_prefix(docs: DataFrame, prefix: str) -> str:
    """The prefix, with underscores behind it until no column of docs begins with it; so an operator's own columns never
    meet a caller's."""
    taken = [f.lower() for f in docs.columns]
    while any(f.startswith(prefix) for f in taken):
        prefix += "_"
    return prefix


def give_back() -> None:
    """Gives back the memory that this Python process holds and nothing refers to."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, which at the end of a task gives back the memory that it held: an executor keeps its Python
    workers, and those of earlier stages stand beside those of later ones."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def through_arrow(docs: DataFrame, run: Callable[[Iterator], Iterator], schema: T.StructType) -> DataFrame:
    """docs.mapInArrow with tidy(run).  The function sees columns by their place, so their names may hold dots."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(tidy(run), schema)
