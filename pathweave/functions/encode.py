"""Multi-hot encoding of a list column over a fixed vocabulary."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


PREFIX = "proc_count__"


def count_columns(labels) -> list[tuple[str, str]]:
    """(label, column name) in alphabetical order of the labels.

    The name is the label behind a prefix.  A label that a plain column cannot
    carry (a dot or back-quote, or equal to an earlier label but for case)
    gets a name without these and with a checksum of the label, so that it
    can be written, read and assembled like any other.
    """
    seen, out = set(), []
    for label in sorted(set(labels)):
        name = label.replace(".", "_").replace("`", "_")
        if name != label or name.lower() in seen:
            name = f"{name}__{zlib.crc32(label.encode()):08x}"
        seen.add(name.lower())
        out.append((label, f"{PREFIX}{name}"))
    return out


def multi_hot(items, vocabulary) -> list[Column]:
    """One 0/1 column per vocabulary entry: 1 when the list holds it.

    Unknown names are ignored and duplicates still give 1 -- the scoring-side
    encoding of a list of procedures.
    """
    c = F.col(items) if isinstance(items, str) else items
    return [F.coalesce(F.array_contains(c, F.lit(v)).cast("int"), F.lit(0)).alias(name)
            for v, name in count_columns(vocabulary)]
