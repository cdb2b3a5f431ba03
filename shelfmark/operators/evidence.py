"""Evidence in layers: cheap evidence first, and contents are read only where it failed.

``matching.cascade`` weighs hits that are all there already. Here a layer's evidence must be read, from
ever larger tables; so each layer is asked only for the keys that no layer before it resolved, and the
scan is cut to the partitions these keys lie in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

MOST_PARTS = 10_000


def cut_to(contents: DataFrame, part: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``contents`` (partitioned by ``part``) with a wanted key; ``wanted`` has both columns.

    The parts that wanted keys lie in are a filter on partitions, so others' files aren't listed or
    read. A list of over ``MOST_PARTS`` would prune little; then the semi join alone decides.
    """
    parts = [r[0] for r in wanted.where(F.col(key).isNotNull() & F.col(part).isNotNull()).select(part).distinct().limit(MOST_PARTS + 1).collect()]
    some = contents.where(F.col(part).isin(parts)) if len(parts) <= MOST_PARTS else contents
    return some.join(wanted.select(key, part).distinct(), [key, part], "left_semi")


def layered(items: DataFrame, key: str, layers: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(key, layer, entry): the first layer's least entry for each key, or ``unmatched``.

    A layer is a function from the rows of ``items`` that are still open to (key, entry). Open rows are
    written between layers, so a layer's reading is done once. Results are those of a cascade over all
    layers. Cases: null keys are never resolved; repeated rows are one key; entries that are null count as none.
    """
    open_, out = items, None
    for name, read in layers:
        hits = read(open_).where("entry is not null").groupBy(key).agg(F.min("entry").alias("entry"))
        found = written(open_.select(key).distinct().join(hits, key).select(F.col(key).alias(key), F.lit(name).alias("layer"), "entry"), "evidence")
        out = found if out is None else out.union(found)
        open_ = written(open_.join(found.select(F.col(key).alias("_found")), F.col(key) == F.col("_found"), "left_anti"), "open")
    rest = open_.select(F.col(key).alias(key)).distinct().select(key, F.lit("unmatched").alias("layer"), F.lit(None).alias("entry"))
    return rest if out is None else out.unionByName(rest)
