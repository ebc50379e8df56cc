"""Left and inner joins of large facts to a lookup table with one row per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_lookup(
    facts: DataFrame, lookup: DataFrame, key: str, how: str = "left", broadcast: bool = False
) -> DataFrame:
    """Join `lookup` (unique on `key`) to `facts`.

    Nothing runs here, and nothing depends on a size known beforehand: adaptive
    execution broadcasts the lookup if it turns out small, and otherwise splits
    the facts of a frequent key by their real size.

    It does neither if the next step groups the facts by `key` and more: they then
    lie as that step needs them, all of a key in one task, and another shuffle
    would be the price. For such facts `broadcast` sends the lookup to them, which
    must be a few bytes a key for no more keys than a vocabulary has.
    """
    return facts.join(F.broadcast(lookup) if broadcast else lookup, key, how)
