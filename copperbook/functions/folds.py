"""Running state along an array."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from copperbook.functions.text import let

_BLOCK = 256


def running(items: Column, state: Column, step, out_type: str) -> Column:
    """Array of outputs, one per item, with a state carried along in order.

    ``step(state, item)`` returns struct(state, out). Outputs collect
    in blocks, so that appending does not copy all that came before and the
    work stays in proportion to the length of the array.
    """

    def none(of: str) -> Column:
        return F.array().cast(f"array<{of}>")

    def one(acc, item):
        return let(
            step(acc.state, item),
            lambda r: F.struct(r.state.alias("state"), F.array_append(acc.out, r.out).alias("out")),
        )

    def block(acc, first):
        inner = F.aggregate(
            F.slice(items, first, F.lit(_BLOCK)),
            F.struct(acc.state.alias("state"), none(out_type).alias("out")),
            one,
        )
        return let(
            inner,
            lambda r: F.struct(r.state.alias("state"), F.array_append(acc.out, r.out).alias("out")),
        )

    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(_BLOCK))).otherwise(none("int"))
    folded = F.aggregate(
        firsts, F.struct(state.alias("state"), none(f"array<{out_type}>").alias("out")), block
    )
    return F.flatten(folded.out)
