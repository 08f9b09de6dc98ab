"""Best-fit packing into bins of several permitted sequence lengths.

Texts are cut into pieces of at most the greatest length. Pieces are dealt into groups of
bounded size. A group is packed by best-fit decreasing: the longest piece first, into the open
bin that it leaves with the least room; where none fits, a bin of the least-cost length is
opened; at the end each bin shrinks to the least permitted length that holds its contents.

Which lengths may be opened is optimised for all of them together: a group is packed once for
every set of permitted lengths that holds the greatest one, and the packing whose bins cost
least after shrinking is kept.

A bin of c words costs OVERHEAD + c + c * c / QUADRATIC: a fixed part, a linear one, and one for
attention over all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.mixing import words_of
from lodestone.llm.staging import Staged

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 64
QUADRATIC = 16384
#: Rows of docs for one packing task.
GROUP_ROWS = 1 << 15


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / QUADRATIC


def best_fit(sizes: list[int], opening: tuple[int, ...], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Sizes, longest first -> each one's bin and offset, and the length of each bin; bins are opened in the lengths `opening`."""
    costs = [(c, cost(c)) for c in sorted(opening)]
    most = costs[-1][0]
    with_room: list[list[int]] = [[] for _ in range(most + 1)]
    rooms = 0  # bit r is set if a bin has room r
    used, bins, offsets = [], [], []
    to_come = sum(sizes)
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room = min((price / max(1, min(c, to_come)), c) for c, price in costs if c >= size)[1]
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        left = room - size
        with_room[left].append(b)
        rooms |= 1 << left
        to_come -= size
    return bins, offsets, [next(c for c in sorted(lengths) if c >= u) for u in used]


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """What best_fit() returns for the set of lengths whose bins cost least together; the first such set, the larger ones first."""
    most = max(lengths)
    rest = sorted(set(lengths) - {most})
    sets = [(*some, most) for n in range(len(rest), -1, -1) for some in combinations(rest, n)]
    found = (best_fit(sizes, some, lengths) for some in sets)
    return min(found, key=lambda f: sum(map(cost, f[2])))


def fill(rows: DataFrame) -> DataFrame:
    """What packed() returns -> bin_length, bins, words and fill (the share of the bins' places that hold a word) of each length."""
    bins = rows.groupBy("bin").agg(F.first("bin_length").alias("bin_length"), F.sum("n_words").alias("words"))
    whole = bins.groupBy("bin_length").agg(F.count(F.lit(1)).alias("bins"), F.sum("words").alias("words"))
    return whole.withColumn("fill", F.col("words") / (F.col("bins") * F.col("bin_length")))


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Where every piece of every row of docs(doc_id, text) goes.

    doc_id, piece (from 0), first_word, n_words, bin, bin_length, bin_words and position (the
    piece's first word in the bin). Words are runs of other characters than white space. Null
    texts and texts without words are one piece of 0 words and sit in some bin. Repeated rows
    are packed once each. Rows are dealt to groups by doc_id and their place in the table, so
    repeated ones don't share a group. Other columns are ignored, an empty table gives an empty
    result.
    """
    most = max(lengths)
    sizes = Staged(docs.select("doc_id", words_of(F.col("text")).alias("words"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("hash")))
    groups = max(1, -(-sizes.rows() // GROUP_ROWS))
    last = F.greatest(F.ceil(F.col("words") / most) - 1, F.lit(0)).cast("int")
    pieces = sizes.df.select("doc_id", "words", "hash", F.posexplode(F.sequence(F.lit(0), last)).alias("piece", "_")).select(
        "doc_id",
        "piece",
        (F.col("piece") * F.lit(most).cast("long")).alias("first_word"),
        F.least(F.lit(most).cast("long"), F.col("words") - F.col("piece") * most).alias("n_words"),
        F.pmod(F.xxhash64("hash", "piece"), F.lit(groups)).alias("part"),
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, found = pack(table["n_words"].to_pylist(), lengths)
        n = table["n_words"].to_numpy()
        bins_ = np.array(bins)
        used = np.bincount(bins_, n).astype(np.int64)
        part = table["part"][0].as_py() << 32
        for name, values in (("bin", bins_ + part), ("bin_length", np.array(found)[bins_]), ("bin_words", used[bins_]), ("position", np.array(offsets))):
            table = table.append_column(name, pa.array(values.astype(np.int64)))
        return table.drop_columns(["part"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, first_word long, n_words long, bin long, bin_length long, bin_words long, position long"
    return pieces.groupBy("part").applyInArrow(run, schema)
