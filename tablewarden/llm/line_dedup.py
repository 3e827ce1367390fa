"""Line deduplication by pairwise alignment.

A document is a sequence of lines. A key is a shortest run of its lines with at least `MIN_WORDS` words,
one from each line on and one up to each line. A later document is compared with the first holder of
each of its keys only, so a frequent passage costs no more comparisons than a rare one and no
group is expanded into pairs; what two documents share in such runs, the first holder shares with
both. The two sequences are aligned by patience diff: lines that occur once in both are anchors, the
longest rising chain of them holds, and the gaps are aligned in turn. Aligned blocks of consecutive
lines with at least `MIN_WORDS` words are deleted from the later document, then runs of so many words
that the alignment left as their order differs.

Lines are compared without surrounding white space. Blank lines are left out of sequences and stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablewarden.llm.durable import cut
from tablewarden.llm.rows import column, packed as packed_row

# low enough for a single repeated line of a sentence, as a key and as a block
MIN_WORDS = 10


def _sequence(text: str) -> tuple[list[int], list[int], list[int]]:
    """Number, hash, and word count of each line that is not blank."""
    numbers, hashes, words = [], [], []
    for i, line in enumerate(text.split("\n")):
        n = len(line.split())
        if n:
            numbers.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line.strip().encode("utf-8", "surrogatepass")) - (1 << 63))
            words.append(n)
    return numbers, hashes, words


def _spans(words: list[int], least: int) -> set[tuple[int, int]]:
    """The shortest runs of enough words from each line on, and up to each line."""
    ends = np.cumsum([0, *words])
    spans = set()
    for i in range(len(words)):
        j = int(np.searchsorted(ends, ends[i] + least))
        if j < len(ends):
            spans.add((i, j))
        start = int(np.searchsorted(ends, ends[i + 1] - least, side="right")) - 1
        if ends[i + 1] >= least:
            spans.add((start, i + 1))
    return spans


def _keys(hashes: list[int], words: list[int], least: int) -> list[int]:
    """Hashes of these runs."""
    packed = np.array(hashes, np.int64)
    return sorted({xxhash.xxh3_64_intdigest(packed[i:j].tobytes()) - (1 << 63) for i, j in _spans(words, least)})


def _sequences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                found = [_sequence(t) for t in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1)]
                columns += [pa.array([f[i] for f in found], pa.list_(t)) for i, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int32()))]
                columns.append(pa.array([_keys(f[1], f[2], least) for f in found], pa.list_(pa.int64())))
                yield pa.record_batch(columns, names=["id", "tie", "numbers", "hashes", "words", "keys"])

    return run


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that rises in both, of pairs that rise in the first."""
    tails, tops, links = [], [], []
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        links.append(tops[at - 1] if at else None)
        tails[at : at + 1] = [b]
        tops[at : at + 1] = [n]
    chain, n = [], tops[-1] if tops else None
    while n is not None:
        chain.append(pairs[n])
        n = links[n]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences. Where a stretch has no line that occurs once in both, the
    common line with the fewest occurrences is the anchor, first with first."""
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {v: i for i, v in zip(range(b1 - 1, b0 - 1, -1), reversed(b[b0:b1]), strict=True) if v in in_a}
        if not where:
            continue
        anchors = _chain([(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and in_b[a[i]] == 1])
        if not anchors:
            rarest = min(where, key=lambda v: (in_a[v] + in_b[v], where[v]))
            anchors = [(a.index(rarest, a0, a1), where[rarest])]
        matched += anchors
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(matched)


def _shared(a: list[int], b: list[int], left: list[int], words: list[int], least: int) -> set[int]:
    """Positions among `left` in b of the lines of all runs of enough words that a has, in whatever order."""
    spans = [(i, j) for i, j in _spans([words[i] for i in left], least) if left[j - 1] - left[i] == j - 1 - i]
    runs = {n: {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} for n in {j - i for i, j in spans}}
    return {k for i, j in spans if tuple(b[left[i] : left[j - 1] + 1]) in runs[j - i] for k in left[i:j]}


def common_lines(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Positions in b of the lines of all aligned blocks of enough words. What is left of b is aligned
    again, so passages that b repeats are found too. Where an alignment deletes nothing, as a chain of
    short lines crosses a passage, the runs both have are deleted without regard to their order."""
    left, found = list(range(len(b))), []
    while left:
        matched = patience(a, [b[i] for i in left])
        blocks, block = [], []
        for x, y in matched:
            if block and (x, y) != (block[-1][0] + 1, block[-1][1] + 1):
                blocks.append(block)
                block = []
            block.append((x, y))
        blocks.append(block)
        gone = {left[y] for block in blocks if sum(words[left[y]] for _, y in block) >= least for _, y in block}
        gone = gone or _shared(a, b, left, words, least)
        if not gone:
            break
        found += gone
        left = [i for i in left if i not in gone]
    return sorted(found)


def _aligned(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("first_hashes", "hashes", "words", "numbers")]
            gone = [[numbers[i] for i in common_lines(a, b, words, least)] for a, b, words, numbers in zip(*lists, strict=True)]
            columns = [batch.column(c) for c in ("id", "tie", "first_id")]
            yield pa.record_batch([*columns, pa.array(gone, pa.list_(pa.int32()))], names=["id", "tie", "first_id", "gone"])

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """`row` (all columns of `docs` as a struct, so names cannot clash), `clean` (the text without deleted
    lines), `n_removed` (lines), `removed` (their numbers from 0), `partners` (ids of the documents aligned with).

    A document is later than those of smaller ids; where ids repeat with different texts, a checksum of
    the text decides, and equal rows are one document. Null and empty texts, texts of fewer words, and
    rows without an id are left as they are (a null stays null). An empty table gives no rows.
    """
    text = column(text_col)
    rows = docs.select(packed_row(docs.columns), column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    plain = rows.where("id IS NOT NULL AND text IS NOT NULL").select("id", "tie", "text")
    kinds = "id long, tie long, numbers array<int>, hashes array<long>, words array<int>, keys array<long>"
    lined = cut(plain.mapInArrow(_sequences(least), kinds).where(F.size("keys") > 0))
    keys = lined.select("id", "tie", F.explode("keys").alias("key"))
    firsts = keys.groupBy("key").agg(F.min(F.struct("id", "tie")).alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = keys.join(firsts, "key").select("id", "tie", F.col("first.id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    pairs = pairs.where("id <> first_id OR tie <> first_tie").distinct()
    sides = lined.select("id", "tie", "numbers", "hashes", "words"), lined.select(F.col("id").alias("first_id"), F.col("tie").alias("first_tie"), F.col("hashes").alias("first_hashes"))
    # equal rows are one document: one sequence stands for them
    sides = sides[0].dropDuplicates(["id", "tie"]), sides[1].dropDuplicates(["first_id", "first_tie"])
    both = pairs.join(sides[0], ["id", "tie"]).join(sides[1], ["first_id", "first_tie"])
    found = both.select("id", "tie", "first_id", "first_hashes", "hashes", "words", "numbers").mapInArrow(_aligned(least), "id long, tie long, first_id long, gone array<int>")
    gone = found.where(F.size("gone") > 0).groupBy("id", "tie").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"), F.array_sort(F.collect_set("first_id")).alias("partners")
    )
    lines = F.split("text", "\n")
    parts = rows.join(gone, ["id", "tie"], "left").select("row", "text", "removed", "partners", F.when(F.col("removed").isNotNull(), lines).alias("lines"))

    def stretch(i):
        start = F.coalesce(F.get("removed", i - 1), F.lit(-1)) + 2
        return F.slice("lines", start, F.coalesce(F.get("removed", i), F.size("lines")) - start + 1)

    clean = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("removed")), stretch)), "\n")
    return parts.select(
        "row",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(clean).alias("clean"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("partners", F.array().cast("array<bigint>")).alias("partners"),
    )
