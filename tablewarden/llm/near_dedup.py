"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's set of word shingles is hashed by one function; its k smallest values are its sketch.
   Documents with equal sets are one class from here on.
2. Inverted lists of retained values generate overlaps. Of two sets as alike as asked, the sketches
   share at least `need` values (certain while a set is no larger than k, else but for a chance of
   about 1e-7), so a class only enters the lists of its rarest values: all but `need` - 1 of them.
   Values that only one class holds count as rarest, so most classes enter no list at all, and
   passages that many documents share are hardly ever among the rarest.
   Of the documents left, shingles that no other one has are counted exactly; that bounds what two
   of them can share and rules most out, such as copies that were each edited in their own way.
3. The union of two sketches estimates likeness; pairs clearly below the threshold go.
4. The exact sets of what is left, recomputed from whole texts, decide.

Lists are not expanded into all pairs. Each class is first compared with the likeliest of its lists'
centres; classes joined that way need no further comparison. In lists that still span several
components, members outside the largest one are compared with all, in blocks of about `BLOCK`
members, and likely pairs alone are emitted. Lists that agree in their largest component and in their
first member are one there, since the lists of a group of copies hold much the same members: each
member's sketch is shuffled once for all of them. Components are formed by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewarden.llm.components import components
from tablewarden.llm.durable import cut
from tablewarden.llm.rows import column
from tablewarden.llm.words import hashed_words, mix

SKETCH = 64
# values of the larger sketches that candidates get for estimates
LARGE = 256
BLOCK = 1024
_U = np.uint64
_SIGN = _U(1 << 63)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of `size` words. A text of fewer words
    has its whole sequence as its only shingle, a text without words has none."""
    factors = mix(np.arange(1, size + 1, dtype=_U)) | _U(1)
    for _, ids, bounds in hashed_words(texts):
        windows = len(ids) - size + 1
        if windows > 0:
            hashes = ids[:windows] * factors[0]
            for place in range(1, size):
                hashes = hashes + ids[place : place + windows] * factors[place]
            hashes = mix(hashes)
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if end - begin >= size:
                yield np.unique(hashes[begin : end - size + 1])
            elif end > begin:
                few = ids[begin:end] * factors[: end - begin]
                yield mix(few.sum(keepdims=True) + _U(end - begin))
            else:
                yield ids[:0]


def needed(n: int, similarity: float, k: int) -> int:
    """Retained values that the sketch of a set of n shares with that of any set as similar."""
    exact = ceil(round(similarity * n, 9))
    if n * similarity <= 1e-9 + k * similarity**2:
        return max(1, exact)
    if n <= k:
        return max(1, min(exact, k - floor((1 - similarity) * n / similarity + 1e-9)))
    return _fewest(similarity, k)


def _fewest(similarity: float, k: int, chance: float = 1e-7) -> int:
    """The largest count that a binomial of k draws falls short of with less than that chance."""
    term, total = (1 - similarity) ** k, 0.0
    for hits in range(k):
        total += term
        if total > chance:
            return max(1, hits)
        term *= (k - hits) / (hits + 1) * similarity / (1 - similarity)
    return k


def _sketches(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, kept = [], [], []
            for values in shingle_sets(batch.column("text"), size):
                counts.append(len(values))
                keys.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                # signed values in the same order
                kept.append((values[:k] ^ _SIGN).view(np.int64))
            ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
            flat = pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("tie"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                names=["doc_id", "tie", "n_shingles", "set_key", "sketch"],
            )

    return run


def _estimates(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """Shared values among the k smallest of the union of two sketches, and how many those are."""
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~twice])
    ranks = np.cumsum(distinct)
    size = min(k, int(ranks[-1]))
    return int(np.count_nonzero(twice & (ranks[1:] <= size))), size


def _likely(shared: int, size: int, k: int, similarity: float) -> bool:
    """Whether sets with this union sketch may be as similar. Exact where the union is complete."""
    return shared >= (_fewest(similarity, k) if size == k else similarity * size - 1e-9)


def _estimated(k: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("sketch_a", "sketch_b"):
                lists = batch.column(name)
                sides.append((lists.offsets.to_numpy(), lists.values.to_numpy()))
            (oa, va), (ob, vb) = sides
            found, rates = [], []
            for i in range(batch.num_rows):
                shared, size = _estimates(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], k)
                if _likely(shared, size, k, similarity):
                    found.append(i)
                    rates.append(shared / size)
            taken = pa.array(found, pa.int32())
            yield pa.record_batch([batch.column("a").take(taken), batch.column("b").take(taken), pa.array(rates, pa.float64())], names=["a", "b", "rate"])

    return run


def _list_pairs(k: int, percent: int):
    """Likely pairs, of common values, of some lists' queries with the members of one of their blocks, which comes
    sorted with its queries."""
    similarity = percent / 100
    need = _fewest(similarity, k)

    def shared(arrays: list[np.ndarray]):
        """Counts, for a query's values, the common ones with each array."""
        values = np.concatenate(arrays)
        owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]

        def count(query: np.ndarray) -> np.ndarray:
            low, high = np.searchsorted(values, query), np.searchsorted(values, query, side="right")
            spans = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            return np.bincount(owner[at], minlength=len(arrays))

        return count

    def may(n: int, common: int, others: np.ndarray, others_common: np.ndarray) -> np.ndarray:
        most = np.minimum(common, others_common)
        return 100 * most >= percent * (n + others - most)

    def pairs(queries: list[tuple], members: list[tuple]) -> Iterator[tuple[int, int]]:
        nodes, roots = np.array([m[0] for m in members]), np.array([m[1] for m in members])
        minor = np.array([m[2] for m in members])
        retained = shared([m[3][:k] for m in members])
        meeting = shared([m[4] for m in members])
        sizes, commons = np.array([m[5] for m in members]), np.array([m[6] for m in members])
        for node, root, _, sketch, values, n, common in queries:
            apart = (roots != root) & ~(minor & (nodes <= node)) & may(n, common, sizes, commons)
            if not apart.any():
                continue
            apart &= retained(sketch[:k]) >= (need if len(sketch) >= k else 1)
            if not apart.any():
                continue
            apart &= meeting(values) > 0
            for j in np.flatnonzero(apart).tolist():
                if _likely(*_estimates(sketch, members[j][3], LARGE), LARGE, similarity):
                    yield max(node, int(nodes[j])), min(node, int(nodes[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, members = None, [], []

        def flush() -> pa.RecordBatch:
            found = sorted(set(pairs(queries, members))) if queries and members else []
            return pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("major", "least", "block", "is_query", "node", "root", "minor")]
            arrays = []
            for name in ("sketch", "values"):
                lists = batch.column(name)
                flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                arrays.append([flat[a:b].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)])
            sizes = [batch.column(c).to_pylist() for c in ("n", "common")]
            for major, least, block, is_query, *row in zip(*plain, *arrays, *sizes, strict=True):
                if (major, least, block) != key:
                    if key:
                        yield flush()
                    key, queries, members = (major, least, block), [], []
                (queries if is_query else members).append(tuple(row))
        if key:
            yield flush()

    return run


def _verified(size: int, percent: int):
    """Pairs whose whole shingle sets are alike enough; texts of both sides come with the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(
                zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size), strict=True)
            ):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    Documents are linked where 100 * shared shingles >= percent * shingles of the union.
    `component_id` is the smallest id reachable over links, `kept` marks that document.

    Defined results: a null or wordless text has no shingles and is linked with nothing. A row without id
    keeps a null component and is kept. Rows that repeat an id are one document: what one of its texts is linked
    with, all are, and they fare alike. An empty table gives no rows. Other columns of `docs` are ignored,
    so their names cannot clash.
    """
    similarity = percent / 100
    text = column(text_col)
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    sketched = cut(texts.mapInArrow(_sketches(shingle, k), "doc_id long, tie long, n_shingles long, set_key binary, sketch array<long>"))
    # one class per set, with a number of its own; its sketch comes from any member, its text from the first
    classes = cut(
        sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        .select("set_key", "first.doc_id", "first.tie", "n", "sketch", F.monotonically_increasing_id().alias("node"))
    )
    held = cut(_held(classes, similarity, k))
    # the texts that may be compared; all texts are shuffled this once
    store = cut(texts.join(classes.join(held.select("node"), "node", "left_semi").select("doc_id", "tie", "node"), ["doc_id", "tie"]).select("node", "text"))
    common = _common(store, shingle).join(classes.select("node", "n"), "node")
    # rows that repeat with their id stand in the store as often, and count in proportion
    common = common.select("node", "n", F.expr("shared * n DIV total").alias("common"))
    held = held.join(common, "node").where(F.col("common") * 100 >= F.col("n") * percent)
    held = cut(held.join(_large_sketches(store, shingle), "node"))

    roots = classes.select("node", F.col("node").alias("root"))
    links = cut(_same_ids(sketched, classes))
    for candidates in (_star_pairs, _residual_pairs):
        pairs = cut(candidates(held, roots, k, percent))
        both = pairs
        for side in "ab":
            both = both.join(store.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
        edges = both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(shingle, percent), "a long, b long")
        links = cut(links.union(edges))
        moved = components(links)
        roots = cut(classes.select("node").join(moved, "node", "left").select("node", F.coalesce("root", "node").alias("root")))

    placed = classes.join(roots, "node").select("set_key", "doc_id", "root")
    members = placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("least")), "root").select("set_key", "least")
    per_row = cut(sketched.select("doc_id", "n_shingles", "set_key").join(members, "set_key", "left").select("doc_id", "n_shingles", F.least("least", "doc_id").alias("component")))
    # a wordless text fares like the other texts of its id
    repeated = per_row.groupBy("doc_id").agg(F.min("component").alias("own"), F.max("component").alias("most")).where("own < most").select("doc_id", "own")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "component"))
    per_row = per_row.join(repeated, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return per_row.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_ids(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that hold texts of one id, each with the least of them."""
    keys = sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_key")
    several = keys.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high").select("doc_id")
    own = keys.join(several, "doc_id").distinct().join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
    return own.join(least, "doc_id").where("node > b").select(F.col("node").alias("a"), "b").distinct()


def _held(classes: DataFrame, similarity: float, k: int) -> DataFrame:
    """(node, held, mass) of each class that could reach the threshold: its rarest retained values, as
    many as needed, and how often all its retained values occur."""
    postings = classes.select("node", "n", F.explode("sketch").alias("value"))
    shared = postings.withColumn("df", F.count("*").over(Window.partitionBy("value"))).where("df > 1")
    # counts below the sketch size are few, so the needed overlap is a lookup
    table = F.array(*[F.lit(needed(n, similarity, k)) for n in range(1, k + 2)])
    need = F.element_at(table, F.least(F.col("n"), F.lit(k + 1)).cast("int"))
    rarest = F.slice("all", F.lit(1), F.size("all") - need + 1)
    return (
        shared.groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("all"), F.sum("df").alias("mass"))
        .where(F.size("all") >= need)
        .select("node", F.array_sort(F.transform(rarest, lambda x: x.value)).alias("held"), "mass")
    )


def _common(store: DataFrame, size: int) -> DataFrame:
    """(node, total, shared): the shingles of a class's rows in `store`, and how many of them another class has too.

    No pair shares more than the smaller share of its two, which bounds its likeness from above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sets = list(shingle_sets(part.column(1), size))
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.record_batch([part.column(0), values], names=["node", "values"])

    rows = store.select("node", "text").mapInArrow(run, "node long, values array<long>").select("node", F.explode("values").alias("value"))
    same = Window.partitionBy("value")
    rows = rows.select("node", (F.min("node").over(same) < F.max("node").over(same)).alias("other"))
    return rows.groupBy("node").agg(F.count("*").alias("total"), F.count_if("other").alias("shared"))


def _large_sketches(store: DataFrame, size: int) -> DataFrame:
    """(node, sketch): the upper halves of the LARGE smallest values of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [((v[:LARGE] ^ _SIGN).view(np.int64) >> 32).astype(np.int32) for v in shingle_sets(batch.column(1), size)]
            ends = pa.array(np.cumsum([0, *map(len, kept)]), pa.int32())
            flat = pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["node", "sketch"])

    found = store.select("node", "text").mapInArrow(run, "node long, sketch array<int>")
    return found.groupBy("node").agg(F.first("sketch").alias("sketch"))


def _star_pairs(held: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): each class with the likeliest centre among those of its lists. A list's centre is the
    member whose values occur most: what others were copied from, rather than a copy."""
    lists = held.select("node", "mass", F.explode("held").alias("value")).distinct()
    centres = lists.groupBy("value").agg(F.max_by("node", F.struct("mass", -F.col("node"))).alias("b"))
    pairs = lists.join(centres, "value").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    for side in "ab":
        pairs = pairs.join(held.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    likely = pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimated(LARGE, percent / 100), "a long, b long, rate double")
    return likely.groupBy("a").agg(F.max_by("b", F.struct("rate", -F.col("b"))).alias("b"))


def _residual_pairs(held: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """Likely pairs across components, from lists that span several. The members of a list's largest
    component are compared with the others only, which go to each block of the list as queries."""
    lists = held.select("node", F.explode("held").alias("value")).distinct()
    placed = lists.join(roots, "node").select("value", "node", "root")
    mixed = (
        placed.groupBy("value", "root").agg(F.count("*").alias("n"), F.min("node").alias("least"))
        .groupBy("value").agg(F.count("*").alias("kinds"), F.max_by("root", F.struct("n", "root")).alias("major"), F.min("least").alias("least"))
        .where("kinds > 1")
        .select("value", "major", "least")
    )
    # lists of one largest component and first member are one; no more than the sketch of that member has values
    family = ["major", "least"]
    rows = cut(placed.join(mixed, "value").groupBy(*family, "node", "root").agg(F.collect_list("value").alias("values")))
    sizes = rows.groupBy(*family).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    rows = rows.join(sizes, family).select(*family, "node", "root", "values", "blocks", (F.col("root") != F.col("major")).alias("minor"), block.alias("block"))
    own = rows.select(*family, "block", F.lit(False).alias("is_query"), "node", "root", "minor", "values")
    queries = rows.where("minor").select(
        *family, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_query"), "node", "root", "minor", "values"
    )
    rows = own.union(queries).join(held.select("node", "sketch", "n", "common"), "node")
    rows = rows.select(*family, "block", "is_query", "node", "root", "minor", "sketch", "values", "n", "common")
    rows = rows.repartition(*family, "block").sortWithinPartitions(*family, "block")
    return rows.mapInArrow(_list_pairs(k, percent), "a long, b long").distinct()
