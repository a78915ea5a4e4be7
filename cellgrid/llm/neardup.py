"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set are its distinct word shingles.  Its sketch has ``BANDS * ROWS`` bins.  In
round i each element is hashed to one bin (after as many rounds as there are bins: to the
i-th bin for certain) with a value that carries i; a bin keeps its smallest value.  Rounds
end for a document when all its bins are full, so every coordinate is filled, coordinates
of two sets agree with a probability of their similarity, and their share concentrates
around it as for independent hashes.

Documents with equal sets form a class, shown by its smallest doc_id.  Classes that share a
band are compared on their full sets, but not all with all.  Each bucket names a pivot, and
its members are compared with that one.  Where a bucket's members are not one component
then, members without a chance go: a set that has too few shingles in common with all other
open sets together can't have enough in common with one.  Each bucket still open has an
anchor, its largest component; all its other members are compared with the anchor's open
members and with each other, in blocks of bounded size that give only the links found.
So every pair of a bucket is compared but for pairs inside one component, where a further
link changes nothing.  Components come from hooking and pointer jumping over tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.store import arrow_map, drop_table, own_columns, temporary, write_table
from cellgrid.llm.words import Lexer, Words, find_words, mix, slices

BANDS, ROWS = 32, 4  # two sets at similarity 0.8 share no band with probability 5e-8
BLOCK = 256  # sets on either side of a block of comparisons
WORDS = Lexer("space", lower=True)
_SEEDS = np.random.Generator(np.random.PCG64(977)).integers(1, 1 << 63, 2 * 1024, dtype=np.uint64)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of the distinct shingles of each row, rows in order; a row with fewer words is one shingle."""
    at, grams = words.grams(size)
    docs = words.doc[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = words.first[short]
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = counts[short] > k
            whole[more] = mix(whole[more] * np.uint64(31) + words.hash[first[more] + k])
        whole = mix(whole + counts[short].astype(np.uint64))
        docs, grams = np.concatenate([docs, short]), np.concatenate([grams, whole])
        order = np.argsort(docs, kind="stable")
        docs, grams = docs[order], grams[order]
    new = ~pd.Series(grams ^ mix(docs.astype(np.uint64) + np.uint64(1))).duplicated().to_numpy()
    return docs[new], grams[new]


def sketch(docs: np.ndarray, grams: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Fast similarity sketches (rows x bins) of the sets; rows without elements keep the largest value."""
    out = np.full((rows, bins), np.iinfo(np.uint64).max)
    flat = out.reshape(-1)
    open_docs, open_grams = docs, grams
    for i in range(2 * bins):
        if not len(open_docs):
            break
        hashed = mix(open_grams ^ _SEEDS[i])
        bin_ = (hashed % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(hashed), i - bins)
        value = (np.uint64(i) << np.uint64(54)) | (mix(hashed + np.uint64(i)) >> np.uint64(10))
        np.minimum.at(flat, open_docs * bins + bin_, value)
        full = (out != np.iinfo(np.uint64).max).all(1)
        keep = ~full[open_docs]
        open_docs, open_grams = open_docs[keep], open_grams[keep]
    return out


def _sums(values: np.ndarray, docs: np.ndarray, rows: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    edges = np.searchsorted(docs, np.arange(rows + 1))
    return sums[edges[1:]] - sums[edges[:-1]]


def _sketch_rows(batch: pa.RecordBatch, size: int):
    for piece in slices(batch, "text"):
        rows = piece.num_rows
        docs, grams = shingle_sets(find_words(piece.column("text"), WORDS), size)
        coordinates = sketch(docs, grams, rows, BANDS * ROWS).reshape(rows, BANDS, ROWS)
        bands = np.broadcast_to(_SEEDS[:BANDS], (rows, BANDS)).copy()
        for k in range(ROWS):
            bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + coordinates[:, :, k])
        n = np.bincount(docs, minlength=rows)
        long = lambda x: pa.array(x.view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), long(bands.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(n), long(_sums(mix(grams), docs, rows)), long(_sums(mix(grams ^ _SEEDS[0]), docs, rows)), lists],
            ["doc_id", "n", "f1", "f2", "bands"],
        )


def _confirm_rows(batch: pa.RecordBatch, size: int, percent: int):
    """Of candidate pairs with both texts, those similar enough on their full sets."""
    for piece in slices(batch, "text_a", 1 << 19):
        rows = piece.num_rows
        sets = [shingle_sets(find_words(piece.column(k), WORDS), size) for k in ("text_a", "text_b")]
        docs = np.concatenate([d for d, _ in sets])
        both = pd.Series(np.concatenate([g ^ mix(d.astype(np.uint64) + np.uint64(1)) for d, g in sets])).duplicated().to_numpy()
        common = np.bincount(docs[both], minlength=rows)
        union = np.bincount(docs, minlength=rows) - common
        linked = pa.array((100 * common >= percent * union) & (union > 0))
        yield pa.RecordBatch.from_arrays([piece.column("a").filter(linked), piece.column("b").filter(linked)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round every node hooks onto its smallest neighbour, chains are jumped, and edges
    are renamed to the new roots; rounds go on until no edge is left between roots.
    """
    edges = write_table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        # the larger end hooks onto its smallest neighbour, so chains fall and have no circles
        parent = write_table(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hook")
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = write_table(parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "jump")
            moved = jumped.filter("moved").limit(1).count()
            drop_table(parent)
            parent = jumped.select("node", "up")
            parent._stored_at = jumped._stored_at
            if not moved:
                break
        maps.append(parent)
        rename = lambda df, k: df.join(parent.withColumnRenamed("node", k), k, "left").withColumn(k, F.coalesce("up", k)).drop("up")  # noqa: B023, E731
        renamed = rename(rename(edges, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = write_table(renamed, "edges")
        drop_table(edges)
        edges = fresh
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # a root of one round may hook in a later one
    out = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("up"), F.col("up").alias("top"))
        moved = out.join(step, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        fresh = later.join(out.select("node"), "node", "left_anti")
        out = write_table(moved.unionByName(fresh), "labels")
    return out.select("node", F.col("up").alias("component"))


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's smallest."""
    pivots = write_table(members.groupBy("bucket").agg(F.min("rep").alias("pivot")), "pivots")
    return members.join(pivots, "bucket").filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()


def _anchored(members: DataFrame) -> DataFrame:
    """(anchor, rep, right, left, block): open members under each anchor; ``left`` marks those outside it, all are on the right."""
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    anchors = write_table(sizes.groupBy("bucket").agg(F.max(F.struct("size", F.col("component").alias("anchor"))).alias("m")).select("bucket", "m.anchor"), "anchors")
    under = write_table(members.join(anchors, "bucket").groupBy("anchor", "rep").agg(F.max(F.col("component") != F.col("anchor")).alias("left")), "under")
    # blocks by hash: about BLOCK members each, for the left and the right side on their own
    counts = write_table(under.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).alias("rights"), F.ceil(F.sum(F.col("left").cast("long")) / BLOCK).alias("lefts")), "counts")
    placed = under.join(counts, "anchor")
    right = placed.select("anchor", "rep", F.lit(False).alias("left"), F.pmod(F.xxhash64("rep"), "rights").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("i"))
    left = placed.filter("left").select("anchor", "rep", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)).alias("j"), F.pmod(F.xxhash64("rep"), "lefts").alias("i"))
    return left.unionByName(right)


def _block_links(batches, size: int, percent: int):
    """Links between the left and the right sets of each block; rows come ordered by block."""

    def solve(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        docs, grams = shingle_sets(find_words(table.column("text"), WORDS), size)
        reps, left = np.asarray(table.column("rep")), np.asarray(table.column("left"))
        codes, kinds = pd.factorize(grams)
        sizes, bounds = np.bincount(docs, minlength=len(reps)), np.searchsorted(docs, np.arange(len(reps) + 1))
        right = np.flatnonzero(~left[docs])
        owner, right_codes = docs[right], codes[right]
        mark = np.zeros(len(kinds), bool)
        a, b = [], []
        for k in np.flatnonzero(left):
            mine = codes[bounds[k] : bounds[k + 1]]
            mark[mine] = True
            common = np.bincount(owner, mark[right_codes], len(reps))
            mark[mine] = False
            linked = np.flatnonzero((common * (100 + percent) >= percent * (sizes + sizes[k])) & (common > 0) & (reps != reps[k]))
            a.append(np.full(len(linked), reps[k]))
            b.append(reps[linked])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in ("anchor", "i", "j")), strict=True))
        low = 0
        for k, key in enumerate(keys):
            if at is not None and key != at:
                held.append(batch.slice(low, k - low))
                yield solve(held)
                held, low = [], k
            at = key
        held.append(batch.slice(low))
    if held:
        yield solve(held)


def _shingle_rows(batch: pa.RecordBatch, size: int):
    for piece in slices(batch, "text"):
        docs, grams = shingle_sets(find_words(piece.column("text"), WORDS), size)
        yield pa.RecordBatch.from_arrays([piece.column("rep").take(pa.array(docs)), pa.array(grams.view(np.int64))], ["rep", "shingle"])


def _with_chance(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Members that may link within their bucket.

    A link needs common * (100 + percent) >= percent * (size + other size); what a set has
    in common with one other is no more than what it has in common with all open sets.
    """
    reps = write_table(members.select("rep").distinct(), "open_reps")
    shingles = write_table(arrow_map(texts.join(reps, "rep").select("rep", "text"), lambda b: _shingle_rows(b, size), "rep long, shingle long"), "shingles")
    several = write_table(shingles.groupBy("shingle").count().filter("count > 1").select("shingle"), "several")
    common = write_table(shingles.join(several, "shingle").groupBy("rep").agg(F.count("*").alias("common")), "common")
    least = write_table(members.groupBy("bucket").agg(F.min("n").alias("least")), "least")
    bound = members.join(common, "rep").join(least, "bucket").filter(F.col("common") * (100 + percent) >= percent * (F.col("n") + F.col("least")))
    out = write_table(_open(write_table(bound.select(*members.columns), "bound")), "members")
    for old in (reps, shingles, several, common, least):
        drop_table(old)
    return out


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    several = write_table(members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket"), "open")
    return members.join(several, "bucket").select(*members.columns)


def _classes(docs: DataFrame, size: int, percent: int, keep) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and the component of each class (f1, f2)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = write_table(arrow_map(named, lambda b: _sketch_rows(b, size), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "sketches")
    known = sketches.filter("n > 0 and doc_id is not null")
    classes = write_table(known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "classes")
    banded = classes.select(F.explode("bands").alias("bucket"), "rep", "n", F.col("rep").alias("component"))
    members = write_table(_open(banded), "members")
    reps = write_table(members.select("rep").distinct(), "reps")
    texts = write_table(named.withColumnRenamed("doc_id", "rep").join(reps, "rep").groupBy("rep").agg(F.min("text").alias("text")), "texts")
    pairs = write_table(_pivot_pairs(members), "pairs")
    with_a = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    links = write_table(arrow_map(with_both.select("a", "b", "text_a", "text_b"), lambda b: _confirm_rows(b, size, percent), "a long, b long"), "links")
    label = write_table(components(links), "labels")
    known = members.drop("component").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    members = write_table(_open(write_table(known, "known")), "members")
    if members.limit(1).count():
        blocks = _anchored(_with_chance(members, texts, size, percent)).join(texts, "rep").select("anchor", "i", "j", "left", "rep", "text")
        ordered = blocks.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
        more = write_table(ordered.mapInArrow(lambda b: _block_links(b, size, percent), "a long, b long"), "links")
        label = write_table(components(links.unionByName(more)), "labels")
    named_class = classes.select("f1", "f2", "rep")
    named_class = named_class.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    return keep(sketches), keep(write_table(named_class, "named"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links, itself included; ``kept``
    marks that document.  A null or empty text has no shingles and no links.  A null doc_id
    can't be named: such a row has a null component_id and is kept.  A row that repeats is
    the same document again and gets the same result.  If rows share a doc_id but not the
    text, the smallest text stands for that id in comparisons.
    """
    with temporary() as keep:
        sketches, classes = _classes(docs, size, percent, keep)
    found = sketches.drop("bands").join(classes, ["f1", "f2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


@own_columns
def keep_one(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """``docs`` with its own columns, one row of each component: one with the smallest doc_id, or one without if none has an id.

    Here each row is a document of its own, so rows that repeat, rows that share an id and
    rows without one are compared like all others.  Rows without words all stay.
    """
    with temporary() as keep:
        rows = keep(write_table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows"))
        found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), size, percent)
        named = rows.select("__row", F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__th"))
        member = found.select(F.col("doc_id").alias("__row"), "component_id").join(named, "__row")
        first = member.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__th", "__row")).alias("first"))
        kept = keep(write_table(first.select(F.col("first.__row").alias("__row")), "kept"))
    # the same join at every size, so that disk and shuffle grow in proportion
    return rows.join(kept.hint("merge"), "__row", "left_semi").select(*(f"`{c}`" for c in docs.columns))
