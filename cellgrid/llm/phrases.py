"""Phrases whose words attract each other, counted on depth-truncated suffix subtrees.

The suffixes of all pieces of text, cut after three words, form a tree in which a node's
count is the number of leaves below it.  The tree is split vertically by prefixes:

1. Prefixes are counted, from one word on.  A prefix with more occurrences than the budget
   is extended by a word, so that only prefixes within the budget (or of full depth)
   remain.  A prefix above the budget holds one word in ``SHARE`` at least, so there are no
   more than ``SHARE`` of a length, and they are known to every task.
2. Prefixes are filed in ``BUCKETS`` buckets by hash; neighbouring buckets form groups of
   about one budget of occurrences.  Prefixes of full depth are not counted beforehand:
   their hashes spread the occurrences of the pair above them evenly over all buckets.
3. Suffixes go to the group of their prefix, equal ones of a slice of text as one row with
   a count.  Each group is sorted and gives its subtrees one below the other: a node is a
   run of rows with the same first words, its count the sum of the run's leaves.  Only the
   leaves below one node of two words are held at a time, equal ones as one row.
4. Nodes of two and three words with ``least`` occurrences are candidates.  The count of a
   candidate's first two words is on its path (or known, if that prefix was extended);
   counts that other subtrees hold are fetched by joins.

Suffixes with a rare first or second word can't be candidates and are left out; a bitmap of
fixed size, filled from the words with ``least`` occurrences, tells them without misses.
Words are told apart by 64-bit hashes of language and lower-cased bytes, phrases by those of
their words.  Counts may reach 10**15; scores are computed with decimals of 38 digits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.store import arrow_map, drop_table, write_table
from cellgrid.llm.words import BLOCK, Lexer, Words, find_words, mix, slices

LEAST, CONTAINED_PERCENT, TOP = 10, 50, 2_000
BUDGET = 1 << 17  # occurrences in a group
SHARE = 4_096
BUCKETS = 1 << 16
BITS = 1 << 24
SLICE = 4 * BLOCK  # text in which equal suffixes become one row
SALTS = 64  # parts of a language that are ranked on their own first

WORDS = Lexer("space", lower=True)
WORDS.is_word = WORDS.is_word.copy()
WORDS.is_word[list(b".,;:!?")] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def breaks(words: Words) -> np.ndarray:
    """Whether each word is the first one of its piece."""
    first = np.zeros(len(words) + 1, bool)
    first[words.first] = True
    for low in range(0, len(words.data), BLOCK):
        at = np.flatnonzero(_BREAK[words.data[low : low + BLOCK]]) + low
        first[np.searchsorted(words.start, at)] = True
    return first[:-1]


def _salts(langs: pa.Array) -> np.ndarray:
    """A 64-bit number for the language of each row."""
    coded = langs.dictionary_encode()
    each = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array([*each, 0], np.uint64)[np.asarray(coded.indices)]


def word_ids(piece: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a batch (text, lang), their ids, and whether each is followed by another one in its piece."""
    words = find_words(piece.column("text"), WORDS)
    ids = mix(words.hash ^ _salts(piece.column("lang"))[words.doc]) if len(words) else np.zeros(0, np.uint64)
    ids[ids == 0] = 1  # 0 stands for no word
    return words, ids, ~np.append(breaks(words)[1:], True)[: len(words)]


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Code of a prefix with one more word; that of one word is the word's id."""
    return mix(prefix * _ODD + word)


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each different code, how often it occurs)."""
    _, at, n = np.unique(codes, return_index=True, return_counts=True)
    return at, n


def _vocabulary_rows(batch: pa.RecordBatch):
    for piece in slices(batch, "text", SLICE):
        words, ids, _ = word_ids(piece)
        at, n = _counted(ids)
        sizes = words.end[at] - words.start[at]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = words.data[np.repeat(words.start[at] - bounds[:-1], sizes) + np.arange(int(bounds[-1]))]
        data = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
        spelled = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(ids[at].view(np.int64)), piece.column("lang").take(pa.array(words.doc[at])), spelled.cast(pa.string()), pa.array(n)], ["id", "lang", "word", "n"])


def _prefix_rows(batch: pa.RecordBatch, above: np.ndarray):
    """Prefixes of two words whose first one is in ``above``, with counts."""
    for piece in slices(batch, "text", SLICE):
        _, ids, linked = word_ids(piece)
        at = np.flatnonzero(linked)
        at = at[_among(ids[at], above)]
        code = extended(ids[at], ids[at + 1])
        place, n = _counted(code)
        first = at[place]
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (code[place], ids[first], ids[first + 1])] + [pa.array(n)], ["code", "w1", "w2", "n"])


@dataclass
class Forest:
    """What every task knows: frequent words as a bitmap, extended prefixes (sorted codes), and the group of each bucket."""

    often: np.ndarray
    hot_words: np.ndarray
    hot_pairs: np.ndarray
    hot_pair_counts: np.ndarray
    group: np.ndarray
    word_rows: list[tuple[int, int]]  # (id, count) of extended words
    pair_rows: list[tuple[int, int, int]]  # (w1, w2, count) of extended pairs

    def is_often(self, ids: np.ndarray) -> np.ndarray:
        place = ids & np.uint64(BITS - 1)
        return (self.often[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _suffix_rows(batch: pa.RecordBatch, forest: Forest):
    """(key, w1, w2, w3, n): suffixes whose first two words are frequent; w3 is 0 if the piece ends or the third word is rare.

    The key is the group and half of the code of the first two words, so rows ordered by
    it keep subtrees together.
    """
    for piece in slices(batch, "text", SLICE):
        _, ids, linked = word_ids(piece)
        often = forest.is_often(ids)
        at = np.flatnonzero(linked[:-1] & often[:-1] & often[1:]) if len(ids) else np.zeros(0, np.int64)
        w1, w2, later = ids[at], ids[at + 1], np.minimum(at + 2, len(ids) - 1)
        w3 = np.where(linked[at + 1] & often[later], ids[later], np.uint64(0))
        two = extended(w1, w2)
        three = extended(two, w3)
        place, n = _counted(three)
        w1, w2, w3, two, three = (x[place] for x in (w1, w2, w3, two, three))
        long, longer = _among(w1, forest.hot_words), _among(two, forest.hot_pairs)
        prefix = np.where(longer, three, np.where(long, two, w1))
        key = (forest.group[_bucket(prefix)].astype(np.int64) << 32) | (two >> np.uint64(32)).astype(np.int64)
        keep = ~longer | (w3 != 0)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), *(pa.array(w[keep].view(np.int64)) for w in (w1, w2, w3)), pa.array(n[keep])], ["key", "w1", "w2", "w3", "n"])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def leaves_of(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (w1, w2, w3, n) in order, equal ones as one."""
    order = np.lexsort((rows[2], rows[1], rows[0]))
    rows = [x[order] for x in rows]
    at = _runs(*rows[:3])
    return [*(x[at] for x in rows[:3]), np.add.reduceat(rows[3], at) if len(at) else rows[3]]


def subtrees(rows: list[np.ndarray], forest: Forest, least: int) -> list[np.ndarray]:
    """Nodes (w1, w2, w3, a, first_two) of two words (w3 is 0) and of three words with ``least`` occurrences, from all leaves below their first two words; ``first_two`` counts these."""
    w1, w2, w3, n = leaves_of(rows)
    pairs = _runs(w1, w2)
    both = np.add.reduceat(n, pairs) if len(pairs) else n
    code = extended(w1[pairs].view(np.uint64), w2[pairs].view(np.uint64))
    hot = _among(code, forest.hot_pairs)
    flat = (both >= least) & ~hot
    both[hot] = forest.hot_pair_counts[np.searchsorted(forest.hot_pairs, code[hot])]
    above = np.repeat(both, np.diff(np.append(pairs, len(n))))
    deep = np.flatnonzero((n >= least) & (w3 != 0))
    at = np.concatenate([pairs[flat], deep])
    return [w1[at], w2[at], np.concatenate([np.zeros(int(flat.sum()), np.int64), w3[deep]]), np.concatenate([both[flat], n[deep]]), above[at]]


def _node_rows(batches, forest: Forest, least: int):
    """Rows come ordered by key; those of a batch's last key wait for the next batch."""
    held_key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column("key"))
        rows = [np.asarray(batch.column(c)) for c in ("w1", "w2", "w3", "n")]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            key = np.concatenate([np.full(len(held[0]), held_key), key])
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in subtrees([x[:cut] for x in rows], forest, least)], ["w1", "w2", "w3", "a", "first_two"])
        held_key, held = key[-1], leaves_of([x[cut:] for x in rows])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in subtrees(held, forest, least)], ["w1", "w2", "w3", "a", "first_two"])


def _pack(load: np.ndarray, budget: int) -> np.ndarray:
    """Group of each bucket: neighbouring buckets up to a budget of occurrences."""
    group, number, filled = np.zeros(BUCKETS, np.int32), 0, 0
    for b in range(BUCKETS):
        if filled and filled + load[b] > budget:
            number, filled = number + 1, 0
        group[b] = number
        filled += load[b]
    return group


def grow_forest(texts: DataFrame, frequent: DataFrame, budget: int) -> Forest:
    """Extend prefixes above the budget, and pack all others into groups."""
    codes = lambda rows: np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    word_rows = [tuple(r) for r in frequent.filter(F.col("n") > budget).select("id", "n").collect()]  # fewer than SHARE
    words, pair_rows, stored = codes(word_rows), [], []
    if word_rows:
        counted = arrow_map(texts, lambda b: _prefix_rows(b, words), "code long, w1 long, w2 long, n long")
        stored.append(write_table(counted.groupBy("code", "w1", "w2").agg(F.sum("n").alias("n")), "pairs"))
        pair_rows = [tuple(r) for r in stored[-1].filter(F.col("n") > budget).collect()]  # fewer than SHARE
    pairs = codes(pair_rows)
    of_pair = {r[0]: r[3] for r in pair_rows}
    pair_counts = np.array([of_pair[c] for c in pairs.view(np.int64).tolist()], np.int64)
    loads = np.full(BUCKETS, sum(r[3] for r in pair_rows) // BUCKETS, np.int64)
    for table in [frequent.withColumnRenamed("id", "code"), *stored]:
        for r in table.filter(F.col("n") <= budget).groupBy(F.col("code").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
            loads[r["bucket"]] += r["n"]
    for table in stored:
        drop_table(table)
    place = F.col("id").bitwiseAND(F.lit(BITS - 1))
    maps = frequent.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # BITS / 32768 rows
    return Forest(_bitmap(maps), words, pairs, pair_counts, _pack(loads, budget), word_rows, [r[1:] for r in pair_rows])


def _bitmap(maps: list) -> np.ndarray:
    """Rows of ``bitmap_construct_agg`` as one array of bytes; bucket k >= 1 holds the values from 32768 (k - 1) + 1 on, bucket 0 the value 0."""
    flags = np.zeros(BITS + 32768, np.uint8)
    for r in maps:
        low = max(0, r["k"] * 32768 - 32767) if r["k"] else 0
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        if r["k"]:
            flags[low : low + len(bits)] |= bits
        else:
            flags[0] |= bits[0]
    return np.packbits(flags[:BITS], bitorder="little")


def _lookup(rows: DataFrame, keys: list[str], table: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` joined with ``table`` by ``keys``; keys of ``copies`` (SHARE rows at most, with a number of copies) are spread over so many."""
    few = F.broadcast(copies)
    salt = F.pmod(F.xxhash64("w1", "w2", "w3"), F.coalesce("copies", F.lit(1))).cast("int")
    spread = rows.join(few, keys, "left").withColumn("salt", salt).drop("copies")
    many = table.join(few, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.coalesce("copies", F.lit(1)) - 1).cast("int")))).drop("copies")
    return spread.join(many.hint("merge"), [*keys, "salt"]).drop("salt")


def _score(a: Column, left: Column, rest: Column) -> Column:
    big = lambda c: c.cast("decimal(15,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", million * (big(a) * big(a)), big(left) * big(rest))


def _candidates(nodes: DataFrame, forest: Forest) -> DataFrame:
    """Candidates of all subtrees, and the extended pairs, whose subtrees lie in several groups."""
    return nodes.unionByName(nodes.sparkSession.createDataFrame([(w1, w2, 0, n, n) for w1, w2, n in forest.pair_rows], nodes.schema))


def _not_contained(pairs: DataFrame, triples: DataFrame, percent: int) -> DataFrame:
    """Pairs without a longer candidate around them that has ``percent`` of their count."""
    around = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    both = pairs.select("w1", "w2", "a", F.lit(None).cast("long").alias("around")).unionByName(around.select("w1", "w2", F.lit(None).cast("long").alias("a"), F.col("a").alias("around")))
    most = both.groupBy("w1", "w2").agg(F.max("a").alias("a"), F.max("around").alias("around")).filter("a is not null")
    return most.filter(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a"))).select("w1", "w2", F.lit(0).cast("long").alias("w3"), "a")


def _scored(candidates: DataFrame, frequent: DataFrame, forest: Forest, budget: int, percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that stay."""
    spark = candidates.sparkSession
    copies = lambda n: 1 + n // budget
    hot_words = spark.createDataFrame([(w, copies(n)) for w, n in forest.word_rows], "w long, copies long")

    def with_word(rows: DataFrame, k: str) -> DataFrame:
        known = frequent.select(F.col("id").alias(k), F.col("word").alias(f"word_{k}"), F.col("n").alias(f"n_{k}"), *(["lang"] if k == "w1" else []))
        return _lookup(rows, [k], known, hot_words.withColumnRenamed("w", k))

    pairs, triples = candidates.filter("w3 = 0"), candidates.filter("w3 <> 0")
    two = with_word(with_word(_not_contained(pairs, triples, percent), "w1"), "w2")
    two = two.select("lang", F.concat_ws(" ", "word_w1", "word_w2").alias("phrase"), "a", F.col("n_w1").alias("l"), F.col("n_w2").alias("r"), _score(F.col("a"), F.col("n_w1"), F.col("n_w2")).alias("score"))
    # a pair of words is in no more candidates than there are frequent words
    last = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("last_two"))
    three = triples.join(last.hint("merge"), ["w2", "w3"])
    three = with_word(with_word(with_word(three, "w1"), "w2"), "w3")
    three = three.withColumns({"s1": _score(F.col("a"), F.col("n_w1"), F.col("last_two")), "s2": _score(F.col("a"), F.col("first_two"), F.col("n_w3"))})
    second = F.col("s2") < F.col("s1")
    pick = lambda x, y: F.when(second, F.col(x)).otherwise(F.col(y))
    three = three.select("lang", F.concat_ws(" ", "word_w1", "word_w2", "word_w3").alias("phrase"), "a", pick("first_two", "n_w1").alias("l"), pick("n_w3", "last_two").alias("r"), pick("s2", "s1").alias("score"))
    return two.unionByName(three)


def _best(scored: DataFrame, top: int) -> DataFrame:
    """Ranks of each language's first ``top`` phrases; parts of a language are ranked first, so that no task meets them all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = part.withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= top).drop("part", "rank")
    return first.withColumn("rank", rank("lang").cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, contained_percent: int = CONTAINED_PERCENT, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces
    into words at blanks and tabs.  ``n`` counts a language's words, ``a`` the phrase; cut
    after k words, ``l`` counts the first part, ``r`` the rest, and the score is
    floor(1000000 a a / (l r)) for the cut where it is lowest (ties: the smallest k).
    Phrases inside a longer candidate with ``contained_percent`` of their count are left
    out.  Ranks follow score and ``a`` downwards, then the phrase's bytes.

    A null text is empty, a null lang is ``und``.  Rows that repeat count each.  Texts may
    be of any length: long ones are worked on alone.  Tables without phrases give no rows.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counted = arrow_map(texts, _vocabulary_rows, "id long, lang string, word string, n long")
    vocabulary = write_table(counted.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "vocabulary")
    sizes = write_table(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = write_table(vocabulary.filter(F.col("n") >= least), "frequent")
    drop_table(vocabulary)
    budget = max(budget, -(-total // SHARE))
    forest = grow_forest(texts, frequent, budget)
    leaves = arrow_map(texts, lambda b: _suffix_rows(b, forest), "key long, w1 long, w2 long, w3 long, n long")
    ordered = leaves.repartition(F.shiftright("key", 32)).sortWithinPartitions("key")
    nodes = ordered.mapInArrow(lambda batches: _node_rows(batches, forest, least), "w1 long, w2 long, w3 long, a long, first_two long")
    nodes = write_table(nodes, "nodes")
    scored = _scored(_candidates(nodes, forest), frequent, forest, budget, contained_percent)
    found = write_table(_best(scored, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for old in (nodes, frequent, sizes):
        drop_table(old)
    return found
