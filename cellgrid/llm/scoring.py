"""Cross-entropy difference of documents under a target and a background language model.

Both models are bigram models with absolute discounting over one vocabulary: every word
that the corpus holds ``MIN_COUNT`` times, a boundary between documents, and one symbol for
words seen more rarely.  The background model counts all documents, the target model the
labelled good ones; the target's unigrams are discounted towards the background's.
Bigrams seen more rarely than ``MIN_COUNT`` times are left to the back-off, in both models.
A document's score is its mean loss per token (its words and its end) under the target
model minus that under the background model; the lower, the more it reads like the target.

A token that backs off loses the sum of a part of its context and a part of its own word, and
a stored bigram adds a correction.  So the difference of the models is one table of
(fingerprint, gain) for words and bigrams, and a score is a sum of looked-up gains.  That table grows with the
corpus.  It is kept as sorted arrays in shards by hash; a chunk of documents sends one row
with its different fingerprints to each shard, each shard has copies for groups of chunks, so
that many requests spread over tasks, and answers are sums per document.  Only words and
bigrams that hold a ``1 / FREQUENT`` share of all tokens each are looked up in place: there
are ``2 * FREQUENT`` of them at most, whatever the corpus, and no shard is burdened by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.store import drop_table, temporary, write_table
from cellgrid.llm.words import Lexer, Words, find_words, mix, slices

MIN_COUNT = 2  # words and bigrams that occur less often are not told apart
DISCOUNT = 0.75
CHUNK_BYTES = 4 << 20  # documents that ask together
COUNT_ENTRIES = 1_000_000  # tokens for each task that adds bigram counts up, on average
SHARD_ENTRIES, CELL_ENTRIES = 1_000_000, 8_000_000  # gains in a model shard; tokens and bigrams asked in a task, both on average
HELD_ENTRIES = 600_000  # sums that a task holds before it sends them on
SENT_ENTRIES = 1 << 17  # sums in a batch of them, on average
FREQUENT = 100_000
BROADCAST_IDS = 500_000  # more target documents than this are joined by a shuffle
BOUNDARY = np.uint64(0x5851F42D4C957F2D)  # fingerprint of what stands between documents
WORDS = Lexer("space", lower=True)


def mark_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and ``target`` (all labels of the document call it good) of every row."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).filter("quality = 1")
    good = write_table(good.select(F.col("doc_id").cast("long").alias("__good")), "target")
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.join(good, F.col("doc_id") == F.col("__good"), "left").select("doc_id", "text", F.col("__good").isNotNull().alias("target"))


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with their summed corpus and target counts, and the carried values of one row each.

    Empties ``parts``: one column after the other is joined and let go, so no second copy of them all is held.
    """
    columns = [list(c) for c in zip(*parts, strict=True)]
    parts.clear()

    def whole(number: int) -> np.ndarray:
        joined = np.concatenate(columns[number])
        columns[number].clear()
        return joined

    keys = whole(0)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    found = [keys[first]]
    del keys
    for number in range(1, len(columns)):
        values = whole(number)
        if number > 2:
            found.append(values[order[first]])
        else:
            found.append(np.add.reduceat(values[order], first, dtype=values.dtype) if len(first) else values)
    return tuple(found)


class _Sums:
    """Running sums by key over the batches of a task; merged whenever the unmerged part has outgrown the rest."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        if len(self) > 2 * len(self.parts[0][0]) + (1 << 19):
            self.parts = [self.get()]

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def get(self) -> tuple[np.ndarray, ...]:
        return _summed(self.parts)


def _counted(batches, keyed, rows):
    """Corpus and target counts of what ``keyed`` finds, summed inside the task, as batches made by ``rows``."""
    sums = _Sums()
    for batch in batches:
        for piece in slices(batch, "text"):
            context, word, doc = sequence(find_words(piece.column("text"), WORDS))
            target = np.asarray(piece.column("target").cast(pa.int8()), np.uint32)[doc]
            keys, *carried = keyed(context, word)
            sums.add(*_summed([(keys, np.ones(len(keys), np.uint32), target, *carried)]))
            if len(sums) > 2 * HELD_ENTRIES:
                found = sums.get()
                sums = _Sums()
                if len(found[0]) > HELD_ENTRIES:
                    yield from rows(*found)
                else:
                    sums.add(*found)
    if sums.parts:
        yield from rows(*sums.get())


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word after it, row) of each token; a document with words is a ring of a boundary and its words."""
    filled = np.flatnonzero(np.diff(words.first) > 0)
    at = words.first[filled]
    context = np.insert(words.hash, at, BOUNDARY)
    return context, np.append(context[1:], BOUNDARY)[: len(context)], np.insert(words.doc, at, filled)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Fingerprint of a bigram."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(word + np.uint64(1)))


@dataclass
class Totals:
    """Index 0 is the corpus (background), 1 the target."""

    symbols: int  # kept words and the symbol for the rest
    tokens: tuple[int, int]
    rest: tuple[int, int]  # tokens of words that are not kept
    kinds: int  # symbols that the target holds

    def unigrams(self, corpus: Column, target: Column) -> tuple[Column, Column]:
        """Probabilities of a symbol with these counts."""
        background = (corpus + 1.0) / F.lit(float(self.tokens[0] + self.symbols))
        if not self.tokens[1]:
            return background, background
        n = float(self.tokens[1])
        return background, F.greatest(target - DISCOUNT, F.lit(0.0)) / n + F.lit(DISCOUNT * self.kinds / n) * background

    def rest_gain(self) -> float:
        """log p(background) - log p(target) of the rest."""
        background = (self.rest[0] + 1.0) / (self.tokens[0] + self.symbols)
        if not self.tokens[1]:
            return 0.0
        target = (max(self.rest[1] - DISCOUNT, 0.0) + DISCOUNT * self.kinds * background) / self.tokens[1]
        return float(np.log(background) - np.log(target))


def count_words(marked: DataFrame) -> tuple[DataFrame, Totals]:
    """((word, corpus, target) of the words that are kept, totals)."""

    def rows(keys: np.ndarray, corpus: np.ndarray, target: np.ndarray):
        for low in range(0, len(keys), 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(corpus[part], pa.int64()), pa.array(target[part], pa.int64())], ["word", "corpus", "target"])

    count = lambda batches: _counted(batches, lambda context, word: (context,), rows)

    counted = marked.mapInArrow(count, "word long, corpus long, target long").groupBy("word").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target"))
    stored = write_table(counted, "unigrams")
    kept = F.col("corpus") >= MIN_COUNT
    total = lambda column, where: F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))
    t = stored.agg(
        F.count_if(kept).alias("kept"), F.count_if(kept & (F.col("target") > 0)).alias("kinds"),
        total("corpus", F.lit(True)).alias("n0"), total("target", F.lit(True)).alias("n1"), total("corpus", ~kept).alias("r0"), total("target", ~kept).alias("r1"),
    ).first()
    return stored.filter(kept), Totals(t["kept"] + 1, (t["n0"], t["n1"]), (t["r0"], t["r1"]), t["kinds"] + (t["r1"] > 0))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys) % np.uint64(shards)).astype(np.int64)


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts the sorted ``keys`` of a shard together and keeps them in order, bounds of the shards)."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, after one byte that says how many."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch of large values, of which only one at a time is copied."""
    for row in range(batch.num_rows):
        yield tuple(c[row].as_py() for c in batch.columns)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def count_pairs(marked: DataFrame, tasks: int) -> DataFrame:
    """(context, word, corpus, target) of the bigrams that occur ``MIN_COUNT`` times."""

    def rows(keys, corpus, target, context, word):
        order, bounds = _by_shard(keys, tasks)
        step = max(1, SENT_ENTRIES * tasks // max(1, len(keys)))
        for low in range(0, tasks, step):
            sent = range(low, min(low + step, tasks))
            cut = [order[bounds[x] : bounds[x + 1]] for x in sent]
            arrays = [[context[x].tobytes() for x in cut], [word[x].tobytes() for x in cut], [_pack(corpus[x]) for x in cut], [_pack(target[x]) for x in cut]]
            yield pa.RecordBatch.from_arrays([pa.array(sent, pa.int32()), *(pa.array(a, pa.binary()) for a in arrays)], ["shard", "context", "word", "corpus", "target"])

    count = lambda batches: _counted(batches, lambda context, word: (pair_key(context, word), context, word), rows)

    def merge(batches):
        held: dict[int, _Sums] = {}
        for batch in batches:
            for shard, *raw in _one_by_one(batch):
                context, word = (np.frombuffer(x, np.uint64) for x in raw[:2])
                if len(context):
                    held.setdefault(shard, _Sums()).add(pair_key(context, word), *map(_unpack, raw[2:]), context, word)
        while held:
            _, corpus, target, context, word = held.popitem()[1].get()
            often = np.flatnonzero(corpus >= MIN_COUNT)
            for low in range(0, len(often), 1 << 16):
                at = often[low : low + (1 << 16)]
                columns = [context[at].view(np.int64), word[at].view(np.int64), corpus[at], target[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["context", "word", "corpus", "target"])

    parts = marked.mapInArrow(count, "shard int, context binary, word binary, corpus binary, target binary").repartitionById(tasks, "shard")
    return write_table(parts.mapInArrow(merge, "context long, word long, corpus long, target long"), "bigrams")


def gains(words: DataFrame, pairs: DataFrame, totals: Totals) -> DataFrame:
    """(context, word, gain, often): what each word (without context) and each stored bigram adds to log p(background) - log p(target).

    A word's gain is that of its unigram and of its back-off as a context, less that of the
    rest; a bigram's is what remains between the models' probabilities and the back-off's.
    Each join's result is written, so that its shuffle files go before the next.
    """
    above = lambda n: F.greatest(F.col(n) - DISCOUNT, F.lit(0.0))
    often = (F.col("corpus") * FREQUENT >= totals.tokens[0]).alias("often")
    with temporary() as keep:
        used = pairs.groupBy("context").agg(F.sum(above("corpus")).alias("s0"), F.sum(above("target")).alias("s1"))
        left = lambda s, n: F.when(F.col(n) > 0, 1 - F.coalesce(F.col(s), F.lit(0.0)) / F.col(n)).otherwise(1.0)
        u0, u1 = totals.unigrams(F.col("corpus"), F.col("target"))
        joined = words.join(used.hint("merge"), words["word"] == used["context"], "left")
        stats = [F.col("corpus").alias("n0"), F.col("target").alias("n1"), left("s0", "corpus").alias("b0"), left("s1", "target").alias("b1"), u0.alias("u0"), u1.alias("u1")]
        symbols = write_table(joined.select("word", *stats, often), "symbols")
        own = symbols.select(F.lit(None).cast("long").alias("context"), "word", (F.ln("b0") - F.ln("b1") + F.ln("u0") - F.ln("u1") - totals.rest_gain()).cast("float").alias("gain"), "often")
        before = symbols.select(F.col("word").alias("context"), "n0", "n1", "b0", "b1").hint("merge")
        odds = lambda count, n, b: F.when(F.col(n) > 0, above(count) / F.col(n) / F.col(b)).otherwise(0.0).cast("float")
        both = write_table(pairs.join(before, "context").select("context", "word", odds("corpus", "n0", "b0").alias("x0"), odds("target", "n1", "b1").alias("x1"), often), "odds")
        pair = both.join(symbols.select("word", "u0", "u1").hint("merge"), "word").select("context", "word", (F.log1p(F.col("x0") / F.col("u0")) - F.log1p(F.col("x1") / F.col("u1"))).cast("float").alias("gain"), "often")
        return keep(write_table(own.unionByName(pair), "gains"))


def _keys(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Fingerprints of the words and bigrams of :func:`gains`."""
    context, word = (np.asarray(table.column(k).fill_null(0), np.int64).view(np.uint64) for k in ("context", "word"))
    return np.where(np.asarray(table.column("context").is_null()), word, pair_key(context, word))


def _look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value of each key or 0, whether it is known)."""
    if not len(known):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = known[at] == keys
    return np.where(found, values[at], 0.0).astype(np.float64), found


@dataclass
class Model:
    table: DataFrame  # (shard, keys, gains) with arrays in order of the keys
    shards: int
    keys: np.ndarray  # the frequent words and bigrams in order, and their gains
    gains: np.ndarray


def fit(marked: DataFrame) -> tuple[Model, Totals]:
    """Gains of all words and bigrams."""
    with temporary() as keep:
        words, totals = count_words(marked)
        pairs = count_pairs(marked, max(1, totals.tokens[0] // COUNT_ENTRIES))
        found = gains(words, pairs, totals)
        drop_table(pairs)
        shards = max(1, found.filter(~F.col("often")).count() // SHARD_ENTRIES)
        frequent = found.filter("often").toArrow()  # 2 * FREQUENT rows at most
        keys = _keys(frequent)
        order = np.argsort(keys)

        schema = pa.schema({"shard": pa.int32(), "key": pa.int64(), "gain": pa.float32()})

        def sharded(batches):
            for batch in batches:
                made = _keys(batch)
                yield pa.RecordBatch.from_arrays([pa.array(_shard(made, shards), pa.int32()), pa.array(made.view(np.int64)), batch.column("gain")], schema.names)

        def arrays(batches):
            held = pa.Table.from_batches(batches, schema)
            shard, made = (held.column(k).to_numpy() for k in ("shard", "key"))
            order = np.lexsort((made.view(np.uint64), shard))
            shard, made, values = shard[order], made[order], held.column("gain").to_numpy()[order]
            for number in np.unique(shard):  # one, as tasks are dealt out by shard
                part = slice(*np.searchsorted(shard, [number, number + 1]))
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x[part].tobytes()], pa.binary()) for x in (made, values))], ["shard", "keys", "gains"])

        rows = found.filter(~F.col("often")).select("context", "word", "gain").mapInArrow(sharded, "shard int, key long, gain float")
        packed = rows.repartitionById(shards, "shard").mapInArrow(arrays, "shard int, keys binary, gains binary")
        table = keep(write_table(packed, "model"))
        return Model(table, shards, keys[order], np.asarray(frequent.column("gain"), np.float32)[order]), totals


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens (words), score (mean loss per token, target minus background, in nats).

    A null or empty text has no tokens and score 0.  Without target documents the target
    model is the background's unigrams.  Rows that repeat are counted and scored singly; a tie cannot arise.
    Very long texts are counted in one task each and never cut.  Empty tables give no rows.
    Other columns are not read, whatever they are called.
    """
    marked = mark_target(docs, labels)
    with temporary() as keep:
        model, totals = fit(marked)
        return _collect(keep(_answers(marked, model, totals)))


def _asked(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints of all words and bigrams in order, row of each, words of each row)."""
    keys, docs, tokens = [], [], []
    row = 0
    for part in slices(piece, "text"):
        words = find_words(part.column("text"), WORDS)
        context, word, doc = sequence(words)
        doc = (doc + row).astype(np.uint32)
        keys += [context, pair_key(context, word)]
        docs += [doc, doc]
        tokens.append(np.diff(words.first))
        row += part.num_rows
    joined, doc = np.concatenate(keys), np.concatenate(docs)
    del keys, docs
    order = np.argsort(joined, kind="stable")
    return joined[order], doc[order], np.concatenate(tokens)


def _answers(marked: DataFrame, model: Model, totals: Totals) -> DataFrame:
    """Sums of gains for documents of a chunk from one shard (``_ANSWER``)."""
    shards, rest = model.shards, totals.rest_gain()
    copies = max(1, 2 * totals.tokens[0] // (shards * CELL_ENTRIES))
    frequent = marked.sparkSession.sparkContext.broadcast((model.keys, model.gains))

    def model_rows(batches):
        for batch in batches:
            for shard, keys, values in _one_by_one(batch):
                for copy in range(copies):
                    yield _rows(_REQUEST, [{"cell": shard * copies + copy, "chunk": -1, "keys": keys, "docs": values}])

    def ask(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", CHUNK_BYTES):
                chunk = (part << 32) | number
                number += 1
                copy = int(mix(np.array([chunk], np.uint64))[0] % np.uint64(copies))
                keys, doc, tokens = _asked(piece)
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
                times, keys = np.diff(np.append(first, len(doc))), keys[first]
                values, known = _look_up(keys, *frequent.value)
                here = np.repeat(known, times)
                base = np.where(tokens > 0, (tokens + 1) * rest, 0.0) + np.bincount(doc[here], np.repeat(values[known], times[known]), len(tokens))
                first, times, keys = first[~known], times[~known], keys[~known]
                order, bounds = _by_shard(keys, shards)
                named = piece.column("doc_id")
                rows = []
                for shard in range(shards):  # the first shard's row also names the documents
                    at = order[bounds[shard] : bounds[shard + 1]]
                    if shard and not len(at):
                        continue
                    n = times[at]
                    where = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    head = {} if shard else {"ids": np.asarray(named.fill_null(0), np.int64).tobytes(), "null_ids": np.asarray(named.is_null()).tobytes(), "tokens": tokens.tobytes(), "base": base.tobytes()}
                    rows.append({"cell": shard * copies + copy, "chunk": chunk, "keys": keys[at].tobytes(), "times": _pack(n), "docs": _pack(doc[where]), **head})
                yield _rows(_REQUEST, rows)

    def answer(batches):
        cell, known, values = None, np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for batch in batches:
            for row in (dict(zip(_REQUEST, r, strict=True)) for r in _one_by_one(batch)):
                if row["cell"] != cell:
                    cell, known, values = row["cell"], np.zeros(0, np.uint64), np.zeros(0, np.float32)
                keys = np.frombuffer(row["keys"], np.uint64)
                if row["chunk"] < 0:  # a cell's model comes before its requests
                    known, values = keys, np.frombuffer(row["docs"], np.float32)
                    continue
                found, _ = _look_up(keys, known, values)
                sums = np.bincount(_unpack(row["docs"]), np.repeat(found, _unpack(row["times"])))
                some = np.flatnonzero(sums)
                yield _rows(_ANSWER, [{"chunk": row["chunk"], "cell": cell, "docs": _pack(some), "sums": sums[some].tobytes(), **{k: row[k] for k in ("ids", "null_ids", "tokens", "base")}}])

    requests = marked.mapInArrow(ask, _ddl(_REQUEST)).unionByName(model.table.mapInArrow(model_rows, _ddl(_REQUEST)))
    cells = requests.repartitionById(shards * copies, F.col("cell").cast("int")).sortWithinPartitions("cell", "chunk")
    return write_table(cells.mapInArrow(answer, _ddl(_ANSWER)), "answers")


def _collect(answers: DataFrame) -> DataFrame:
    """The documents of each chunk from the answers of all shards."""

    def collect(batches):
        held: list[dict] = []
        for batch in batches:
            for row in (dict(zip(_ANSWER, r, strict=True)) for r in _one_by_one(batch)):
                if held and held[0]["chunk"] != row["chunk"]:
                    yield _document_rows(held)
                    held = []
                held.append(row)
        if held:
            yield _document_rows(held)

    return answers.repartition("chunk").sortWithinPartitions("chunk", "cell").mapInArrow(collect, "doc_id long, n_tokens long, score double")


_REQUEST = ["cell", "chunk", "keys", "times", "docs", "ids", "null_ids", "tokens", "base"]
_ANSWER = ["chunk", "cell", "docs", "sums", "ids", "null_ids", "tokens", "base"]


def _ddl(columns: list[str]) -> str:
    return ", ".join(f"{c} {'long' if c in ('cell', 'chunk') else 'binary'}" for c in columns)


def _rows(columns: list[str], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.int64() if c in ("cell", "chunk") else pa.binary()) for c in columns], columns)


def _document_rows(answers: list[dict]) -> pa.RecordBatch:
    (named,) = (a for a in answers if a["ids"] is not None)
    ids, tokens = np.frombuffer(named["ids"], np.int64), np.frombuffer(named["tokens"], np.int64)
    total = np.frombuffer(named["base"], np.float64).copy()
    for a in answers:
        total[_unpack(a["docs"])] += np.frombuffer(a["sums"], np.float64)
    doc_id = pa.array(ids, mask=np.frombuffer(named["null_ids"], bool))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(tokens), pa.array(np.where(tokens > 0, total / (tokens + 1), 0.0))], ["doc_id", "n_tokens", "score"])
