"""Benchmark decontamination over a stored, distributed positional inverted index.

The index is a written table, partitioned by document: a row holds the postings of a
shard of documents, every term of theirs in hash order with the ascending places of
its words, as compressed differences. It is built once from the training texts and
can be searched for any number of benchmarks (``build_index``, ``search_index``);
only postings of terms are read then, no text.

A test window is answered from its rarest term, by counts over the whole index: that
term's places, less its offset in the window, are the candidates, and each further
term, rarest first, keeps those whose offset-adjusted place a binary search finds in
its own list. What is left are exact phrase matches; for proximity matches every
further term may stand up to ``SLACK`` words from there.

The test items are the query set. They are split in blocks of a fixed number of
bytes, and every block is answered against all rows; the driver holds and sends out
one block's terms and windows (a bounded size) at a time.

Defined results: null or wordless texts have no words and no hits; null or
wordless items have no windows; equal items all count, a repeated item_id
counts once; repeated documents give repeated results; an empty benchmark hits
nothing. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import ALNUM, LOWER, Prefix, column_bytes, pieces, word_spans
from .scratch import Scratch, prepare_python
from .shards import Shards, distinct, expand, expand_keys, squeeze, squeeze_keys

WINDOW = 8
SLACK = 2
BLOCK_BYTES = 8 << 20
MIN_ITEMS = 2


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts and the word offsets of each text."""
    data = LOWER[data]
    starts, ends, words = word_spans(data, offs, ALNUM)
    return Prefix(data).spans(starts, ends), words


# ----------------------------------------------------------------------- index

_INDEX = "shard long, ids array<long>, words binary, terms binary, counts binary, places binary"


def _postings(shard: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    h, words = hashed_words(*column_bytes(texts))
    terms, _, term, counts = distinct(h)
    # term-major, places ascending: one ascending sequence
    places = np.sort(term.astype(np.int64) * max(h.size, 1) + np.arange(h.size))
    blobs = (squeeze(np.diff(words).astype(np.uint32)), squeeze_keys(terms), squeeze(counts.astype(np.uint32)), squeeze_keys(places))
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), ids, *(pa.array([b], pa.binary()) for b in blobs)], names=[c.split()[0] for c in _INDEX.split(", ")])


def build_index(shards: Shards, scratch: Scratch) -> DataFrame:
    """The index of the rows of ``shards`` (``doc_id`` and ``text`` among their columns)."""

    def work(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield _postings(shard, rows.column("doc_id").combine_chunks(), rows.column("text").combine_chunks())

    index = shards.map(work, _INDEX)
    index.write.options(compression="uncompressed", **{"parquet.block.size": str(8 << 20)}).parquet(scratch.path("index"))
    return shards.spark.read.schema(index.schema).parquet(scratch.path("index"))


class _Lists:
    """Of one index row: the list of each term of a vocabulary."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        many = expand(row["words"], np.uint32).astype(np.int64)
        self.offs = np.concatenate([[0], np.cumsum(many)])
        self.size = max(int(self.offs[-1]), 1)
        terms, counts = expand_keys(row["terms"]), expand(row["counts"], np.uint32).astype(np.int64)
        self.places = expand_keys(row["places"]).astype(np.int64)
        self.term, known = _find(terms, vocabulary)
        start = np.cumsum(counts) - counts
        self.start = np.where(known, start[self.term] if terms.size else 0, 0)
        self.count = np.where(known, counts[self.term] if terms.size else 0, 0)

    def near(self, term: np.ndarray, place: np.ndarray, doc: np.ndarray, slack: int) -> np.ndarray:
        """Does a vocabulary term stand within ``slack`` of a place of that document?"""
        low, high = np.maximum(place - slack, self.offs[doc]), np.minimum(place + slack, self.offs[doc + 1] - 1)
        base = self.term[term] * self.size
        at = np.minimum(np.searchsorted(self.places, base + low), self.places.size - 1)
        found = self.places[at]
        return (self.count[term] > 0) & (low <= high) & (found >= base + low) & (found <= base + high)


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(values, wanted)
    at[at == values.size] = 0
    return at, values[at] == wanted if values.size else np.zeros(wanted.size, bool)


# --------------------------------------------------------------------- windows


class Windows:
    """Windows of a block of items: term ids in ``terms`` (-1 past the end of a short one)."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int = WINDOW):
        self.width = width
        rows, items = [], []
        terms: list[np.ndarray] = []
        for _, _, data, offs in pieces(pa.array(texts, pa.string()), 1 << 40):
            h, words = hashed_words(data, offs)
            for i in range(len(words) - 1):
                own = h[words[i] : words[i + 1]]
                if own.size:
                    pad = np.concatenate([own, np.zeros(max(0, width - own.size), np.uint64)])
                    n = max(1, own.size - width + 1)
                    rows.append(np.lib.stride_tricks.sliding_window_view(pad, width)[:n])
                    items.append(np.full(n, i))
                    terms.append(np.full(n, min(width, own.size)))
        self.ids = ids
        self.length = np.concatenate(terms) if terms else np.zeros(0, int)
        item = np.concatenate(items) if items else np.zeros(0, int)
        hashes = np.concatenate(rows) if rows else np.zeros((0, width), np.uint64)
        self.vocabulary = np.unique(hashes[np.arange(width)[None, :] < self.length[:, None]])
        self.terms = np.searchsorted(self.vocabulary, hashes).astype(np.int64)
        self.terms[np.arange(width)[None, :] >= self.length[:, None]] = -1
        # equal windows are searched once; each keeps the items that have it
        key = np.concatenate([self.terms, self.length[:, None]], axis=1)
        _, first, self.group = np.unique(key, axis=0, return_index=True, return_inverse=True)
        self.group = self.group.ravel()
        self.terms, self.length = self.terms[first], self.length[first]
        self.owner = np.unique(np.stack([self.group, item], axis=1), axis=0) if item.size else np.zeros((0, 2), int)
        self.order = np.tile(np.arange(width), (self.terms.shape[0], 1))

    def rank(self, counts: np.ndarray) -> None:
        """Order each window's terms by their counts over the whole index, rarest first."""
        used = self.terms >= 0
        freq = np.where(used, counts[np.where(used, self.terms, 0)] if counts.size else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(freq, axis=1, kind="stable")

    def match(self, lists: _Lists, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, place of its first word, document, exact) of every match."""
        used = self.terms >= 0
        there = (~used | (lists.count[np.where(used, self.terms, 0)] > 0)).all(axis=1) if self.terms.size and lists.count.size else np.zeros(self.length.size, bool)
        live = np.flatnonzero(there)
        rare = self.order[live, 0]
        term = self.terms[live, rare]
        many = lists.count[term] if live.size else np.zeros(0, int)
        w = np.repeat(np.arange(live.size), many)
        within = np.arange(w.size) - np.repeat(np.cumsum(many) - many, many)
        anchor = lists.places[lists.start[term][w] + within] - (lists.term[term] * lists.size)[w] if w.size else np.zeros(0, np.int64)
        begin = anchor - rare[w]
        doc = np.searchsorted(lists.offs, anchor, "right") - 1
        exact = (begin >= lists.offs[doc]) & (begin + self.length[live][w] <= lists.offs[doc + 1])
        if not slack:
            w, begin, doc, exact = w[exact], begin[exact], doc[exact], exact[exact]
        for k in range(1, self.width):
            if not w.size:
                break
            col = self.order[live[w], k]
            want = self.terms[live[w], col]
            there = want < 0
            wanted = np.where(there, 0, want)
            hit = there | lists.near(wanted, begin + col, doc, slack)
            if slack:
                exact = exact & (there | lists.near(wanted, begin + col, doc, 0))
            w, begin, doc, exact = w[hit], begin[hit], doc[hit], exact[hit]
        return live[w], begin, doc, exact

    def items_of(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``window``, item) of every item that has one."""
        lo, hi = np.searchsorted(self.owner[:, 0], window), np.searchsorted(self.owner[:, 0], window, "right")
        many = hi - lo
        r = np.repeat(np.arange(window.size), many)
        return r, self.owner[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(r.size), 1]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Windows]:
    """Items in blocks of bounded bytes, fetched partition by partition."""
    ids: list[int] = []
    texts: list[str | None] = []
    held = 0
    for row in items.select("item_id", "text").dropDuplicates().toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        held += len(row.text or "") + 16
        if held >= block_bytes:
            yield Windows(ids, texts)
            ids, texts, held = [], [], 0
    yield Windows(ids, texts)


def _ranked(index: DataFrame, windows: Windows) -> Windows:
    """``windows`` with the corpus counts of its terms; they are no more than the block's words."""
    sent = index.sparkSession.sparkContext.broadcast(windows.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sent.value.size, np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                at, known = _find(expand_keys(terms), sent.value)
                counts = expand(counts, np.uint32)
                total[known] += counts[at[known]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    found = index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(windows.vocabulary.size, np.int64)
    counts[found.column("term").to_numpy()] = found.column("n").to_numpy()
    windows.rank(counts)
    sent.destroy()
    return windows


_HITS = "shard long, pos long, doc_id long, n_words long, hits binary, items array<string>, near array<string>"


def _search(block, slack: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows: Windows = block.value
    for batch in batches:
        for row in batch.to_pylist():
            lists = _Lists(row, windows.vocabulary)
            found, begin, doc, exact = windows.match(lists, slack)
            covered = np.zeros(lists.offs[-1] + 1, np.int64)
            np.add.at(covered, begin[exact], 1)
            np.add.at(covered, begin[exact] + windows.length[found[exact]], -1)
            hit = np.cumsum(covered[:-1]) > 0
            n = len(row["ids"])
            items, near = [[] for _ in range(n)], [[] for _ in range(n)]
            for to, which in ((items, exact), (near, np.ones(exact.size, bool))):
                pair = np.unique(np.stack([doc[which], found[which]], axis=1), axis=0) if found.size else np.zeros((0, 2), int)
                r, item = windows.items_of(pair[:, 1])
                for d, i in np.unique(np.stack([pair[r, 0], item], axis=1), axis=0).tolist() if r.size else []:
                    if windows.ids[i] is not None:
                        to[d].append(str(windows.ids[i]))
            bits = [b""] * n
            for d in np.unique(doc[exact]).tolist():
                bits[d] = np.packbits(hit[lists.offs[d] : lists.offs[d + 1]]).tobytes()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()))
            columns = (np.full(n, row["shard"]), np.arange(n), row["ids"], np.diff(lists.offs), bits, items, near)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _HITS.split(", ")])


def search_index(index: DataFrame, items: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, slack: int = SLACK) -> DataFrame:
    """Per row of the index: shard, pos, doc_id, n_words, n_hit, n_items, items (sorted
    ids), n_near (items with a proximity match, exact ones among them), contaminated."""
    spark = index.sparkSession
    prepare_python(spark, 2)  # rows are shards
    answers = []
    for block in item_blocks(items, block_bytes):
        sent = spark.sparkContext.broadcast(_ranked(index, block))
        search = lambda batches, sent=sent: _search(sent, slack, batches)
        answers.append(scratch.save(f"answers{len(answers)}", index.mapInArrow(search, _HITS)))
        sent.destroy()
    out = answers[0]
    if len(answers) > 1:  # the hit words of a document are those of any block
        every = reduce(DataFrame.unionAll, answers).groupBy("shard", "pos")
        out = every.agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list(F.when(F.length("hits") > 0, F.col("hits"))).alias("all"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "near")))
        out = out.mapInArrow(_any_bit, _HITS)
    prepare_python(spark)
    # set bits of a hex string, four to a digit
    ones = "hex(hits)"
    for digits, mark in (("[1248]", "x"), ("[3569AC]", "xx"), ("[7BDE]", "xxx"), ("F", "xxxx"), ("0", "")):
        ones = f"regexp_replace({ones}, '{digits}', '{mark}')"
    sorted_items = F.array_sort(F.array_distinct("items"))
    made = [F.length(F.expr(ones)).cast("long").alias("n_hit"), F.size(sorted_items).cast("long").alias("n_items"), sorted_items.alias("items")]
    return out.select("shard", "pos", "doc_id", "n_words", *made, F.size(F.array_distinct("near")).cast("long").alias("n_near"), (F.size(sorted_items) >= MIN_ITEMS).alias("contaminated"))


def _any_bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        merged = []
        for parts in batch.column("all").to_pylist():
            size = max((len(p) for p in parts), default=0)
            total = np.zeros(size, np.uint8)
            for p in parts:
                total |= np.frombuffer(p, np.uint8)
            merged.append(total.tobytes())
        kept = ("shard", "pos", "doc_id", "n_words")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(merged, pa.binary()), batch.column("items"), batch.column("near")], names=[*kept, "hits", "items", "near"])


def find_benchmark_words(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, slack: int = SLACK) -> DataFrame:
    """``search_index`` of an index of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "decontam")
    shards = Shards(docs.select("doc_id", "text"), scratch)
    index = build_index(shards, scratch)
    shards.drop()
    out = search_index(index, items, scratch, block_bytes, slack).drop("shard", "pos")
    scratch.drop("index")
    return out


def phrase_matches(index: DataFrame, items: DataFrame, slack: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All matches: doc_id, item_id, first word in the document; with ``slack``, proximity matches."""
    spark = index.sparkSession
    prepare_python(spark, 2)
    out = []
    for block in item_blocks(items, block_bytes):
        sent = spark.sparkContext.broadcast(_ranked(index, block))

        def places(batches, sent=sent):
            windows = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    lists = _Lists(row, windows.vocabulary)
                    found, begin, doc, _ = windows.match(lists, slack)
                    r, item = windows.items_of(found)
                    columns = ([row["ids"][d] for d in doc[r].tolist()], [windows.ids[i] for i in item.tolist()], (begin - lists.offs[doc])[r])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "first_word"])

        out.append(index.mapInArrow(places, "doc_id long, item_id long, first_word long"))
    return reduce(DataFrame.unionAll, out)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = find_benchmark_words(docs, items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")
