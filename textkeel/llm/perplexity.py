"""Quality rules: word statistics, perplexity bands of an n-gram model, word order.

The byte model is a modified Kneser-Ney model of the bytes of words (each word
padded with a space on both sides), one per language, of order ``ORDER`` whatever
the size. Tasks count n-grams over whole texts, Spark sums the counts, and the
probabilities are made by aggregations and joins (``gram_scores``). The word model
spans two words: a word after its predecessor, smoothed to the word alone and that
to the byte model (Dirichlet priors ``WORD_PRIOR`` and ``PAIR_PRIOR``), a document's own
occurrences left out of every count, as each document is part of the corpus.

No model is broadcast or fetched: documents lie in packed shards (``shards``). A shard
asks for the corpus counts of its distinct words and word pairs and for the scores of
its distinct n-grams, as sorted hash arrays cut in ranges; a range sums the counts or
looks the n-grams up in its part of the score table, and answers in the order sent.

A document's perplexity is the mean over all bytes of all its words. Per language
the band is the median of the log-perplexity minus ``LOWER`` and plus ``UPPER`` robust standard
deviations (quartiles), over the documents that pass the base rules, widened for short texts (by the square root
of 1 + SHORT / words, as a mean of few words varies more); outside it, above or
below, a document is rejected. ``word_gain`` is what the words before tell of the
words, in nats a word: about 0 where words stand in any order. A document is
rejected below ``least_gain``, the median less ``LOWER`` deviations, not widened and
of the lower half (median less lower quartile), as near copies only raise the upper one.

Defined results: null, empty and wordless texts have no words and fail the base;
a null language is a language of its own; where a language's quartiles meet, the
band has a least width; repeated documents get equal results; an empty table
gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import NOT_SPACE, Prefix, U, column_bytes, mix, order_of, row_of, shingles, sums_by_text, word_spans
from .scratch import Scratch, prepare_python
from .shards import Shards, distinct, expand, expand_keys, squeeze, squeeze_keys, told_counts

ORDER = 4
WORD_PRIOR, PAIR_PRIOR = 1000.0, 10.0
#: UPPER is set from the documents of sf0.1 (README): 3 rejects 96 % of texts spaced out with bars and 0.9 % of good ones.
LOWER, UPPER, LEAST_SIGMA, SHORT = 3.0, 3.0, 0.015, 300
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: First bytes of the code points of words.
_BEGINS_WORD_CHAR = NOT_SPACE & ((np.arange(256) & 0xC0) != 0x80)
ASK_ROUNDS, SCORE_ROUNDS = 3, 4
BIN = 0.001

# ------------------------------------------------------------------ base rules


def _within(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a text."""
    return mix(h + rows.astype(U) * U(0x9E3779B97F4A7C15))


def base_columns(data: np.ndarray, offs: np.ndarray, known: tuple | None = None) -> dict[str, np.ndarray]:
    """Per text (``known``: its prefix hashes and word spans): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(offs) - 1
    if known is None:
        known = (Prefix(data), *word_spans(data, offs, NOT_SPACE))
    prefix, starts, ends, words = known
    rows = row_of(words)
    out = {"n_words": np.diff(words), "word_chars": sums_by_text(_BEGINS_WORD_CHAR[data], offs), "n_symbols": sums_by_text(SYMBOLS[data], offs)}
    # lines: between newlines and the ends of texts
    newline = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offs[:-1], newline + 1]))
    line_row = np.searchsorted(offs, begin, "right") - 1
    # begins and ends pair up in order; a newline that ends a text begins an empty line, which never counts
    stop = np.sort(np.concatenate([newline, offs[1:]]))
    first = np.searchsorted(starts, begin)
    holds = (first < starts.size) & (begin < stop)
    holds[holds] = starts[first[holds]] < stop[holds]
    begin, stop, line_row = begin[holds], stop[holds], line_row[holds]
    h = prefix.spans(begin, stop)
    _, one = np.unique(_within(h, line_row), return_index=True)
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[one], minlength=n)
    w = prefix.spans(starts, ends)
    h, _ = shingles(w, words, 3, False)
    at = np.flatnonzero(rows[: max(w.size - 2, 0)] == rows[2:]) if w.size > 2 else np.zeros(0, int)
    h = _within(h, rows[at])
    order = order_of(h)
    same = np.zeros(at.size, bool)
    if at.size > 1:
        twin = h[order][1:] == h[order][:-1]
        same[1:] |= twin
        same[:-1] |= twin
    hit = at[order[same]]
    covered = np.zeros(w.size, bool)
    for k in range(3):
        covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)
    return out


# ---------------------------------------------------------------------- counts


def ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each padded word, but the leading space: the word, the
    length of the longest n-gram that ends there, and its bytes packed."""
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(size.size), size)
    inside = np.arange(size.sum()) - begin[word]
    at = starts[word] + inside - 1
    seq = np.where((inside == 0) | (inside == size[word] - 1), 32, data[np.clip(at, 0, max(data.size - 1, 0))] if data.size else 0).astype(np.int64)
    packed = np.zeros(seq.size, np.int64)
    for m in range(order):
        shifted = np.zeros(seq.size, np.int64)
        shifted[m:] = seq[: seq.size - m]
        packed |= np.where(inside >= m, shifted << (8 * m), 0)
    length = np.minimum(order, inside + 1)
    keep = inside > 0
    return word[keep], length[keep], packed[keep]


def _language_ids(column: pa.Array) -> np.ndarray:
    """A 63-bit hash of each row's language; null is 0."""
    coded = column.dictionary_encode(null_encoding="encode")
    own = [0 if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") >> 1 for x in coded.dictionary.to_pylist()]
    return np.array(own or [0], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


class _Tokens:
    """The words of a shard: ``row`` and ``key`` (even) of each token, and, when ``find_words``
    has been called, the distinct ``word`` keys."""

    def __init__(self, rows: pa.Table, key_bits: int, base: bool = False):
        self.data, self.offs = column_bytes(rows.column("text"))
        prefix = Prefix(self.data)  # eight bytes a byte, so it is let go of as soon as may be
        self.starts, self.ends, self.words = word_spans(self.data, self.offs, NOT_SPACE)
        self.base = base_columns(self.data, self.offs, (prefix, self.starts, self.ends, self.words)) if base else None
        self.row = row_of(self.words).astype(np.int32)
        self.ids = _language_ids(rows.column("lang").combine_chunks())
        self.shift = U(64 - key_bits)
        salt = self.ids.astype(U) * U(0x9E3779B97F4A7C15)
        self.h = mix(prefix.spans(self.starts, self.ends) + salt[self.row])
        del prefix
        self.key = (self.h >> self.shift) & ~U(1)

    def find_words(self) -> None:
        self.word, self.first, self.of_word, self.word_count = distinct(self.key)
        self.lang = self.ids[self.row[self.first]]

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with a word before, and the key (odd) of each with it."""
        at = np.flatnonzero(self.row[1:] == self.row[:-1]) + 1
        return at, (mix(self.h[at - 1] * U(0xD6E8FEB86659FD93) + self.h[at]) >> self.shift) | U(1)

    def languages(self):
        """Keys (even) that stand for all words of a language, the language of each, counts."""
        known, inverse = np.unique(self.ids, return_inverse=True)
        key = (mix(known.astype(U) ^ U(0x1234567F4A7C15)) >> self.shift) & ~U(1)
        return key, known, np.bincount(inverse.ravel(), np.diff(self.words), known.size).astype(np.int64)

    def grams(self, order: int):
        """(language id, distinct words of it, word and key of each of their n-grams)."""
        for x in np.unique(self.lang).tolist():
            pick = np.flatnonzero(self.lang == x)
            word, length, packed = ngrams(self.data, self.starts[self.first[pick]], self.ends[self.first[pick]], order)
            yield x, pick, word, length << 36 | packed


def _gram_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys & ((1 << 36) - 1)) % parts


def _gram_parts(shards: Shards) -> int:
    return max(shards.count // 16, 8) | 1


def send_ngrams(shards: Shards, order: int = ORDER) -> DataFrame:
    """(part, shard, lang, keys, counts): each shard's distinct n-grams and their counts over its tokens. The
    scores it must be told are of these same n-grams, so a shard is gone over once for both."""
    bits, parts = shards.key_bits, _gram_parts(shards)

    def work(shard: int, rows: pa.Table):
        out, tokens = [], _Tokens(rows, bits)
        tokens.find_words()
        for x, pick, word, key in tokens.grams(order):
            keys, _, inverse, _ = distinct(key)
            sums = np.bincount(inverse, tokens.word_count[pick][word], keys.size).astype(np.uint32)
            where = _gram_part(keys, parts)
            out += [(part, shard, x, squeeze_keys(keys[where == part]), squeeze(sums[where == part])) for part in np.unique(where).tolist()]
        if out:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=["part", "shard", "lang", "keys", "counts"])

    return shards.map(work, "part int, shard long, lang long, keys binary, counts binary")


def _sum_ngrams(sent: pa.Table) -> pa.Table:
    """The counts of a part's n-grams over all shards."""
    out = []
    for x in np.unique(sent.column("lang").to_numpy()).tolist():
        own = sent.filter(pc.equal(sent.column("lang"), x))
        keys, _, inverse, _ = distinct(np.concatenate([expand_keys(k) for k in own.column("keys").to_pylist()]))
        counts = np.concatenate([expand(c, np.uint32) for c in own.column("counts").to_pylist()])
        sums = np.bincount(inverse, counts, keys.size).astype(np.int64)
        keys = keys.astype(np.int64)
        out.append(pa.table([pa.array(np.full(keys.size, x)), pa.array((keys >> 36).astype(np.int32)), pa.array(keys & ((1 << 36) - 1)), pa.array(sums)], names=["lang", "n", "gram", "c"]))
    return pa.concat_tables(out)


def count_ngrams(shards: Shards, order: int = ORDER, sent: DataFrame | None = None) -> DataFrame:
    """Counts of (language id, length, n-gram) over all tokens; ``sent``: what ``send_ngrams`` gave, if it is written."""
    sent = send_ngrams(shards, order) if sent is None else sent
    return sent.groupBy("part").applyInArrow(_sum_ngrams, "lang long, n int, gram long, c long")


# ----------------------------------------------------------------------- model


def _discounts(c: np.ndarray) -> np.ndarray:
    n1, n2, n3, n4 = (max(int((c == k).sum()), 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])


def kneser_ney(grams: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> tuple[dict, dict, float]:
    """Of one language: {n: (gram, probability)}, {n: (context, back-off)} and the
    weight of an unseen byte. ``grams``: {n: (gram, count)}; those shorter than
    ``order`` are the ones at the start of a word, which keep their counts."""
    tables, above = {}, None
    for n in range(order, 0, -1):
        g, c = grams.get(n, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        if above is not None:  # continuation counts: distinct bytes before
            suffix, types = np.unique(above & ((1 << (8 * n)) - 1), return_counts=True)
            g, c = np.concatenate([g, suffix]), np.concatenate([c, types])
            g, inverse = np.unique(g, return_inverse=True)
            c = np.bincount(inverse.ravel(), c, g.size).astype(np.int64)
        else:
            at = np.argsort(g)
            g, c = g[at], c[at]
        tables[n], above = (g, c), g
    probability, backoff, lower, unseen = {}, {}, None, 1.0
    for n in range(1, order + 1):
        g, c = tables[n]
        d = _discounts(c)[np.minimum(c, 3)]
        context, inverse = np.unique(g >> 8, return_inverse=True)
        inverse = inverse.ravel()
        total = np.bincount(inverse, c, context.size)
        gamma = np.bincount(inverse, np.minimum(d, c), context.size) / np.maximum(total, 1)
        if n == 1:
            unseen = float(gamma[0]) / 257 if gamma.size else 1 / 257
            base = np.full(g.size, 1 / 257)
        else:
            base = lower[1][np.searchsorted(lower[0], g & ((1 << (8 * (n - 1))) - 1))]
        p = np.maximum(c - d, 0) / np.maximum(total, 1)[inverse] + gamma[inverse] * base
        lower = (g, p)
        probability[n], backoff[n] = (g, p), (context, gamma)
    return probability, backoff, unseen


def gram_scores(counts: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """Table of (lang, n, gram, p): ``kneser_ney``'s log-probability of the last byte
    of every counted n-gram, by joins instead of in memory."""
    tables, above = {}, None
    for n in range(order, 0, -1):
        t = counts.filter(F.col("n") == n).select("lang", "gram", "c")
        if above is not None:
            t = t.unionByName(above.groupBy("lang", F.expr(f"gram & {(1 << (8 * n)) - 1}L").alias("gram")).agg(F.count("*").alias("c")))
            t = t.groupBy("lang", "gram").agg(F.sum("c").alias("c"))
        tables[n] = above = scratch.save(f"order{n}", t)
    done, lower = None, None
    for n in range(1, order + 1):
        t = tables[n]
        n1, n2, n3, n4 = (F.greatest(F.count_if(F.col("c") == k), F.lit(1)) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        clip = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
        cut = t.groupBy("lang").agg(clip(1 - 2 * y * n2 / n1, 0.05, 0.95).alias("d1"), clip(2 - 3 * y * n3 / n2, 0.1, 1.9).alias("d2"), clip(3 - 4 * y * n4 / n3, 0.15, 2.85).alias("d3"))
        t = t.join(cut, "lang").withColumn("d", F.expr("CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"))
        t = t.select("lang", "gram", "c", "d", F.expr("gram >> 8").alias("context"))
        sums = t.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum(F.least("d", "c")).alias("mass"))
        t = t.join(sums, ["lang", "context"])
        base = F.lit(1 / 257)
        if lower is not None:
            t = t.withColumn("suffix", F.expr(f"gram & {(1 << (8 * (n - 1))) - 1}L"))
            t = t.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("q").alias("base")), ["lang", "suffix"])
            base = F.col("base")
        q = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("mass") / F.col("total") * base
        lower = scratch.save(f"scores{n}", t.select("lang", F.lit(n).alias("n"), "gram", q.alias("q")))
        done = lower if done is None else done.unionByName(lower)
    return done.select("lang", "n", "gram", F.log("q").cast("float").alias("p"))


# --------------------------------------------------- what a shard asks and is told


def _count_keys(rows: pa.Table, key_bits: int, low: int = 0, high: int = 1 << 63) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of languages, words and pairs from ``low`` to below ``high``, and their counts."""
    tokens = _Tokens(rows, key_bits)
    _, pair = tokens.pair_keys()
    keys = np.concatenate([x[(x >= U(low)) & (x < U(high))] for x in (tokens.key, pair)])
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, int)
    keys, counts = keys[at], np.diff(np.append(at, keys.size))
    lang, _, words = tokens.languages()
    inside = (lang >= U(low)) & (lang < U(high))
    for x, n in zip(lang[inside], words[inside]):  # a few
        at = np.searchsorted(keys, x)
        if at < keys.size and keys[at] == x:
            counts[at] += n
        else:
            keys, counts = np.insert(keys, at, x), np.insert(counts, at, n)
    return keys, counts


def _find_scores(asked: pa.Table, scores: pa.Table) -> pa.Table:
    """The scores of a part's n-grams, to each shard in the order sent."""
    lang, key = scores.column("lang").to_numpy(), scores.column("n").to_numpy().astype(np.int64) << 36 | scores.column("gram").to_numpy()
    p, own = scores.column("p").to_numpy().astype(np.float32), {}
    for x in np.unique(lang).tolist():
        at = np.flatnonzero(lang == x)
        at = at[np.argsort(key[at])]
        own[x] = key[at], p[at]
    told = [squeeze(own[x][1][np.searchsorted(own[x][0], expand_keys(keys).astype(np.int64))]) for x, keys in zip(asked.column("lang").to_pylist(), asked.column("keys").to_pylist())]
    return pa.table([*(asked.column(c) for c in ("shard", "part", "lang")), pa.array(told, pa.binary())], names=["shard", "part", "lang", "told"])


_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _own(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in its text."""
    _, _, inverse, counts = distinct(_within(keys, rows))
    return counts[inverse]


def _score(rows: pa.Table, reply: pa.Table, carried, parts: int, order: int, key_bits: int) -> list[pa.Array]:
    tokens = _Tokens(rows, key_bits, base=True)
    tokens.find_words()
    r, n, base = tokens.row, rows.num_rows, tokens.base
    counted = reply.filter(pc.is_null(reply.column("lang")))
    two, pair = tokens.pair_keys()
    pair, _, of_pair, _ = distinct(pair)
    lang, known, _ = tokens.languages()
    _, _, inverse, _ = distinct(np.concatenate([tokens.word, pair, lang]))
    sums = told_counts(counted)[inverse].astype(np.int64)
    c_word, c_pair, c_lang = np.split(sums, [tokens.word.size, tokens.word.size + pair.size])
    own_pair = _own(r[two], pair[of_pair])
    both = c_pair[of_pair] - own_pair
    del inverse, sums, pair, of_pair, own_pair
    # log-probability of each distinct word by its bytes
    told: dict[int, list] = {}
    scored = reply.filter(pc.is_valid(reply.column("lang"))).sort_by("part")
    for x, blob in zip(scored.column("lang").to_pylist(), scored.column("told").to_pylist()):
        told.setdefault(x, []).append(expand(blob, np.float32))
    log_word = np.zeros(tokens.word.size)
    for x, pick, word, key in tokens.grams(order):
        keys, _, of_key, _ = distinct(key)
        p = np.zeros(keys.size)
        p[np.argsort(_gram_part(keys, parts), kind="stable")] = np.concatenate(told[x])
        log_word[pick] = np.bincount(word, p[of_key], pick.size)
    logs, sizes = log_word[tokens.of_word], tokens.ends - tokens.starts + 1
    many = np.diff(tokens.words)
    # words alone, then after the word before, less the document's own occurrences
    c = c_word[tokens.of_word] - _own(r, tokens.h)
    total = np.maximum(c_lang[np.searchsorted(known, tokens.ids)] - many, 0)[r]
    alone = (c + WORD_PRIOR * np.exp(logs)) / (total + WORD_PRIOR)
    after = (both + PAIR_PRIOR * alone[two]) / (c[two - 1] + PAIR_PRIOR)
    gain = np.bincount(r[two], np.log(after / alone[two]), n) / np.maximum(many, 1)
    size = np.bincount(r, sizes, n)
    ppl = np.where(size > 0, -np.bincount(r, logs, n) / np.maximum(size, 1), np.nan)
    return [*(rows.column(k) for k in carried), *(pa.array(base[k].astype(np.int64)) for k in _NUMBERS), pa.array(ppl, from_pandas=True), pa.array(np.where(many > 0, gain, np.nan), from_pandas=True)]


def _quartiles(rows: DataFrame, column: str) -> DataFrame:
    """(__lang, q): lower quartile, median and upper quartile of each language, by counts in
    bins of ``BIN``, so they are the same however the rows are dealt, unlike those of a sketch."""
    bins = rows.filter(F.col(column).isNotNull()).groupBy(F.col("lang").alias("__lang"), F.floor(F.col(column) / BIN).alias("bin")).agg(F.count("*").alias("n"))
    of_lang = W.partitionBy("__lang")  # of bins, at most some ten thousand a language
    bins = bins.withColumns({"upto": F.sum("n").over(of_lang.orderBy("bin")), "all": F.sum("n").over(of_lang)})
    value = lambda share: F.min(F.when(F.col("upto") >= share * F.col("all"), (F.col("bin") + 0.5) * BIN))
    return bins.groupBy("__lang").agg(F.array(*[value(x) for x in (0.25, 0.5, 0.75)]).alias("q"))


def score_shards(shards: Shards, scratch: Scratch, carry: tuple[str, ...] = ("doc_id", "lang"), order: int = ORDER) -> DataFrame:
    """Per row: shard, pos, and the columns of ``quality_rules``."""
    spark, bits = shards.spark, shards.key_bits
    sent, parts = scratch.save("sent", send_ngrams(shards, order)), _gram_parts(shards)
    counts = scratch.save("counts", count_ngrams(shards, order, sent))
    scores = gram_scores(counts, scratch, order).withColumn("part", F.pmod("gram", F.lit(parts)).cast("int"))
    told = scratch.save("scores", sent.drop("counts").groupBy("part").cogroup(scores.groupBy("part")).applyInArrow(_find_scores, "shard long, part int, lang long, told binary"))
    counted = shards.count_keys(lambda rows, *within: _count_keys(rows, bits, *within), "counted", ASK_ROUNDS)
    reply = counted.withColumn("lang", F.lit(None).cast("long")).unionByName(told)
    carried = [shards.schema[c] for c in carry]
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("pos", T.LongType()), *carried] + [T.StructField(c, T.LongType()) for c in _NUMBERS] + [T.StructField(c, T.DoubleType()) for c in ("log_ppl", "word_gain")])

    def work(rows: pa.Table, reply: pa.Table, shard: int) -> pa.Table:
        place = (pa.array(np.full(rows.num_rows, shard, np.int64)), pa.array(np.arange(rows.num_rows)))
        return pa.table([*place, *_score(rows, reply, carry, parts, order, bits)], names=schema.fieldNames())

    scored = shards.answer(reply, work, schema, "scored", SCORE_ROUNDS)
    for name in ("sent", "counts", "scores", *(f"counted{k}" for k in range(ASK_ROUNDS)), *(f"{x}{n}" for x in ("order", "scores") for n in range(1, order + 1))):
        scratch.drop(name)
    prepare_python(spark)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    q, g = (_quartiles(scored.filter("NOT base_failed"), c) for c in ("log_ppl", "word_gain"))
    sigma = lambda c: F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(LEAST_SIGMA))
    both = q.withColumnRenamed("q", "p").join(g.withColumnsRenamed({"__lang": "__l", "q": "g"}), F.col("__lang").eqNullSafe(F.col("__l")))
    bands = scratch.save("bands", both.select("__lang", F.col("p")[1].alias("middle"), sigma("p").alias("sigma"), F.col("g")[1].alias("middle_gain"), F.greatest((F.col("g")[1] - F.col("g")[0]) / 0.6745, F.lit(LEAST_SIGMA)).alias("sigma_gain")))
    out = scored.join(bands, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    wide = F.col("sigma") * F.sqrt(1 + F.lit(SHORT) / F.greatest("n_words", F.lit(1)))
    out = out.withColumns({"lower": F.col("middle") - LOWER * wide, "upper": F.col("middle") + UPPER * wide, "least_gain": F.col("middle_gain") - LOWER * F.col("sigma_gain")})
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")) & (F.col("word_gain") >= F.col("least_gain")), F.lit(False))
    made = [(~F.col("base_failed") & inside).alias("kept"), F.exp("log_ppl").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"), "word_gain", "least_gain"]
    return out.select("shard", "pos", *carry, *_NUMBERS, "base_failed", *made)


def quality_rules(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document of ``docs`` (doc_id, lang, text): doc_id, lang, the base columns, perplexity,
    lower, upper, word_gain, least_gain, base_failed and kept."""
    scratch = Scratch(docs.sparkSession, "quality_rules")
    shards = Shards(docs.select("doc_id", "lang", "text"), scratch)
    out = score_shards(shards, scratch, order=order).drop("shard", "pos")
    shards.drop()
    return out


def op5_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
