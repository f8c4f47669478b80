"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct five-word shingles; two documents link at a
Jaccard similarity of 0.75 or more. Exact, in these steps:

1. Every shingle is counted over the corpus, exactly. Shingles are ordered rarest first
   (count, then hash), and only those of a set's prefix (the first
   ``n - ceil(0.75 n) + 1``) that occur more than once are indexed.
2. Documents with equal sets are one node. Nodes with the same least hash are
   compared with the leaders of their (salted) group, and a node that links to a
   leader joins its star: a highly similar set whose answers are derived. Leaders
   are gathered once more by a second hash, so a large group has few of them.
3. Index lists are cut in blocks, one a star, that keep the least and largest set
   size and the most shingles left after the list's position. Two blocks are
   skipped if even those bounds cannot reach the overlap; for the others the
   leaders' overlap is computed, and linked stars become one component.
4. What can still link nodes of different components are members of unskipped
   blocks. A member's overlap with another is bounded from its leaders' computed
   overlap and its differences on the way to its leader. The bound is a sum of one
   term a leader pair and one a member, so the greatest term of a star rules out
   star pairs, then members; only pairs that the bound allows are compared.

Components, not pairs, are the result, so pairs already connected are never
enumerated. Shingles are 64-bit hashes.

Defined results: null, empty and wordless texts have an empty set and link with
nothing; a null id takes part but never names a component (a component of null
ids only has a null id); repeated rows share a node. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import LOWER, NOT_SPACE, Prefix, U, mix, pieces, shingles, word_spans
from .components import components
from .scratch import Scratch, partitions_for, prepare_python
from .shards import Shards, told_counts

WORDS = 5
NUM, DEN = 75, 100
STAR_SALT_ROWS = 400
BLOCK = 256


def required(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of sets of n and m that link: 100 i >= 75 (n + m - i)."""
    s = np.asarray(n) + np.asarray(m)
    return -(-NUM * s // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _sets(texts: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    for at, to, data, offs in pieces(texts):
        data = LOWER[data]
        starts, ends, words = word_spans(data, offs, NOT_SPACE)
        h, rows = shingles(Prefix(data).spans(starts, ends), words, WORDS, True)
        cut = np.searchsorted(rows, np.arange(to - at + 1))
        for i in range(to - at):
            s = np.sort(h[cut[i] : cut[i + 1]])
            yield s[np.append(True, s[1:] != s[:-1])] if s.size else s


def _keys(rows: pa.Table, shift: U) -> tuple[np.ndarray, np.ndarray]:
    """Keys are the upper bits of hashes, so they ascend as hashes do."""
    parts = [x >> shift for x in _sets(rows.column("text"))]
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, U), np.zeros(0, int))


_SETS = "shard long, pos long, doc_id long, n long, node long, least long, least2 long, prefix binary, tokens binary"


def _describe(rows: pa.Table, reply: pa.Table, shard: int, shift: U) -> pa.Table:
    """A row a document; the first of each set in the shard, if it has an indexed
    shingle, carries its prefix (token, position) and all its tokens."""
    (keys, _), counts = _keys(rows, shift), told_counts(reply)
    n, node, least, least2, prefix, tokens, seen = [], [], [], [], [], [], set()
    for s in _sets(rows.column("text")):
        name = int((mix(s).sum(dtype=U) ^ U(s.size)).astype(np.int64))
        n.append(s.size)
        node.append(name)
        low, low2, p, t = 0, 0, None, None
        if s.size and name not in seen:
            seen.add(name)
            c = counts[np.searchsorted(keys, s >> shift)]
            common = c.max() > 1
            order = np.argsort(c, kind="stable")[: prefix_length(s.size)] if common else None
            at = np.flatnonzero(c[order] > 1) if common else np.zeros(0, int)
            if at.size:
                low, low2 = (int(mix(s + U(salt)).min().astype(np.int64)) for salt in (77, 7777))
                p = s[order[at]].tobytes() + at.astype("<u4").tobytes()
                t = s.tobytes()
        least.append(low)
        least2.append(low2)
        prefix.append(p)
        tokens.append(t)
    made = (pa.array(x, pa.int64()) for x in (np.full(len(n), shard), np.arange(len(n))))
    return pa.table([*made, rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, node, least, least2)), *(pa.array(x, pa.binary()) for x in (prefix, tokens))], names=[x.split()[0] for x in _SETS.split(", ")])


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = list(batches)
    return pa.Table.from_batches(got) if got else None


def _as_set(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, U)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two ascending distinct arrays."""
    if x.size > y.size:
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == y.size] = 0
    return int((y[at] == x).sum()) if y.size else 0


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each (least, salt) group, link nodes to the first leader they link with."""
    rows = _whole(batches)
    names = ["node", "leader", "n", "shared"]
    out: list[tuple] = []
    if rows is not None and rows.num_rows:
        rows = rows.sort_by([("least", "ascending"), ("salt", "ascending"), ("n", "ascending"), ("node", "ascending")])
        least, salt, node, n = (rows.column(k).to_numpy() for k in ("least", "salt", "node", "n"))
        tokens = rows.column("tokens").combine_chunks()
        edge = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (salt[1:] != salt[:-1]), [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            leaders: list[tuple[int, np.ndarray]] = []
            for i in range(a, b):
                s = _as_set(tokens[i].as_py())
                for name, other in leaders:
                    need = required(s.size, other.size)
                    if min(s.size, other.size) >= need and (shared := overlap(other, s)) >= need:
                        out.append((int(node[i]), name, s.size, shared))
                        break
                else:
                    leaders.append((int(node[i]), s))
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


_POSTS = "part int, token binary, node binary, leader binary, n binary, pos binary, root binary"


def _post(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a task, packed by token range."""
    token, node, leader, n, pos, root = [], [], [], [], [], []
    for batch in batches:
        for p, *own in zip(batch.column("prefix"), *(batch.column(k).to_pylist() for k in ("node", "leader", "n", "root")), strict=True):
            blob = p.as_py()
            k = len(blob) // 12
            token.append(np.frombuffer(blob, "<u8", k))
            pos.append(np.frombuffer(blob, "<u4", k, 8 * k))
            for to, value in zip((node, leader, n, root), own, strict=True):
                to.append(np.full(k, value, np.int64))
    if not token:
        return
    arrays = [np.concatenate(x) for x in (token, node, leader, n, pos, root)]
    arrays[3], arrays[4] = arrays[3].astype(np.int32), arrays[4].astype(np.int32)
    part = (arrays[0] >> U(32)).astype(np.int64) * parts >> 32
    order = np.argsort(part, kind="stable")
    ids, first = np.unique(part[order], return_index=True)
    cuts = [np.split(x[order], first[1:]) for x in arrays]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in cuts)], names=[x.split()[0] for x in _POSTS.split(", ")])


def _lists(rows: pa.Table) -> list[np.ndarray]:
    kinds = (U, np.int64, np.int64, np.int32, np.int32, np.int64)
    return [np.concatenate([np.frombuffer(x, k) for x in rows.column(c).to_pylist()]) for c, k in zip(("token", "node", "leader", "n", "pos", "root"), kinds, strict=True)]


def _pairs_in_lists(token: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of blocks of one list, by distance. Blocks ascend by token
    and least size, so one is done at the first block too large for it, and one
    whose position leaves too little for a set of its own size or more never starts."""
    live, d = np.flatnonzero(left >= required(lo, lo)), 1
    while live.size:
        live = live[live + d < token.size]
        live = live[(token[live] == token[live + d]) & (NUM * lo[live + d] <= DEN * hi[live])]
        if live.size:
            yield live, live + d
        d += 1


def _blocks(token, group, n, pos):
    """One block per (token, group): its bounds, and the block of each posting."""
    order = np.lexsort((group, token))
    t, g = token[order], group[order]
    at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])]))
    size, left = n[order].astype(np.int64), (n - pos)[order].astype(np.int64)
    lo, hi, rest = np.minimum.reduceat(size, at), np.maximum.reduceat(size, at), np.maximum.reduceat(left, at)
    end = np.append(at[1:], token.size)
    by = np.lexsort((lo, t[at]))
    return order, at[by], end[by], t[at][by], g[at][by], lo[by], hi[by], rest[by]


def _possible(lo1, hi1, left1, lo2, hi2, left2) -> np.ndarray:
    """Can some sets of two blocks link? The overlap is at most what is left after
    the list's position in either, and sizes must be within 3:4."""
    sizes = (DEN * hi1 >= NUM * lo2) & (DEN * hi2 >= NUM * lo1)
    return sizes & (np.minimum(left1, left2) >= required(np.maximum(lo1, -(-NUM * lo2 // DEN)), np.maximum(lo2, -(-NUM * lo1 // DEN))))


def _leader_pairs(rows: pa.Table) -> pa.Table:
    token, _, leader, n, pos, _ = _lists(rows)
    found = [np.zeros((0, 2), np.int64)]
    held = 0
    if token.size:
        _, _, _, t, g, lo, hi, left = _blocks(token, leader, n, pos)
        for i, j in _pairs_in_lists(t, lo, hi, left):
            ok = _possible(lo[i], hi[i], left[i], lo[j], hi[j], left[j])
            if ok.any():
                found.append(np.stack([np.minimum(g[i], g[j])[ok], np.maximum(g[i], g[j])[ok]], 1))
                held += len(found[-1])
            if held > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
    found = np.unique(np.concatenate(found), axis=0)
    return pa.table({"x": pa.array(found[:, 0]), "y": pa.array(found[:, 1])})


def _star_links(ours: pa.Table, theirs: pa.Table) -> pa.Table:
    """Links of members of one star (of one component) with sets of other stars;
    one link of each other component is enough."""
    out: list[tuple] = []
    if ours.num_rows and theirs.num_rows:
        sets = [_as_set(t) for t in ours.column("tokens").to_pylist()]
        size, root = np.array([s.size for s in sets]), ours.column("root")[0].as_py()
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        joined: set[int] = {root}
        for blob, other in zip(theirs.column("tokens"), theirs.column("root").to_pylist(), strict=True):
            if other in joined:
                continue
            s = _as_set(blob.as_py())
            lo, many = np.searchsorted(token, s), np.searchsorted(token, s, "right")
            many -= lo
            at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            if (np.bincount(owner[at], minlength=len(sets)) >= required(size, s.size)).any():
                joined.add(other)
                out.append((root, other))
    columns = list(zip(*out, strict=True)) if out else [[], []]
    return pa.table({k: pa.array(c, pa.int64()) for k, c in zip("ab", columns, strict=True)})


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [overlap(_as_set(a.as_py()), _as_set(b.as_py())) for a, b in zip(batch.column("tx"), batch.column("ty"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), batch.column("nx"), batch.column("ny"), pa.array(shared, pa.int64())], names=["x", "y", "nx", "ny", "shared"])


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, nx, ny, shared, linked) of pairs (x, y)."""
    left = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    both = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "nx", "ny", "tx", "ty")
    out = both.mapInArrow(_overlaps, "x long, y long, nx long, ny long, shared long")
    return out.withColumn("linked", F.expr(f"{DEN} * shared >= {NUM} * (nx + ny - shared)"))


def _starred(sets: DataFrame, key: str, parts: int) -> DataFrame:
    """(node, leader, n, shared) of the nodes that join a star of those with their key."""
    groups = sets.groupBy(key).agg(F.count("*").alias("k")).filter("k > 1")
    groups = groups.select(F.col(key).alias("least"), F.ceil(F.col("k") / STAR_SALT_ROWS).alias("salts"))
    own = sets.select(F.col(key).alias("own"), "node", "n", "tokens")
    grouped = own.join(groups, own["own"] == groups["least"]).select("least", F.pmod(F.xxhash64("node"), "salts").alias("salt"), "node", "n", "tokens")
    return grouped.repartition(parts, "least", "salt").mapInArrow(_stars, "node long, leader long, n long, shared long")


def jaccard_classes(shards: Shards, scratch: Scratch, parts: int) -> DataFrame:
    """(shard, pos, doc_id, n_shingles, root) of every row; ``root`` names its class, null without shingles."""
    shift = U(64 - shards.key_bits)
    reply = shards.count_keys(lambda rows: _keys(rows, shift), "reply")
    rows = shards.answer(reply, lambda rows, told, shard: _describe(rows, told, shard, shift), _SETS, "documents")
    scratch.drop("reply0")
    prepare_python(shards.spark)
    sets = rows.filter("tokens IS NOT NULL").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "least", "least2", "prefix", "tokens")))
    sets = scratch.save("sets", sets)
    rows = scratch.save("light", rows.select("shard", "pos", "doc_id", "n", "node"))
    scratch.drop("documents0")

    # stars of highly similar sets; then, by a second hash, stars of their leaders
    stars = scratch.save("stars", _starred(sets, "least", parts))
    star = stars.select(F.col("node").alias("m"), "leader", (F.col("n") - F.col("shared")).alias("extra"))
    led = sets.join(star, sets["node"] == star["m"], "left").select("node", F.coalesce("leader", "node").alias("leader"), "n", F.coalesce("extra", F.lit(0)).alias("extra"), "prefix")
    heads = sets.join(stars.select("node"), "node", "left_anti")
    stars2 = scratch.save("stars2", _starred(heads, "least2", parts))
    star2 = stars2.select(F.col("node").alias("m"), F.col("leader").alias("top"), (F.col("n") - F.col("shared")).alias("more"))
    led = led.join(star2, led["leader"] == star2["m"], "left")
    led = led.select("node", F.coalesce("top", "leader").alias("leader"), "n", (F.col("extra") + F.coalesce("more", F.lit(0))).alias("extra"), "prefix")
    led = scratch.save("led", led)

    # leaders' pairs from unskipped blocks
    post = lambda df: df.select("prefix", "node", "leader", "n", "root").mapInArrow(lambda b: _post(2 * parts, b), _POSTS).groupBy("part")
    pairs = post(led.withColumn("root", F.col("leader"))).applyInArrow(_leader_pairs, "x long, y long")
    compared = scratch.save("leaders", _compare(pairs.distinct(), sets))
    links = stars.union(stars2).select(F.col("node").alias("a"), F.col("leader").alias("b")).union(compared.filter("linked").select("x", "y"))
    roots = scratch.save("roots", components(links, scratch, "first"))

    # members of stars that are not connected yet
    x, y = (roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("x", "y"))
    apart = compared.filter("NOT linked").join(x, "x", "left").join(y, "y", "left")
    apart = apart.filter(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select("x", "y", F.col("shared").alias("of_leaders"))
    apart = scratch.save("apart", apart)
    gain = F.expr(f"{NUM + DEN} * extra - {NUM} * n")
    stat = led.groupBy(F.col("leader").alias("star")).agg(F.max(gain).alias("most"), F.count("*").alias("k"))
    for k in ("x", "y"):
        apart = apart.join(stat.select(F.col("star").alias(k), F.struct(F.col("k"), F.col("star"), F.col("most")).alias(f"s{k}")), k)
    shared = ((NUM + DEN) * F.col("of_leaders")).alias("shared")
    some = apart.filter(shared + F.col("sx.most") + F.col("sy.most") >= 0).select(shared, F.greatest("sx", "sy").alias("big"), F.least("sx", "sy").alias("small"))
    some = scratch.save("open", some.select("shared", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("big", "small") for c in ("star", "k", "most")]).distinct())
    if not some.isEmpty():
        # members of the larger star of a pair meet those of the smaller ones, in blocks
        r = roots.select(F.col("node").alias("m"), "root")
        own = led.select("node", "leader", gain.alias("gain")).join(r, F.col("node") == F.col("m"), "left").select("node", "leader", "gain", F.coalesce("root", "node").alias("root"))
        blocks = some.groupBy("big_star").agg(
            F.ceil(F.first("big_k") / BLOCK).alias("rows"), F.ceil(F.sum("small_k") / BLOCK).alias("columns"), F.max(F.col("shared") + F.col("small_most")).alias("lent")
        )
        ours = own.join(blocks, own["leader"] == blocks["big_star"]).filter("gain + lent >= 0")
        ours = ours.withColumn("row", F.pmod(F.xxhash64("node"), "rows")).withColumn("column", F.explode(F.expr("sequence(0L, columns - 1)")))
        theirs = own.join(some, own["leader"] == some["small_star"]).filter("gain + shared + big_most >= 0").join(blocks.drop("lent"), "big_star")
        theirs = theirs.withColumn("column", F.pmod(F.xxhash64("node"), "columns")).withColumn("row", F.explode(F.expr("sequence(0L, rows - 1)")))
        key, tokens = ["big_star", "row", "column"], sets.select("node", "tokens")
        # fresh column ids, as both sides come from the same tables
        ours, theirs = (d.select(*key, "node", "root").join(tokens, "node").select(*[F.col(c).alias(c) for c in (*key, "root", "tokens")]).groupBy(*key) for d in (ours, theirs))
        more = scratch.save("members", ours.cogroup(theirs).applyInArrow(_star_links, "a long, b long").distinct())
        if not more.isEmpty():  # join components, by their roots
            over = components(more, scratch, "second").select(F.col("node").alias("root"), F.col("root").alias("top"))
            within = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            alone = over.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")
            roots = scratch.save("roots2", within.union(alone))

    # the class of every row; a node of very many copies is a skewed key, which AQE splits
    named = roots.select(F.col("node").alias("of"), "root")
    own = F.when(F.col("n") > 0, F.coalesce("root", "node"))
    out = rows.join(named, F.col("node") == F.col("of"), "left").select("shard", "pos", "doc_id", F.col("n").alias("n_shingles"), own.alias("root"))
    out = scratch.save("classes", out)
    for name in ("light", "sets", "stars", "stars2", "led", "leaders", "apart", "open", "members", "roots", "roots2"):
        scratch.drop(name)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    parts = partitions_for(docs)
    shards = Shards(docs.select("doc_id", "text"), scratch)
    rows = jaccard_classes(shards, scratch, parts)
    shards.drop()
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "of")
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.join(least, F.col("root") == F.col("of"), "left").select("doc_id", "n_shingles", own.alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
