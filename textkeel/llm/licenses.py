"""License scans by ordered signature rules, in DataFrame functions only.

Texts are reduced to their words (lower-cased, one space between). A rule's regex
runs only where its keyword stands in the words: words that every match of the rule
holds, derived from the regex itself, behind a still shorter ``STEM`` that many
keywords share. Nothing else keeps a text from a rule.

Matches are word intervals with a priority and a rank. Of equal intervals the better
stays (lower priority number, then lower rank); an interval is suppressed if a longer
one of the same or a better priority contains it. Overlaps without containment stay.
Places of matches and suppression are running sums and running maxima over the rows
of a text's matches, so the work is in proportion to text and matches.

Defined results: a null text counts as empty, an empty text has no words and no
detections; repeated rows give repeated results; rows with a null id are scanned
like any other; of the caller's columns all but the text are carried, and those
named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .license_rules import BASE, rules
from .scratch import Scratch

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Parts that keywords share, looked for first; a keyword without any stands for itself.
STEMS = ("licen", "gpl", "bsd", "warrant", "redistribut", "distribut", "permission", "copyright", "software", "domain", "commons", "mpl", " cc", "mit", "apache", "www", "public")


def _gates():
    groups: dict[str, list[dict]] = {}
    for r in rules():
        word = f" {r['keyword']} "
        groups.setdefault(next((s for s in STEMS if s in word), word), []).append(r | {"keyword": word})
    return F.array(*[F.struct(F.lit(stem).alias("stem"), F.array(*[F.struct(*[F.lit(r[k]).alias(k) for k in ("keyword", "regex", "rank")]) for r in own]).alias("rules")) for stem, own in groups.items()])


_SPACES = "length({0}) - length(replace({0}, ' ', ''))"
#: Every match of a rule: the spaces before it since the last, and those inside.
_PARTS = f"""
filter(zip_with(split(__words, r.regex, -1), regexp_extract_all(__words, r.regex, 0), (s, m) ->
  named_struct('before', {_SPACES.format('s')}, 'inside', {_SPACES.format('m')})), x -> x.inside IS NOT NULL)
"""
_HITS = f"""
filter(transform(flatten(transform(filter(__gates, g -> contains(__words, g.stem)), g -> filter(g.rules, r -> contains(__words, r.keyword)))),
  r -> named_struct('rank', r.rank, 'parts', {_PARTS})), h -> size(h.parts) > 0)
"""
_MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def _base_columns() -> dict:
    base = [(f" {p} ", label) for p, label in BASE]
    once = lambda p: f"CASE WHEN contains(__words, '{p}') THEN regexp_count(__words, '(?<= ){p.strip()}(?= )') ELSE 0 END"
    first = lambda p: f"CASE WHEN contains(__words, '{p}') THEN {_SPACES.format(f'''substring_index(__words, '{p}', 1)''')} END"
    last = lambda p: f"CASE WHEN contains(__words, '{p}') THEN n_words - {len(p.split())} - ({_SPACES.format(f'''substring_index(__words, '{p}', -1)''')}) END"
    return {
        "n_base": F.expr("CAST(" + " + ".join(once(p) for p, _ in base) + " AS BIGINT)"),
        "first_word": F.expr("CAST(least(" + ", ".join(first(p) for p, _ in base) + ") AS BIGINT)"),
        "last_word": F.expr("CAST(greatest(" + ", ".join(last(p) for p, _ in base) + ") AS BIGINT)"),
        "base": F.expr("array_compact(array(" + ", ".join(f"CASE WHEN contains(__words, '{p}') THEN '{label}' END" for p, label in base) + "))"),
    }


def _of_rule(key: str, rank: str):
    """A rule's property by its rank, from a literal array."""
    return F.element_at(F.array(*[F.lit(r[key]) for r in rules()]), F.col(rank) + 1)


def _kept(spans: DataFrame) -> DataFrame:
    """Suppression among the intervals (uid, first_word, end_word, priority, rank) of each text."""
    best = spans.groupBy("uid", "first_word", "end_word").agg(F.min(F.struct("priority", "rank")).alias("b"))
    best = best.select("uid", "first_word", "end_word", "b.priority", "b.rank")
    # of those before, the farthest end at each priority: they contain this one if they end no earlier
    before = W.partitionBy("uid").orderBy("first_word", F.desc("end_word")).rowsBetween(W.unboundedPreceding, -1)
    levels = sorted({r["priority"] for r in rules()})
    farthest = [F.max(F.when(F.col("priority") == p, F.col("end_word"))).over(before).alias(f"end{p}") for p in levels]
    inside = [(F.col("priority") >= p) & F.coalesce(F.col(f"end{p}") >= F.col("end_word"), F.lit(False)) for p in levels]
    contained = inside[0]
    for test in inside[1:]:
        contained = contained | test
    return best.select("*", *farthest).filter(~contained).select("uid", "first_word", "end_word", "priority", "rank")


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, the base columns, labels, score and
    ``detections``: array of (first_word, end_word, label, rank, priority, confidence)."""
    scratch = Scratch(docs.sparkSession, "licenses")
    keep = [c for c in docs.columns if c not in _MADE and c != text_col]
    own = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("own")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), NON_WORD, " ")), F.lit(" "))
    df = docs.select(own, words.alias("__words")).withColumn("n_words", F.expr(f"CAST(if(__words = '  ', 0, {_SPACES.format('__words')} - 1) AS BIGINT)"))
    df = df.withColumns(_base_columns()).withColumn("__gates", _gates()).withColumn("hits", F.expr(_HITS)).drop("__words", "__gates")
    rows = scratch.save("scanned", df.withColumn("uid", F.monotonically_increasing_id()))
    spans = rows.select("uid", F.explode("hits").alias("h")).select("uid", "h.rank", F.posexplode("h.parts").alias("i", "part"))
    so_far = W.partitionBy("uid", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("part.before") + F.col("part.inside")).over(so_far)
    spans = spans.select("uid", "rank", (end - F.col("part.inside") - 1).alias("first_word"), end.alias("end_word"), _of_rule("priority", "rank").alias("priority"))
    found = _kept(spans).select("uid", F.struct("first_word", "end_word", _of_rule("label", "rank").alias("label"), "rank", "priority", _of_rule("confidence", "rank").alias("confidence")).alias("d"))
    found = found.groupBy("uid").agg(F.array_sort(F.collect_list("d")).alias("detections"))  # of one text
    out = rows.drop("hits").join(found.withColumnRenamed("uid", "of"), F.col("uid") == F.col("of"), "left")
    none = F.expr("CAST(array() AS array<string>)")
    own_labels = F.coalesce(F.transform("detections", lambda d: d["label"]), none)
    made = {
        "n_words": F.col("n_words"),
        "n_base": F.col("n_base"),
        "first_word": F.col("first_word"),
        "last_word": F.col("last_word"),
        "base_labels": F.array_join(F.array_sort("base"), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat("base", own_labels))), ","),
        "score": F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)),
        "detections": F.col("detections"),
    }
    return out.select(*[F.col(f"own.`{c}`").alias(c) for c in keep], *[v.alias(k) for k, v in made.items()])


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return scan_licenses(docs).select(*cols, F.coalesce(F.size("detections"), F.lit(0)).alias("n_detections"))
