"""Regex dialect helpers and match offsets, all as Catalyst expressions.

Patterns in this package are written for Java with two marks: ``\\m`` opens and
``\\M`` closes an ASCII word, and ``\\s`` is Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def java(pattern: str, ignore_case: bool = True) -> str:
    """The Java pattern of one of ours."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\m":
            out.append("(?<![A-Za-z0-9_])")
        elif two == r"\M":
            out.append("(?![A-Za-z0-9_])")
        elif two == r"\s":
            out.append(_SPACE if depth else f"[{_SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            depth += (two[0] == "[") - (two[0] == "]" and depth > 0)
            out.append(two[0])
            i -= 1
        i += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def units(expression: str) -> str:
    """Length in UTF-16 code units."""
    return f"CAST(length(encode({expression}, 'UTF-16BE')) / 2 AS INT)"


def literal(expression: str) -> str:
    """SQL: a pattern that matches just this string."""
    return f"concat('\\\\Q', replace({expression}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"


def holds(column: str, *groups: tuple[str, ...]) -> str:
    """SQL: of each group some literal stands in the text. With literals that every match
    of a pattern needs, a gate that costs far less than the pattern and loses nothing."""
    return " AND ".join("(" + " OR ".join(f"contains({column}, {quoted(x)})" for x in group) + ")" for group in groups)


_STEP = 32


def running(name: str) -> str:
    """SQL: the sums of all elements before each one of the array of integers in the lambda
    variable ``name``, in blocks of blocks, so the work is about linear in the array."""
    total = lambda x: f"aggregate({x}, 0, (s, v) -> s + v)"
    block = lambda x, b: f"slice({x}, {b} * {_STEP} + 1, {_STEP})"
    blocks = lambda x: f"if(size({x}) = 0, CAST(array() AS array<int>), transform(sequence(0, CAST(floor((size({x}) - 1) / {_STEP}) AS INT)), b -> {total(block(x, 'b'))}))"
    inside = lambda x, starts: f"flatten(transform({starts}, (s0, b) -> transform(array({block(x, 'b')}), w -> transform(w, (v, i) -> s0 + {total('slice(w, 1, i)')}))[0]))"
    top = f"transform(b2, (v, i) -> {total('slice(b2, 1, i)')})"
    return f"transform(array({blocks(name)}), b1 -> transform(array({blocks('b1')}), b2 -> {inside(name, inside('b1', top))})[0])[0]"


def matches(column: str, pattern: str, gate: str = "true") -> str:
    """SQL: array of (raw, at) of all matches; ``at`` in UTF-16 units. Texts that the gate
    shuts out, or that hold no match, skip the rest."""
    p = quoted(pattern)
    found = f"""filter(zip_with(split({column}, {p}, -1), regexp_extract_all({column}, {p}, 0), (s, m) -> named_struct('s', {units('s')}, 'n', {units('m')}, 'm', m)), x -> x.m IS NOT NULL)"""
    placed = f"transform(array(transform(f, x -> x.s + x.n)), steps -> zip_with(f, {running('steps')}, (x, before) -> named_struct('raw', x.m, 'at', before + x.s)))[0]"
    return f"""CASE WHEN {gate} AND {column} RLIKE {p} THEN transform(array({found}), f -> {placed})[0]
      ELSE CAST(array() AS array<struct<raw:string,at:int>>) END"""


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input that lies in few pieces, dealt over the cores: text scans are
    bound by CPU. Larger inputs have pieces enough and stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES else df


#: Below this much a core, an input is dealt out; about what one scan task gets otherwise.
SMALL_BYTES = 64 << 20


def entropy(token: str) -> str:
    """SQL: Shannon entropy of a token in bits a character. A character is counted by what taking
    it out leaves: one native pass for each distinct one."""
    share = f"transform(array_distinct(split({token}, '')), c -> (length({token}) - length(replace({token}, c, ''))) / length({token}))"
    return f"aggregate({share}, 0D, (h, p) -> h - p * log2(p))"


def case_label(rank: str, labels: tuple[str, ...]) -> str:
    return "CASE " + rank + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(labels)) + " END"


def loopback(host: Column) -> Column:
    """localhost, *.localhost, ::1, 0.0.0.0 and 127.d.d.d."""
    return (host == "localhost") | host.endswith(".localhost") | host.isin("::1", "0.0.0.0") | host.rlike(r"^127\.\d{1,3}\.\d{1,3}\.\d{1,3}\z")


def host_of(authority: str) -> str:
    """SQL: lower-cased host of an authority: after the last @, in brackets or before the port."""
    tail = f"element_at(split({authority}, '@', -1), -1)"
    return f"lower(CASE WHEN {tail} RLIKE '^\\\\[[^\\\\]]*\\\\]' THEN regexp_extract({tail}, '^\\\\[([^\\\\]]*)\\\\]', 1) ELSE split({tail}, ':', -1)[0] END)"


def sql(expression: str) -> Column:
    return F.expr(expression)


def once(df: DataFrame, name: str, expression: Column | str) -> DataFrame:
    """``df`` with a column computed once a row: a generator of one element, which
    the optimizer, unlike a projection, does not copy into every use."""
    value = F.expr(expression) if isinstance(expression, str) else expression
    return df.withColumn("__once", F.explode(F.array(F.struct(value.alias("v"))))).withColumn(name, F.col("__once.v")).drop("__once")
