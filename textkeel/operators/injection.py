"""Hidden characters, instruction phrases and lookalike words, as columns.

Every detector is an array of findings; one projection concatenates them, so a
text is scanned in one stage and never copied per rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BIDI, CYRILLIC_LIKE, EMOJI, GREEK_LIKE, INVISIBLE, JOINER_SCRIPT, MARK, PHRASES, SEVERITIES, TAG, VARIATION, WORD_LETTERS
from ..functions.text import case_label, holds, java, matches, once, quoted, units


@dataclass(frozen=True)
class ScanConfig:
    unicode: bool = True
    instruction: bool = True
    homoglyph: bool = True
    max_findings: int = 200
    whitelist: tuple[str, ...] = ()


def _emoji() -> str:
    return "[" + "".join("-".join(f"\\x{{{x}}}" for x in part.split("-")) for part in EMOJI.split()) + "]"


_E = _emoji() + "{1,2}"  # a width in the lookbehind: Java 17 steps by code units in a class of ranges
_J = f"[{JOINER_SCRIPT}]"
_ZW = r"[\x{200C}\x{200D}]"
_V = f"[{VARIATION}]"
#: Family -> pattern of its runs, by precedence. A lookbehind over the long classes stands behind a
#: lookahead for the few characters it is about, as it would else be tried at every character of a text.
HIDDEN = {
    "tag": f"[{TAG}]++",
    "bidi": f"[{BIDI}]++",
    "mark": f"[{MARK}]++",
    "variation": f"(?={_V})(?<!{_E}){_V}++",
    "joiner": f"(?={_ZW})(?<={_J}){_ZW}(?={_J})",
    "invisible": rf"(?:[{INVISIBLE}]|(?!\A)\x{{FEFF}}|(?={_ZW})(?!(?<={_E})\x{{200D}}{_emoji()})(?!(?<={_J}){_ZW}{_J}){_ZW})++",
}
_TYPES = {
    "tag": ("Unicode Tag Smuggling", "critical", "characters of the Tags block, which a model reads as ASCII"),
    "bidi": ("Bidirectional Text Override", "high", "bidirectional controls that reorder what a reader sees"),
    "mark": ("Bidirectional Mark", "low", "directional marks, usual in right-to-left text"),
    "variation": ("Variation Selector Smuggling", "high", "variation selectors with no emoji before them"),
    "joiner": ("Script Joiner", "low", "joiners that the script around them requires"),
    "invisible": ("Invisible Character Sequence", "medium", "invisible characters"),
}
#: A character of which every hidden run has one; below the first of them one comparison tells that a character is none.
_HIDES = rf"[\x{{AD}}-\x{{10FFFF}}&&[{TAG}{BIDI}{MARK}{VARIATION}{INVISIBLE}\x{{200C}}\x{{200D}}\x{{FEFF}}]]"
STRIPPED = "|".join(HIDDEN[k] for k in ("tag", "bidi", "variation", "invisible"))
#: Of each phrase rule, in order: of every group, a literal that every match holds, in lower case.
NEEDS = (
    (("<|",), ("|>",)),
    (("[inst", "[/inst", "[sys", "[/sys", "system>", "human>", "assistant>"),),
    (("ignore", "disregard", "forget", "override", "bypass"), ("instruction", "prompt", "rule", "direction", "command", "guideline", "constraint", "context")),
    (("forget",), ("everything", "all")),
    (("new", "updated", "revised", "real", "actual", "true"), ("instruction", "prompt", "rule", "directive"), (":", "-", "\u2014")),
    (("not", "don't", "never"), ("tell", "inform", "mention", "reveal", "alert", "notify", "warn", "show"), ("user", "human", "developer", "operator", "owner")),
    (("without",), ("user", "human", "developer", "operator")),
    (("silently", "quietly", "secretly", "covertly", "discreetly"),),
    (("send", "post", "upload", "transmit", "exfiltrate", "leak", "forward", "email", "publish", "share"), ("env", "credential", "secret", "key", "token", "password")),
    (("$(",), ("curl", "wget", "fetch", "invoke-webrequest", "iwr")),
    (("base64",), ("|",)),
    (("curl", "wget"), ("|",), ("sh",)),
    (("system", "initial", "instruction", "prompt", "guidelines", "configuration"), ("your", "the", "all"), ("reveal", "repeat", "print", "output", "echo", "show", "display", "disclose", "summar")),
    (("important", "attention", "urgent", "warning", "notice"), ("for", "to")),
    (("note", "message", "instruction", "directive"), ("ai", "assistant", "llm", "agent", "model", "claude", "copilot", "cursor")),
    (("ai", "llm", "assistant", "agent", "claude", "copilot", "cursor", "chatgpt", "gemini", "codex"), (",", ":"), ("ignore", "disregard", "stop", "instead", "note", "you", "not", "always")),
    (("you", "act"), ("are", "now", "as")),
    (("mode", "disable", "turn", "suspend", "ignore"), ("enable", "activate", "on", "safety", "security", "content")),
    (("package", "dependency", "module", "library"), ("`", "'", '"'), ("to", "before")),
)
_FINDING = "struct<type:string,severity:string,index:int,length:int,raw:string,detail:string,decoded:string>"
_NONE = f"CAST(array() AS array<{_FINDING}>)"


def decode_tags(expression: str) -> str:
    """SQL: the printable ASCII of tag characters; structural ones vanish."""
    hidden, plain = "".join(chr(0xE0000 + c) for c in range(32, 127)), "".join(chr(c) for c in range(32, 127))
    kept = f"regexp_replace({expression}, {quoted('[^' + chr(92) + 'x{E0020}-' + chr(92) + 'x{E007E}]')}, '')"
    return f"translate({kept}, {quoted(hidden)}, {quoted(plain)})"


def _finding(source: str, kind: str, severity: str, detail: str, decoded: str = "CAST(NULL AS STRING)") -> str:
    return f"transform({source}, m -> named_struct('type', {quoted(kind)}, 'severity', {severity}, 'index', m.at, 'length', {units('m.raw')}, 'raw', m.raw, 'detail', {detail}, 'decoded', {decoded}))"


def hidden_findings(column: str) -> str:
    parts = []
    for family, pattern in HIDDEN.items():
        kind, severity, words = _TYPES[family]
        level = "if(length(m.raw) >= 8, 'high', 'medium')" if family == "invisible" else f"'{severity}'"
        decoded = f"nullif({decode_tags('m.raw')}, '')" if family == "tag" else "CAST(NULL AS STRING)"
        parts.append(_finding(matches(column, pattern), kind, level, f"concat(length(m.raw), ' ', {quoted(words)})", decoded))
    # in text order across families, as one pass over the text finds them
    both = f"concat({', '.join(parts)})"
    ordered = f"array_sort({both}, (x, y) -> CASE WHEN x.index < y.index THEN -1 WHEN x.index > y.index THEN 1 ELSE 0 END)"
    return f"CASE WHEN {column} RLIKE {quoted(_HIDES)} THEN {ordered} ELSE {_NONE} END"


def phrase_findings(column: str, lowered: str) -> str:
    """``lowered``: the text in lower case, in which each rule's literals are looked for first."""
    return "concat(" + ", ".join(_finding(matches(column, java(p, i), holds(lowered, *NEEDS[n])), kind, f"'{severity}'", quoted(f"phrase rule {n + 1}: {kind.lower()}")) for n, (kind, severity, p, i) in enumerate(PHRASES)) + ")"


def homoglyph_findings(column: str) -> str:
    # the range they stand in is asked first: one comparison for most characters, where the list takes one each
    like = lambda x, chars: f"{x} RLIKE {quoted(f'[{min(chars)}-{max(chars)}&&[{chars}]]')}"
    words = f"filter({matches(column, f'[{WORD_LETTERS}]{{4,}}')}, m -> m.raw RLIKE '[A-Za-z]' AND ({like('m.raw', CYRILLIC_LIKE)} OR {like('m.raw', GREEK_LIKE)}))"
    detail = f"concat('Latin mixed with lookalike ', if({like('m.raw', CYRILLIC_LIKE)}, 'Cyrillic', 'Greek'), ' letters')"
    found = _finding(words, "Homoglyph / Mixed Script", "'medium'", detail)
    return f"CASE WHEN {like(column, CYRILLIC_LIKE + GREEK_LIKE)} THEN {found} ELSE {_NONE} END"


def rank(expression: str) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + " END"


def phrase_pattern_count() -> int:
    return len(PHRASES)


def _capped(most: int) -> str:
    """Rows over the cap: a stronger finding takes the first of the weakest slots."""
    weakest = f"array_min(transform(a, h -> {rank('h.severity')}))"
    if most <= 0:
        return _NONE
    slot = f"array_position(transform(a, h -> {rank('h.severity')}), {weakest}) - 1"
    step = f"CASE WHEN size(a) < {most} THEN array_append(a, f) WHEN {rank('f.severity')} <= {weakest} THEN a ELSE transform(a, (h, i) -> if(i = {slot}, f, h)) END"
    return f"if(size(__all) <= {most}, __all, aggregate(__all, {_NONE}, (a, f) -> {step}))"


def scan_injection(df: DataFrame, text_col: str = "text", config: ScanConfig = ScanConfig()) -> DataFrame:
    """``df`` with findings, highest_severity, cleaned_text, stripped_count, truncated.

    A null text has no findings and a null cleaned_text; findings are ordered by
    severity, then index. Whitelist patterns that do not compile are skipped.
    """
    df = once(df, "__low", f"lower(`{text_col}`)")
    families = ((config.unicode, hidden_findings), (config.instruction, lambda c: phrase_findings(c, "__low")), (config.homoglyph, homoglyph_findings))
    parts = [f(f"`{text_col}`") for on, f in families if on]
    found = f"concat({', '.join([_NONE, *parts])})"
    allowed = compiling(df, config.whitelist)
    df = once(df, "__all", f"if(`{text_col}` IS NULL, {_NONE}, coalesce({found}, {_NONE}))")
    for pattern in allowed:
        df = df.withColumn("__all", F.expr(f"filter(__all, f -> NOT f.raw RLIKE {quoted(pattern)})"))
    order = f"array_sort(transform(__kept, (f, i) -> struct(-{rank('f.severity')} AS r, f.index AS at, i AS i, f AS f)))"
    df = once(df, "__kept", _capped(config.max_findings)).withColumn("truncated", F.expr(f"size(__all) > {max(config.max_findings, 0)}"))
    df = once(df, "findings", f"transform({order}, x -> x.f)").drop("__low", "__all", "__kept")
    top = f"array_max(transform(findings, f -> {rank('f.severity')}))"
    df = df.withColumn("highest_severity", F.expr(case_label(top, SEVERITIES)))
    return strip_hidden(df, text_col)


def strip_hidden(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with cleaned_text and stripped_count (UTF-16 units)."""
    column = f"`{text_col}`"
    df = df.withColumn("cleaned_text", F.expr(f"if({column} RLIKE {quoted(_HIDES)}, regexp_replace({column}, {quoted(STRIPPED)}, ''), {column})"))
    return df.withColumn("stripped_count", F.expr(f"{units(column)} - {units('cleaned_text')}"))


def long_form(scanned: DataFrame, *keys: str) -> DataFrame:
    """A row per finding."""
    return scanned.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.*")


def compiling(df: DataFrame, patterns: tuple[str, ...]) -> list[str]:
    """Those of the patterns that Java compiles."""
    java_pattern, good = df.sparkSession._jvm.java.util.regex.Pattern, []
    for p in patterns:
        try:
            java_pattern.compile(p)
            good.append(p)
        except Exception:  # noqa: BLE001  a pattern of a user's that does not compile is skipped
            continue
    return good
