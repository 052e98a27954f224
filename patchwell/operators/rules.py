"""Ordered category rules and pattern scans. Both are plain lists: add an entry to extend them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t


class Rule(NamedTuple):
    rule_id: str
    version: int
    holds: Callable[[], Column]
    category: str
    confidence: str
    signal: str


def _types_within(names: list[str]) -> Column:
    return F.coalesce((F.size("file_types") > 0) & (F.size(F.array_except(F.map_keys("file_types"), F.array(*map(F.lit, names)))) == 0), F.lit(False))


#: Category rules over the columns of a profile; the first that holds wins.
CATEGORY_RULES = [
    Rule("empty", 1, lambda: F.col("is_empty"), "packaging", "high", "nothing is left of the change once it is normalised"),
    Rule("ignore-file-only", 1, lambda: F.col("ignore_file_only"), "packaging", "high", "every file is an ignore file and every line a pattern"),
    Rule("whitespace-only", 1, lambda: F.col("whitespace_only"), "packaging", "high", "added and removed lines are the same but for white space"),
    Rule("comment-only", 1, lambda: F.col("comment_only"), "documentation", "high", "every changed line is a comment or blank"),
    Rule("doc-only", 1, lambda: _types_within(["doc"]), "documentation", "high", "every file is documentation"),
    Rule("build-only", 1, lambda: _types_within(["build", "data"]) & F.map_contains_key("file_types", "build"), "packaging", "high", "every file is part of the build, or data beside it"),
    Rule("test-only", 1, lambda: _types_within(["test"]), "test", "high", "every file is a test"),
    Rule("substantive", 1, lambda: F.lit(True), "unknown", "low", "no content rule settles it"),
]


def first_rule(rules: list[Rule] = CATEGORY_RULES) -> Column:
    """struct(rule_id, rule_version, category, confidence, signal) of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(None))
    for r in rules:
        hit = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("rule_version"), F.lit(r.category).alias("category"), F.lit(r.confidence).alias("confidence"), F.lit(r.signal).alias("signal"))
        out = out.when(r.holds(), hit)
    return out


# Constructs worth a look, by detail; the second list holds for shell files only.
CONSTRUCTS = [
    ("shell-out", r"\bos\.system\s*\("),
    ("shell-out", r"\bsystem\s*\("),
    ("shell-out", r"\b(?:os\.)?popen\s*\("),
    ("shell-out", r"Runtime\.getRuntime\(\)\.exec\b"),
    ("shell-out", r"\bsubprocess\b.*\bshell\s*=\s*True\b"),
    ("fetch-piped-to-shell", r"\b(?:curl|wget)\b.*\|\s*(?:sudo\s+)?(?:ba)?sh\b"),
    ("decode-piped-to-shell", r"\bbase64\b.*(?:-d|--decode)\b.*\|\s*(?:ba)?sh\b"),
    ("decode-exec", r"\beval\s*\(.*\b(?:base64|atob)\b"),
    ("decode-exec", r"\bexec\s*\(.*\bdecode\b"),
    ("embedded-private-key", r"-----BEGIN (?:RSA |OPENSSH |EC |DSA |PGP )?PRIVATE KEY-----"),
    ("reverse-shell", r"/dev/tcp/"),
    ("reverse-shell", r"\bnc\b.*\s-e\b"),
]
SHELL_CONSTRUCTS = [("shell-out", r"`[^`]* [^`]*`")]
SHELL_EXTENSIONS = [".sh", ".bash"]


#: Words of which a text must hold one of each group for a pattern to match it; in the order of the patterns.
CONSTRUCT_WORDS = [
    [["os.system"]], [["system"]], [["popen"]], [["Runtime.getRuntime().exec"]], [["subprocess"], ["shell"], ["True"]], [["curl", "wget"], ["|"], ["sh"]], [["base64"], ["|"], ["sh"]],
    [["eval"], ["base64", "atob"]], [["exec"], ["decode"]], [["PRIVATE KEY-----"]], [["/dev/tcp/"]], [["nc"], ["-e"]],
]
SHELL_CONSTRUCT_WORDS = [[["`"]]]


def holds(x: Column, words: list[list[str]]) -> Column:
    """One word of each group is in the text."""
    out = t.any_of([x.contains(w) for w in words[0]])
    for group in words[1:]:
        out &= t.any_of([x.contains(w) for w in group])
    return out


def may_hold(text: Column, ext: Column) -> Column:
    """Whether a text has what some construct needs."""
    return t.any_of([holds(text, w) for w in CONSTRUCT_WORDS]) | (ext.isin(SHELL_EXTENSIONS) & t.any_of([holds(text, w) for w in SHELL_CONSTRUCT_WORDS]))


def construct_details(line: Column, ext: Column) -> Column:
    """Array of the details that fire in an added code line, each once; empty for a blank line. A pattern runs only where its words are."""
    hits = [F.when(holds(line, w) & line.rlike(p), F.lit(d)) for (d, p), w in zip(CONSTRUCTS, CONSTRUCT_WORDS, strict=True)]
    hits += [F.when(ext.isin(SHELL_EXTENSIONS) & holds(line, w) & line.rlike(p), F.lit(d)) for (d, p), w in zip(SHELL_CONSTRUCTS, SHELL_CONSTRUCT_WORDS, strict=True)]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def construct_flags(code_lines: DataFrame) -> DataFrame:
    """A row for each added code line and detail that fires: the line's columns, detail, evidence."""
    line = F.col("text")
    rows = code_lines.filter(may_hold(line, F.col("ext")))  # few lines; no pattern matches a blank one
    return rows.withColumn("detail", F.explode(construct_details(line, F.col("ext")))).withColumn("evidence", t.strip(line))


def construct_suspects(patches: DataFrame, body: str = "body") -> DataFrame:
    """The patches whose body holds some construct's words and matches its pattern: all others have no line that does, and needn't be cut into files.

    No pattern spans a line, so what matches in a line matches in the body around it.
    """
    rows, x = patches.select("*", F.explode(F.array(body)).alias("_body")), F.col("_body")  # worked out once
    every = zip([*CONSTRUCTS, *SHELL_CONSTRUCTS], [*CONSTRUCT_WORDS, *SHELL_CONSTRUCT_WORDS], strict=True)
    return rows.filter(t.any_of([holds(x, w) & x.rlike(p) for (_, p), w in every])).drop("_body")


# Prompt-injection families and their patterns, in order.
INJECTIONS = [
    ("instruction-phrase", r"(?iu)(ignore|disregard|forget)\s+(all\s+|any\s+)?(previous|prior|above|earlier|preceding|your)\s+(instructions?|prompts?|rules|directives|context)"),
    ("instruction-phrase", r"(?iu)\bsystem\s+prompt\b"),
    ("instruction-phrase", r"(?iu)\bnew\s+instructions?\s*:"),
    ("instruction-phrase", r"(?iu)\brespond\s+only\s+with\b"),
    ("instruction-phrase", r"(?iu)\bclassify\s+this\s+(patch|diff|change|file)\s+as\b"),
    ("instruction-phrase", r"(?iu)\b(print|reveal|repeat|output)\s+(your|the)\s+(system\s+)?(prompt|instructions)\b"),
    ("instruction-phrase", r"(?iu)\byou\s+are\s+now\s+(a|an|in)\b"),
    ("chat-template-marker", r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|system\|>"),
    ("chat-template-marker", r"\[/?INST\]|<<SYS>>|<</SYS>>"),
    ("chat-template-marker", r'"role"\s*:\s*"(system|assistant)"'),
    ("chat-template-marker", r"(?m)^\s*(Human|Assistant):\s"),
    ("invisible-tag-block", r"[\x{e0000}-\x{e007f}]"),
    ("zero-width", r"[\x{200b}\x{200c}\x{2060}\x{feff}]{4,}"),
    ("bidi-control", r"[\x{202a}-\x{202e}\x{2066}-\x{2069}]"),
]


#: As above, of the lower-cased text where a pattern ignores case.
INJECTION_WORDS = [
    [["ignore", "disregard", "forget"], ["instruction", "prompt", "rules", "directives", "context"]], [["system"], ["prompt"]], [["new"], ["instruction"]], [["respond"], ["only"], ["with"]], [["classify"], ["this"], ["as"]],
    [["print", "reveal", "repeat", "output"], ["prompt", "instructions"]], [["you"], ["are"], ["now"]], [["<|"]], [["INST]", "<<SYS>>", "<</SYS>>"]], [['"role"']], [["Human:", "Assistant:"]], None, None, None,
]
#: First bytes, in UTF-8, of the characters that a pattern without words looks for.
INJECTION_BYTES = {11: [b"\xf3\xa0"], 12: [b"\xe2\x80", b"\xe2\x81", b"\xef\xbb"], 13: [b"\xe2\x80", b"\xe2\x81"]}
#: Characters that a pattern takes for i, s or k where it ignores case, and lower-casing doesn't.
ODD_CASE = "\u0130\u0131\u017f\u212a"


def injection_candidates(x: Column, low: Column) -> list[Column]:
    """For each pattern whether the text, given with its lower-cased form, has what the pattern needs."""
    ascii_only = F.octet_length(x) == F.length(x)
    odd = ~ascii_only & t.any_of([x.contains(c) for c in ODD_CASE])
    out = []
    for i, ((_, p), words) in enumerate(zip(INJECTIONS, INJECTION_WORDS, strict=True)):
        if words is None:
            out.append(~ascii_only & t.any_of([F.contains(x.cast("binary"), F.lit(b)) for b in INJECTION_BYTES[i]]))
        else:
            out.append(holds(low, words) | odd if "(?iu)" in p else holds(x, words))
    return out


def injection_suspects(patches: DataFrame, body: str = "body") -> DataFrame:
    """The patches whose body has what some injection pattern needs: no part of the others, cut at line ends, can have a hit."""
    rows = patches.select("*", F.explode(F.array(F.lower(body))).alias("_low"))
    return rows.filter(t.any_of(injection_candidates(F.col(body), F.col("_low")))).drop("_low")


def injected(x: Column, low: Column) -> list[Column]:
    """For each pattern whether it fires; a pattern runs only on its candidates."""
    return [c & x.rlike(p) for c, (_, p) in zip(injection_candidates(x, low), INJECTIONS, strict=True)]


def injection_hits(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row for each pattern that fires in a text: the row's other columns, family, pattern_no, snippet (40 characters around, made visible, 160 at most). A null text has no hit."""
    x, low = F.col(text), F.col("_low")
    rows = texts.select("*", F.explode(F.array(F.lower(x))).alias("_low"))
    # first the texts with a hit, as they are few
    rows = rows.withColumn("_hits", F.array(*injected(x, low))).filter(F.exists("_hits", lambda h: h))
    found = [F.when(F.get("_hits", F.lit(i)), F.struct(F.lit(f).alias("family"), F.lit(i).alias("pattern_no"), F.regexp_extract(x, r"(?s)(.{0,40}(?:" + p + r").{0,40})", 1).alias("near"))) for i, (f, p) in enumerate(INJECTIONS)]
    rows = rows.withColumn("hit", F.explode(F.array_compact(F.array(*found))))
    return rows.select(*[c for c in texts.columns if c != text], "hit.family", "hit.pattern_no", F.substring(t.visible(F.col("hit.near")), 1, 160).alias("snippet"))


def consistency(claim: Column, content: Column) -> Column:
    return F.when(claim == "unknown", "claim-unknown").when(content == "unknown", "content-substantive").when(claim == content, "agree").otherwise("disagree")


def review_flag(claim: Column, content: Column, touches_code: Column, flagged: Column) -> Column:
    """A construct fired, or a benign claim stands over unsettled content that touches code."""
    return flagged | (claim.isin("documentation", "packaging") & (content == "unknown") & touches_code)


def provably_benign() -> Column:
    """Over the columns of a profile: reason why it needs no security rating, or null."""
    quiet = ~F.col("touches_code")
    return (
        F.when(F.col("is_empty"), "no content changes").when(F.col("whitespace_only"), "white space only")
        .when(F.col("comment_only"), "comments only").when(quiet & (F.col("types") == "doc"), "documentation only")
        .when(quiet & F.col("benign_data_only"), "translations, changelog or copyright only")
    )
