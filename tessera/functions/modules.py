"""Reading specification modules: names, parents, definitions, invariants, configurations. Columns, but for nested comments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

#: Modules of the standard and community libraries; they are nobody's protocol.
LIBRARY = (
    "Integers", "Naturals", "Reals", "Sequences", "FiniteSets", "Bags", "TLC", "TLCExt", "TLAPS", "TLAPSExt", "RealTime", "Randomization", "Functions", "SequencesExt", "FiniteSetsExt", "Folds",
    "BagsExt", "Json", "IOUtils", "DyadicRationals", "SVG", "FiniteSetTheorems", "NaturalsInduction", "WellFoundedInduction", "Toolbox", "MCTest",
)
DEFINITION = r"(?m)^(\w+)\s*(?:\([^)\n]*\))?\s*=="


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def module_name(text: Column, default: str | None = None, strict: bool = True) -> Column:
    found = _some(F.regexp_extract(text, r"(?i)----\s*MODULE\s+(\w+)\s*----" if strict else r"MODULE\s+(\w+)", 1))
    return F.coalesce(found, F.lit(default)) if default else found


def module_names(text: Column) -> Column:
    """All modules that a text names, for holdout checks."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"MODULE\s+(\w+)"), 1))


def _names(blob: Column) -> Column:
    parts = F.transform(F.split(F.regexp_replace(blob, r"\\\*.*$", ""), ","), lambda p: F.regexp_extract(p, r"^\s*(\w+)", 1))
    return F.filter(parts, lambda p: (p != "") & ~F.upper(p).isin("LOCAL", "INSTANCE", "MODULE"))


def extends(text: Column) -> Column:
    """Modules of the first EXTENDS line."""
    return _names(F.regexp_extract(text, r"(?im)^\s*(?:LOCAL\s+)?EXTENDS[ \t]+([^\n]*)", 1))


def all_extends(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^\s*(?:LOCAL\s+)?EXTENDS[ \t]+([^\n]*)"), 1), _names)))


def instances(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bINSTANCE\s+(\w+)"), 1))


def referenced(text: Column) -> Column:
    """Modules that it builds on, libraries aside, sorted."""
    library = F.array(*map(F.lit, LIBRARY))
    return F.array_sort(F.array_except(F.array_union(all_extends(text), instances(text)), library))


def missing_context(text: Column, provided: Column | None = None) -> Column:
    """Referenced modules that neither the text nor `provided` defines."""
    gone = F.array_except(referenced(text), module_names(text))
    return F.array_except(gone, provided) if provided is not None else gone


def context_notice(text: Column) -> Column:
    gone = missing_context(text)
    return F.when(F.size(gone) > 0, F.concat(F.lit("This module also needs: "), F.array_join(gone, ", "), F.lit(".")))


def code_lines(text: Column) -> Column:
    """Lines that aren't blank and don't begin with a comment."""
    return F.size(F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: (line != "") & ~line.startswith("\\*") & ~line.startswith("(*")))


def is_shim(text: Column, name: Column | None = None) -> Column:
    """A small wrapper that only sets a checker up for another module."""
    name = F.coalesce(name, module_name(text), F.lit("")) if name is not None else F.coalesce(module_name(text), F.lit(""))
    parents = extends(text)
    own = F.array_except(parents, F.array(*map(F.lit, LIBRARY)))
    n = code_lines(text)
    core = F.when(name.rlike("^MC[A-Z]"), F.substring(name, 3, 1000))
    named = name.startswith("MC") & (F.length(name) >= 4) & (n <= 160)
    return named & (F.coalesce(F.array_contains(own, core), F.lit(False)) | (F.array_contains(parents, F.lit("TLC")) & (n <= 15) & (F.size(own) > 0)))


def definitions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DEFINITION), 1)


def has_duplicate_definitions(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(r"(?m)^(\w+)\s*=="), 1)
    return F.size(names) != F.size(F.array_distinct(names))


def body(text: Column, name: str | Column, limit: int = 4000) -> Column:
    """A definition's right side, up to the next definition, separator or end; capped."""
    name = F.lit(name) if isinstance(name, str) else name
    pattern = F.concat(F.lit(r"(?ms)^\Q"), name, F.lit(r"\E\s*(?:\([^)\n]*\))?\s*==(.*?)(?=^\w+\s*(?:\([^)\n]*\))?\s*==|^={4,}|^-{4,}|\z)"))
    return F.substring(strip(F.get(F.regexp_extract_all(text, pattern, 1), F.lit(0))), 1, limit)


def called(body_text: Column, names: Column) -> Column:
    """Names of the list that the body uses, longest first, then by name."""
    used = F.filter(names, lambda n: F.regexp_like(body_text, F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b"))))
    return F.transform(F.array_sort(F.transform(used, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda x: x["n"])


def variables(text: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(text, r"(?m)^\s*VARIABLES?\s+([^\n]*)", 1), r"\s*,\s*"), lambda v: v != "")


def constants(text: Column) -> Column:
    """Declared constants, over several lines too, comments out."""
    blob = F.regexp_replace(F.regexp_extract(text, r"(?ms)^\s*CONSTANTS?\b(.*?)(?=^\s*(?:VARIABLES?|ASSUME|EXTENDS|INSTANCE|\w+\s*==)|\z)", 1), r"\\\*[^\n]*", "")
    return F.array_distinct(F.filter(F.transform(F.split(blob, ","), lambda c: F.regexp_extract(c, r"^\s*(\w+)", 1)), lambda c: c != ""))


def guessed_type(name: Column) -> Column:
    """What a variable's name tells of its kind."""
    low = F.lower(name)
    control = low.startswith("pc") | (low == "self")
    return F.when(control, "[control / process state]").when(low.rlike("chan|msg|buf"), "[message/channel component]").when(low.endswith("s") & (low != "vars"), "[set or sequence component]").otherwise("[state function / data value]")


# The sentences of the notes.
NOTE_EXISTS = "existential quantification (\\E) chooses a witness (e.g. process or schedule step)."
NOTE_CHOOSE = "CHOOSE picks a deterministic value satisfying a predicate."
NOTE_OR = "disjunction (\\/) combines alternative transitions."
NOTE_NO_CHOICE = "No explicit \\E/CHOOSE detected in scanned Next/spec fragment; may be deterministic or use library ops."
NOTE_WEAK, NOTE_STRONG = "Weak fairness (WF_) on action(s).", "Strong fairness (SF_) on action(s)."
NOTE_FAIR = "Fairness constraints appear in Spec or related definitions."
NOTE_UNFAIR = "No WF_/SF_ tokens found in Spec fragment; liveness may be absent or expressed differently."


def _noted(none: str, *found: Column) -> Column:
    told = F.concat_ws(" ", *found)
    return F.when(told == "", none).otherwise(told)


def nondeterminism(text: Column, next_body: Column, head: int = 12_000) -> Column:
    """What leaves the next state open, in words; the relation's body and the head of the text are looked at."""
    seen, step = F.concat(F.coalesce(next_body, F.lit("")), F.substring(text, 1, head)), F.coalesce(next_body, F.lit(""))
    has = lambda s, x: F.contains(s, F.lit(x))
    return _noted(NOTE_NO_CHOICE, F.when(has(seen, "\\E"), NOTE_EXISTS), F.when(has(seen, "CHOOSE"), NOTE_CHOOSE), F.when(has(step, "\\/") & has(text, "Next"), NOTE_OR))


def fairness(text: Column, spec_line: Column, tail: int = 4000) -> Column:
    """The fairness that the specification's line and the end of the text state, in words."""
    seen = F.concat(F.coalesce(spec_line, F.lit("")), F.substring(text, -tail, tail))
    return _noted(NOTE_UNFAIR, F.when(F.contains(seen, F.lit("WF_")), NOTE_WEAK), F.when(F.contains(seen, F.lit("SF_")), NOTE_STRONG), F.when(F.contains(F.lower(seen), F.lit("fair")), NOTE_FAIR))


INVARIANT_NAME = r"(?m)^(\w+Inv(?:ariant)?|TypeOK|Safety\w*)\s*=="


def invariant_names(text: Column, config: Column | None = None) -> Column:
    """Names that the configuration lists; without any, definitions at the start of a line whose names tell an invariant."""
    told = F.regexp_extract_all(text, F.lit(INVARIANT_NAME), 1)
    if config is None:
        return told
    listed = F.flatten(F.transform(F.regexp_extract_all(config, F.lit(r"INVARIANTS?\s+([^\n]+)"), 1), lambda x: F.split(F.trim(x), r"\s+")))
    listed = F.filter(listed, lambda n: (n != "") & ~n.startswith("\\*"))
    return F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(told)


def invariant_blocks(text: Column) -> Column:
    """Each invariant's header line with the indented or blank lines below it."""
    found = F.regexp_extract_all(text, F.lit(r"(?mi)^((?:TypeOK|Safety|Inv\w*|[^\n]*Invariant)[^\S\n]*==[^\n]*(?:\n(?: [^\n]*|[^\S\n]*(?=\n|\z)))*)"), 1)
    return F.transform(found, strip)


def invariant_block(text: Column) -> Column:
    """All invariants' blocks, an empty line between; empty if there is none."""
    return F.array_join(invariant_blocks(text), "\n\n")


def trivial_invariant(text: Column, names: Column) -> Column:
    return (F.size(names) > 0) & F.forall(names, lambda n: F.regexp_like(text, F.concat(F.lit(r"(?m)^\Q"), n, F.lit(r"\E\s*==\s*TRUE\s*$"))))


# Names that are sets of actors, single actors; others are small numbers.
ACTORS = r"^(Proc|Process|Node|Server|Client|Participant|Thread|Worker|Acceptor|Proposer|Learner|Replica|Philosopher|Fork)s?$"
SINGLE_ACTORS = r"^(Coordinator|Leader|Primary|Head|Tail)$"


def constant_value(name: Column, text: Column) -> Column:
    """A small value for the checker: by how the text uses the name (end of a range, set after \\in), else by the name, else 3."""
    used = lambda before: F.regexp_like(text, F.concat(F.lit(before + r"\Q"), name, F.lit(r"\E\b")))
    actors = "{v1, v2, v3}"
    return F.when(used(r"\b\d+\s*\.\.\s*"), "3").when(used(r"[\\]in\s+"), actors).when(name.rlike(ACTORS), actors).when(name.rlike(SINGLE_ACTORS), "v1").otherwise("3")


def checker_config(text: Column) -> Column:
    """A configuration: specification or Init and Next, invariants, constants. Null without a next-state relation."""
    names = definitions(text)
    has = lambda n: F.array_contains(names, F.lit(n))
    head = F.when(has("Spec"), "SPECIFICATION Spec").when(has("Init") & has("Next"), "INIT Init\nNEXT Next")
    inv = F.transform(invariant_names(text), lambda n: F.concat(F.lit("INVARIANT "), n))
    con = F.transform(constants(text), lambda c: F.concat(F.lit("CONSTANT "), c, F.lit(" = "), constant_value(c, text)))
    return F.when(head.isNotNull(), F.array_join(F.concat(F.array(head), inv, con), "\n"))


def inline_config(text: Column) -> Column:
    """struct(spec, config): what follows the terminator is a configuration if a keyword of one begins a line."""
    rest = F.regexp_extract(text, r"(?s)={4,}[ \t]*\n(.*)$", 1)
    ours = rest.rlike(r"(?m)^\s*(SPECIFICATION|INIT|NEXT|INVARIANTS?|CONSTANTS?|PROPERTY|PROPERTIES)\b")
    keep = F.array_join(F.filter(F.split(rest, "\n"), lambda line: F.trim(line) != ""), "\n")
    return F.struct(F.when(ours, F.regexp_extract(text, r"(?s)^(.*?={4,})", 1)).otherwise(text).alias("spec"), F.when(ours, keep).alias("config"))


def family(source: Column, path: Column | None = None) -> Column:
    """The folder of a module's file, else its source without the last part."""
    folder = _some(F.regexp_extract(path, "^(.*)/[^/]*$", 1)) if path is not None else F.lit(None).cast("string")
    return F.coalesce(folder, F.when(source.rlike("^[a-z]+:"), F.regexp_replace(source, ":[^:]*$", "")))


def header_comment_lines(text: Column, first: int = 80) -> Column:
    """Line comments among the first lines, marks off, joined by spaces; rules of stars and dashes aside."""
    marked = F.filter(F.slice(F.split(text, "\n"), 1, first), lambda line: line.rlike(r"^\s*\\\*"))
    bare = F.transform(marked, lambda line: F.trim(F.regexp_replace(line, r"^\s*\\\*+|[*-]{3,}", "")))
    return F.array_join(F.filter(bare, lambda line: line != ""), " ")


def without_line_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"\\\*[^\n]*", "")


def carve(text: Column, section: str = "Next") -> Column:
    """struct(prefix, removed, suffix) around a definition; concat() of the three is the text again. Null without it."""
    pattern = rf"(?ms)\A(.*?)(^{section}\s*==.*?)(?=^\w+\s*(?:\([^)\n]*\))?\s*==|^={{4,}}|\z)(.*)\z"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(rf"(?m)^{section}\s*=="), F.struct(part(1).alias("prefix"), part(2).alias("removed"), part(3).alias("suffix")))


def assembled(name: Column, pieces: dict[str, Column]) -> Column:
    """A module from its pieces; empty and null pieces are left out."""
    parts = [F.when(F.trim(p) != "", F.concat(F.lit(f"{k} == " if k[:1].isupper() and k not in ("EXTENDS", "CONSTANTS", "VARIABLES") else f"{k} "), p)) for k, p in pieces.items()]
    return F.concat_ws("\n", F.concat(F.lit("---- MODULE "), name, F.lit(" ----")), *parts, F.lit("===="))


def _comments(text: str) -> list[str]:
    """Outermost (* ... *) blocks, nested ones inside kept as they are; an open one ends the search."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text) - 1:
        pair = text[i : i + 2]
        if pair == "(*":
            if depth == 0:
                start = i + 2
            depth, i = depth + 1, i + 2
        elif pair == "*)" and depth:
            depth, i = depth - 1, i + 2
            if depth == 0:
                out.append(text[start : i - 2])
        else:
            i += 1
    return out


# Nesting isn't regular, so these three are Arrow-batched UDFs.
@F.pandas_udf(T.ArrayType(T.StringType()))
def block_comments(text: pd.Series) -> pd.Series:
    """Texts of the outermost block comments."""
    return text.map(lambda t: _comments(t or ""))


@F.pandas_udf(T.StringType())
def without_block_comments(text: pd.Series) -> pd.Series:
    def strip(t: str) -> str:
        for c in _comments(t):
            t = t.replace(f"(*{c}*)", "", 1)
        return t

    return text.map(lambda t: strip(t or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def depth_aware_split(blob: pd.Series) -> pd.Series:
    """Parts between commas that stand in no bracket."""

    def split(t: str) -> list[str]:
        parts, depth, now = [], 0, ""
        for c in t:
            depth += (c in "([{<") - (c in ")]}>")
            if c == "," and depth <= 0:
                parts.append(now.strip())
                now = ""
            else:
                now += c
        return [p for p in [*parts, now.strip()] if p]

    return blob.map(lambda t: split(t or ""))


def joined_comments(text: Column, short: int = 200) -> Column:
    """Block comments, short ones that follow one another joined by a space."""
    blocks = F.filter(F.transform(block_comments(text), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")

    def add(out: Column, c: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = F.coalesce((F.length(last) < short) & (F.length(c) < short), F.lit(False))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat_ws(" ", last, c)))).otherwise(F.concat(out, F.array(c)))

    return F.aggregate(blocks, F.array().cast("array<string>"), add)
