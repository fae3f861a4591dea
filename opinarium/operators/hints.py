"""Title hints as regular expressions, checked in linear time before anything is matched.

A hint is text that someone typed. One without special characters is looked for as it stands. Any other is read as an expression if the
check proves it well formed; if not, it is looked for as it stands too, so that no hint can stop a job. The
check replaces escapes, sets, repeats and groups by one sign each, from the inside out, with patterns that never repeat a group,
and then counts brackets in one pass over what is left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make a hint an expression.
SPECIAL = r"[\\^$.|?*+()\[{]"
#: An expression is read up to this length and depth of groups; Java matches its parts by recursion.
LENGTH, DEPTH = 500, 40
#: Titles longer than this are not matched against repeated groups, for the same reason, but searched for the hint's text.
TITLE = 2000
#: Java's flags for what the dialect of the hints means: any case, Unicode classes, line feeds as the only line ends.
FLAGS = "(?idU)"

# Signs that stand for parts of an expression; a hint that has one itself is plain text.
_CLASS, _LITERAL, _BORDER, _SET = "\ue000", "\ue001", "\ue002", "\ue003"
_SIGNS = "[\ue000-\ue003]"
# General categories, escapes that stand for a class of characters, and escaped characters.
_CATEGORY = r"\\[pP]\{(?:L|Lu|Ll|Lt|Lm|Lo|M|Mn|Mc|Me|N|Nd|Nl|No|P|S|Z|C)\}"
_STEPS = (
    (r"\\\\", _LITERAL),  # pairs first, so that each backslash left escapes what follows it
    (_CATEGORY, _CLASS),
    (r"\\[dwsDWS]", _CLASS),
    (r"\\[bB]", _BORDER),
    (r"\\[ntrf!-/:-@\[\]^_`{-~ ]", _LITERAL),
)
_SETS = r"\[\^?+([^\[\]]+)\]"
_RANGE = r"([0-9A-Za-z])-([0-9A-Za-z])"
_BOUNDS = r"\{([0-9]{1,3}),([0-9]{1,3})\}"
_AFTER = (
    (r"\{[0-9]{1,3}(?:,[0-9]{0,3})?\}", "*"),
    (r"\((?:\?[:=!])?", "("),
    (rf"[$^{_BORDER}]", "^"),
    (r"[^()|*+?^\\\[{]", "a"),
    (r"([a)])[*+?][+?]?", "$1"),
)


def _replaced(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, sign in steps:
        text = F.regexp_replace(text, pattern, sign)
    return text


def _sound_set(content: Column) -> Column:
    """Whether the inside of a set means the same everywhere: hyphens at the ends or in ranges that go up."""
    bare = F.regexp_replace(F.regexp_replace(content, r"^-", ""), r"-$", "")
    ranges = F.regexp_extract_all(bare, F.lit(_RANGE), F.lit(0))
    upward = F.forall(ranges, lambda r: F.substring(r, 1, 1) <= F.substring(r, 3, 1))
    alone = ~F.contains(F.regexp_replace(bare, _RANGE, ""), F.lit("-"))
    foreign = [F.contains(bare, F.lit(sign)) for sign in ("&&", "\\", _BORDER)]
    return upward & alone & (bare != "") & ~foreign[0] & ~foreign[1] & ~foreign[2]


def _balanced(brackets: Column) -> Column:
    """Whether every group is closed and none is nested deeper than ``DEPTH``."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(state: Column, sign: Column) -> Column:
        depth = state["depth"] + F.when(sign == "(", 1).when(sign == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (state["ok"] & depth.between(0, DEPTH)).alias("ok"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda state: state["ok"] & (state["depth"] == 0))


def well_formed(hint: Column) -> Column:
    """Whether a hint is an expression that Java reads, and reads as the dialect of the hints does.

    Covered: literals, dots, escapes and classes, categories, sets and ranges, borders and anchors, alternatives, nested, plain and
    look-ahead groups, and repeats, lazy and possessive ones included. Back references, look-behind, named groups and flags are not.
    """
    escaped = _replaced(hint, _STEPS)
    sets = F.regexp_extract_all(escaped, F.lit(_SETS), F.lit(1))
    unset = F.regexp_replace(escaped, _SETS, _SET)
    bounds = F.regexp_extract_all(unset, F.lit(_BOUNDS), F.lit(0))
    ordered = F.forall(
        bounds,
        lambda b: F.regexp_extract(b, _BOUNDS, 1).cast("int") <= F.regexp_extract(b, _BOUNDS, 2).cast("int"),
    )
    signs = _replaced(unset, _AFTER)
    rest = F.regexp_like(signs, F.lit(r"[*+?\\\[{]"))  # a repeat of nothing or of a repeat, or a part left open
    sound = ordered & F.forall(sets, _sound_set) & ~rest & _balanced(F.regexp_replace(signs, "[^()]", ""))
    within = (F.char_length(hint) <= LENGTH) & ~F.regexp_like(hint, F.lit(_SIGNS))
    return F.when(within, sound).otherwise(F.lit(False))


def hint_pattern(hint: Column) -> Column:
    """The expression to match titles with; null for a hint that is looked for as it stands."""
    special = F.regexp_like(hint, F.lit(SPECIAL))
    return F.when(F.when(special, well_formed(hint)).otherwise(False), F.concat(F.lit(FLAGS), hint))


def pattern_matches(title: Column, hint: Column, pattern: Column) -> Column:
    """Case-insensitive match of a hint, whose ``hint_pattern`` is given, inside a title; false if either is missing."""
    repeated = F.regexp_like(pattern, F.lit(r"\)[*+{]"))
    expression = pattern.isNotNull() & ~(repeated & (F.char_length(title) > TITLE))
    found = F.when(expression, F.regexp_like(title, pattern)).otherwise(F.contains(F.lower(title), F.lower(hint)))
    return F.coalesce(found, F.lit(False))
