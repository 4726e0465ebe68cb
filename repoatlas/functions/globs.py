"""Glob patterns as Spark predicates.

A pattern with exactly one ``**`` is a literal prefix plus a suffix pattern that is
matched against the whole path; every other pattern is a plain wildcard match in
which ``*`` also crosses ``/``. Both cases reduce to "starts with" and one wildcard
match, so a pattern becomes a pair (prefix, wildcard).
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_pattern(pattern: str) -> tuple[str, str]:
    """(literal prefix, wildcard pattern); an empty wildcard accepts everything."""
    if pattern.count("**") != 1 or len(pattern.split("**")) != 2:
        return "", pattern
    prefix, suffix = pattern.split("**")
    suffix = suffix.lstrip("/")
    return prefix.rstrip("/"), f"*{suffix}" if suffix else "*"


# Pieces of a wildcard pattern: a bracket set, or one character.
# Possessive, so "[]" and "[!]" without a closing bracket after them stay literal.
_PIECE = r"\[!?+\]?+[^\]]*+\]|(?s:.)"


def _set_regex(body: str) -> str:
    """Java regex of the inside of ``[...]``."""
    negate, body = body.startswith("!"), body.removeprefix("!")
    items = []
    for lo, hi in re.findall(r"(?s)(.)(?:-(.))?", body):
        if not hi:
            items.append(re.escape(lo) if not lo.isalnum() else lo)
        elif lo <= hi:
            items.append(
                "-".join(c if c.isalnum() else "\\" + c for c in (lo, hi))
            )
    if not items:
        return "(?s:.)" if negate else "(?!)"
    return f"[{'^' if negate else ''}{''.join(items)}]"


def wildcard_regex(wildcard: str) -> str:
    """Anchored Java regex of a wildcard pattern."""
    out = []
    for piece in re.findall(_PIECE, wildcard):
        if piece == "*":
            out.append(".*")
        elif piece == "?":
            out.append(".")
        elif len(piece) > 1:
            out.append(_set_regex(piece[1:-1]))
        else:
            out.append(piece if piece.isalnum() or piece in "/_" else "\\" + piece)
    return r"(?s)\A" + re.sub(r"(\.\*)+", ".*", "".join(out)) + r"\z"


def glob_match(path: Column, pattern: str) -> Column:
    """Predicate for one literal pattern.

    Patterns without ``?`` and ``[`` become starts-with / contains / ends-with, which
    stay in generated code and can be pushed into the scan.
    """
    prefix, wildcard = split_pattern(pattern)
    conds = [path.startswith(prefix)] if prefix else []
    pieces = re.split(r"\*+", wildcard)
    if "?" in wildcard or "[" in wildcard or len(pieces) > 3 or (
        len(pieces) == 3 and (pieces[0] or pieces[2])
    ):
        conds.append(path.rlike(wildcard_regex(wildcard)))
    elif len(pieces) == 1:
        conds.append(path == F.lit(wildcard))
    elif len(pieces) == 3:
        conds.append(path.contains(pieces[1]))
    else:
        head, tail = pieces
        if head:
            conds.append(path.startswith(head))
        if tail:
            conds.append(path.endswith(tail))
        if head and tail:
            conds.append(F.length(path) >= len(head) + len(tail))
    cond = path.isNotNull() if not conds else conds[0]
    for extra in conds[1:]:
        cond = cond & extra
    return cond


def any_glob(path: Column, patterns) -> Column:
    cond = F.lit(False)
    for i, pattern in enumerate(patterns):
        cond = glob_match(path, pattern) if i == 0 else cond | glob_match(path, pattern)
    return cond


def selected(path: Column, include, exclude) -> Column:
    """Any exclude rule drops the path; otherwise some include rule must accept it."""
    return ~any_glob(path, exclude) & any_glob(path, include)


# Between the pieces of a pattern, and between the characters of a piece: no text has these.
_STAR, _NEXT = "﷐", "﷑"


def _ranges(token: Column) -> Column:
    """(negated, ranges) of one token: a bracket set, ``?`` or a character."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    negated = inner.startswith("!")
    body = F.when(negated, F.substring(inner, F.lit(2), F.length(inner))).otherwise(inner)
    is_set = F.length(token) > 1
    parts = F.when(token == "?", F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(F.when(is_set, body).otherwise(token), F.lit(r"(?s).-.|."), F.lit(0))
    )
    ends = F.transform(
        parts,
        lambda r: F.struct(F.substring(r, 1, 1).alias("lo"), F.substring(r, -1, 1).alias("hi")),
    )
    return F.struct(
        ((token == "?") | (is_set & negated)).alias("negated"),
        # A backward range such as [z-a] holds nothing.
        F.filter(ends, lambda e: e["lo"] <= e["hi"]).alias("ranges"),
    )


def compiled_rule(pattern: Column) -> Column:
    """A pattern of a table in the form that ``rule_hits`` tests without any regex.

    ``prefix``; then ``exact``, or what the path starts and ends with and the texts in between,
    in order. Patterns with ``?`` or ``[...]`` have ``pieces`` instead: for each run between
    stars its characters as ranges.
    """
    one = F.size(F.split(pattern, r"\*\*")) == 2
    prefix = F.when(one, F.regexp_replace(F.split_part(pattern, F.lit("**"), F.lit(1)), "/+$", ""))
    suffix = F.regexp_replace(F.split_part(pattern, F.lit("**"), F.lit(2)), "^/+", "")
    wildcard = F.when(one, F.concat(F.lit("*"), suffix)).otherwise(pattern)
    tokens = F.regexp_extract_all(wildcard, F.lit(_PIECE), F.lit(0))
    plain = ~F.exists(tokens, lambda t: (t == "?") | (F.length(t) > 1))
    texts = F.split(wildcard, r"\*+")
    n = F.size(texts)
    runs = F.split(
        F.array_join(
            F.transform(tokens, lambda t: F.when(t == "*", _STAR).otherwise(F.concat(t, F.lit(_NEXT)))), ""
        ),
        _STAR,
    )
    pieces = F.transform(
        runs,
        lambda run: F.transform(F.filter(F.split(run, _NEXT), lambda t: t != ""), _ranges),
    )
    between = F.filter(F.slice(texts, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda t: t != "")
    return F.struct(
        F.coalesce(prefix, F.lit("")).alias("prefix"),
        F.when(plain & (n == 1), wildcard).alias("exact"),
        F.when(plain & (n > 1), F.element_at(texts, 1)).otherwise("").alias("head"),
        F.when(plain & (n > 1), F.element_at(texts, -1)).otherwise("").alias("tail"),
        F.when(plain, between).alias("between"),
        F.when(~plain, pieces).alias("pieces"),
    )


def rule_hits(path: Column, rule: Column) -> Column:
    """Whether a path matches a rule that ``compiled_rule`` made."""
    ends = (
        path.startswith(rule["head"])
        & path.endswith(rule["tail"])
        & (F.length(path) >= F.length(rule["head"]) + F.length(rule["tail"]))
    )

    inner = F.when(F.size(rule["between"]) == 0, F.lit(True)).when(
        (F.size(rule["between"]) == 1) & (rule["head"] == "") & (rule["tail"] == ""),
        path.contains(rule["between"][0]),
    ).otherwise(_in_order(path, rule))
    plain = F.when(rule["exact"].isNotNull(), path == rule["exact"]).otherwise(ends & inner)
    return path.startswith(rule["prefix"]) & F.when(rule["pieces"].isNull(), plain).otherwise(
        _matches_pieces(path, rule["pieces"])
    )


def _in_order(path: Column, rule: Column) -> Column:
    """The texts in between follow one another, from behind the head to before the tail."""

    def step(at, text):
        found = F.call_function("locate", text, path, at)
        return F.when((at > 0) & (found > 0), found + F.length(text)).otherwise(F.lit(0))

    end = F.aggregate(rule["between"], F.length(rule["head"]) + 1, step)
    return (end > 0) & (end - 1 <= F.length(path) - F.length(rule["tail"]))


def _matches_pieces(path: Column, pieces: Column) -> Column:
    """Pieces of ranges: the first at the start, the last at the end, the others in order, each
    as early as it can be."""
    length = F.length(path)
    first, last, n = F.element_at(pieces, 1), F.element_at(pieces, -1), F.size(pieces)

    def holds(char, atom):
        found = F.exists(atom["ranges"], lambda r: (char >= r["lo"]) & (char <= r["hi"]))
        return found != atom["negated"]

    def at(place, piece):
        chars = F.transform(
            piece, lambda atom, k: holds(F.call_function("substring", path, place + k, F.lit(1)), atom)
        )
        return (place + F.size(piece) - 1 <= length) & F.forall(chars, lambda c: c)

    limit = length - F.size(last)

    def step(place, piece):
        top = limit - F.size(piece) + 1
        places = F.when((place > 0) & (place <= top), F.sequence(place, top))
        found = F.element_at(F.filter(places, lambda p: at(p, piece)), 1)
        return F.coalesce(F.try_add(found, F.size(piece)), F.lit(0))

    middle = F.filter(F.slice(pieces, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda p: F.size(p) > 0)
    end = F.aggregate(middle, F.size(first) + 1, step)
    open_ends = (
        (F.size(first) <= limit)
        & at(F.lit(1), first)
        & at(limit + 1, last)
        & (end > 0)
        & (end - 1 <= limit)
    )
    return F.when(n == 1, (length == F.size(first)) & at(F.lit(1), first)).otherwise(open_ends)
