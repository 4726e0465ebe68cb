"""Lexical expressions over C and C++ text.

Lines are numbered by marks in the text, so no running sum over segments is needed. One
pattern takes comments and directives out and steps over literals; those are hidden, and
what is left is cut into segments that end at a brace, a semicolon or an access label.
Everything is row-local: no shuffle.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mark of a line number: \x01 number \x02. Segments are cut at \x03.
_M0, _M1, _CUT = "\x01", "\x02", "\x03"
MARK = r"\x01\d+\x02"
# Literals keep their text in a private-use area, out of reach of the patterns below.
_PLAIN = "\x01\x02" + "".join(map(chr, range(0x20, 0x7F)))
_HIDDEN = "".join(chr(0xE000 + ord(c)) for c in _PLAIN)

# The last mark within a token is a group, so that the line of what follows is known.
_IN_BLOCK = r"(?:[^*\x01]++|(\x01\d++\x02)|\x01|\*(?!/))*+(?:\*/)?"
_STRING = r'"(?:[^"\\\n\x01]++|(\x01\d++\x02)|\x01|\\\n|\\[^\n])*+"'
_RAW = (
    r'(?:(?<!\w)|(?<=(?<!\w)u8)|(?<=(?<!\w)[uUL]))R"([^()\\\s]{0,16})\('
    r'(?:[^\x01]|(\x01\d++\x02)|\x01(?!\d++\x02))*?\)\GROUP"'
)
_CHAR = r"'(?:[^'\\\n]++|\\[^\n])*+'"
_LINE_COMMENT = r"//(?:[^\n\\]++|\\\n|\\)*+"


def _no_groups(pattern: str) -> str:
    return pattern.replace(r"(\x01", r"(?:\x01")


_BLOCK = r"/\*" + _no_groups(_IN_BLOCK)
_DIRECTIVE = (
    r"(?<=\x02)[ \t]*+#(?:[^\n\\/\"]++|" + _no_groups(_STRING) + r"|\"|\\\n|\\|/(?![/*])|" + _BLOCK + r")*+"
)
# Group 1 is a literal, 5 the start of a comment; 3, 4 and 6 are the last marks of raw
# strings, strings and comments. Few characters are one that a token starts with.
_TOKEN = (
    r"(?=[\"'/R# \t])(?:(" + _RAW.replace("GROUP", "2") + "|" + _STRING + "|" + _CHAR + r")|(/\*)"
    + _IN_BLOCK + "|" + _LINE_COMMENT + "|" + _DIRECTIVE + ")"
)
# The same with the first word of a branch directive as group 7.
_BRANCH = r"#[ \t]*+(?:if|ifn?def|elif|elifn?def|else|endif)\b"
_TOKEN_OR_BRANCH = _TOKEN.replace(_DIRECTIVE, rf"(?<=\x02)(?:(?=[ \t]*+({_BRANCH})))?+" + _DIRECTIVE[len(r"(?<=\x02)"):])
_LITERAL = _no_groups(_RAW.replace("GROUP", "1") + "|" + _STRING + "|" + _CHAR)
_PIECE = _LITERAL + r"|(?:[^\"'R]++|R(?!\"))++|(?s:.)"
_INCLUDE = (
    r"(?s)\A[ \t]*+#[ \t]*+include(?=[ \t<\"/])(?:[ \t]|" + _BLOCK + r"|\\\n(?:" + MARK + ")?+)*+"
    r"(<[^>\n]*+>|" + _no_groups(_STRING) + r"|[A-Za-z_][^\n/]*+)"
)
# An include directive of a text without marks, block comments and backslashes.
_INCLUDE_LINE = r"(?md)^[ \t]*+#[ \t]*+include(?:[^\n/\"]++|\"[^\"\n]*+\"|\"|/(?![/*]))*+"
# A quote within a number, outside of what follows a letter.
_DIGIT_QUOTE = r"((?:(?<![\w.])[0-9]|\G(?!\A))[\w.]*+)'(?=\w)"

_WORD = r"[A-Za-z_]\w*+"


def _nest(opening: str, closing: str, depth: int) -> str:
    """Balanced brackets up to a nesting depth."""
    inner = rf"{opening}[^{opening}{closing}]*+{closing}"
    for _ in range(depth):
        inner = rf"{opening}(?:[^{opening}{closing}]++|{inner})*+{closing}"
    return inner


# How deep the patterns follow brackets; deeper ones are hidden before they are used.
_PAREN_DEPTH, _ANGLE_DEPTH = 7, 4
_PAREN = _nest(r"\(", r"\)", _PAREN_DEPTH - 1)
_ANGLE = r"<(?:[^<>;{}]|<(?:[^<>;{}]|<(?:[^<>;{}]|<[^<>;{}]*+>)*+>)*+>)*+>"
_ATTR = r"\[\[[^\]]*+\]\]|(?:alignas|__attribute__|__declspec)\s*+" + _PAREN

_SPECIFIERS = (
    r"\b(?:static|inline|virtual|explicit|constexpr|consteval|constinit|extern|mutable|"
    r"register|thread_local|const|volatile|__inline|__forceinline|__inline__)\b"
)
_NOT_NAMES = (
    r"(?:if|for|while|switch|catch|return|sizeof|alignof|decltype|alignas|noexcept|throw|"
    r"new|delete|defined|static_assert|requires|do|else|co_return|co_await|co_yield)\b"
)
_OPERATOR = r"operator\s*+(?:\(\s*\)|\[\s*\]|[^\s\w(\[]{1,3}|[^()]+)"
_NAME = (
    rf"(?:(?:::\s*+)?(?:{_WORD}(?:{_ANGLE})?\s*+::\s*+)*+)"
    rf"(?:{_OPERATOR}|~?\s*+(?!{_NOT_NAMES}){_WORD}(?:{_ANGLE})?+)"
)
_QUALIFIERS = (
    rf"(?:\s++|(?:const|volatile|override|final|mutable)\b|&&?|(?:noexcept|throw)\b(?:\s*+{_PAREN})?+|"
    rf"->(?:[\w\s*&]|::|{_ANGLE}|{_PAREN}|\[\[[^\]]*+\]\])++|\[\[[^\]]*+\]\]|[A-Z_][A-Z0-9_]*+\b(?:\s*+{_PAREN})?+)*+"
)
# prefix | pointer part | name | parameters and qualifiers | initialiser list or try
_FUNCTION = (
    rf"(?s)\A((?:[\w\s:*&~]|{_ANGLE}|{_ATTR})*?)"
    r"((?:[*&](?:\s|[*&]|\bconst\b|\bvolatile\b)*+)?)"
    rf"(?<![\w:])({_NAME})(\s*+{_PAREN}{_QUALIFIERS})"
    r"((?::(?!:)|try\b).*|)\z"
)
_STATEMENT = r"(?s)\b(?:return|else|case|new|throw|goto|do|typedef|using|namespace|delete)\b(?!\s*+\()"
# What starts like this is no function, whatever follows.
_CONTROL = r"\A\s*+(?:if|for|while|switch|catch|else|do|try)\b"
_TEMPLATE = rf"(?:template\s*+{_ANGLE}|requires\s*+{_PAREN}|friend\b|extern\s*+[^\w\s]*+?)"
_LEAD = rf"(?s)\A(?:\s|{MARK}|{_TEMPLATE})*+"

_LABEL = r"(?<!\w)((?:public|protected|private)\b(?:[ \t]++\w++)?[ \t]*+:(?!:))"
_CLASS_HEAD = (
    rf"(?s)({MARK})(class|struct)\b((?:\s|{MARK}|{_ATTR}|{_WORD}(?=\s++[A-Za-z_])(?!\s++final\s*+(?:[:{{]|\z)))*+)"
    rf"((?:{_WORD}(?:\s*+::\s*+{_WORD})*+(?:\s*+{_ANGLE})?+)?+)((?:\s|{MARK})*+(?:final\b)?(?:\s|{MARK})*+"
    r"(?::(?!:)[^(){};=]*+)?)\z"
)
_MENTION = (
    rf"(?s){MARK}(?:class|struct)\b(?:\s|{MARK}|{_ATTR})++"
    rf"(?!(?:final|class|struct)\b){_WORD}(?:\s*+::\s*+{_WORD})*+(?:\s*+{_ANGLE})?+"
)

_GAP = rf"(?:\s|{MARK})*+"
# A braced member initialiser is not a scope.
_AFTER_BRACE = rf"\}}{_GAP}[,{{]"
_BRACED = (
    rf"(?<=[:,])({_GAP}{_WORD}(?:\s*+::\s*+{_WORD})*+(?:{_ANGLE})?+{_GAP})"
    rf"\{{([^{{}};]*+)\}}(?={_GAP}[,{{])"
)
_ENUM_CLASS = r"(enum|friend)[ \t]++(?:class|struct)\b"


def _bare(text: Column) -> Column:
    """Without marks; few texts have any."""
    own = text.contains(_M0) | text.contains(_M1) | text.contains(_CUT)
    return F.when(own, F.translate(text, _M0 + _M1 + _CUT, "   ")).otherwise(text)


def _unix(text: Column) -> Column:
    return F.when(
        text.contains("\r"), F.replace(text, F.lit("\r\n"), F.lit("\n"))
    ).otherwise(text)


def marked(text: Column) -> Column:
    """The text with a mark at the start of each line."""
    lines = F.split(_let(_let(text, _bare), _unix), "\n")
    return F.array_join(
        F.transform(
            lines, lambda line, i: F.concat(F.lit(_M0), (i + 1).cast("string"), F.lit(_M1), line)
        ),
        "\n",
    )


def include_texts(text: Column) -> Column:
    """What follows each ``#include``, with its brackets or quotes.

    Only what ends with the line of the last "include" is looked at if no literal, comment or
    directive can reach over a line there; else the whole text is cut into tokens.
    """

    def searched(t, top):
        lines = ~(top.contains("/*") | top.contains("\\") | top.contains('R"'))
        return F.struct(
            F.when(lines, top).otherwise(_let(marked(t), _quoted_digits)).alias("text"),
            F.when(lines, _INCLUDE_LINE).otherwise(_TOKEN).alias("pattern"),
        )

    def found(text):
        """Of a text with the word; others are not searched at all."""
        where = _let(
            _let(_let(text, _bare), _unix),
            lambda t: _let(_to_last_include(t), lambda top: searched(t, top)),
        )
        tokens = _let(where, lambda w: F.regexp_extract_all(w["text"], w["pattern"], F.lit(0)))
        return _named(F.filter(tokens, lambda t: t.contains("#") & t.rlike(r"\A[ \t]*+#")))

    return _let(
        text,
        lambda t: F.when(t.contains("include"), found(t)).otherwise(
            F.array().cast("array<string>")
        ),
    )


def _to_last_include(text: Column) -> Column:
    """Up to the end of the line that holds the last "include"."""
    behind = F.substring_index(text, "include", -1)
    past_line = F.length(behind) - F.length(F.substring_index(behind, "\n", 1))
    return F.substring(text, F.lit(1), F.length(text) - past_line)


def _named(directives: Column) -> Column:
    """What the include directives among them name."""
    found = F.transform(
        directives, lambda d: _trimmed_end(F.regexp_extract(d, _INCLUDE, 1))
    )
    return F.transform(F.filter(found, lambda t: t != ""), shown)


def _trimmed_end(text: Column) -> Column:
    """Without blanks at the end; a name in quotes or brackets has none."""
    return _let(
        text,
        lambda t: F.when(t.endswith('"') | t.endswith(">"), t).otherwise(
            F.regexp_replace(t, r"\s++\z", "")
        ),
    )


def include_names(include_text_list: Column) -> Column:
    """Array of (name, is_system) of what ``include_texts`` gives."""
    return F.transform(
        include_text_list,
        lambda t: F.struct(include_name(t).alias("name"), include_is_system(t).alias("is_system")),
    )


def include_is_system(include_text: Column) -> Column:
    return include_text.startswith("<")


def include_name(include_text: Column) -> Column:
    return F.btrim(include_text, F.lit('<>"'))


def _quoted_digits(text: Column) -> Column:
    """Quotes between digits hidden, so that they start no literal."""
    return F.when(
        text.contains("'") & text.rlike(r"[0-9A-Fa-f]'[0-9A-Fa-f]"),
        F.regexp_replace(text, _DIGIT_QUOTE, "$1" + _hide("'")),
    ).otherwise(text)


def neutral_text(marked_text: Column) -> Column:
    """Marked text without comments and directives, with literals hidden."""
    text = _quoted_digits(marked_text)
    has_halves = text.contains("#") & text.rlike(r"\x02[ \t]*+#[ \t]*+el")
    bare = F.when(
        has_halves, F.regexp_replace(text, _TOKEN_OR_BRANCH, "$1$3$4$5$6$7")
    ).otherwise(F.regexp_replace(text, _TOKEN, "$1$3$4$5$6"))

    def hidden(piece):
        return F.when(
            piece.rlike(r"\AR?[\"'](?s:.)"), F.translate(piece, _PLAIN, _HIDDEN)
        ).otherwise(piece)

    def without_literals(bare):
        pieces = F.regexp_extract_all(bare, F.lit(_PIECE), F.lit(0))
        return F.when(
            bare.contains('"') | bare.contains("'"), F.array_join(F.transform(pieces, hidden), "")
        ).otherwise(bare)

    # Of a comment its start is left, which no other code holds.
    spaced = F.replace(_let(bare, without_literals), F.lit("/*"), F.lit(" "))
    spaced = _let(spaced, lambda t: F.when(t.contains("#"), one_half(t)).otherwise(t))
    return _let(
        spaced,
        lambda t: F.when(
            t.rlike(_AFTER_BRACE), F.regexp_replace(t, _BRACED, "$1$2")
        ).otherwise(t),
    )


def one_half(text: Column) -> Column:
    """Neutral text with branch directives -> without them, and with one half of each ``#if``
    whose halves do not all close the braces they open: the first.

    Where every half pairs up on its own, all stay. Directives nest; those without a partner
    only disappear. Line marks of other lines are not touched.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[^#]++|#[^#]*+"), F.lit(0))

    def parts(piece):
        return F.struct(
            F.regexp_extract(piece, rf"\A({_BRANCH})", 1).alias("word"),
            (_count(piece, "{") - _count(piece, "}")).alias("net"),
        )

    # An open #if: braces its first half leaves open, those of the half at hand, whether a half
    # before left some, and the piece that the second half starts with.
    def frame(first, now, uneven, second):
        return F.struct(
            first.cast("int").alias("first"),
            now.alias("now"),
            uneven.alias("uneven"),
            second.alias("second"),
        )

    def fresh(net):
        return frame(F.lit(None), net, F.lit(False), F.lit(-1))

    # Below all lies the file itself. Dropped halves are "from-to " in one text: the state is
    # copied at each step, which costs a text far less than an array.
    start = F.struct(F.array(fresh(F.lit(0))).alias("open"), F.lit("").alias("dropped"))

    def step(state, i, word, net):
        stack, dropped = state["open"], state["dropped"]
        size, top = F.size(stack), F.element_at(stack, -1)
        below = F.slice(stack, F.lit(1), size - 1)
        first = F.coalesce(top["first"], top["now"])
        uneven = top["uneven"] | (top["now"] != 0)

        def more(at, net):
            return frame(at["first"], at["now"] + net, at["uneven"], at["second"])

        def closed():
            rest = F.slice(stack, F.lit(1), size - 2)
            return F.concat(rest, F.array(more(F.element_at(stack, -2), first + net)))

        second = F.when(top["second"] < 0, i).otherwise(top["second"])
        inside = size > 1
        is_end = inside & word.endswith("endif")
        is_else = inside & word.rlike(r"\A#[ \t]*+el")
        is_if = word.rlike(r"\A#[ \t]*+if")
        drops = is_end & (top["second"] >= 0) & uneven
        half = F.concat_ws("-", top["second"], i - 1, F.lit(" "))
        return F.struct(
            F.when(is_if, F.concat(stack, F.array(fresh(net))))
            .when(is_else, F.concat(below, F.array(frame(first, net, uneven, second))))
            .when(is_end, closed())
            .otherwise(F.concat(below, F.array(more(top, net))))
            .alias("open"),
            F.when(drops, F.concat(dropped, half)).otherwise(dropped).alias("dropped"),
        )

    def dropped_of(pieces):
        placed = F.transform(
            pieces, lambda p, i: F.struct(i.alias("i"), parts(p).alias("p"))
        )
        return F.aggregate(
            placed,
            start,
            lambda state, x: step(state, x["i"], x["p"]["word"], x["p"]["net"]),
            lambda state: F.regexp_extract_all(state["dropped"], F.lit(r"\d++-\d++"), F.lit(0)),
        )

    def kept(pieces, dropped):
        def places_of(half):
            ends = (F.substring_index(half, "-", 1), F.substring_index(half, "-", -1))
            return F.sequence(*(end.cast("int") for end in ends))

        gone = F.flatten(F.transform(dropped, places_of))
        places = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
        left = F.transform(places, lambda i: F.get(pieces, i))
        return F.regexp_replace(F.array_join(left, ""), _BRANCH, "")

    return _let(pieces, lambda ps: _let(dropped_of(ps), lambda dropped: kept(ps, dropped)))


def shown(text: Column) -> Column:
    """Undo the hiding of literals and drop the line marks."""

    def unmarked(plain):
        return F.when(plain.contains(_M0), F.regexp_replace(plain, MARK, "")).otherwise(plain)

    # What is hidden takes three bytes a character.
    return _let(
        text,
        lambda t: F.when(F.octet_length(t) == F.length(t), unmarked(t)).otherwise(
            unmarked(F.translate(t, _HIDDEN, _PLAIN))
        ),
    )


# Pieces that a running text is built from before it joins the others.
_STRIDE = 128
# More elements than the lines of a text can be, small enough to add to.
_MANY = 1 << 30


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once for all of its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hide(chars: str) -> str:
    return "".join(chr(0xE000 + ord(c)) for c in chars)


def _hide_nested(text: Column, opening: str, closing: str, depth: int) -> Column:
    """Hides the brackets within brackets; only texts with more than ``depth`` opening ones.

    One pass with a depth counter: the text is cut behind each bracket into pieces, those are
    taken in strides, the depth before a stride follows from what the strides before it leave
    open, and within a stride text and depth run along. The work grows with the length.
    """
    both = opening + closing
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)[^{both}]*+[{both}]|.++"), F.lit(0))

    def step(piece):
        return F.when(piece.endswith(opening), 1).when(piece.endswith(closing), -1).otherwise(0)

    def hidden(piece):
        return F.concat(
            F.substring(piece, F.lit(1), F.length(piece) - 1),
            F.translate(F.right(piece, F.lit(1)), both, _hide(both)),
        )

    def move(so_far, piece):
        total = so_far["total"] + step(piece)
        return F.struct(total.alias("total"), F.least(so_far["low"], total).alias("low"))

    def depth_before(moves, i):
        # A closing bracket without an opening one leaves the depth at zero.
        return F.aggregate(
            F.slice(moves, F.lit(1), i),
            F.lit(0),
            lambda d, m: F.greatest(d + m["total"], m["total"] - m["low"]),
        )

    def add(so_far, piece):
        after = F.greatest(so_far["depth"] + step(piece), F.lit(0))
        inner = (F.least(so_far["depth"], after) > 0) & (step(piece) != 0)
        return F.struct(
            after.alias("depth"),
            F.concat(so_far["text"], F.when(inner, hidden(piece)).otherwise(piece)).alias("text"),
        )

    def fold(strides, moves):
        return F.transform(
            strides,
            lambda stride, i: F.aggregate(
                stride,
                F.struct(depth_before(moves, i).alias("depth"), F.lit("").alias("text")),
                add,
                lambda state: state["text"],
            ),
        )

    def in_strides(pieces):
        starts = F.sequence(F.lit(1), F.size(pieces), F.lit(_STRIDE))
        return F.transform(starts, lambda at: F.slice(pieces, at, F.lit(_STRIDE)))

    def moves_of(strides):
        still = F.struct(F.lit(0).alias("total"), F.lit(0).alias("low"))
        return F.transform(strides, lambda stride: F.aggregate(stride, still, move))

    folded = _let(
        _let(pieces, in_strides),
        lambda strides: _let(moves_of(strides), lambda moves: F.array_join(fold(strides, moves), "")),
    )
    return F.when(_count(text, opening) > depth, folded).otherwise(text)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _more_than(text: Column, char: str, times: int) -> Column:
    """``_count(text, char) > times`` by one search of the text."""
    return F.octet_length(F.substring_index(text, char, times + 1)) < F.octet_length(text)


def _ends_in(segment: Column, delims: str) -> Column:
    """Whether the last character is one of ``delims``, without counting the others."""
    return reduce(Column.__or__, (segment.endswith(d) for d in delims))


def opens_or_ends(segment: Column) -> Column:
    """Whether a header is in front of the last character."""
    return _ends_in(segment, "{;")


def is_label(segment: Column) -> Column:
    return segment.endswith(":")


def shallow(segment: Column) -> Column:
    """A segment whose brackets nest no deeper than the header patterns follow them."""
    flat = _let(
        _hide_nested(segment, "(", ")", _PAREN_DEPTH),
        lambda text: _hide_nested(text, "<", ">", _ANGLE_DEPTH),
    )
    deep = _more_than(segment, "(", _PAREN_DEPTH) | _more_than(segment, "<", _ANGLE_DEPTH)
    return F.when(deep, flat).otherwise(segment)


def segments(text: Column) -> Column:
    return _let(marked(text), segments_of)


def segments_of(marked_text: Column) -> Column:
    """Segments ending at a brace, a semicolon or an access label, and the rest.

    Every segment starts with a line mark; others stand at line starts and before
    class keywords.
    """

    def keywords(neutral):
        return F.when(
            neutral.contains("enum") | neutral.contains("friend"),
            F.regexp_replace(neutral, _ENUM_CLASS, "$1"),
        ).otherwise(neutral)

    def cut(line):
        """A line, or the rest of one, behind its own mark without the first character."""
        whole = F.concat(F.lit(_M0), line)
        out = whole
        for brace in "{};":
            out = F.replace(out, F.lit(brace), F.lit(brace + _CUT))
        out = F.when(
            line.contains(":")
            & (line.contains("public") | line.contains("protected") | line.contains("private")),
            F.regexp_replace(out, _LABEL, "$1" + _CUT),
        ).otherwise(out)
        # The line's mark follows each cut.
        mark = F.concat(F.lit(_M0), F.substring_index(line, _M1, 1), F.lit(_M1))
        out = F.replace(out, F.lit(_CUT), F.concat(F.lit(_CUT), mark))
        out = F.when(
            line.contains("class") | line.contains("struct"),
            F.regexp_replace(out, r"(?=class\b|struct\b)(?<!\w)", mark),
        ).otherwise(out)
        # Nothing is left of many lines: blank ones, directives, comments.
        return F.when(line.endswith(_M1 + "\n"), whole).otherwise(out)

    lines = F.split(_let(neutral_text(marked_text), keywords), _M0)
    # The text starts with a mark: what is before it is empty.
    marked = F.transform(F.slice(lines, F.lit(2), F.lit(_MANY)), cut)
    return F.split(F.array_join(marked, ""), _CUT)


# Segments that matter for symbols: scopes, labels, named class heads without a body,
# and defaulted and deleted functions.
def segment_matters(segment: Column) -> Column:
    return (
        _ends_in(segment, "{}:")
        | has_class_word(segment)
        | (
            (segment.contains("default") | segment.contains("delete"))
            & segment.rlike(r"=\s*+(?:default|delete)\s*+;\z")
        )
    )


def has_class_word(segment: Column) -> Column:
    return segment.contains(_M1 + "class") | segment.contains(_M1 + "struct")


def last_line(segment: Column) -> Column:
    return F.substring_index(F.substring_index(segment, _M0, -1), _M1, 1).try_cast("int")


def first_line(segment: Column) -> Column:
    return F.substring(F.substring_index(segment, _M1, 1), F.lit(2), F.length(segment)).try_cast("int")


def last_code_line(segment: Column) -> Column:
    """Line of the last code character, or where the segment starts if it has none."""
    code = F.regexp_replace(segment, rf"(?s)(?:\s|{MARK})++\z", "")
    return F.when(code == "", first_line(segment)).otherwise(last_line(code))


def delimiter(segment: Column) -> Column:
    out = F.lit("")
    for end in ":;}{":
        out = F.when(segment.endswith(end), F.lit(end)).otherwise(out)
    return out


def header(segment: Column, delim: Column) -> Column:
    """Segment without its delimiter, still with line marks."""
    # Texts are cut behind each brace and semicolon: there is none before the last character.
    out = F.when(delim == "", segment).otherwise(
        F.substring(segment, F.lit(1), F.length(segment) - 1)
    )
    for end in ";}{":
        out = F.when(delim == end, F.substring_index(segment, end, 1)).otherwise(out)
    return out


def lead(segment: Column) -> Column:
    """Marks, template heads and the like in front of the code of a header."""
    return F.regexp_extract(segment, _LEAD, 0)


def first_code_line(lead: Column) -> Column:
    """Line of the first code character after the lead."""
    return last_line(lead)


def access_label(segment: Column) -> Column:
    return F.regexp_extract(
        segment, r"\b(public|protected|private)\b(?:\s++\w++)?\s*+:\z", 1
    )


def plain_header(head: Column, lead: Column) -> Column:
    """Header without its lead and without line marks."""
    rest = F.substring(head, F.length(lead) + 1, F.lit(_MANY))
    return F.when(rest.contains(_M0), F.regexp_replace(rest, MARK, "")).otherwise(rest)


def class_match(head: Column) -> Column:
    """The part of an opening header that is a class head, or ''."""
    return F.regexp_extract(_without_templates(head), _CLASS_HEAD, 0)


def _without_templates(head: Column) -> Column:
    return F.when(
        head.contains("template"), F.regexp_replace(head, rf"(?s)template\s*+{_ANGLE}", " ")
    ).otherwise(head)


def class_keyword(match: Column) -> Column:
    return F.regexp_extract(match, r"\A\x01\d+\x02(class|struct)\b", 1)


def class_name(match: Column) -> Column:
    return F.regexp_replace(
        shown(F.regexp_extract(match, _CLASS_HEAD, 4)), r"\A\s++|\s++\z", ""
    )


def class_line(match: Column) -> Column:
    return F.regexp_extract(match, r"\d+", 0).try_cast("int")


def class_mentions(head: Column, opens_scope: Column) -> Column:
    """Named class specifiers without a body, as (kind, name, line_start, line_end)."""
    bare = _without_templates(head)
    rest = F.when(opens_scope, F.regexp_replace(bare, _CLASS_HEAD, "")).otherwise(bare)
    return F.transform(
        F.regexp_extract_all(rest, F.lit(_MENTION), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, r"\x02(class|struct)\b", 1).alias("kind"),
            shown(
                F.regexp_extract(
                    m,
                    rf"(?s)({_WORD}(?:\s*+::\s*+{_WORD})*+(?:\s*+{_ANGLE})?+)\z",
                    1,
                )
            ).alias("name"),
            F.regexp_extract(m, r"\A\x01(\d+)", 1).try_cast("int").alias("line_start"),
            last_line(m).alias("line_end"),
        ),
    )


def function_parts(plain: Column) -> Column:
    """[prefix, pointer, name, rest] of a function header, or an array of another size.

    ``= default`` and ``= delete`` are cut off first: such members count as definitions.
    """
    cut = F.when(
        plain.contains("="), F.regexp_replace(plain, r"(?s)=\s*+(?:default|delete)\s*+\z", "")
    ).otherwise(plain)
    parsed = F.split(F.regexp_replace(cut, _FUNCTION, "$1\x04$2\x04$3\x04$4"), "\x04")
    return F.when(plain.contains("(") & ~plain.rlike(_CONTROL) & ~cut.rlike(_STATEMENT), parsed)


def ends_bodyless(plain: Column) -> Column:
    return plain.rlike(r"(?s)=\s*+(?:default|delete)\s*+\z")


def block_kind(plain: Column, head: Column) -> Column:
    """unnamed_namespace, namespace, linkage, union, or null."""
    return F.when(
        plain.contains("namespace"),
        F.when(
            plain.rlike(r"\A\s*+(?:inline\s++)?namespace\b(?:\s|\[\[[^\]]*+\]\])*+\z"),
            F.lit("unnamed_namespace"),
        ).when(
            plain.rlike(r"\A\s*+(?:inline\s++)?namespace\b[^(){};=]*+\z"), F.lit("namespace")
        ),
    ).when(
        head.contains("extern")
        & head.rlike(r"(?s)\A(?:\s|\x01\d+\x02)*+extern\s*+[^\w\s]*+(?:\s|\x01\d+\x02)*+\z"),
        F.lit("linkage"),
    ).when(
        plain.contains("union") & plain.rlike(r"(?s)(?:\A|[\s;])union\b[^(){};=]*+\z"),
        F.lit("union"),
    )


def function_prefix(parts: Column) -> Column:
    """What is in front of the name of ``function_parts``, without attributes."""
    return F.when(
        parts[0].rlike(r"[\[(]"), F.regexp_replace(parts[0], _ATTR, " ")
    ).otherwise(parts[0])


def full_name(parts: Column) -> Column:
    return _trim(parts[2])


def result_type(prefix: Column) -> Column:
    return _trim(F.regexp_replace(prefix, _SPECIFIERS, ""))


def is_static(prefix: Column) -> Column:
    return prefix.contains("static") & prefix.rlike(r"\bstatic\b")


def function_name(full_name: Column) -> Column:
    """Name of a function without its outermost scope."""
    qualified = full_name.contains("::")
    inner = F.when(
        qualified,
        F.regexp_extract(full_name, rf"(?s)\A(?:{_WORD}(?:{_ANGLE})?+)?\s*+::\s*+(.*)\z", 1),
    ).otherwise(F.regexp_replace(full_name, rf"\A~\s*+|{_ANGLE}\z", ""))
    return F.when(qualified | ~full_name.rlike(r"\Aoperator\b(?!\w)"), shown(inner))


def signature(parts: Column, result_type: Column) -> Column:
    declarator = _trim(F.concat(parts[1], parts[2], parts[3]))
    return shown(F.concat_ws(" ", F.when(result_type != "", result_type), declarator))


def is_plain_member(head: Column) -> Column:
    """False behind a template head, ``requires`` or ``friend``."""
    return ~head.rlike(rf"(?s)\A(?:\s|{MARK})*+(?:template|friend|requires)\b")


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
