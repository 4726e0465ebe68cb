"""``cpp_text`` for one text at a time, inside tasks.

The patterns and the order of the steps are those of ``cpp_text``; a test holds both equal.
Strings stay in one process here, where an expression hands a text from one pattern to the next.
Texts are taken as ``text.valid_text`` gives them.
"""

import re

from repoatlas.functions import cpp_text as C

_M0, _M1 = "\x01", "\x02"


def _compiled(pattern: str) -> re.Pattern:
    """A pattern of ``cpp_text``: word ends go by all letters, classes by ASCII, as there."""
    for ours, theirs in ((r"\b", r"(?u:\b)"), (r"\z", r"\Z"), ("*+?", "*+"), ("(?md)", "(?m)")):
        pattern = pattern.replace(ours, theirs)
    return re.compile(pattern, re.ASCII)


_HIDE = str.maketrans(C._PLAIN, C._HIDDEN)
_SHOW = str.maketrans(C._HIDDEN, C._PLAIN)
_BARE = str.maketrans(_M0 + _M1 + C._CUT, "   ")
_BLANKS = " \t\n\r\x0b\x0c"

_mark = _compiled(C.MARK)
# ``cpp_text._TOKEN`` without groups for the last mark within a token: group 1 is a literal.
_token = _compiled(
    r"(?=[\"'/R# \t])(?:(" + C._no_groups(C._RAW.replace("GROUP", "2") + "|" + C._STRING) + "|" + C._CHAR
    + ")|" + C._BLOCK + "|" + C._LINE_COMMENT + "|" + C._DIRECTIVE + ")"
)
_maybe_half = _compiled(r"#[ \t]*+el")
_has_halves = _compiled(r"\x02[ \t]*+#[ \t]*+el")
_piece = _compiled(C._PIECE)
_is_literal = _compiled(r"R?[\"'](?s:.)")
_digit_quote = _compiled(r"[0-9A-Fa-f]'[0-9A-Fa-f]")
_quoted_number = _compiled(r"(?<![\w.])[0-9][\w.]*+(?:'(?=\w)[\w.]*+)++")
# Literals and the comment of a line without block comments, raw strings and a line joined to it.
_line_token = _compiled(r"(\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+')|//(?s:.*)")
_after_brace = _compiled(C._AFTER_BRACE)
_braced = _compiled(C._BRACED)
_enum_class = _compiled(C._ENUM_CLASS)
_cut = _compiled(r"([{};])")
_label = _compiled(C._LABEL)
_keyword = _compiled(r"(?<!\w)(?=class\b|struct\b)")
_defaulted = _compiled(r"=\s*+(?:default|delete)\s*+;\z")
_bodyless = _compiled(r"=\s*+(?:default|delete)\s*+\z")
_access = _compiled(r"\b(public|protected|private)\b(?:\s++\w++)?\s*+:\z")
_lead = _compiled(C._LEAD)
_template = _compiled(rf"(?s)template\s*+{C._ANGLE}")
_class_head = _compiled(C._CLASS_HEAD)
_class_word = _compiled(r"\x01\d+\x02(class|struct)\b")
_number = _compiled(r"\d+")
_mention = _compiled(C._MENTION)
_mention_kind = _compiled(r"\x02(class|struct)\b")
_mention_name = _compiled(rf"(?s)({C._WORD}(?:\s*+::\s*+{C._WORD})*+(?:\s*+{C._ANGLE})?+)\z")
_unnamed = _compiled(r"\s*+(?:inline\s++)?namespace\b(?:\s|\[\[[^\]]*+\]\])*+\z")
_namespace = _compiled(r"\s*+(?:inline\s++)?namespace\b[^(){};=]*+\z")
_linkage = _compiled(r"(?s)(?:\s|\x01\d+\x02)*+extern\s*+[^\w\s]*+(?:\s|\x01\d+\x02)*+\z")
_union = _compiled(r"(?s)(?:\A|[\s;])union\b[^(){};=]*+\z")
_control = _compiled(C._CONTROL)
_statement = _compiled(C._STATEMENT)
_function = _compiled(C._FUNCTION)
_attribute = _compiled(C._ATTR)
_specifiers = _compiled(C._SPECIFIERS)
_static = _compiled(r"\bstatic\b")
_inner_name = _compiled(rf"(?s)(?:{C._WORD}(?:{C._ANGLE})?+)?\s*+::\s*+(.*)\z")
_around_name = _compiled(rf"\A~\s*+|{C._ANGLE}\z")
_operator = _compiled(r"operator\b(?!\w)")
_no_member = _compiled(rf"(?s)(?:\s|{C.MARK})*+(?:template|friend|requires)\b")
_halves = _compiled(r"(?s)[^#]++|#[^#]*+")
_branch = _compiled(C._BRANCH)
_include = _compiled(C._INCLUDE)
_include_line = _compiled(C._INCLUDE_LINE)
_directive = _compiled(r"[ \t]*+#")
_blank_end = _compiled(r"\s++\z")
_blank_ends = _compiled(r"\A\s++|\s++\z")
_brackets = {"(": re.compile(r"([()])"), "<": re.compile(r"([<>])")}


def plain(text: str) -> str:
    """Without marks and with Unix line ends."""
    if _M0 in text or _M1 in text or C._CUT in text:
        text = text.translate(_BARE)
    return text.replace("\r\n", "\n") if "\r" in text else text


def _reaches_over_lines(text: str) -> bool:
    """Whether a literal, comment or directive can."""
    return "/*" in text or "\\\n" in text or 'R"' in text


def marked(text: str) -> str:
    return "\n".join([f"{_M0}{n}{_M1}{line}" for n, line in enumerate(text.split("\n"), 1)])


def _quoted_digits(text: str) -> str:
    if "'" in text and _digit_quote.search(text):
        return _quoted_number.sub(lambda m: m[0].replace("'", C._hide("'")), text)
    return text


def _hidden(piece: str) -> str:
    return piece.translate(_HIDE) if _is_literal.match(piece) else piece


def _line_part(match: re.Match) -> str:
    return match[1].translate(_HIDE) if match[1] else ""


def _kept(match: re.Match) -> str:
    """Of a token a literal, or the start of a comment, and its last mark."""
    token = match[0]
    kept = match[1] or ("/*" if token.startswith("/*") else "")
    at = token.rfind(_M0) if kept else -1
    return kept if at < 0 else kept + token[at : token.index(_M1, at) + 1]


def _branch_or_kept(match: re.Match) -> str:
    """``_kept``, or the first word of a branch directive."""
    directive = match[0].lstrip(" \t") if match[1] is None else ""
    word = _branch.match(directive) if directive.startswith("#") else None
    return word[0] if word else _kept(match)


def _lines_alone(text: str) -> str:
    """Marked text without comments and directives where none reaches over a line."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if "#" in line and _directive.match(line):
            line = ""
        elif '"' in line or "'" in line or "//" in line:
            line = _line_token.sub(_line_part, line)
        out.append(f"{_M0}{n}{_M1}{line}")
    return "\n".join(out)


def neutral(text: str) -> str:
    """``cpp_text.neutral_text`` of a plain text."""
    digits = "'" in text and _digit_quote.search(text)
    halves = "#" in text and _maybe_half.search(text)
    if not digits and not halves and not _reaches_over_lines(text):
        out = _lines_alone(text)
    else:
        out = _quoted_digits(marked(text))
        branches = halves and _has_halves.search(out)
        out = _token.sub(_branch_or_kept if branches else _kept, out)
        if '"' in out or "'" in out:
            out = "".join([_hidden(m[0]) for m in _piece.finditer(out)])
        out = out.replace("/*", " ")
    if "#" in out:
        out = one_half(out)
    if _after_brace.search(out):
        out = _braced.sub(r"\1\2", out)
    return out


def one_half(text: str) -> str:
    """``cpp_text.one_half``."""
    pieces = _halves.findall(text)
    # An open #if: braces its first half leaves open, those of the half at hand, whether a half
    # before left some, and the piece that the second half starts with.
    stack, gone = [[None, 0, False, -1]], bytearray(len(pieces))
    for i, piece in enumerate(pieces):
        found = _branch.match(piece)
        word = found[0][1:].lstrip(" \t") if found else ""
        net = piece.count("{") - piece.count("}")
        first, now, uneven, second = top = stack[-1]
        first, uneven = now if first is None else first, uneven or now != 0
        if word.startswith("if"):
            stack.append([None, net, False, -1])
        elif len(stack) > 1 and word.startswith("el"):
            stack[-1] = [first, net, uneven, i if second < 0 else second]
        elif len(stack) > 1 and word.endswith("endif"):
            if second >= 0 and uneven:
                gone[second:i] = b"\1" * (i - second)
            stack.pop()
            stack[-1][1] += first + net
        else:
            top[1] += net
    return _branch.sub("", "".join([p for p, dropped in zip(pieces, gone) if not dropped]))


def shown(text: str) -> str:
    if not text.isascii():
        text = text.translate(_SHOW)
    return _mark.sub("", text) if _M0 in text else text


def _hide_nested(text: str, opening: str, closing: str, depth: int) -> str:
    if text.count(opening) <= depth:
        return text
    pieces, level = _brackets[opening].split(text), 0
    for i in range(1, len(pieces), 2):
        after = level + 1 if pieces[i] == opening else max(level - 1, 0)
        if min(level, after) > 0:
            pieces[i] = C._hide(pieces[i])
        level = after
    return "".join(pieces)


def _shallow(segment: str) -> str:
    if segment.count("(") > C._PAREN_DEPTH or segment.count("<") > C._ANGLE_DEPTH:
        return _hide_nested(
            _hide_nested(segment, "(", ")", C._PAREN_DEPTH), "<", ">", C._ANGLE_DEPTH
        )
    return segment


def _last_line(text: str) -> int | None:
    at = text.rfind(_M0) + 1
    end = text.find(_M1, at)
    # A lead may end within a mark.
    return int(text[at:end]) if end > at else _int(text[at:])


def _int(digits: str) -> int | None:
    return int(digits) if digits.isdecimal() and digits.isascii() else None


def _last_code_line(segment: str) -> int | None:
    code = segment
    while True:
        code = code.rstrip(_BLANKS)
        if not code.endswith(_M1) or not code[(at := code.rfind(_M0)) + 1 : -1].isdecimal():
            break
        code = code[:at]
    if code == "":
        return _int(segment.split(_M1, 1)[0][1:])
    return _last_line(code)


def segments(text: str) -> list[str]:
    """``cpp_text.segments_of`` of a plain text."""
    text = neutral(text)
    if "enum" in text or "friend" in text:
        text = _enum_class.sub(r"\1", text)
    labels = "public" in text or "protected" in text or "private" in text
    pieces = _cut.split(text)
    if labels:
        pieces = _labels_cut(pieces)
    # Each segment but the first starts with the mark of its line.
    out, mark, end = [], "", len(pieces) - 1
    for i in range(0, end + 1, 2):
        piece = pieces[i]
        whole = f"{mark}{piece}{pieces[i + 1]}" if i < end else mark + piece
        if "class" in piece or "struct" in piece:
            whole = mark + _with_keywords(whole[len(mark) :], mark)
        out.append(whole)
        at = piece.rfind(_M0)
        if at >= 0:
            mark = piece[at : piece.rfind(_M1) + 1]
    return out


def _labels_cut(pieces: list[str]) -> list[str]:
    """Texts and what ends them by turns, cut behind access labels as well."""
    out = []
    for i in range(0, len(pieces), 2):
        piece = pieces[i]
        if ":" in piece and ("public" in piece or "protected" in piece or "private" in piece):
            out += _label.split(piece)
        else:
            out.append(piece)
        out += pieces[i + 1 : i + 2]
    return out


def _with_keywords(text: str, mark: str) -> str:
    """With the mark of its line before each class keyword."""
    out, done = [], 0
    for found in _keyword.finditer(text):
        here = text[done : found.start()]
        out.append(here)
        at = here.rfind(_M0)
        if at >= 0:
            mark = here[at : here.index(_M1, at) + 1]
        out.append(mark)
        done = found.start()
    out.append(text[done:])
    return "".join(out)


def _has_class_word(text: str) -> bool:
    return "\x02class" in text or "\x02struct" in text


def _without_templates(head: str) -> str:
    return _template.sub(" ", head) if "template" in head else head


def _mentions(head: str, opens: bool) -> list[tuple]:
    rest = _without_templates(head)
    if opens:
        rest = _class_head.sub("", rest)
    out = []
    for found in _mention.finditer(rest):
        m = found[0]
        out.append(
            (
                _mention_kind.search(m)[1],
                shown(_mention_name.search(m)[1]),
                _int(m[1 : m.index(_M1)]),
                _last_line(m),
            )
        )
    return out


def _block_kind(text: str, head: str) -> str | None:
    if "namespace" in text:
        if _unnamed.match(text):
            return "unnamed_namespace"
        if _namespace.match(text):
            return "namespace"
        return None
    if "extern" in head and _linkage.match(head):
        return "linkage"
    if "union" in text and _union.search(text):
        return "union"
    return None


def _function_parts(text: str) -> list[str] | None:
    if "(" not in text or _control.match(text):
        return None
    cut = _bodyless.sub("", text) if "=" in text else text
    if _statement.search(cut):
        return None
    found = _function.match(cut)
    parts = list(found.groups()[:4]) if found else [cut]
    if "\x04" in cut:
        parts = "\x04".join(parts).split("\x04")
    return parts if len(parts) == 4 else None


def _function_name(full: str) -> str | None:
    if "::" in full:
        found = _inner_name.match(full)
        return shown(found[1]) if found else ""
    if full.startswith("operator") and _operator.match(full):
        return None
    if "~" in full or ">" in full:
        full = _around_name.sub("", full)
    return shown(full)


def file_rows(text: str) -> tuple[list[tuple], int, int | None]:
    """Segments that matter of a plain text, their number with all others, and the last line of
    code.

    A row: pos, delim, kind, label, name, signature, is_static, plain_member, line_start,
    line_last, mentions.
    """
    cut, rows = segments(text), []
    for pos, segment in enumerate(cut):
        delim = segment[-1:]
        if delim == "}":
            if not _has_class_word(segment):
                rows.append((pos, delim, None, None, None, None, None, None, None, _last_line(segment), ()))
                continue
        elif delim not in "{:" or not delim:
            class_word = _has_class_word(segment)
            ends = ("default" in segment or "delete" in segment) and _defaulted.search(segment)
            if not class_word and not ends:
                continue
        rows.append((pos, *_header(segment, delim)))
    return rows, len(cut), _last_code_line(cut[-1])


def _header(segment: str, delim: str) -> tuple:
    """What is read off the header of a segment."""
    opens, ends = delim == "{", delim == ";"
    if opens or ends or _has_class_word(segment):
        segment = _shallow(segment)
    if delim not in ("{", "}", ";", ":"):
        delim, head = "", segment
    else:
        head = segment[:-1]
    line_last, kind, label, name, signature = _last_line(segment), None, None, None, None
    is_static = plain_member = line_start = None
    if delim == ":":
        found = _access.search(segment)
        label = found[1] if found else None
    class_word = _has_class_word(head)
    if opens or ends:
        lead = _lead.match(segment)[0]
        line_start = _last_line(lead)
        rest = head[len(lead) :]
        if _M0 in rest:
            rest = _mark.sub("", rest)
        match = _class_head.search(_without_templates(head)) if opens and class_word else None
        if match:
            found = _class_word.match(match[0])
            kind = found[1] if found else ""
            name = _blank_ends.sub("", shown(match[4] or ""))
            line_start = _int(_number.search(match[0])[0])
        else:
            block = _block_kind(rest, head) if opens else None
            parts = None
            if opens or _bodyless.search(rest):
                parts = _function_parts(rest)
            if block:
                kind = block
            elif parts:
                kind = "function" if opens else "bodyless"
            elif opens:
                kind = "other"
            if parts:
                prefix = parts[0]
                if "[" in prefix or "(" in prefix:
                    prefix = _attribute.sub(" ", prefix)
                result = _specifiers.sub("", prefix).strip(_BLANKS)
                name = _function_name(parts[2].strip(_BLANKS))
                declarator = (parts[1] + parts[2] + parts[3]).strip(_BLANKS)
                signature = shown(f"{result} {declarator}" if result else declarator)
                is_static = "static" in prefix and _static.search(prefix) is not None
                plain_member = _no_member.match(head) is None
    mentions = _mentions(head, opens) if class_word else ()
    return delim, kind, label, name, signature, is_static, plain_member, line_start, line_last, mentions


def include_texts(text: str) -> list[str]:
    """``cpp_text.include_texts`` of a plain text."""
    at = text.rfind("include")
    if at < 0:
        return []
    line_end = text.find("\n", at)
    top = text if line_end < 0 else text[:line_end]
    if _reaches_over_lines(top):
        tokens = (m[0] for m in _token.finditer(_quoted_digits(marked(text))))
        directives = [t for t in tokens if "#" in t and _directive.match(t)]
    else:
        directives = _include_line.findall(top)
    out = []
    for directive in directives:
        found = _include.match(directive)
        name = found[1] if found else ""
        if not name.endswith(('"', ">")):
            name = _blank_end.sub("", name)
        if name:
            out.append(shown(name))
    return out


def include_names(text: str) -> list[tuple[str, bool]]:
    return [(t.strip('<>"'), t.startswith("<")) for t in include_texts(text)]
