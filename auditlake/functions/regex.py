"""Check that a rule's pattern means the same to Java, and spell it for Java.

Rules are written in the linear-time dialect (no look-around, no back-references), but Java
backtracks: a repeated choice of single characters is spelled as a class, which it repeats in a
loop, and an unbounded repeat of a group with alternatives or repeats inside, which it follows by
recursion, is refused. Patterns outside the common subset are rejected by name rather than silently read differently.
"""

from __future__ import annotations

import re
import warnings
from re import _parser

# POSIX class names and what Java calls them.
POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl",
    "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct",
    "space": "Space", "upper": "Upper", "word": "Word", "xdigit": "XDigit",
}
GENERAL_CATEGORIES = re.compile(r"L[ultmo]?|M[nce]?|N[dlo]?|P[cdseifo]?|S[mcko]?|Z[slp]?|C[cfosn]?")
ASCII_BOUNDARY = (
    "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
)
ASCII_NOT_BOUNDARY = (
    "(?:(?<![0-9A-Za-z_])(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_]))"
)
MAX_REPEAT = 1000

_PIECE = re.compile(
    r"(?P<prop>\\[pP](?:\{\^?\w+\}|[A-Z]))"
    r"|(?P<quote>\\Q(?:.|\n)*?(?:\\E|\Z))"
    r"|(?P<hex>\\x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2}))"
    r"|(?P<esc>\\(?:.|\n))"
    r"|(?P<posix>\[:\^?\w+:\])"
    r"|(?P<cls>\[\^?\]?)"
    r"|(?P<group>\(\?(?:P?<\w+>|[imsU]*(?:-[imsU]+)?[:)]|.?.?))"
    r"|(?P<rep>\{\d+(?:,\d*)?\}[?+]?|[*+?][?+]?)"
    r"|(?P<char>(?:.|\n))"
)


class PatternError(ValueError):
    """The pattern does not compile, or is outside the supported dialect."""


def _escape(token: str, inside_class: bool) -> str:
    body = token[1]
    if body == "b" and not inside_class:
        return ASCII_BOUNDARY
    if body == "B" and not inside_class:
        return ASCII_NOT_BOUNDARY
    if body == "z" and not inside_class:
        return r"\z"
    if body == "s":
        return r"\t\n\f\r " if inside_class else r"[\t\n\f\r ]"
    if body == "S" and not inside_class:
        return r"[^\t\n\f\r ]"
    if body in "dDwWafnrtv" or (body == "A" and not inside_class):
        return {"v": r"\x0B"}.get(body, token)
    if body.isalnum():
        raise PatternError(f"unsupported escape {token}")
    return token


def _property(token: str) -> str:
    name = token[2:].strip("{}")
    negate = name.startswith("^")
    name = name.lstrip("^")
    head = "\\P" if (token[1] == "P") != negate else "\\p"
    return f"{head}{{{name}}}" if GENERAL_CATEGORIES.fullmatch(name) else f"{head}{{Is{name}}}"


def _group(token: str) -> str:
    if re.fullmatch(r"\(\?P?<\w+>", token):
        return "(?:"
    if not re.fullmatch(r"\(\?[ims]*(?:-[ims]+)?[:)]", token):
        raise PatternError(f"unsupported group {token}")
    flags = token[2:-1]
    on = flags.split("-")[0]
    return "(?" + flags.replace("i", "iu", 1) + token[-1] if "i" in on else token


def _repeat(token: str) -> str:
    counts = [int(n) for n in re.findall(r"\d+", token)]
    if any(n > MAX_REPEAT for n in counts):
        raise PatternError("repeat count above 1000")
    if len(counts) == 2 and counts[0] > counts[1]:
        raise PatternError(f"bad repeat {token}")
    if token.endswith("+") and len(token) > 1:
        raise PatternError("possessive quantifier")
    return token


def has_boundary(pattern: str) -> bool:
    return ASCII_BOUNDARY in to_java(pattern) or ASCII_NOT_BOUNDARY in to_java(pattern)


def without_boundaries(pattern: str) -> str:
    """Java spelling with word boundaries left out: matches at least what the pattern does."""
    return to_java(pattern).replace(ASCII_BOUNDARY, "(?:)").replace(ASCII_NOT_BOUNDARY, "(?:)")


def _one_of(group: list[str]) -> list[str]:
    """A group of single characters, spelled as one class; other groups stay as they are."""
    if group[0] not in ("(", "(?:"):
        return group
    parts, inside = [""], False
    for token in group[1:-1]:
        inside = token in ("[", "[^", "[\\]", "[^\\]") or inside and token != "]"
        if token == "|" and not inside:
            parts.append("")
        else:
            parts[-1] += token
    # One character, an escape of one, or a class without another inside.
    single = re.compile(r"[^\\.^$()\[\]{}*+?]|\\[^0-9A-Za-z]|\\[dDwWtnrfa]|\\x(?:[0-9A-F]{2}|\{[0-9A-F]+\})|\\[pP]\{\w+\}|\[[^\[\]\\]+\]", re.I)
    if not all(single.fullmatch(p) for p in parts):
        return group
    return ["[" + "".join("\\" + p if p in ("&", "-") else p for p in parts) + "]"]


def _recurses(tree, repeated: bool = False) -> bool:
    """Whether an unbounded repeat holds alternatives or repeats of its own."""
    for kind, value in tree:
        name = str(kind)
        if name == "BRANCH":
            if repeated or any(_recurses(t) for t in value[1]):
                return True
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            if repeated and low != high or _recurses(inner, repeated or high > MAX_REPEAT):
                return True
        elif name == "SUBPATTERN":
            if _recurses(value[-1], repeated):
                return True
        elif name in ("ASSERT", "ASSERT_NOT"):
            if _recurses(value[1]):
                return True
    return False


def to_java(pattern: str) -> str:
    """Java spelling of ``pattern``; raises PatternError when there is none."""
    out, depth, inside, repeatable, opened = [], 0, False, False, []
    for piece in _PIECE.finditer(pattern):
        kind, token = piece.lastgroup, piece.group()
        if inside:
            if kind == "char" and token == "]":
                inside, repeatable = False, True
                out.append("]")
            elif kind == "posix":
                name = token[2:-2]
                if name.lstrip("^") not in POSIX:
                    raise PatternError(f"unknown class {token}")
                out.append(("\\P" if name[0] == "^" else "\\p") + f"{{{POSIX[name.lstrip('^')]}}}")
            elif kind == "prop":
                out.append(_property(token))
            elif kind == "hex":
                out.append(token)
            elif kind == "esc":
                out.append(_escape(token, True))
            elif kind == "cls":
                # A plain '[' is a literal; a closing bracket right after it ends the class.
                out.append("\\[" + ("\\^" if "^" in token else ""))
                if token.endswith("]"):
                    inside, repeatable = False, True
                    out.append("]")
            else:
                out.append("".join("\\&" if c == "&" else c for c in token))
            continue
        if kind == "rep":
            if not repeatable:
                raise PatternError(f"nothing to repeat before {token}")
            if opened and opened[-1][1] == len(out):
                out[opened[-1][0] :] = _one_of(out[opened[-1][0] :])
            out.append(_repeat(token))
            repeatable = False
            continue
        repeatable = True
        if kind == "cls":
            inside = True
            out.append("[" + ("^" if "^" in token else "") + ("\\]" if token.endswith("]") else ""))
        elif kind == "posix":
            raise PatternError("POSIX class outside a bracket")
        elif kind == "prop":
            out.append(_property(token))
        elif kind == "quote":
            out.append(re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", token[2:].removesuffix("\\E")))
        elif kind == "hex":
            out.append(token)
        elif kind == "esc":
            out.append(_escape(token, False))
        elif kind == "group":
            out.append(_group(token))
            if token.endswith(")"):
                repeatable = False
            else:
                depth, repeatable = depth + 1, False
                opened.append([len(out) - 1, -1])
        elif token == "(":
            out.append(token)
            depth, repeatable = depth + 1, False
            opened.append([len(out) - 1, -1])
        elif token == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unexpected )")
            out.append(token)
            # The last entry is the group that ended last, and where.
            ended = next(k for k in range(len(opened) - 1, -1, -1) if opened[k][1] < 0)
            opened[ended:] = [[opened[ended][0], len(out)]]
        else:
            if token == "\\":
                raise PatternError("trailing backslash")
            if token in "|":
                repeatable = False
            out.append("\\" + token if token in "{}" else token)
    if inside:
        raise PatternError("missing ]")
    if depth:
        raise PatternError("missing )")
    return "".join(out)


def problem(pattern: str) -> str | None:
    """Why the pattern is refused, or None."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)  # a class inside a class, as Java reads it
        return _problem(pattern)


def _problem(pattern: str) -> str | None:
    try:
        probe = re.sub(r"\\[pPx]\{\w+\}", "x", to_java(pattern)).replace(r"\z", "$")
        probe = re.sub(r"\(\?[imsu-]+:", "(?:", re.sub(r"\(\?[imsu-]+\)", "", probe))
        re.compile(probe)
        # Java would follow such a repeat by recursion, once for each turn, and may try every split.
        if _recurses(_parser.parse(probe)):
            return "alternatives or repeats inside an unbounded repeat"
    except PatternError as error:
        return str(error)
    except (re.error, OverflowError) as error:
        return str(error)
    return None


def required_literal(pattern: str) -> str:
    """A text every match contains ('' if none is evident): a cheap test before the pattern.

    Only plain characters outside groups count, and none after an alternation or a flag.
    """
    best, run, depth, inside = "", "", 0, False
    for piece in _PIECE.finditer(pattern):
        kind, token = piece.lastgroup, piece.group()
        if inside:
            inside = token != "]" and not (kind == "cls" and token.endswith("]"))
            continue
        if token == "|" or (kind == "group" and "i" in token):
            return ""
        plain = kind == "char" and depth == 0 and token not in ".^$()[]"
        if kind == "esc" and depth == 0 and not token[1].isalnum():
            plain, token = True, token[1]
        if plain:
            run += token
            continue
        if kind == "rep":
            # The repeated character may be missing or repeated, so it ends the run.
            run = run[:-1] if not token.startswith("+") else run
        best, run = max(best, run, key=len), ""
        inside = kind == "cls"
        depth += token == "(" or (kind == "group" and not token.endswith(")"))
        depth -= token == ")"
    return max(best, run, key=len)


def keyword_trie(keywords) -> str:
    """One pattern that finds the longest keyword at a position, sharing common prefixes."""
    root: dict = {}
    for word in keywords:
        node = root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def quote(char: str) -> str:
        return char if char.isalnum() or char == " " else "\\" + char

    def render(node: dict) -> str:
        run = ""
        while len(node) == 1 and "" not in node:
            char, node = next(iter(node.items()))
            run += quote(char)
        ends = "" in node
        branches = [quote(c) + render(child) for c, child in node.items() if c != ""]
        if not branches:
            return run
        body = "|".join(branches)
        return f"{run}(?:{body})?" if ends else f"{run}(?:{body})"

    return render(root)
