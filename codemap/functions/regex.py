"""Regular expressions of the import extraction (JVM) and the whitespace class shared with the oracle.

Python sources are read left to right by one ordered alternation, so a comment hides a quote and a string hides a comment,
whichever starts first. JavaScript needs a state as well: see ``functions.js_lexer``.
"""
from __future__ import annotations

IDENT = r"[\p{L}_][\p{L}\p{N}_]*"
DOTTED = IDENT + r"(?:\." + IDENT + r")*"
DOTTED_FULL = "^" + DOTTED + "$"

# Line ends as Python reads them, and a backslash at the end of a line.
LINE_END = r"\r\n?"
CONTINUATION = "\\\n"

# Python strings (with escapes; unclosed ones end nowhere and are no string) and comments. The look-ahead leaves all other characters at once.
PY_STRING_OR_COMMENT = (r"(?=[\"'#])(?:" r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""' + r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
                        r'|"(?:[^"\\\n]++|\\.)*+"' + r"|'(?:[^'\\\n]++|\\.)*+'|#[^\n]*)")
PY_ITEM = DOTTED + r"(?:[ \t]+as[ \t]+" + IDENT + ")?"
# A statement starts a line, or follows ';' or the ':' of a one-line compound statement.
PY_STATEMENT = (r"(?md)(?:^|[;:])[ \t]*(?:import[ \t]+" + PY_ITEM + r"(?:[ \t]*,[ \t]*" + PY_ITEM + r")*[ \t]*(?=;|$)"
                r"|from(?:[ \t]+|(?=\.))\.*[ \t]*(?:" + DOTTED + r"[ \t]+)?import\b[ \t]*(?:\([^)]*\)|[^\n(;][^\n;]*))")
PY_IS_FROM = r"(?md)^[;: \t]*from\b"
PY_IMPORT_LIST = r"(?md)^[;: \t]*import[ \t]+([^\n]*)"
# group 1 = leading dots, 2 = module, 3 = list (a parenthesised list may span lines)
PY_FROM_PARTS = r"(?d)from[ \t]*(\.*)[ \t]*(?:(" + DOTTED + r")[ \t]+)?import\b[ \t]*([\s\S]*)"
PY_LIST_NOISE = r"[()]"
EDGE_SPACE = r"^[ \t\r\n]+|[ \t\r\n]+$"

# Whitespace as Python's str.split() sees it (fixed set of code points).
PY_WHITESPACE = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
