"""JavaScript imports by a lexer with state, as one fold over a file's lexemes in Column expressions.

What a slash, a brace or a quote means depends on what stands before it, so lexemes are cut without a meaning (words, runs of blanks, line ends,
escape pairs, ``${``, single characters) and a state goes over them from left to right. Words that have no part of their own in the state, with the blanks between
them, are one lexeme: each would leave the state as the last of them does, so a line of prose is a few steps, not two for each word. The state:

  m  mode: c code, s / d string, t template text, r regular expression, k class in one, l / b line and block comment
  k  open braces: '{' of code, '$' of a template's ``${``; a '}' that closes a '$' goes back into the template's text
  p  the last significant lexeme of code: o operator or keyword (a slash begins a regular expression), v value (it divides), '.'
  l  the lexeme before, whatever it is
  i  import: i after ``import``, j in its clause, f after ``from``; q after ``require``, a in its arguments
  d  brackets open in the arguments
  a  the argument so far: n nothing, s one string, x anything else
  c  characters of the string
  o  modules found

Only ``import`` and ``require`` begin a search for a module, so when the last of them is over (i is empty) nothing more is found: the fold goes over a file's
text up to there, and over the whole of it only if REACH characters after the last one are not enough.

A regular expression, and a string in single or double quotes, ends at the line's end at the latest, as an error in the text would else hide the rest.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words after which a slash begins a regular expression.
KEYWORDS = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "yield", "await")
_LETTER = r"(?:[\p{L}\p{N}_]|\$(?!\{))"
_PLAIN = "(?!(?:" + "|".join(("import", "require", "from", *KEYWORDS)) + ")(?!" + _LETTER + "))" + _LETTER + "++"
LEXEME = r"\\[\s\S]|\$\{|" + _PLAIN + r"(?:[ \t\f\x0B]++" + _PLAIN + ")*+|" + _LETTER + r"++|[ \t\f\x0B]+|\r\n|[\s\S]"

#: Characters after the last ``import`` or ``require`` in which its import is looked for first.
REACH = 200
#: The text up to REACH characters after the last word that may be one of the two: whole words, also right after an escape pair.
BEGINNING = r"(?s)^.*(?=[ir])(?:(?<![\p{L}\p{N}_$])|(?<=\\.))(?:import|require)(?!" + _LETTER + ").{0," + str(REACH) + "}"


def _case(*pairs: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs) + f" ELSE {otherwise} END"


def _step() -> str:
    """The next state, in terms of the state ``s`` and the lexeme ``t`` (with its kind: w word, b blank, n line end, x other)."""
    code, word, quote = "s.m = 'c'", "t.k = 'w'", "t.t IN ('\\'', '\"')"
    comment = "t.t IN ('/', '*') AND s.l = '/'"  # after a slash of code, or of what seemed to begin a regular expression
    ends = "(s.m = 's' AND t.t = '\\'' OR s.m = 'd' AND t.t = '\"')"
    broken = "s.m IN ('s', 'd', 'r', 'k', 'l') AND t.k = 'n'"
    mode = _case(
        (broken, "'c'"),
        (f"s.m IN ('c', 'r') AND {comment}", "if(t.t = '/', 'l', 'b')"),
        (code, _case(("t.t = '\\''", "'s'"), ("t.t = '\"'", "'d'"), ("t.t = '`'", "'t'"),
                     ("t.t = '/' AND s.p = 'o' AND s.l <> '<'", "'r'"), ("t.t = '}' AND right(s.k, 1) = '$'", "'t'"), otherwise="'c'")),
        (f"{ends} OR s.m = 't' AND t.t IN ('`', '${{') OR s.m = 'r' AND t.t = '/' OR s.m = 'b' AND t.t = '/' AND s.l = '*'", "'c'"),
        ("s.m = 'r' AND t.t = '['", "'k'"), ("s.m = 'k' AND t.t = ']'", "'r'"), otherwise="s.m")
    braces = _case((f"{code} AND t.t = '{{'", "concat(s.k, '{')"), ("s.m = 't' AND t.t = '${'", "concat(s.k, '$')"),
                   (f"{code} AND t.t = '}}'", "left(s.k, length(s.k) - 1)"), otherwise="s.k")
    words = ", ".join(f"'{w}'" for w in KEYWORDS)
    previous = _case(
        (f"s.m IN ('c', 'r') AND {comment}", "if(s.m = 'c', 'v', 'o')"),  # the comment's slash was taken for a division, or not
        (f"{ends} OR s.m = 't' AND t.t = '`' OR s.m = 'r' AND t.t = '/'", "'v'"),
        ("s.m = 't' AND t.t = '${'", "'o'"),
        (f"NOT ({code}) OR t.k IN ('b', 'n') OR {quote}", "s.p"),
        (word, f"if(t.t IN ({words}) AND s.p <> '.', 'o', 'v')"),
        ("t.t IN (')', ']') OR t.t IN ('+', '-') AND s.l = t.t OR t.t = '/' AND s.l = '<'", "'v'"), ("t.t = '.'", "'.'"), otherwise="'o'")
    # lexemes that say nothing about an import: blanks, and slashes and stars that may belong to a comment
    still = f"NOT ({code}) OR t.k IN ('b', 'n') OR t.t = '/' OR t.t = '*' AND s.l = '/' OR {quote}"
    closes = "s.i = 'a' AND s.d = 0 AND t.t IN (',', ')')"
    state = _case(
        (ends, _case(("s.i IN ('a', 'j')", "s.i"), otherwise="''")),
        (still, "s.i"),
        (f"{word} AND s.p <> '.' AND t.t = 'import'", "'i'"), (f"{word} AND s.p <> '.' AND t.t = 'require'", "'q'"),
        ("s.i = 'a'", _case(("s.d = 0 AND t.t = ')'", "''"), otherwise="'a'")),
        ("s.i IN ('i', 'j') AND (t.t IN ('{', '*') OR t.k = 'w')", "if(s.i = 'j' AND t.t = 'from', 'f', 'j')"),
        ("s.i = 'j' AND t.t IN ('}', ',')", "'j'"), ("s.i = 'f' AND t.t = 'from'", "'f'"), ("s.i = 'q' AND t.t = '('", "'a'"), otherwise="''")
    depth = _case((f"NOT ({code}) OR s.i <> 'a'", "0 + if(s.i = 'a', s.d, 0)"), ("t.t IN ('(', '[', '{')", "s.d + 1"),
                  ("t.t IN (')', ']', '}') AND s.d > 0", "s.d - 1"), otherwise="s.d")
    argument = _case(
        ("s.i <> 'a'", "'n'"), (f"{ends}", "if(s.d = 0 AND s.a = 'n', 's', 'x')"), (still, "if(s.m = 't', 'x', s.a)"),
        ("s.d = 0 AND t.t = ','", "'n'"), otherwise="'x'")
    text = _case((f"{code} AND {quote}", "if(s.i = 'a' AND s.a <> 'n', s.c, '')"), (f"s.m IN ('s', 'd') AND NOT {ends} AND NOT (s.i = 'a' AND s.a <> 'n')", "concat(s.c, t.t)"), otherwise="s.c")
    found = _case((f"{ends} AND s.i IN ('i', 'f') OR {code} AND {closes} AND s.a = 's'", "concat(s.o, array(s.c))"), otherwise="s.o")
    last = _case((f"s.m IN ('c', 'r') AND {comment}", "''"), otherwise="t.t")
    fields = {"m": mode, "k": braces, "p": previous, "l": last, "i": state, "d": depth, "a": argument, "c": text, "o": found}
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def lexemes(content: Column) -> Column:
    """array<struct<k, t>>: the lexemes of a text with their kinds."""
    first = lambda t: F.substring(t, 1, 1)
    kind = lambda t: (F.when(t.rlike(r"^[\p{L}\p{N}_$]") & (t != "${"), "w").when(first(t).isin(" ", "\t", "\f", "\x0b"), "b")
                      .when(first(t).isin("\n", "\r", "\u2028", "\u2029"), "n").otherwise("x"))
    return F.transform(F.regexp_extract_all(content, F.lit(LEXEME), F.lit(0)), lambda t: F.struct(kind(t).alias("k"), t.alias("t")))


def beginning(content: str) -> Column:
    """The text up to REACH characters after its last ``import`` or ``require``; empty without one."""
    return F.regexp_extract(content, BEGINNING, 0)


def _folded(lexeme_column: str) -> Column:
    """struct<i, o>: the import that is open after the lexemes, and the modules found."""
    start = "named_struct('m', 'c', 'k', '', 'p', 'o', 'l', '', 'i', '', 'd', 0, 'a', 'n', 'c', '', 'o', cast(array() as array<string>))"
    return F.expr(f"aggregate({lexeme_column}, {start}, (s, t) -> {_step()}, s -> named_struct('i', s.i, 'o', s.o))")


def _unquoted(found: Column) -> Column:
    return F.transform(found, lambda m: F.regexp_replace(m, F.lit("^[\"']+|[\"']+$"), F.lit("")))


def modules(lexeme_column: str) -> Column:
    """The modules that a file's lexemes import, in order: array<string>."""
    return _unquoted(_folded(lexeme_column)["o"])


def settled_modules(lexeme_column: str) -> Column:
    """``modules`` of the lexemes of a file's ``beginning``, null if an import is still open at its end.

    The last lexeme may be cut short by that end, so it has no part in this; the others are those of the whole text, or the first words of one of its lexemes.
    """
    folded = _folded(f"slice({lexeme_column}, 1, greatest(size({lexeme_column}) - 1, 0))")
    return F.get(F.transform(F.filter(F.array(folded), lambda f: f["i"] == ""), lambda f: _unquoted(f["o"])), F.lit(0))
