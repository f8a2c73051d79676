"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought into a canonical form: lower case, one space for every run of anything but letters and digits, no copyright statements, and
spellings that guidelines for licence matching treat as equal (over the joined words, so a phrase may be broken between lines).
What a statement names as holder ends with its line or sentence, which re-wrapping moves. So a text has two digests: one without the lines, and the first sentences of
lines, that only state a copyright; and one of all its words less the words "copyright", its sign, years and reserved rights, which does not depend on
lines at all. Either is looked up among the same digests of known licence texts by a hash join; the digest of every line
among those of known one-line notices. Texts are never shuffled: only digests leave a row, and the table of known digests is
as long as the list of licences (Spark broadcasts it if its size allows, else it is a shuffled join).
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, named
from codemap.llm.licence_texts import NOTICES, TEXTS

#: Words that follow "copyright" in sentences, also where a licence's lines are broken before it; a holder's name begins with none of them.
NOT_HOLDERS = ("holder holders owner owners owned ownership notice notices law laws line interest interests disclaimer treaty permission license licenses licence statement statements patent "
               "doctrines resulting and or on those then of more like including if are also the by to in is for from as that this which will must may shall with without "
               "infringement protection protected act claims terms information registration rights work works material").split()


def _other_word(words: list[str], first: bool = True) -> str:
    """A pattern for every word of a-z and 0-9 but these, without lookahead, which not every engine has."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    runs = re.findall(r"\w+", "".join(" " if c in heads else c for c in "abcdefghijklmnopqrstuvwxyz"))
    rest = "".join(r if len(r) < 3 else f"{r[0]}-{r[-1]}" for r in runs) + "0-9"
    found = "(" + "|".join([f"[{rest}][a-z0-9]*"] + [h + _other_word(r, False) for h, r in sorted(heads.items())]) + ")"
    return found if first or "" in words else found + "?"


_HOLDER_ENDS = "(19|20)[0-9]{2}|present|authors|contributors|developers|maintainers|inc|incorporated|ltd|limited|llc|gmbh|corp|corporation|foundation|university"
#: A line that only states a copyright, or reserves all rights: a word or sign, then a sign, a year or a placeholder and up to twenty words; a holder's name in
#: a line of up to a dozen words; "the" or "by" and what ends as a name or with a year; "(c)" alone only where a year or name ends the line.
COPYRIGHT_LINE = (r"^[^a-z0-9©]*((copyright|©|\(c\))[^a-z0-9©]*(copyright|©|\(c\)|[0-9]{4}|[<\[][a-z0-9]*)([^a-z0-9]+[a-z0-9]+){0,20}[^a-z0-9]*$|all rights reserved[^a-z0-9]*$"
                  rf"|(copyright|©)[^a-z0-9©]+{_other_word(NOT_HOLDERS)}([^a-z0-9]+[a-z0-9]+){{0,11}}[^a-z0-9]*$"
                  r"|(copyright|©)[^a-z0-9©]*[À-῿぀-퟿][^a-z0-9]*$"
                  rf"|((copyright|©)[^a-z0-9©]+(the|by)|\(c\))([^a-z0-9]+[a-z0-9]+){{0,12}}[^a-z0-9]+({_HOLDER_ENDS})([^a-z0-9]+all rights reserved)?[^a-z0-9]*$)")
#: What a line must contain to be looked at for a statement.
COPYRIGHT_SIGNS = ("copyright", "©", "(c)", "all rights reserved")
#: A line with this says more than who holds the copyright.
NAMES_LICENCE = "licen"
#: A statement that is the first sentence of a line which goes on.
COPYRIGHT_HEAD = r"^[^a-z0-9©]*((copyright|©|\(c\))[^a-z0-9©]*)+[0-9]{4}[^.]{0,80}[.][ \t]+(all rights reserved[.]?[ \t]+)?"
#: Words of a statement that are left out wherever they stand, in a text of words and single spaces.
COPYRIGHT_WORDS = r"\b(copyright|c)( (copyright|c))*( [0-9]{4})+( present)?\b|\ball rights reserved\b"
#: Equivalent spellings, as (pattern, replacement) on lower-case text; fixed values.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("licencor", "licensor"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("capitalisation", "capitalization"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favourite", "favorite"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("https", "http"),
)
ANY_SPELLING = "|".join(a for a, _ in SPELLINGS)
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(low: Column) -> Column:
    """The words of a lower-case text, with single spaces."""
    return F.trim(F.regexp_replace(low, NOT_WORD, " "))


def spelled(words: Column, any_: Column) -> Column:
    """Words with equivalent spellings made one, where ``any_`` (some spelling may be there) holds."""
    done = words
    for old, new in SPELLINGS:
        done = F.replace(done, F.lit(old), F.lit(new))
    return F.when(any_, done).otherwise(words)


def lines_of(text: Column) -> Column:
    """For each line, its words (w) and those that are left without a copyright statement (left); of null, one empty line."""
    low = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
    signed = lambda line: reduce(lambda a, b: a | b, [line.contains(sign) for sign in COPYRIGHT_SIGNS])
    left = lambda line: F.when(~line.contains(NAMES_LICENCE) & line.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(words_of(F.regexp_replace(line, F.lit(COPYRIGHT_HEAD), F.lit(""))))
    worded = F.transform(low, lambda line: F.struct(line.alias("line"), words_of(line).alias("w")))
    return F.transform(worded, lambda x: F.struct(x["w"].alias("w"), F.when(signed(x["line"]), left(x["line"])).otherwise(x["w"]).alias("left")))


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def prepared(texts: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The kept columns, the ``lines`` of a text, all its ``words``, and whether any spelling is among them (``any_spelling``).

    Each goes through a generator, so that what follows sees an attribute and no expression is worked out twice.
    """
    lines = texts.select(*keep, F.inline(F.array(F.struct(lines_of(text).alias("lines")))))
    words = lines.select(*keep, "lines", F.inline(F.array(F.struct(_joined(F.transform("lines", lambda x: x["w"])).alias("words")))))
    spellings = F.array(*(F.lit(old) for old, _ in SPELLINGS))
    found = F.exists(spellings, lambda old: F.col("words").contains(old))
    return words.select(*keep, "lines", "words", F.inline(F.array(F.struct(found.alias("any_spelling")))))


def digests() -> tuple[Column, Column]:
    """The two digests of rows of ``prepared``: without statements by line and sentence, and by words alone. Most texts state no copyright: both are that of their words."""
    words, any_ = F.col("words"), F.col("any_spelling")
    stated = F.exists("lines", lambda x: x["left"] != x["w"])
    bare = F.trim(F.regexp_replace(F.regexp_replace(words, F.lit(COPYRIGHT_WORDS), F.lit(" ")), F.lit(" +"), F.lit(" ")))
    signed = words.contains("copyright") | words.contains(" c ") | words.startswith("c ") | words.contains("all rights reserved")
    first = F.when(stated, spelled(_joined(F.transform("lines", lambda x: x["left"])), any_)).otherwise(spelled(words, any_))
    return F.md5(first), F.md5(spelled(F.when(signed, bare).otherwise(words), any_))


def known(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(kind, digest, licence_id) of texts: licence id -> its forms; both digests, as kinds 1 and 2. Equal digests give the smallest id."""
    given = [(name, form) for name, forms in (TEXTS if texts is None else texts).items() for form in forms]
    frame = prepared(spark.createDataFrame(given, "licence_id string, text string"), F.col("text"), "licence_id")
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), d.alias("digest")) for i, d in enumerate(digests(), 1))))
    return frame.select("licence_id", kinds.alias("k")).groupBy("k.kind", "k.digest").agg(F.min("licence_id").alias("licence_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, list[str]] | None = None,
         notices: dict[str, list[str]] | None = None) -> DataFrame:
    """(id_col, digest, licence_id, notices) of every row.

    licence_id names the licence that the whole text is, else null; notices the ids of one-line notices in it,
    sorted and comma-joined. A null or empty text, or one of copyright lines only, has the digest of the empty text and no licence.
    Repeated rows and null ids each give their row; other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "licences")
    source = prepared(docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")), F.col("text"), "id")
    first, second = digests()
    line = lambda x: spelled(x["left"], F.col("any_spelling") & x["left"].rlike(ANY_SPELLING))
    each = F.transform(F.filter("lines", lambda x: x["left"] != ""), lambda x: F.md5(line(x)))
    found_digests = scratch.keep(source.select("id", first.alias("digest"), second.alias("bare"), each.alias("each")), "digests")
    whole, lines = known(spark, texts), known(spark, NOTICES if notices is None else notices)
    empty = F.md5(F.lit(""))
    found = (found_digests.select("digest", F.explode("each").alias("line")).join(lines.filter("kind = 1").select(F.col("digest").alias("line"), "licence_id"), "line")
             .groupBy("digest").agg(F.array_join(F.sort_array(F.collect_set("licence_id")), ",").alias("notices")))
    whole = whole.filter(F.col("digest") != empty)
    by_line = whole.filter("kind = 1").select("digest", F.col("licence_id").alias("by_line"))
    by_word = whole.filter("kind = 2").select(F.col("digest").alias("bare"), F.col("licence_id").alias("by_word"))
    named_ = found_digests.select("id", "digest", "bare").join(by_line, "digest", "left").join(by_word, "bare", "left")
    return (named_.join(scratch.keep(found, "found"), "digest", "left")
            .select(F.col("id").alias(id_col), "digest", F.coalesce("by_line", "by_word").alias("licence_id"), F.coalesce("notices", F.lit("")).alias("notices")))
