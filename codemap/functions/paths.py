"""Column expressions over file paths (extension, skip, signal, noise, penalty, language).

All helpers take and return ``Column`` objects so they stay inside whole-stage codegen.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def extension(path) -> Column:
    """'.' + text after the last '.' of the whole path; '' when there is no dot."""
    p = _col(path)
    return F.when(F.instr(p, ".") > 0, F.concat(F.lit("."), F.substring_index(p, ".", -1))).otherwise(F.lit(""))


def filename(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path) -> Column:
    """Everything before the last '/', '' for a root-level file."""
    p = _col(path)
    return F.when(F.instr(p, "/") > 0, p.substr(F.lit(1), F.length(p) - F.length(filename(p)) - 1)
                  ).otherwise(F.lit(""))


def depth(path) -> Column:
    """Number of '/' characters."""
    p = _col(path)
    return F.length(p) - F.length(F.regexp_replace(p, "/", ""))


def top_folder(path) -> Column:
    return F.substring_index(_col(path), "/", 1)


def should_skip(path) -> Column:
    """Any path part (the file name included) is a skip dir, or the extension is skipped. Case-sensitive."""
    p = _col(path)
    return F.arrays_overlap(F.split(p, "/"), _lits(K.SKIP_DIRS)) | extension(p).isin(K.SKIP_EXTENSIONS)


def is_signal(path) -> Column:
    return filename(path).isin(K.SIGNAL_FILENAMES)


def is_pinned(path) -> Column:
    return F.lower(filename(path)).isin(K.ALWAYS_FETCH_FILENAMES)


def is_noise(path) -> Column:
    """Lower-cased: a directory part (not the file name) is a noise dir, or the file name is test-like."""
    low = F.lower(_col(path))
    parts = F.split(low, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    fn = F.substring_index(low, "/", -1)
    conds = [F.arrays_overlap(dirs, _lits(K.NOISE_DIRS))]
    conds += [fn.startswith(x) for x in K.NOISE_FILE_PREFIXES]
    conds += [fn.endswith(x) for x in K.NOISE_FILE_SUFFIXES]
    conds += [fn.isin(K.NOISE_FILES)]
    return any_of(conds)


def path_penalty(path) -> Column:
    """0.2 when a penalised substring occurs in the lower-cased path, else 0.5 for doc/config suffixes, else 1."""
    low = F.lower(_col(path))
    strong = any_of([low.contains(s) for s in K.PENALTY_SUBSTRINGS])
    weak = any_of([low.endswith(s) for s in K.PENALTY_SUFFIXES])
    return (F.when(strong, F.lit(K.PENALTY_STRONG))
            .when(weak, F.lit(K.PENALTY_WEAK))
            .otherwise(F.lit(1.0)))


def language(path) -> Column:
    """Language name of the (whole-path) extension, null when unknown."""
    pairs = []
    for ext, lang in K.EXTENSION_TO_LANGUAGE:
        pairs += [F.lit(ext), F.lit(lang)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def ends_with_any(c, suffixes) -> Column:
    c = _col(c)
    return any_of([c.endswith(s) for s in suffixes])
