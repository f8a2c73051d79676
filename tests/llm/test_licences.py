import hashlib
import re
import textwrap
from pathlib import Path

import regex

from codemap.llm import licences
from codemap.llm.licence_texts import NOTICES, TEXTS

MIT = TEXTS["MIT"][0]
CASES = [
    MIT, "MIT LICENCE\n\nCopyright (c) 2019 A. Nother\nAll rights reserved.\n\n" + MIT, "/* " + MIT.replace(". ", ".\n * ").upper() + " */",
    MIT + " extra", TEXTS["Zlib"][0].replace("acknowledgment", "acknowledgement"), "Copyright 2020 X", "", None, " \n\t",
    "text before\n// Released under the MIT licence.\n# SPDX-License-Identifier: ISC\nLicensed under CC BY-NC 4.0", "Released under the MIT License. And more.",
    "copyright holders may sue", "é ü 中 organisation", "x" * 300_000, TEXTS["BSD-3-Clause"][1].replace("\n", "\r\n"),
]


def plain(text):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text).strip(" ")


def spell(words):
    for a, b in licences.SPELLINGS:
        words = words.replace(a, b)
    return words


def canonical(text):
    """The words of each line without a copyright statement."""
    out = []
    for line in (text or "").lower().split("\n"):
        if "licen" in line or not re.search(licences.COPYRIGHT_LINE, line):
            out.append(plain(re.sub(licences.COPYRIGHT_HEAD, "", line)))
    return [w for w in out if w]


def bare(text):
    """All words, whatever the lines."""
    out, words, i = [], plain((text or "").lower()).split(), 0
    while i < len(words):
        j = i
        while j < len(words) and words[j] in ("copyright", "c"):
            j += 1
        k = j
        while k < len(words) and re.fullmatch("[0-9]{4}", words[k]):
            k += 1
        if j > i and k > j:
            i = k + (words[k:k + 1] == ["present"])
        elif words[i:i + 3] == ["all", "rights", "reserved"]:
            i += 3
        else:
            out.append(words[i])
            i += 1
    return spell(" ".join(out))


def brute(text):
    key = lambda t: hashlib.md5(t.encode()).hexdigest()
    lines, whole = canonical(text), lambda t: spell(" ".join(canonical(t)))
    by_line = {whole(f): n for n, fs in sorted(TEXTS.items(), reverse=True) for f in fs}
    by_word = {bare(f): n for n, fs in sorted(TEXTS.items(), reverse=True) for f in fs}
    notice = {whole(f): n for n, fs in sorted(NOTICES.items(), reverse=True) for f in fs}
    return key(whole(text)), by_line.get(whole(text)) or by_word.get(bare(text)), ",".join(sorted({notice[spell(x)] for x in lines if spell(x) in notice}))


def test_equals_brute_force(spark):
    rows = list(enumerate(CASES)) + [(None, CASES[0]), (0, CASES[0]), (9, CASES[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as digest", "2 as notices", "3 as lines")
    got = sorted((tuple(r) for r in licences.scan(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)
    named = {r[0]: r[2] for r in got if r[0] is not None}
    assert [named[i] for i in range(6)] == ["MIT", "MIT", "MIT", None, "Zlib", None] and named[14] == "BSD-3-Clause"
    assert brute(CASES[9])[2] == "CC-BY-NC-4.0,ISC,MIT"
    assert licences.scan(df.limit(0)).count() == 0


def test_own_table(spark):
    df = spark.createDataFrame([(1, "My, TEXT"), (2, "mine")], "doc_id long, text string")
    got = {r.doc_id: (r.licence_id, r.notices) for r in licences.scan(df, texts={"Z": ["my text"], "A": ["MY TEXT!"]}, notices={"N": ["mine"]}).collect()}
    assert got == {1: ("A", ""), 2: (None, "N")}


FULL = {"Apache-2.0": "Apache License", "GPL-1.0": "GNU GENERAL PUBLIC LICENSE", "GPL-2.0": "GNU GENERAL PUBLIC LICENSE", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE",
        "LGPL-2.0": "GNU LIBRARY GENERAL PUBLIC LICENSE", "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE", "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE",
        "GFDL-1.2": "GNU Free Documentation License", "GFDL-1.3": "GNU Free Documentation License", "MPL-1.1": "MOZILLA PUBLIC LICENSE", "MPL-2.0": "Mozilla Public License Version 2.0",
        "CC0-1.0": "CC0 1.0 Universal", "CC-BY-SA-4.0": "Attribution-ShareAlike 4.0 International", "Artistic-1.0-Perl": "The \"Artistic License\"",
        "BSL-1.0": "Boost Software License", "Unicode-3.0": "UNICODE LICENSE V3", "BSD-3-Clause": "The Regents of the University of California"}


def test_whole_licence_files(spark):
    """Each long text as a file: as published, filled in, as a comment, with other line ends, under an older address, and cut or changed."""
    folder = Path(licences.__file__).parent / "licence_files"
    files = {f.stem: f.read_text() for f in folder.iterdir()}
    assert set(files) == set(FULL)
    rows = []
    for name, text in files.items():
        assert FULL[name] in text[:400]
        filled = text.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Acme").replace("http://", "https://")
        old = text.replace("51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")
        for t in (text, "Copyright The X Authors\n\n" + filled, "\n".join(" * " + x.upper() for x in text.split("\n")), text.replace("\n", "\r\n"), old):
            rows.append((name, t))
        rows += [(None, text[len(text) // 2:]), (None, text + "\nand more")]
        if name.startswith(("Apache", "GPL")):
            rows.append((name, text[:text.index("END OF TERMS") + 27]))
    got = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licence_id for r in got} == {i: name for i, (name, _) in enumerate(rows)}


def test_copyright_lines(spark):
    """Lines that name a holder are left out; lines of a licence that begin with the word are not."""
    stated = ["Copyright Acme Inc. 2020", "Copyright The X Authors", "Copyright The X Authors. All rights reserved.", "// Copyright Jane Doe <j@x.org>", "Copyright by Foo Ltd.", "(c) Acme 2020",
              "© Acme", "Copyright {yyyy} {name of copyright owner}", "Copyright Contributors to the X project", "Copyright Émile Zola", "Copyright 中文", "Copyright (c) 2019 A. Nother"]
    words = ["copyright", "copyright holders may sue", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "copyright notice and this permission notice", "copyright treaty adopted on 20 December 1996",
             "(c) You must retain, in the Source form", "copyright the software, and (2) offer you this license", "Copyright and Related Rights", "copyrighted by the Free Software Foundation"]
    rows = [(i, f"MIT License\n\n{x}\n\n{MIT}") for i, x in enumerate(stated + words)]
    got = {r.doc_id: r.licence_id for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == ["MIT"] * len(stated) + [None] * len(words)
    # MIT broken before every word
    broken = [(i, MIT[:m.start()] + "\n" + MIT[m.start() + 1:]) for i, m in enumerate(re.finditer(" ", MIT))]
    assert {r.licence_id for r in licences.scan(spark.createDataFrame(broken, "doc_id long, text string")).collect()} == {"MIT"}


def test_known_texts_are_found_however_they_are_wrapped(spark):
    """Every form of every known text at widths from 40 to 120, and with a line for each paragraph."""
    rows = []
    for name, forms in TEXTS.items():
        for form in forms:
            paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", form)]
            for width in (*range(40, 121, 16), 10 ** 9):
                wrapped = ("\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in paragraphs)
                rows.append((name, "\n\n".join(wrapped)))
    got = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(8)).collect()
    words = {name: {bare(f) for f in forms} for name, forms in TEXTS.items()}
    assert all(r.licence_id == rows[r.doc_id][0] or words[r.licence_id or "?"] & words[rows[r.doc_id][0]] for r in got)


def test_statements_take_nothing_else_along(spark):
    one_line = "Copyright 2020 Foo. " + " ".join(MIT.split())
    rows = [(1, one_line), (2, "Copyright 2020 Foo. SPDX-License-Identifier: MIT"), (3, "Copyright 2019 was the year in which we wrote a very long sentence that says a lot about nothing at all and goes on and on until it ends."),
            (4, "Copyright (c) 2020 Foo Inc. All rights reserved. " + " ".join(MIT.split())), (5, "(c) 2020 Foo\n\n" + " ".join(MIT.split()))]
    got = {r.doc_id: (r.licence_id, r.notices, r.digest) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    empty = hashlib.md5(b"").hexdigest()
    assert got[1][0] == got[5][0] == "MIT" and got[2][1] == "MIT" and got[3][2] != empty
    assert got[4][0] in ("MIT", None)  # "Inc." ends the sentence that names the holder


def test_plan_is_native(spark, capsys):
    licences.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
