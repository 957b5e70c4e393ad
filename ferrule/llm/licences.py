"""Licence scan by canonical digest.

A text is put into canonical form - lower case, one spelling of words that have several, no copyright lines, no
punctuation, single spaces - and the digest of the whole is looked up among those of known licences. All of it runs as
DataFrame functions; the known digests are a small table.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense",
    "organisation": "organization", "organisations": "organizations", "authorisation": "authorization", "authorised": "authorized",
    "favour": "favor", "behaviour": "behavior", "honour": "honor", "fulfil": "fulfill", "modelling": "modeling",
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "merchantibility": "merchantability",
    "noninfringement": "non infringement", "analyse": "analyze", "centre": "center", "whilst": "while", "judgement": "judgment",
    "programme": "program", "practise": "practice", "redistributions": "redistribution", "https": "http", "owner": "holder", "holders": "holder",
}
#: More than so many known licences are joined instead of broadcast (a digest and a name each).
BROADCAST_LICENCES = 100_000

#: Texts of licences, and the one-line notices by which texts name one.
KNOWN = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC0-1.0": "Released under CC0 1.0.",
}
#: Lines that stand above a licence whose text has no title of its own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "Unlicense": ("The Unlicense", "Unlicense"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"),
}
#: Lines that state a copyright: "Copyright ..." with a year, a sign or a blank to fill in, "(c) ...", "All rights reserved".
#: A line of running text that starts with the word stays.
COPYRIGHT_LINE = r"(^|\n)[^\pL\n]*(copyright[^\n]*([0-9][0-9][0-9][0-9]|\(c\)|©|[<\[{]|all rights reserved)|\(c\)|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    lines = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    # a space on both sides of every word, so that a word's spelling can be told by literal replacement
    words = F.concat(F.lit(" "), F.regexp_replace(lines, r"[^\pL\pN]+", "  "), F.lit(" "))
    for word, other in SPELLINGS.items():
        words = F.replace(words, F.lit(f" {word} "), F.lit(f" {other} "))
    return F.trim(F.regexp_replace(words, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def reference_texts() -> list[tuple[str, str]]:
    """(licence, text) of whole licences: the files of licence_texts, MIT and ISC, each with and without its title, with
    and without what follows its terms or numbers its clauses, and with each paragraph as lines and as one line."""
    whole = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")}
    whole |= {name: KNOWN[name] for name in ("MIT", "ISC")}
    out = []
    for name, text in sorted(whole.items()):
        text = text.strip("\n")
        forms = {text, re.split("(?<=END OF TERMS AND CONDITIONS)", text)[0]}
        if name.startswith("BSD"):
            forms.add(re.sub(r"(?m)^\d\. ", "", text))
        if name in TITLES:
            forms |= {f"{title}\n\n{x}" for title in TITLES[name] for x in forms}
        else:
            forms |= {x.split("\n\n", 1)[1] for x in forms}
        # lines of running text may state a year or a sign, so line ends inside paragraphs can matter
        forms |= {"\n\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", form)) for form in forms}
        out += [(name, form) for form in sorted(forms)]
    return out


def known_digests(spark: SparkSession, licences: dict[str, str] | None = None) -> DataFrame:
    """(licence, digest) of known texts, or of the reference texts and notices; of texts with the same form the first name
    in order stays."""
    texts = [*KNOWN.items(), *reference_texts()] if licences is None else list(licences.items())
    rows = spark.createDataFrame(texts, "licence string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence")).select("licence", "digest")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, digest of the whole text in canonical form, licence (null if unknown).

    Null and empty texts have the digest of the empty form, which names no licence. Null and repeated ids stay as they
    are, row by row; other columns are ignored.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    known = known.groupBy(F.col("digest").alias("known_digest")).agg(F.min("licence").alias("licence"))
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    small = known.count() <= BROADCAST_LICENCES
    empty = F.sha2(F.lit(""), 256)
    out = rows.join(F.broadcast(known) if small else known, (F.col("digest") == F.col("known_digest")) & (F.col("digest") != empty), "left")
    return out.select(F.col("doc_id").alias(id_col), "digest", "licence")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql() -> str:
    """The same in DuckDB's SQL."""

    def form(text: str) -> str:
        lines = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '\\1', 'g')"
        words = rf"(' ' || regexp_replace({lines}, '[^\pL\pN]+', '  ', 'g') || ' ')"
        for word, other in SPELLINGS.items():
            words = f"replace({words}, ' {word} ', ' {other} ')"
        return f"trim(regexp_replace({words}, ' +', ' ', 'g'))"

    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN.items())
    return (
        f"with texts(licence, text) as (values {values}), "
        f"known as (select sha256({form('text')}) as digest, min(licence) as licence from texts group by 1), "
        f"docs as (select doc_id, sha256({form('text')}) as digest from documents) "
        "select d.doc_id, d.digest, k.licence from docs d left join known k on k.digest = d.digest and d.digest <> sha256('')"
    )
