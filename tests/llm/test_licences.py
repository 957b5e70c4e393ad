import duckdb
from pyspark.sql import functions as F

from ferrule.llm.licences import KNOWN, known_digests, scan, scan_sql


def rows():
    mit = KNOWN["MIT"]
    return [
        (1, mit),
        (2, "Copyright (c) 2020 Some Body\n\n" + mit.upper()),
        (3, mit.replace(",", " ").replace("sublicense", "sublicence") + "\n© 1999 x. All rights reserved."),
        (4, mit + " and more"),
        (5, None),
        (6, ""),
        (7, "  licenced under the APACHE licence version 2.0"),
        (8, "Copyright 2001 only"),
        (9, "a" * 100_000),
        (9, mit),
    ]


def test_canonical_texts_are_found(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = [(r.doc_id, r.licence) for r in scan(df).orderBy("doc_id", "licence").collect()]
    assert got == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, None), (6, None), (7, "Apache-2.0"), (8, None), (9, None), (9, "MIT")]
    assert scan(df.limit(0)).count() == 0


def test_sql_gives_the_same(spark):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows())
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    order = lambda x: sorted(x, key=str)
    assert order(c.execute(scan_sql()).fetchall()) == order([tuple(r) for r in scan(df).collect()])


def test_own_licences(spark):
    known = known_digests(spark, {"own": "Use it, and be kind!"})
    df = spark.createDataFrame([(1, "use IT and be kind"), (2, "no")], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in scan(df, known).collect()} == {1: "own", 2: None}


MIT = """The MIT License (MIT)

Copyright (c) 2015 Jane Doe and contributors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
"""
BSD = """BSD 3-Clause License

Copyright (c) 2001, The Example Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_whole_licences_written_apart(spark):
    from pathlib import Path

    shared = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {name: Path("/usr/share/common-licenses", f) for name, f in shared.items()}
    rows = [("MIT", MIT), ("MIT", MIT.split("\n\n", 1)[1]), ("Unlicense", UNLICENSE), ("BSD-3-Clause", BSD), (None, MIT[:-20])]
    rows += [(name, p.read_text()) for name, p in found.items() if p.exists()]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert [r.licence for r in scan(df).orderBy("doc_id").collect()] == [n for n, _ in rows]


def test_running_text_that_starts_with_copyright_stays(spark):
    one, two, three = KNOWN["MIT"].split("\n\n")
    wrapped = three.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT")
    rows = [(1, f"MIT License\n\nCopyright (c) 2020 Jane Doe\n\n{one}\n\n{two}\n\n{wrapped}"), (2, f"{one}\n{two}\n{wrapped}"), (3, f"Copyright Jane Doe 1999\n{one}\n{two}")]
    got = {r.doc_id: r.licence for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None}
