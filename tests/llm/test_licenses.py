"""Sentence rules on known texts."""

import pytest

from quarry.llm import licenses

CASES = [
    (None, 0, "", "NONE"),
    ("", 0, "", "NONE"),
    ("Plain prose. Nothing here.", 0, "", "NONE"),
    ("Intro.\nLicensed under the Apache License, Version 2.0.\nMore.", 1, "apache2Under", "Apache-2.0"),
    ("RELEASED UNDER THE MIT LICENSE.", 1, "mitReleased", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", 1, "gpl3Under", "GPL-3.0"),
    ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", 2, "ccByNc4,mitReleased", "MIT,CC-BY-NC-4.0"),
    ("Released under the MIT License.\nReleased under the MIT License.", 2, "mitReleased,mitReleased", "MIT"),
    ("Copyright 2020 Someone.", 1, "copyright", "UNKNOWN"),
    ("All rights reserved. " * 2000, 2000, None, "Proprietary"),
    (
        "Redistribution and use in source and binary forms are permitted;\nRedistributions of source code must retain it;\nRedistributions in binary form must reproduce it;\nNeither the name of X nor Y may be used to endorse it.",
        4,
        "bsdRedistribution,bsdSource,bsdBinary,bsdEndorse",
        "BSD-3-Clause",
    ),
]


def test_cases(documents):
    got = {r.doc_id: r for r in licenses.scan(documents([t for t, *_ in CASES])).collect()}
    for i, (_, n, ids, verdict) in enumerate(CASES):
        assert (got[i].n_sentences, got[i].licenses) == (n, verdict)
        assert ids is None or got[i].sentence_ids == ids


def test_empty(documents):
    assert licenses.scan(documents([])).count() == 0


@pytest.mark.parametrize("name", ["op6_mixing", "op10_licenses"])
def test_against_sql(spark, tmp_path, documents, name):
    import duckdb

    from quarry.llm import queries

    documents([t for t, *_ in CASES] + [(50, "a b c", None), (51, "d e", "t"), (51, "d e f", "t")]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.
"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.  See the GNU {}General Public License for more details.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
APACHE = """# Copyright 2020 Someone
#
# Licensed under the Apache
# License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
"""
WRAPPED = [
    (BSD + ENDORSE + AS_IS, "BSD-3-Clause"),
    (BSD + AS_IS, "BSD-2-Clause"),
    ((BSD + ENDORSE + AS_IS).replace("\n", "\r\n"), "BSD-3-Clause"),
    ("".join(f" * {x}\n" for x in (BSD + ENDORSE + AS_IS).split("\n")), "BSD-3-Clause"),
    (MIT, "MIT"),
    (GPL.format(":", "", ",", 3, ""), "GPL-3.0"),
    (GPL.format(":", "", ",", 3, "").replace("\n", " "), "GPL-3.0"),
    (GPL.format(";", "", ";", 2, ""), "GPL-2.0"),
    (GPL.format(";", "Lesser ", ";", "2.1", "Lesser "), "LGPL"),
    ("        GNU GENERAL PUBLIC LICENSE\n           Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", "GPL-3.0"),
    (MPL, "MPL-2.0"),
    (" ".join(MPL.split()), "MPL-2.0"),
    (APACHE, "Apache-2.0"),
    ("        Apache License\n    Version 2.0, January 2004\n", "Apache-2.0"),
    ("// Copyright 2020 Someone\n// SPDX-License-Identifier: MIT OR Apache-2.0\n#include", "MIT OR Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only"),
    ("Licensed under CC BY-NC 4.0\nReleased under the MIT License", "MIT,CC-BY-NC-4.0"),
    ("Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "Apache-2.0,Proprietary"),
    ("Copyright 2020 Someone. All rights reserved.", "Proprietary"),
]


def test_wrapped_texts(documents):
    got = {r.doc_id: r.licenses for r in licenses.scan(documents([t for t, _ in WRAPPED])).collect()}
    assert [got[i] for i in range(len(WRAPPED))] == [verdict for _, verdict in WRAPPED]
