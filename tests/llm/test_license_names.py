"""Labels of the license scan need the license's name, wherever the notice begins."""

import duckdb
import pytest

from babelmill.llm import licenses

SAID = [
    ("Released under the BSD License", ""),
    ("Released under the Apache License", "apache"),
    ("Released under the MIT License", "mit"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by"),
    ("licensed under a Creative Commons Attribution 4.0 International License", ""),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under the GNU General Public License version 2", "gpl"),
    ("This work is licensed under the GNU Lesser General Public License version 3", ""),
    ("This work is licensed under the GNU General Public License version 3", "gpl,gpl-3.0"),
    ("Licensed under the Apache License 2.0", "apache,apache-2.0"),
    ("license x the y mit z under w released", ""),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl-3.0"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "epl-2.0"),
    ("This program and the accompanying materials are made available under the terms of the Common Public License 2.0 which is available at", ""),
]


def test_labels_need_the_name(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(d).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(SAID)] == SAID


@pytest.mark.parametrize("spread", [0, 36, 41, 42])
def test_every_beginning_of_a_block_counts(spark, spread):
    """A notice of 23 words with words put between lies in BLOCK words up to a spread of 41, wherever it begins."""
    name = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()
    notice = name[:16] + [f"y{i}" for i in range(spread + 3)] + name[16:]
    assert len(notice) == 23 + spread
    # At most 4 of the 19 distinct words may be missing; without the first part, too many are.
    texts = [" ".join([f"x{i}" for i in range(lead)] + notice) for lead in range(70)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for i, text in enumerate(texts):
        w, s = text.split(), set(name)
        for a in range(len(w)):
            block = w[a : a + licenses.BLOCK]
            if len(s & set(block)) >= licenses.need(len(s)) and "associated documentation files" in " ".join(block):
                want.add(i)
    assert {r.doc_id for r in licenses.scan(d).where("labels = 'mit'").collect()} == want
    assert len(want) in (0, 70)


def test_query_equals_sql_on_misnamed_notices(spark, tmp_path):
    """Planted notices with names and without, far from their names, repeated rows: the same labels as in SQL."""
    from tests import oracle

    names = [" ".join(f"pad{i}" for i in range(lead)) + " " + t for lead, (t, _) in enumerate(SAID)]
    apart = "Permission is hereby granted, free of charge, to any person obtaining a copy " + " ".join(f"y{i}" for i in range(60)) + " of this software and associated documentation files"
    texts = [t for t, _ in SAID] + names + [apart, apart.replace("y1 ", ""), None, "", "mit license " * 40, *[" ".join(t for t, _ in SAID[i : i + 3]) for i in range(10)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (None, texts[1])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    oracle.assert_same(licenses.op8_license_scan(spark, str(tmp_path)), con, licenses.oracle())
