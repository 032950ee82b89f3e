import hashlib

import brute
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickwright.llm import licenses, pii


def found(docs, **how):
    out = pii.find_spans(docs, **how)
    return [r.asDict() for r in out.select("id", "terms", *pii.digest_columns(out)).collect()]


def check_base(rows, texts):
    for r in rows:
        want = [f"{k}:{s}:{e}" for k, s, e in brute.personal(texts[r["id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (r["id"], r["spans"][:300], want[:5])
        got = r["spans"].split(",") if r["spans"] else []
        assert got[: len(want)] == want and all(x.startswith("term:") for x in got[len(want) :])
        assert [r[f"n_{k}"] for k in brute.PERSONAL] == [sum(w.startswith(k + ":") for w in want) for k in brute.PERSONAL]


def test_base_spans(spark, small_dir, odd):
    for docs in (spark.read.parquet(f"{small_dir}/documents.parquet"), odd):
        texts = {r.doc_id: r.text for r in docs.collect()}
        rows = found(docs)
        assert len(rows) == len(texts)
        check_base(rows, texts)


def test_base_spans_random(spark):
    pieces = ["a", "Z", "@", ".", "-", "+", "_", "%", " ", "(", ")", "1", "25", "4111111111111111", "255", "256", "0", "é", "\n", "b.c", "x@y.z", "+49 30 123456"]
    texts: list[str] = []

    @settings(max_examples=1500, database=None, deadline=None, derandomize=True)
    @given(st.lists(st.sampled_from(pieces), max_size=24))
    def collect(parts):
        texts.append("".join(parts))

    collect()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_base(found(docs), dict(enumerate(texts)))


def test_long_inputs_are_linear(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 100_000, "a@b" + ".c" * 100_000, "+1" + " " * 200_000, "1 " * 100_000, "x@y.zz " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["id"]: r for r in found(docs)}
    assert rows[6]["n_email"] == 3000 and rows[3]["n_email"] == 1
    want = ",".join(f"email:{7 * i}:{7 * i + 6}" for i in range(3000))
    assert rows[6]["spans"].startswith(want)


def test_disclosure(spark):
    """A word that stands with an address only is found; words that stand everywhere are not."""
    data = [(i, f"common words here and project zanzibar from jo@example.org about common things {i}", "x") for i in range(5)]
    data += [(100 + i, f"common words here and things about other project from nobody number {i}", "x") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, spans string")
    out = pii.find_spans(docs)
    rows = {r["id"]: r for r in out.collect()}
    for i in range(5):
        text = data[i][1]
        assert [text[t["s"] : t["e"]] for t in rows[i]["terms"]] == ["zanzibar"]
        assert rows[i]["terms"][0]["remove"]
    assert not any(rows[100 + i]["terms"] or rows[100 + i]["spans"] for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, out).collect()}
    assert clean[3] == "common words here and project  from [EMAIL] about common things 3" and clean[101] == data[6][1]
    assert pii.sanitise(docs, out).columns == docs.columns
    assert not any(r["terms"] for r in found(docs, min_support=6))


def test_pii_odd(odd, repeated, empty):
    for docs in (odd, repeated, empty):
        out = pii.find_spans(docs)
        assert out.count() == docs.count()
        clean = pii.sanitise(docs, out)
        assert clean.columns == docs.columns and clean.count() == docs.count()
        assert not clean.where(F.col("text").contains("192.168.1.1")).count()


def test_license_base(spark, small_dir, odd):
    for docs in (spark.read.parquet(f"{small_dir}/documents.parquet"), odd):
        got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
        for r in docs.select("doc_id", "text").collect():
            g = got[r.doc_id]
            assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute.licenses(r.text)
            assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1


def test_matching_statistics():
    import random

    rng = random.Random(4)
    for _ in range(60):
        seqs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 4))]
        a = licenses.Automaton(seqs)
        text = [rng.randint(1, 4) for _ in range(30)]
        inside = lambda x: [(k, i + len(x)) for k, s in enumerate(seqs) for i in range(len(s) - len(x) + 1) if s[i : i + len(x)] == x]
        for i, n, v in a.statistics(text):
            want = max(m for m in range(i + 2) if not m or inside(text[i + 1 - m : i + 1]))
            assert n == want
            if n:
                assert a.ends[v] == sorted(inside(text[i + 1 - n : i + 1]))


def test_templates(spark):
    mit = licenses.TEMPLATES["mit"]
    words = mit.split()
    texts = [
        f"some code. {mit.upper()} tail", " ".join(w if i % 9 else "other" for i, w in enumerate(words)), " ".join(words[:20]), "no licence of any sort here",
        " ".join(reversed(words)), licenses.TEMPLATES["gpl-3"], licenses.TEMPLATES["bsd"] + " x " * 500 + licenses.TEMPLATES["isc"], " ".join(words * 300),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[0].labels == "mit" and got[0].score == 1.0
    first, end = (int(x) for x in got[0].spans.split(":")[1:3])
    assert (first, end) == (2, 2 + len(words))
    assert got[1].labels == "mit" and 0.8 < got[1].score < 1 and got[2].labels == "" and 0.2 < got[2].score < 0.5
    assert not got[3].labels and not got[4].labels and got[4].score < 0.2
    assert "gpl-3" in got[5].labels and got[5].score == 1.0 and got[6].labels == "bsd,isc" and got[7].labels == "mit"


def test_license_odd(repeated, empty):
    assert licenses.scan_licenses(repeated).count() == repeated.count() and licenses.scan_licenses(empty).count() == 0


def test_disclosure_anywhere(spark):
    """A telling word far from the mention is found, at all its places, in documents that mention the entity only."""
    gap = "common words here and more of them again " * 12
    data = [(i, f"Zanzibar office. {gap} jo@example.org {gap} the zanzibar, or ZANZIBAR. {gap} {i}") for i in range(4)]
    data += [(4, f"{gap} zanzibar {gap}"), *((10 + i, f"{gap} number {i}") for i in range(400))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    out = pii.find_spans(docs, generalise_at=0.8, remove_at=0.99)
    rows = {r["id"]: r for r in out.collect()}
    for i in range(4):
        terms = rows[i]["terms"]
        assert [data[i][1][t["s"] : t["e"]] for t in terms] == ["Zanzibar", "office", "zanzibar", "ZANZIBAR"]
        assert [t["remove"] for t in terms] == [False, True, False, False]  # zanzibar is known without the address, too
    assert not any(rows[i]["terms"] for i in rows if i >= 4)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, out).collect()}
    assert all("zanzibar" not in clean[i].lower() and "the z*, or Z*." in clean[i] for i in range(4)) and "zanzibar" in clean[4]


def test_disclosure_random(spark):
    """Against counting all pairs of all documents."""
    import math
    import random
    import re

    rng = random.Random(3)
    names = [f"p{i}@a.bc" for i in range(6)] + ["abcd..efgh@a.bc"]
    words = [chr(97 + i) * 4 for i in range(26)]
    texts = []
    for i in range(150):
        own = [n for n in names if rng.random() < 0.04]
        said = rng.choices(words, [1 / (k + 1) ** 2 for k in range(26)], k=12) + [w for n in own for w in (words[names.index(n) + 15],) * 2]
        parts = own + said
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += texts[:3] * 3  # copies are no evidence, but marked alike
    term = re.compile(r"(?<![^\W_@.%+-])[a-z]{4,}(?!\.?[\w@%+-])")
    mails = [{m[0]: m.span() for m in re.finditer(brute.PERSONAL["email"], t)} for t in texts]
    found = [[m for m in term.finditer(t) if t[m.start() - 1 : m.start()] not in list("@._%+-")] for t in texts]
    said = [{m[0] for m in f} for f in found]
    once = [texts.index(t) == d for d, t in enumerate(texts)]
    n = sum(once)
    want = []
    for d, t in enumerate(texts):
        marks = []
        for m in found[d]:
            best = -9.0
            for c in mails[d]:
                df_c, df_t = sum(c in x for x, o in zip(mails, once) if o), sum(m[0] in y for y, o in zip(said, once) if o)
                both = sum(c in x and m[0] in y for x, y, o in zip(mails, said, once) if o)
                if both >= 2 and df_c < n:
                    best = max(best, math.log2(both * n / (df_t * df_c)) / math.log2(n / df_c))
            if best >= 0.5 and not any(s < m.end() and m.start() < e for s, e in (x.span() for x in re.finditer(brute.PERSONAL["email"], t))):
                marks.append((m.start(), m.end(), best >= 0.9))
        want.append(marks)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: [tuple(t) for t in r["terms"]] for r in pii.find_spans(docs, generalise_at=0.5, remove_at=0.9).collect()}
    assert [got[d] for d in range(len(texts))] == want and sum(map(len, want)) > 40


def test_copies_are_no_evidence(spark, small_dir):
    """Doubling a table changes no span; a document and its copies reveal nothing; one address with one name in different texts does."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000 + i, "Quixotic words of one only document jo@one.example and more") for i in range(30)]
    rows += [(9100 + i, f"Xylophonist number {chr(97 + i) * 5} writes to mail@two.example in text {chr(98 + i) * 6}") for i in range(3)]
    schema = "doc_id long, text string"
    spans = lambda data: {r["id"]: (r["spans"], r["terms"]) for r in pii.find_spans(spark.createDataFrame(data, schema).repartition(3)).collect()}
    one, two = spans(rows), spans(rows + [(20_000 + i, t) for i, t in rows])
    assert {i: s for i, s in two.items() if i < 20_000} == one and {i - 20_000: s for i, s in two.items() if i >= 20_000} == one
    assert not any(one[9000 + i][1] for i in range(30))
    assert [rows[-3][1][t["s"] : t["e"]] for t in one[9100][1]] == ["Xylophonist", "number", "writes", "text"]  # all only here, not the words of one text


def test_sanitise_keeps_columns_of_any_name(spark):
    names = ["_pii_id", "_pii_text", "_pii_hash", "_pii_edits", "_pii_row", "spans", "terms", "uid"]
    docs = spark.createDataFrame([(1, "mail a@b.cd", *names), (2, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = {r.doc_id: r for r in pii.sanitise(docs, pii.find_spans(docs)).collect()}
    assert out[1].text == "mail [EMAIL]" and all(out[i][n] == n for i in (1, 2) for n in names)


def test_disclosure_between_numbers_and_in_lists(spark):
    """Numbers that are no cards, versions and the other entities of a list hide no term and cut none in two."""
    common = "common words here and things about other project from nobody"
    data = [(i, f"Kowalski, flat 12, no 34, v 1.2.3.999, card 4111111111111111. {common} {i}") for i in range(3)]
    data += [(10 + i, f"lists Nightingale: a{i}@b.cd, jo@example.org, c{i}@d.ef, 10.0.0.1 {common}") for i in range(3)]
    data += [(20 + i, f"{'x' * 150}{'y' * 20}zebra jo2@example.org {common} {i}") for i in range(3)]
    data += [(100 + i, f"lists card flat {common} number {i}") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    rows = {r["id"]: r for r in pii.find_spans(docs).collect()}
    terms = lambda i: [t for d, t in data if d == i for t in [t[x["s"] : x["e"]] for x in rows[i]["terms"]]]
    for i in range(3):
        assert rows[i]["spans"][0]["k"] == pii.KINDS.index("card") and terms(i) == ["Kowalski"]
        assert len(rows[10 + i]["spans"]) == 4 and terms(10 + i) == ["Nightingale"]
        assert terms(20 + i) == [f"{'x' * 150}{'y' * 20}zebra"]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, pii.find_spans(docs)).collect()}
    assert clean[0].startswith(", flat 12, no 34, v 1.2.3.999, card [CARD]. common") and clean[10].startswith("lists : [EMAIL], [EMAIL], [EMAIL], [IP] ")


def test_every_notice_has_its_span(spark):
    """Repeated notices, near each other, far apart and damaged, are all reported."""
    mit, by = licenses.TEMPLATES["mit"].split(), licenses.TEMPLATES["cc-by"].split()
    far = ["other"] * 100
    broken = [w if i % 9 else "other" for i, w in enumerate(mit)]
    one, two = by[:8] + ["x"] + by[9:], by[:6] + ["x"] + by[7:]
    texts = [mit * 300, (mit + far) * 3, mit + far + broken + mit[:20], one + one + two + far + by, mit[:20] * 3]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    n = len(mit)

    def places(i, label):
        return [tuple(int(x) for x in s.split(":")[1:3]) for s in rows[i].spans.split(",") if s.startswith(label + ":")]

    assert places(0, "mit") == [(i * n, i * n + n) for i in range(300)]
    assert places(1, "mit") == [(i * (n + 100), i * (n + 100) + n) for i in range(3)]
    (first, end), (first2, end2) = places(2, "mit")
    assert (first, end) == (0, n) and n + 100 <= first2 < n + 110 and 2 * n + 90 < end2 <= 2 * n + 100
    m = len(by)
    assert places(3, "cc-by") == [(0, m), (m, 2 * m), (2 * m, 3 * m), (3 * m + 100, 4 * m + 100)]
    assert rows[3].score == 1.0 and not rows[4].spans and not rows[4].labels and rows[4].score < 0.5


NOTICES = {
    "agpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "mit": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
    'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. THE "
    'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
    "https://www.eclipse.org/legal/epl-2.0",
}


def test_one_label_a_notice(spark):
    """Notices as they are written, each template by itself, and all of them in one text: the label of the family and no neighbour's."""
    keys = list(licenses.TEMPLATES)
    texts = list(NOTICES.values()) + [licenses.TEMPLATES[k] for k in keys] + [" far ".join(f"{'x ' * 60}{t}" for t in NOTICES.values())]
    docs = spark.createDataFrame([(i, f"some words {t} more words") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels) for r in licenses.scan_licenses(docs).collect()}
    wrong = {k: got[i] for i, k in enumerate(NOTICES) if got[i][0] != k}
    wrong |= {k: got[i] for i, k in enumerate(keys, len(NOTICES)) if got[i][0] != k.split("/")[0]}
    assert not wrong
    assert got[len(texts) - 1][0] == ",".join(sorted(NOTICES))
