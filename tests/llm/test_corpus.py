import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrica.llm import bpe_transducer as bpe
from matrica.llm import decontaminate, licenses, line_crf, quality_rules, site_templates, token_orc, url_filter, warc, weighted_dedup

LONG = "word%d other%d text " * 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long, band int"


def docs(spark, texts):
    """Documents with a clashing extra column."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or ""), 7) for i, t in enumerate(texts)], DOCS)


def words(n, seed, k=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(k)}" for _ in range(n))


def test_transducer_equals_textbook_bpe():
    r = random.Random(1)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 700:
        a, b = r.choice(list(ranks)), r.choice([x for x in ranks if x.isalpha()])
        if a.isalpha() and len(a + b) <= 8 and all(c < 103 for c in a + b):
            ranks.setdefault(a + b, len(ranks))
    t = bpe.Transducer(ranks)
    for _ in range(400):
        s = bytes(r.choice(b"abcdef") for _ in range(r.randrange(1, 60)))
        assert t.encode(s) == bpe.merge_bytes(ranks, s)
    s = bytes(r.choice(b"abcdef") for _ in range(1500))
    assert list(t.stream([s[:700], s[700:]])) == bpe.merge_bytes(ranks, s) == t.encode(s)


def test_bpe_equals_tiktoken_and_round_trips():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own, ref = bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    for _ in range(500):
        s = "".join(r.choice("ab \n\t12é漢🙂'sre,.\0  ") for _ in range(r.randrange(40)))
        ids = own.encode(s)
        assert ids.tolist() == ref.encode_ordinary(s) and own.decode(ids) == s.encode()
    d = bpe.StreamDecoder(own.transducer.tokens)
    ids = own.encode("漢🙂é").tolist()
    assert "".join(d.push([i]) for i in ids) + d.close() == "漢🙂é"


def test_bpe_documents_edge_cases(spark):
    import public_tokenizers as P

    rows = bpe.encode_documents(docs(spark, [None, "", "a b", "a b", "x" * 5000]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows[:2]] == [(0, empty, empty)] * 2
    assert rows[2]["ids"] == rows[3]["ids"] and rows[4]["decoded_sha256"] == hashlib.sha256(b"x" * 5000).hexdigest()
    assert bpe.encode_documents(docs(spark, ["a"]).limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_orc_round_trip(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = [None, "", "Don't STOP é ß", "a <|endoftext|> b", "café Σας", words(3000, 1)]
    path = f"file://{tmp_path}/orc"
    token_orc.write_token_orc(docs(spark, texts), path, P.path("word_bpe_49k.json"), partitions=3)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, at = [], 0
    for i, x in enumerate(texts):
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in token_orc.token_digests(spark, path).orderBy("doc_id").collect()] == want
    assert [r["start"] for r in token_orc.read_token_orc(spark, path).orderBy("doc_id").collect()] == [w[1] for w in want]


def test_word_encoder_equals_tokenizer_on_all_pairs():
    """Every pair of characters of the plain set, alone and inside words."""
    import public_tokenizers as P

    with open(P.path("word_bpe_49k.json"), "rb") as f:
        e = token_orc.WordEncoder(f.read())
    plain = [chr(c) for c in range(0x2200) if not token_orc._ODD.match(chr(c))]
    assert e.by_word and len(plain) > 250
    for a in plain:
        texts = [a + b for b in plain] + ["x" + a + b + "1" for b in plain]
        want = [np.array(x.ids, "<u4").tobytes() for x in e.tok.encode_batch(texts, add_special_tokens=False)]
        assert [e.encode(t) for t in texts] == want, a


def test_token_orc_ties_and_pruned_lookup(spark, tmp_path):
    import public_tokenizers as P

    texts = [f"text {i}" for i in range(4000)]
    d = docs(spark, texts).union(docs(spark, ["b", "a b c", "b"]).withColumn("doc_id", F.lit(7).cast("long")))
    path = f"file://{tmp_path}/orc"
    token_orc.write_token_orc(d, path, P.path("word_bpe_49k.json"), partitions=1, stride=1000)
    rows = token_orc.read_token_orc(spark, path).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted([*range(4000), 7, 7, 7])
    crc = [(r["doc_id"], r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in rows]
    assert sorted(crc) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in token_orc.token_digests(spark, path).collect())
    got = token_orc.lookup_tokens(spark, path, [3500])
    assert [r["ids"] for r in got.collect()] == [r["ids"] for r in rows if r["doc_id"] == 3500]
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert "PushedFilters: [In(doc_id" in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple") or "EqualTo(doc_id,3500)" in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert scan.metrics().apply("numOutputRows").value() <= 1003  # one stride of four
    empty = f"file://{tmp_path}/none"
    token_orc.write_token_orc(d.limit(0), empty, P.path("word_bpe_49k.json"), partitions=1)
    assert token_orc.token_digests(spark, empty).count() == 0


def brute_repeat(w, n=5):
    seen = {}
    for i in range(len(w) - n + 1):
        seen.setdefault(tuple(w[i : i + n]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + n)})


def test_rule_counts_equal_brute_force(spark):
    import re

    r = random.Random(3)
    texts = [None, "", " \n\t ", "a b c d e a b c d e", "x " * 40, "l1 a\nl1 a\n\n \nl2 #*$%&|<>"] + [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(30)] + ["y " * 20000]
    for row in quality_rules.rule_counts(docs(spark, texts)).collect():
        t = texts[row["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row["n_words"], row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), brute_repeat(w)), t[:50]
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))


def test_bad_host_loses_its_documents(spark):
    good = words(40, 9)
    rows = [(i, "bad " if i % 10 else good, "en", "spam" if i < 60 else f"h{i % 8}", 1, 0) for i in range(60)] + [(100 + i, words(40, i), "en", f"h{i % 8}", 1, 0) for i in range(80)] + [(999, good, "en", None, 1, 0)]
    d = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(d).where("kept").collect()}
    assert kept == {100 + i for i in range(80)} | {999}
    assert {r["doc_id"] for r in quality_rules.keep_by_rules(d).collect()} == kept
    assert quality_rules.quality_verdicts(d.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    import re

    items = [words(30, 50 + i) for i in range(6)] + ["two words", None]
    texts = [None, "", words(300, 1), words(100, 2) + " " + items[0] + " " + words(2000, 3), items[1].upper().replace(" ", ", "), " ".join(items[2].split()[:29]), " ".join(items[3].split()[:15]), items[4] + " " + items[5]]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    sh = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)}
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if sh(x) and len(sh(t) & sh(x)) >= 0.8 * len(sh(x))}
    for rows in (200_000, 0):  # broadcast and shuffled
        got = decontaminate.contaminated(docs(spark, texts), b, broadcast_rows=rows)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) >= 5
    assert decontaminate.contaminated(docs(spark, texts), b.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs(spark, texts), b).count() == len(texts) - len({i for i, _ in want})


def test_license_rules(spark):
    mit = ". ".join(licenses.SENTENCES[k][0] for k in ("mit_grant", "mit_notice", "asis_mit"))
    texts = [None, "", "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny", mit, "licensed to kill", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License."]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {0: [], 1: [], 2: ["MIT"], 3: ["Apache-2.0"], 4: ["MIT"], 5: [], 6: ["MIT", "CC-BY-NC-4.0"]}


def test_wrapped_licenses(spark):
    import textwrap

    wrap = lambda *keys, lead="", end=".\n", width=72: end.join("\n".join(lead + x for x in textwrap.wrap(licenses.SENTENCES[k][0], width)) for k in keys) + "."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance\nwith the License.\nYou may obtain a copy of the\nLicense at\n\n  http://www.apache.org/licenses/LICENSE-2.0\n'
    gpl = licenses.SENTENCES["gpl_free"][0]
    texts = [
        "Copyright (c) 2020 X\n\n" + wrap("mit_grant", "mit_notice", "asis_mit", end=":\n\n"),
        "/*\n" + wrap("mit_grant", "mit_notice", "asis_mit", lead=" * ", end=".\n *\n") + "\n */",
        wrap("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", end=".\r\n  1. ", width=60).replace("\n", "\r\n"),
        "\n".join("# " + x for x in apache.split("\n")),
        "\n".join(textwrap.wrap(gpl, 70)) + ".\n",
        "Licensed under the\n\nMIT License or so",
        "Licensed under the MIT. License",
        "first line\nReleased under the\nMIT License\nlast line",
        "漢" * 50_000 + " . ; : \n" * 20_000 + "MIT License",
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {0: ["MIT"], 1: ["MIT"], 2: ["BSD-3-Clause"], 3: ["Apache-2.0"], 4: ["GPL-3.0-or-later"], 5: [], 6: [], 7: ["MIT"], 8: ["MIT"]}


def test_parts_of_license_sentences(spark):
    gpl = "%s is free software%s you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation%s %s.\n"
    later = "either version %d of the License, or\n(at your option) any later version"
    end = "\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
    cases = [
        (gpl % ("This program", ";", ";", later % 2), ["GPL-2.0-or-later"]),
        (gpl % ("This program", ";", ";", later % 3) + end, ["GPL-3.0-or-later"]),
        (gpl % ("Frob", ":", ",", later % 3) + end, ["GPL-3.0-or-later"]),
        (gpl % ("This program", ";", ",", later % 2) + end, ["GPL-2.0-or-later"]),
        (gpl % ("This program", ";", ";", "version 2 of the License") + end, ["GPL-2.0-only"]),
        (gpl % ("This program", ":", ",", "version 3"), ["GPL-3.0-only"]),
        (gpl % ("This program", ";", ";", later % 1), []),
        *((f"# SPDX-License-Identifier: {x}\nimport y\n", [want]) for x, want in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-only", "GPL-3.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("MPL-2.0", "MPL-2.0"))),
        ("SPDX-License-Identifier: Zlib", []),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", ["MPL-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 1.1. If a copy", []),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, [t for t, _ in cases])).collect()}
    assert got == dict(enumerate(w for _, w in cases))


def test_crf_learns_lines(spark):
    r = random.Random(5)
    good = ["\n".join(words(8, r.random()) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    bad = ["\n".join(" ".join(w + "$$$" for w in words(8, r.random()).split()) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    m = line_crf.fit(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    s = line_crf.score_texts(m, good[40:] + bad[40:] + ["", "\n\n", "a" * 100_000])
    assert (s[:20] > 0.5).all() and (s[20:40] < 0.5).all() and ((s >= 0) & (s <= 1)).all()
    assert line_crf.score_texts(line_crf.fit(["a"], [1]), ["x", ""]).tolist() == [1, 1]
    d = docs(spark, [None, good[41], bad[41]])
    assert [x["doc_id"] for x in line_crf.keep_good(d, m).collect() if x["text"]] == [1]


def test_forward_backward_equals_enumeration():
    import itertools

    u, step = np.array([[0.3, -1.0, 2.0]]), np.array([[0.5, -0.2], [0.1, 0.7]])
    score = {y: sum(u[0, i] * y[i] for i in range(3)) + sum(step[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=3)}
    z = sum(np.exp(v) for v in score.values())
    p, pairs, logz = line_crf._forward_backward(u, np.ones((1, 3), bool), step)
    assert np.allclose(p[0], [sum(np.exp(v) for y, v in score.items() if y[i]) / z for i in range(3)]) and np.isclose(pairs.sum(), 2)


def test_near_duplicates(spark):
    base = words(400, 1, 10**6)
    edit = lambda k: " ".join(w if i != k else "changed" for i, w in enumerate(base.split()))
    texts = [None, None, "", "", "a b", "A, b!", base, base] + [edit(10 * k) for k in range(20)] + [words(400, 100 + i, 10**6) for i in range(10)]
    got = {r["doc_id"]: r["class_id"] for r in weighted_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got[0] == 0 and got[1] == 1 and got[2] == got[3] == 2 and got[4] == got[5] == 4
    assert {got[i] for i in range(6, 28)} == {6} and all(got[i] == i for i in range(28, 38))
    assert weighted_dedup.drop_near_duplicates(docs(spark, texts)).count() == 2 + 1 + 1 + 1 + 10
    assert weighted_dedup.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_near_duplicates_by_exact_frequencies(spark):
    import math
    from collections import Counter

    left, right, own = words(100, 1, 10**9), words(100, 2, 10**9), words(183, 3, 10**9)
    texts = [f"{own} {left}", f"{own} {right}"] + [f"{words(600, 10 + i, 10**9)} {left if i % 2 else right}" for i in range(1000)]
    d, h, _ = weighted_dedup.shingles(texts)
    df = Counter(h.tolist())
    a, b = set(h[d == 0].tolist()), set(h[d == 1].tolist())
    ratio = lambda w: sum(map(w, a & b)) / sum(map(w, a | b))
    assert ratio(lambda x: 1.0) < weighted_dedup.THRESHOLD <= ratio(lambda x: math.log1p(len(texts) / df[x]))
    got = {r["doc_id"]: r["class_id"] for r in weighted_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got[0] == got[1] == 0 and all(got[i] == i for i in range(2, len(texts)))


def test_near_duplicates_equal_all_pairs(spark):
    """Every pair at 0.8 or more by exact TF-IDF, near copies and large groups included, against all pairs."""
    import itertools
    import math
    import re
    from collections import Counter

    r = random.Random(6)
    texts = []
    for g in range(40):
        base = words(r.randrange(8, 400), 1000 + g, 3000).split()
        for _ in range(r.choice([1, 2, 3, 25])):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 20))):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += texts[:30] + ["x " * n for n in (1, 4, 5, 9, 300)] + [None, "", "!!", "É é"]
    sets = []
    for t in texts:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(k for x in sets for k in x)
    idf = {k: math.log1p(len(texts) / c) for k, c in df.items()}
    sim = lambda x, y: sum(min(x[k], y[k]) * idf[k] for k in x.keys() & y.keys()) / sum(max(x[k], y[k]) * idf[k] for k in x.keys() | y.keys())
    up = list(range(len(texts)))
    find = lambda i: i if up[i] == i else find(up[i])
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (texts[i] is not None and texts[i] == texts[j]) or (sets[i] and sets[j] and sim(sets[i], sets[j]) >= 0.8)]
    for i, j in links:
        up[max(find(i), find(j))] = min(find(i), find(j))
    got = {x["doc_id"]: x["class_id"] for x in weighted_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links) and len(links) > 400
    assert sum(got[i] == find(i) for i in got) >= 0.99 * len(texts) and all(find(i) == find(got[i]) for i in got)


def test_near_duplicates_in_a_group_of_copies(spark):
    """Copies at 0.81 without weights stay one class, though all of them count in the frequencies of what they share."""
    base = words(100, 1, 10**9).split()
    texts = [" ".join(f"edit{k}" if i == 5 + 5 * k else w for i, w in enumerate(base)) for k in range(18)]
    texts += [words(20, 100 + i, 10**9) for i in range(9000)]
    d, h, _ = weighted_dedup.shingles(texts[:2])
    a, b = set(h[d == 0].tolist()), set(h[d == 1].tolist())
    assert weighted_dedup.THRESHOLD <= len(a & b) / len(a | b) < 0.82
    got = {r["doc_id"]: r["class_id"] for r in weighted_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert {got[i] for i in range(18)} == {0} and all(got[i] == i for i in range(18, len(texts)))


def test_near_duplicates_repeated_and_null_ids(spark):
    a, b = words(60, 1, 10**6), words(60, 2, 10**6)
    rows = [("1", a), ("1", a), ("1", b), ("2", b), (None, a), (None, words(60, 3, 10**6)), (None, None), ("3", None), ("3", None), ("4", None)]
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id string, text string, _md5 int")
    got = sorted((r["doc_id"] or "", r["class_id"] or "", r["keep"]) for r in weighted_dedup.near_duplicates(d).collect())
    assert got == sorted([("1", "1", True), ("1", "1", False), ("1", "1", True), ("2", "1", False), ("", "1", False), ("", "", True), ("", "", True), ("3", "3", True), ("3", "3", False), ("4", "4", True)])
    kept = weighted_dedup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] or "", r["text"] or "") for r in kept.collect()) == sorted([("1", a), ("1", b), ("", words(60, 3, 10**6)), ("", ""), ("3", ""), ("4", "")])


def test_bounds_of_large_buckets_lose_nothing(spark):
    base = words(200, 5, 10**6).split()
    texts = [" ".join(f"z{k}" if i in (k % 190, (7 * k) % 190) else x for i, x in enumerate(base)) for k in range(120)]
    classes = lambda small: sorted((r["doc_id"], r["class_id"]) for r in weighted_dedup.near_duplicates(docs(spark, texts), small=small).collect())
    assert classes(2) == classes(12) == classes(200)


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(1, 2**63, 300, dtype=np.uint64))
    a, b = rng.random(300) + 0.1, rng.random(300) + 0.1
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = weighted_dedup.Sampler(800).sample(np.concatenate([h, h]), np.log(np.concatenate([a, b]).astype(np.float32)), np.array([0, 300]))
    assert abs((s[0] == s[1]).mean() - want) < 0.06


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 100_000
    rows = [(3, "http://a/", "same", 1), (1, "http://b/\nx", "same", 1), (2, None, None, 1), (4, "u", "", 1), (5, "u", big, 1), (6, "u", "WARC/1.1\r\n\r\n\r\n\r\n", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _id int")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    for i, _, t, _ in rows:
        raw = (t or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {3: ("revisit", 1), 4: ("revisit", 2)}
    folder = f"file://{tmp_path}/w"
    chunks = warc.chunk_table(spark, warc.write_archives(pages, folder, chunk=1000), chunk=1000).where("record_id = 5").orderBy("chunk_no").collect()
    assert len(chunks) == 200 and b"".join(c["data"] for c in chunks) == big.encode() and [c["is_last"] for c in chunks].count(True) == 1
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_repeated_ids_and_ties(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (2, "v", "same"), (2, "u", "other"), (3, "u", "x"), (None, "u", "x"), (None, None, "null ids"), (None, None, "null ids")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, _key int")
    key = lambda r: tuple(str(x) for x in r)
    dig = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, dig("same"), "response", None), (1, dig("same"), "revisit", 1), (2, dig("same"), "revisit", 1), (2, dig("same"), "revisit", 1), (2, dig("other"), "response", None), (3, dig("x"), "response", None)]
    want += [(None, dig("x"), "revisit", 3), (None, dig("null ids"), "response", None), (None, dig("null ids"), "response", None)]
    got = [(r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r["record_type"] for r in warc.round_trip(pages.where("page_id = 1"), min_revisit=5).collect()} == {"response"}


def test_warc_rejects_cut_archive():
    blob = gzip.compress(warc._head("response", 1, "u", "X", 50, None) + b"short")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(blob)))


PAGE = "<html><head><title>t</title></head><body><header>Top</header><nav><a>Menu</a></nav><article><h1>Head &amp; tail</h1><p>One\n  two<br>three<p>Four<div class='comments'>no</div><div class=box>%s</div></article><aside>side</aside><form>f</form><script>x</script><footer>end</footer></body></html>"


def test_html_extraction(spark):
    rows = [(i, "http://h.org/%d" % i, PAGE.replace("One", f"One{i}") % "Follow our site", 1) for i in range(8)] + [(20, None, None, 1), (21, "x", "plain &lt; text", 1), (22, "http://h.org/", "<p>a<p>b</div><ul><li>c<li>d", 1), (23, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, 1)]
    got = {r["page_id"]: r["text"] for r in site_templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[3] == "Head & tail\nOne3 two three\nFour"
    assert got[20] == "" and got[21] == "plain < text" and got[22] == "a\nb\nc\nd" and got[23] == "deep"


def test_repeated_articles_are_no_template(spark):
    rows = [(i, "http://h.org/%d" % i, "<nav>n%d</nav><article><h1>T</h1><p>Same passage</p></article>" % i) for i in range(30)]
    got = site_templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in got.collect()} == {"T\nSame passage"}


def test_template_of_pages_all_in_containers(spark):
    rows = [(i, "http://h.org/%d" % i, "<article>\n<div><p>Text %d</p></div>\n<div class=box>Read us daily</div>\n</article>" % i) for i in range(12)]
    got = site_templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {i: "Text %d" % i for i in range(12)}


def test_template_share_of_different_articles(spark):
    page = lambda i, more="": "<article><p>Text %d</p>%s</article>" % (i, more)
    box = "<div>Read us daily</div>"
    copied = [(i, "http://copied.org/%d" % i, page(min(i, 10), box if i < 10 else "")) for i in range(200)]
    large = [(1000 + i, "http://large.org/%d" % i, page(i, box if i < 240 else "<div>Just once or twice %d</div>" % (i // 4))) for i in range(3000)]
    got = {r["page_id"]: r["text"] for r in site_templates.main_texts(spark.createDataFrame(copied + large, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Text %d" % min(i, 10) for i in range(200)) and all(got[1000 + i] == "Text %d" % i for i in range(240))
    assert all(got[1000 + i] == "Text %d\nJust once or twice %d" % (i, i // 4) for i in range(240, 3000))


def test_url_rules_and_mining(spark):
    urls = [f"http://{'pills' if i % 2 else 'news'}.site{i % 7}.net/{'buy' if i % 2 else 'read'}/{i}" for i in range(200)]
    lab = spark.createDataFrame([(u, bool(i % 2)) for i, u in enumerate(urls)], "url string, block boolean")
    pages = [(0, "http://pills.x.net/z"), (1, "https://NEWS.x.net/buy"), (2, "http://www.example.org/en/12?q"), (3, "http://example.org/en/2"), (4, "ftp://a.com/de/"), (5, None), (6, "no scheme"), (7, "http://a.com")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), lab).collect()}
    assert got[0][3] == "block" and got[1] == ("news.x.net", "/buy", None, "block")
    assert got[2] == ("www.example.org", "/en/12", "example.org/en/1", "block") and got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("a.com", "", None, "allow")
    none = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), lab.where("not block"))
    assert none.where(F.col("n_rules") > 0).count() == 0


def test_url_mining_equals_brute_force(spark):
    """A rare bad host among many good URLs, and a table that is mostly bad: verdicts against all token sets."""
    import itertools

    r = random.Random(8)
    rare = [(f"http://{r.choice(['a', 'b', 'c'])}.good{r.randrange(9)}.org/{r.choice(['news', 'blog', 'shop'])}/{r.choice(['x', 'y'])}", r.random() < 0.02) for _ in range(3000)]
    rare += [(f"http://pills.bad.net/{r.choice(['buy', 'read'])}/x", r.random() < 0.9) for _ in range(30)]
    most = [(f"http://{'spam' if i % 4 else 'ham'}{i % 3}.net/{r.choice(['p', 'q'])}/{'deal' if i % 8 > 3 else 'info'}", bool(i % 4) or r.random() < 0.3) for i in range(400)]
    for rows in (rare, most):
        lab = spark.createDataFrame(rows, "url string, block boolean")
        tokens = [frozenset(x["t"]) for x in lab.select(url_filter.url_tokens(F.col("url")).alias("t")).collect()]
        bad, n = [b for _, b in rows], len(rows)
        rate = sum(bad) / n
        sets = {frozenset(c) for t in set(tokens) for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)}
        lift, rules = min(url_filter.MIN_LIFT, (1 + 1 / rate) / 2), []
        for c in sets:
            on = [b for t, b in zip(tokens, bad) if c <= t]
            if sum(on) >= url_filter.MIN_COUNT and sum(on) / len(on) >= url_filter.MIN_CONFIDENCE and sum(on) / len(on) / rate >= lift:
                rules.append(c)
        want = {u: any(c <= t for c in rules) for (u, _), t in zip(rows, tokens)}
        urls = sorted(want)
        pages = spark.createDataFrame([*enumerate(urls), (len(urls), urls[0])], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("_id", F.lit(2))
        got = {(x["page_id"], x["verdict"]) for x in url_filter.judge_urls(pages, lab, fixed=[]).collect()}
        assert got == {(i, "block" if want[u] else "allow") for i, u in [*enumerate(urls), (len(urls), urls[0])]}
        assert 0 < sum(want.values()) < len(want)
    assert url_filter.judge_urls(pages.limit(0), lab).count() == 0
    long = spark.createDataFrame([(1, "http://pills.bad.net/" + "buy/" * 30_000)], "page_id long, url string")
    assert url_filter.judge_urls(long, lab.limit(0)).first()["verdict"] == "allow"


def test_host_prior_equals_sql(spark, tmp_path):
    """Hosts that fall and hosts that stay, one with a third of all rows, against the SQL form."""
    import duckdb

    from matrica.llm import queries

    rows, k = [], 0
    for h, n, bad in [("hot", 150, 0.7), ("fine", 80, 0.05), ("tiny-bad", 2, 1.0), ("bad", 40, 0.9), (None, 60, 0.1), *((f"h{i}", 12, 0.1) for i in range(8))]:
        for i in range(n):
            rows.append((k, "bad text" if i < bad * n else words(30, k), "en", h, 1))
            k += 1
    d = spark.createDataFrame([*rows, rows[0], rows[100]], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = quality_rules.quality_verdicts(d).toPandas().sort_values(["doc_id"]).reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    one = "SELECT source, sum((NOT kept AND NOT base_failed)::INT) AS gone FROM (" + queries.oracle_sql()["op4_quality_rules"] + ") JOIN (SELECT DISTINCT doc_id, source FROM documents) USING (doc_id) GROUP BY source"
    gone = {h: n for h, n in con.sql(one).fetchall() if n}
    back = got.merge(d.select("doc_id", "source").distinct().toPandas(), on="doc_id")
    mine = back[~back.kept & ~back.base_failed].groupby("source").size().to_dict()
    assert mine == gone and set(mine) == {"hot", "bad"}


def test_prior_recovers_its_parameters():
    rng = np.random.default_rng(3)
    n = rng.integers(5, 200, 4000)
    for mean, strength in ((0.2, 5.0), (0.5, 30.0)):
        p = rng.binomial(n, rng.beta(mean * strength, (1 - mean) * strength, 4000)) / n
        m, rho = quality_rules.weighted_prior(n.sum(), (n * p).sum(), (n * p * p).sum(), (n * n).sum(), 4000.0, n.sum())
        assert abs(m - mean) < 0.02 and abs(1 / rho - 1 - strength) < 0.15 * strength
    assert quality_rules.weighted_prior(10.0, 0.0, 0.0, 50.0, 2.0, 10.0) == (0.0, 0.0)


def test_fit_is_bounded_in_bytes(spark):
    good, bad = "\n".join([words(8, 1)] * 3), "\n".join(["$$$ *** " + words(3, 2)] * 3)
    rows = [(i, (good if i % 2 else bad) + f" {i}", "en", "s", 1, 0) for i in range(60)] + [(100, "long " * 50_000, "en", "s", 1, 0), (1, good, "xx", "s", 1, 0), (101, None, "en", "s", 1, 0)]
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 0), (101, 1), (None, 1), (5, None), (7, 9), (999, 0)], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    m = line_crf.fit_labels(d, lab, train_bytes=6000)
    s = {(r["doc_id"], r["score"] >= 0.5) for r in line_crf.score_documents(d, m).collect() if r["doc_id"] < 60}
    assert sum((i, i % 2 == 1) in s for i in range(60)) >= 57
    assert line_crf.score_documents(d.limit(0), m).count() == 0
    assert line_crf.fit_labels(d, lab.limit(0)).constant == 1.0 and line_crf.fit_labels(d, lab.where("quality = 1")).constant == 1.0
    assert line_crf.fit_labels(d, lab, train_bytes=1).constant is not None


def test_decontamination_repeats_and_empty(spark):
    items = [words(30, 50), words(30, 50), words(6, 51)]
    b = spark.createDataFrame([(0, items[0]), (1, items[1]), (2, items[2]), (2, items[2])], "item_id long, text string")
    d = spark.createDataFrame([(1, "x y " + items[0]), (1, items[2]), (1, items[2]), (2, words(9, 3)), (None, items[0])], "doc_id long, text string").withColumn("_s", F.lit(1))
    got = sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontaminate.contaminated(d, b).collect())
    assert got == [(1, 0, 26, 26), (1, 1, 26, 26), (1, 2, 2, 2)]
    assert decontaminate.contaminated(d.limit(0), b).count() == 0


def test_site_templates_without_telling_names(spark):
    """Boilerplate that no name gives away goes by recurrence alone; a host of few pages keeps it."""
    page = "<body><div class=x1><p>All our pages carry this</p></div><article><h1>T%d</h1><p>Text %d</p><section class=x2>Share me</section></article><article><p>Second %d</p></article><div class=x3>End</div></body>"
    rows = [(i, f"http://big.org/{i}", page % (i, i, i), 1) for i in range(40)] + [(100 + i, f"http://few.org/{i}", page % (i, i, i), 1) for i in range(2)] + [(0, "http://big.org/0", page % (0, 0, 0), 1)]
    out = site_templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, _key int")).collect()
    got = {r["page_id"]: (r["text"], r["n_templates"]) for r in out}
    assert len(out) == 43 and all(got[i] == (f"T{i}\nText {i}\nSecond {i}", 3) for i in range(40))
    assert got[100] == ("T0\nText 0\nShare me\nSecond 0", 0)
    deep = "<div>" * 5000 + "<nav>gone</nav><p>a<p>b" + "</div>" * 5000
    assert site_templates.extract(deep)[0] == "a\nb"


def test_pipeline_from_end_to_end(spark, tmp_path):
    import corpus_pipeline

    bench = [words(30, 70 + i) for i in range(3)]
    texts = ["\n".join(words(12, 200 + 7 * i + k) for k in range(6)) for i in range(60)]
    texts += [texts[0], texts[1] + " more", "short", None, texts[2] + "\n" + bench[1], "\n".join(["$$$ *** !!! ###"] * 12)]
    docs(spark, texts).drop("band").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(40)] + [(65, 0, 0), (62, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"] for r in out.collect()}
    assert got >= set(range(3, 60)) and not got & {60, 61, 62, 63, 64}
    assert {"doc_id", "n_tokens"} <= set(out.columns)
