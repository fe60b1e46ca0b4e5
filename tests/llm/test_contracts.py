"""The queries' results against brute force over whole small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.common import lower, words
from textmill.llm import queries as Q


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return {r.doc_id: r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}


def test_sharding(spark, tiny, docs):
    rows = Q.op1_sharding(spark, tiny).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_shard = defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "rows")
        by_shard[r.shard].append(r)
    assert sorted(by_shard) == list(range(16))
    counts = [len(x) for x in by_shard.values()]
    assert max(counts) - min(counts) <= 1
    sources = Counter(r.source for r in docs.values())
    for shard in by_shard.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        own = Counter(r.source for r in shard)
        for s, n in sources.items():
            assert abs(own[s] - n / 16) <= 2


def test_packing(spark, tiny, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for d, r in docs.items()}
    rows = Q.op2_packing(spark, tiny).collect()
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, all_ids in ids.items():
        at = 0
        for start, length in sorted(covered[d]):
            assert start == at
            at += length
        assert at == len(all_ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 4096 * 2


def test_token_ids_of_odd_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from textmill.llm.packing import ChunkTokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own, rng = Tokenizer.from_file(path), ChunkTokenizer(path), random.Random(11)
    pieces = ["İ", "İ.", "i̇,", "é", "e\u0301", "क़", "ß", "ẞ.", "word", "Word", "a", "1", ".", ",", " ", "\n", "\x1c", "\u00a0", "\u2009", "'s", "'", "-", "_", "日本", "\U0001f600", "\u0338", "<", "²", "ǅ.", "ﬁ,", "\u200b"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(20_000)]
    got = own.encode(texts)
    want = tok.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g.tolist() != w.ids] == []


def test_hidden_markov_scores(spark, tiny, docs):
    rows = {r.doc_id: r for r in Q.op4_hmm_scores(spark, tiny).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    tokens = {d: [*words(lower(r.text)), None] for d, r in docs.items()}
    count = Counter(t for d in docs if not held[d] for t in tokens[d])
    n, v = sum(count.values()), len(count)
    total = [0.0, 0.0]
    for d, t in tokens.items():
        r = rows[d]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)
        assert r.held_out == held[d] and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(t), sum(count[x] > 0 for x in t))
        assert r.base_score == pytest.approx(base, abs=1e-6 * len(t))
        if held[d]:
            total[0] += base
            total[1] += r.score
    assert total[1] > total[0]


def test_substrings(spark, tiny, docs):
    rows = {r.doc_id: r for r in Q.op5_substring_dedup(spark, tiny).collect()}
    seen = set()
    for d in sorted(docs):
        w = words(docs[d].text)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (rows[d].n_words, rows[d].n_removed, rows[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_substrings_of_rows_without_an_id(spark):
    from textmill.llm.substrings import removal_digest, repeated_spans, without_repeats

    line = " ".join(f"w{i}" for i in range(40))
    rows = [(None, line, 1), (5, line, 2), (7, "x " + line + " y", 3), (8, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __asked long")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in removal_digest(docs, repeated_spans(docs)).collect()}
    assert got == {None: (40, 0), 5: (40, 40), 7: (42, 40), 8: (0, 0)}
    assert {(r.doc_id, r.text, r["__asked"]) for r in without_repeats(docs).collect()} == {(None, line, 1), (5, "", 2), (7, "x y", 3), (8, None, 4)}


def test_language(spark, docs):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op7_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        t = truth[r.doc_id]
        if r.held_out and t.lang is not None and len(t.text or "") >= 40:
            total += 1
            right += r.lang_pred == t.lang
    assert right >= 0.97 * total > 0


def _fingerprint(text):
    import xxhash

    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, tiny, docs):
    fps = {d: _fingerprint(r.text) for d, r in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = Q.op9_simhash(spark, tiny).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(d, f"{fps[d]:016x}", find(d)) for d in docs}
    assert len(rows) == len(docs)


def test_quality(spark, tiny, docs):
    rows = {r.doc_id: r for r in Q.op10_quality_rules(spark, tiny).collect()}
    for d, doc in docs.items():
        text, w = doc.text or "", words(doc.text)
        lines = [x for x in text.split("\n") if words(x)]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = [False] * len(w)
        for i in range(len(w) - 7):
            if windows[tuple(w[i : i + 8])] > 1:
                repeat[i : i + 8] = [True] * 8
        r = rows[d]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(repeat))
        assert r.base_failed == (len(w) < 20 or 100 * sum(repeat) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q.op10_quality_rules(spark, sf).collect() if r.doc_id in label]
    good = [r for r in rows if label[r.doc_id] == 1]
    assert sum(r.kept for r in good) >= 0.95 * len(good)


@pytest.mark.parametrize("name", Q.ORACLE_SQL)
def test_query_matches_sql(spark, tiny, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        db.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    want = db.sql(Q.ORACLE_SQL[name])
    got = Q.QUERIES[name](spark, tiny)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.fetchall()))


def test_interleaving_does_not_depend_on_ranges(spark):
    """Rows without a key, ties and repeated rows: the same places whatever the number of ranges, every slot once."""
    from textmill.llm.sharding import interleave, range_bits_for

    rows = [(None if i % 3 == 0 else i // 2, i % 50, "ab"[i % 5 == 0] if i % 7 else None, 9) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, crc long, source string, shard int")
    found = [interleave(df, ties=("crc",), shards=7, range_bits=b).select("doc_id", "crc", "source", "shard", "slot").collect() for b in (1, 10, 16)]
    assert Counter(found[0]) == Counter(found[1]) == Counter(found[2])
    places = sorted((r.shard, r.slot) for r in found[0])
    counts = Counter(s for s, _ in places)
    assert places == [(s, k) for s in range(7) for k in range(counts[s])] and max(counts.values()) - min(counts.values()) <= 1
    assert [range_bits_for(n) for n in (0, 256_410, 10**10, 10**15)] == [10, 10, 14, 20]


def test_token_rollup(spark, tiny, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    labels = spark.read.parquet(f"{tiny}/labels.parquet").collect()
    toxic, poor = {r.doc_id for r in labels if r.toxic == 1}, {r.doc_id for r in labels if r.quality == 0}
    want = defaultdict(lambda: [0, 0])
    for d, r in docs.items():
        if d not in toxic:
            each = {"bpe": len(tok.encode(r.text or "", add_special_tokens=False).ids) + (d in poor), "words": len(words(r.text))}
            for version, n in each.items():
                total = want[r.source, r.lang, version]
                total[0], total[1] = total[0] + 1, total[1] + n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in Q.op8_token_rollup(spark, tiny).collect()}
    assert got == dict(want)


def test_leaks_of_whole_items(spark, tiny, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()}
    rows = Q.op3_decontamination(spark, tiny).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    flat = {d: " ".join(words(r.text)) for d, r in docs.items()}
    whole = {(d, i) for d, t in flat.items() for i, x in items.items() if " ".join(words(x)) in t}
    assert whole and whole <= found
    for r in rows:
        assert r.question_overlap >= 0.5 and r.answer_overlap >= 0.5


def test_licences(spark, tiny, docs):
    from textmill.llm.licences import CONFIRM

    rows = Q.op6_licence_scan(spark, tiny).collect()
    assert len({(r.doc_id, r.paragraph) for r in rows}) == len(rows)
    for r in rows:
        assert 0 <= r.probability <= 1 and r.confirmed == (r.similarity >= CONFIRM) and (not r.confirmed or r.family != "unknown")
    planted = {"Apache License, Version 2.0": "apache-2.0", "the MIT License": "mit", "GNU General Public License, version 3": "gpl-3.0", "CC BY-NC 4.0": "cc-by-nc-4.0", "All rights reserved": "proprietary"}
    want = {(d, f) for d, r in docs.items() for x, f in planted.items() if x in (r.text or "")}
    assert want and {(r.doc_id, r.family) for r in rows if r.confirmed} == want


def test_licences_in_wrapped_texts_and_other_words(spark):
    from textmill.llm import licences as L

    mit = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
    others = ["Available under Apache-2.0.", "We chose the MPL 2.0 for this library.", "Released under the Zebra Public License.", "The garden is open to visitors in May.", "His driving licence was lost."]
    texts = [mit, gpl, bsd, *others, None, "", "   "]
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    best = {}
    for r in rows:
        best[r.doc_id] = max(best.get(r.doc_id, (False, 0.0, "unknown")), (r.confirmed, r.probability if r.family != "unknown" else 0.0, r.family))
    family = {k: v[2] for k, v in best.items()}
    assert [best[k][0] for k in range(3)] == [True] * 3 and [family[k] for k in range(5)] == ["mit", "gpl-3.0", "bsd-3-clause", "apache-2.0", "mpl-2.0"]
    assert all(family.get(k, "unknown") == "unknown" for k in (5, 6, 7, 8, 9, 10))


def test_licence_scores_are_those_of_the_model(spark):
    from textmill.llm import licences as L

    model = L.train()
    texts = [t for _, t in L.labelled_paragraphs() if L.held_out(t) and "\n" not in t]
    got = {(r.doc_id, r.paragraph): r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    right = 0
    for k, (family, t) in enumerate((f, t) for f, t in L.labelled_paragraphs() if L.held_out(t)):
        grams = L._grams(t)
        z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.bias))) / np.sqrt(max(len(grams), 1))
        p = np.exp(z) / np.exp(z).sum()
        top = model.families[int(p[:-1].argmax())]
        told = top if p[:-1].max() >= model.threshold and not L.contradicts(top, t) else "unknown"
        r = got.get((k, 0))
        if r is None:
            # without a word that speaks for a family, the model cannot name one
            assert told == "unknown"
        elif (k, 1) not in got:
            assert r.probability == pytest.approx(p[:-1].max(), rel=1e-6) and r.family == told
        right += told == family
    assert right >= 0.9 * len(texts)


def test_licences_next_to_a_family_are_not_confirmed(spark):
    from textmill.llm import licences as L

    neighbours = [
        "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.",
        "Released under the BSD 2-Clause License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC",
        "Licensed under the Eclipse Public License, v. 2.0.", "SPDX-License-Identifier: EPL-2.0",
        "Licensed under CC BY-NC-ND 4.0.", "This work is not licensed under the MIT License.", "Released under the GPL version 2.", "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the Apache License, Version 1.1.", "Licensed under the Mozilla Public License 1.1.", "This work is licensed under a Creative Commons Attribution 3.0 International License.",
    ]
    own = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the GPL version 3.": "gpl-3.0", "Licensed under CC BY 4.0.": "cc-by-4.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "Released under the BSD 3-Clause License.": "bsd-3-clause", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary",
    }
    rows = L.scan(spark.createDataFrame(list(enumerate([*neighbours, *own])), "doc_id long, text string")).collect()
    named = {}
    for r in rows:
        named.setdefault(r.doc_id, set()).add((r.family, r.confirmed))
    assert {i: x for i, x in named.items() if i < len(neighbours) and x != {("unknown", False)}} == {}
    assert [named[len(neighbours) + k] for k in range(len(own))] == [{(f, True)} for f in own.values()]


def test_licence_hold_out_is_of_whole_phrases_and_foreign_names():
    from textmill.llm import licences as L

    rows = L.labelled_paragraphs()
    held = [(f, t) for f, t in rows if L.held_out(t)]
    assert 0.1 < len(held) / len(rows) < 0.5 and any(f == "unknown" for f, _ in held)
    phrases = L.PHRASES[3::4]
    assert all(L.held_out(p.format(n)) for p in phrases for names in L.NAMES.values() for n in names)
    assert 0.3 < L.train().threshold < 0.95
