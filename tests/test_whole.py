"""Queries of the catalogue do the whole job: no rows or stages are left out."""

import unicodedata

from textmill.plans import catalogue


def _documents(spark, at, texts):
    rows = [(k, t, lang, f"src{k % 2}", n) for k, (t, lang, n) in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")


def test_attack_report_takes_every_document(spark, tmp_path):
    long_text = " ".join(f"The word {i} is here." for i in range(500))
    texts = [("A big cat.", "en", 10), (long_text, "en", len(long_text)), ("Ein Satz. Noch einer.", "de", 21), ("no language", None, None), (None, "en", None)]
    _documents(spark, tmp_path, texts)
    rows = catalogue.attack_report(spark, str(tmp_path)).collect()
    assert len(rows) == 17 and {r.n for r in rows} == {5}
    changed = {(r.attack, r.severity): 5 - r.no_ops for r in rows}
    assert changed["homoglyph_substitute", 0.2] >= 2 and changed["zero_width_insert", 0.05] >= 1


def test_exact_contamination_takes_all_documents_and_normalises(spark, tmp_path):
    texts = ["one  text of   some words", "other", "one text of some words", None, "ﬁne words", "unseen"]
    _documents(spark, tmp_path, [(t, "en", 1) for t in texts])
    items = [(1, "one text of some words"), (2, "fine words"), (3, "not there"), (4, None), (5, " other ")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = {k: " ".join(unicodedata.normalize("NFKC", t).split()) for k, t in enumerate(texts, 1) if t is not None}
    want = {(i, min(k for k, p in plain.items() if p == " ".join(t.split()))) for i, t in items if t is not None and " ".join(t.split()) in plain.values()}
    assert len(want) == 3
    assert {(r.item_id, r.train_id) for r in catalogue.whole_exact_contamination(spark, str(tmp_path)).collect()} == want


def test_funnel_runs_the_stages_after_redaction(spark, tmp_path):
    nouns = "river mountain harbour garden window kitchen teacher doctor village market bridge castle forest island valley station library museum theatre factory".split()
    kept = " ".join(f"the {a} and a {b}" for a, b in zip(nouns, nouns[1:], strict=False))
    spaced = kept.replace(" ", "  ")
    # long enough only with the address that redaction shortens
    address = " ".join("the sea and a big dog of it is on my red bed in an old".split() * 3) + " it is by me " + "a" * 60 + "@example.com"
    _documents(spark, tmp_path, [(kept, "en", 1), (spaced, "en", 1), ("short", "en", 1), (None, "en", 1), ("\u200b", "en", 1), (address, "en", 1)])
    rows = catalogue.QUERIES[catalogue.FLAGSHIP](spark, str(tmp_path)).collect()
    counts = {}
    for r in rows:
        counts[r.reason] = counts.get(r.reason, 0) + r.n
    # two spellings of one text are two kept documents only if they are not normalised
    assert counts == {"kept": 1, "too_short_chars": 1, "empty_or_unidentified": 1, "empty_after_normalization": 1, "too_short_chars_after_redaction": 1}
