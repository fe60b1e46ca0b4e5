"""What showed on larger tables only: lost digits, slow forms of expressions, disk that grows."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from textmill.functions import attacks
from textmill.functions import text as T
from textmill.llm import simhash
from textmill.operators import cleaning
from textmill.plans import catalogue
from textmill.sources import readers


def test_quotes_keep_digits_at_their_ends(spark):
    first = "0997 begins this sentence of enough letters 0."
    others = [f"{k}{k} begins the sentence number {k} of them and ends with {k}" + ("." if k < 4 else "") for k in range(1, 5)]
    docs = spark.createDataFrame([(1, "  ".join([first, *others])), (2, "  " + others[3] + " ")], "doc_id long, text string")
    got = {(r.doc_id, r.place): r.quote for r in readers.quotes(docs).collect()}
    assert got == {**{(1, k): q for k, q in enumerate([first, *others])}, (2, 0): others[3]}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_split_once(spark):
    docs = spark.createDataFrame([(1, "One. Two. Three.")], "doc_id long, text string")
    assert _plan(attacks.attack_matrix(docs, {"sentence_reorder": (0.3,)})).count("split(") == 1


def test_plain_texts_stay_out_of_python_and_are_normalised_alike(spark):
    texts = ["a  b \n c\n\n\n\nd ", " x<b>y</b> [t](u) ", "é​ß ", "аб в", "ﬁne\xa0print", "a&nbsp;&amp;lt; b", "a\r\n b\x0b c", "", None, " \n ", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(T.normalize("t")).collect()]
    assert got == ["a b\nc\n\nd", "x y t", "éß", "аб в", "fine print", "a < b", "a\nb\x0b c", "", None, "", "é"]
    sent = df.select("t", F.col("t").rlike(T.PLAIN).alias("plain")).collect()
    assert all(r.t is None or not r.plain or unicodedata.normalize("NFKC", r.t) == r.t for r in sent) and sum(bool(r.plain) for r in sent) >= 5
    assert "rlike" in _plan(df.select(T.normalize("t"))).lower()


def test_tokens_are_counted_between_white_space(spark):
    texts = ["", " ", "a", " a\tb　c\x1cd\n", "a ", "\xa0x y"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").coalesce(1).select(T.token_count("t").alias("n"))
    assert [r.n for r in df.collect()] == [*[len(re.findall(rf"[^{T.SPACES}]+", t)) for t in texts], None]
    assert "regexp_extract_all" not in _plan(df)


def test_funnel_counts_tokens_and_finds_words_once(spark):
    records = spark.createDataFrame([("a", 1, "text")], "source_id string, source_record_id long, text string")
    judged = cleaning.judge(records, normalise=False, redact=False).select("reject_reason")
    plan = _plan(judged)
    # one pattern each for plain texts and for others, whatever number of stages reads their result
    assert plan.count(f"{T.UNPRINTED}[{T.SPACE}]+") == 1 and plan.count(T.NO_WORD) == 2 and plan.count("(?U)") == 1


def test_plain_texts_are_measured_like_others(spark):
    rng = random.Random(15)
    parts = ["a", "Of", "of", "ÉÉ", "éé", "Ж", "ж", "İ", "i̇", "ß", "ΑΣ", "ας", "中", "中文", "_", "x_1", "²", "7", "\u200b", "\u200c", "don't", "…", "“q”", "(", ".", "==", " ", "  ", "\n", " \n\n", "\t", "\r\n", "\xa0", "\u3000", "\x1c", "\u2028"]
    plain = [p for p in parts if re.fullmatch(r"[\n -~éÉЖж中文\u200b]*", p)]
    texts = ["", " ", "\n", "_", "...", "İ", "a\n a \nb", *["".join(rng.choices(plain if k % 2 else parts, k=rng.randrange(60))) for k in range(400)]]
    t = F.col("t")
    alone = F.struct(T.symbol_ratio(t).alias("symbols"), T.repeated_line_ratio(t).alias("repeated"), T.mean_word_length(t).alias("word_length"), T.unique_word_ratio(t).alias("distinct"))
    df = spark.createDataFrame([(x,) for x in texts], "t string").coalesce(1)
    rows = df.select("t", t.rlike(T.STEADY).alias("steady"), T.token_count(t).alias("n"), T.quality(t).alias("q"), alone.alias("alone")).collect()
    assert 150 < sum(r.steady for r in rows) < len(rows) - 150
    assert all(r.q == r.alone for r in rows)
    assert all(r.n == len(re.findall(rf"[^{T.SPACES}]+", r.t)) for r in rows)
    # lowering keeps the number of characters of each steady character, and whether it belongs to a word
    each = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS t")).where(t.rlike(T.STEADY))
    word = rf"\A{T.WORD}\z"
    assert each.count() > 20_000 and each.where((F.length(F.lower(t)) != 1) | (F.lower(t).rlike(word) != t.rlike(word))).count() == 0


def test_batches_of_pages_and_texts_are_bounded(spark, tiny):
    for query in (catalogue.page_text, catalogue.whole_exact_contamination, catalogue.document_attributes):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        query(spark, tiny)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_matched_cap_moves_no_texts(spark, tiny):
    assert "text" not in _plan(catalogue.matched_cap(spark, tiny))


def test_filed_fingerprints_move_once(spark):
    fps = [0, 1, 3, 7, 15, 31, 1 << 40, (1 << 40) | 3, -1, -2, 0x5555555555555555]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert "Join" not in _plan(simhash._near(df))
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {x: {x} for x in fps}
    for _ in fps:
        want = {x: set().union(*(want[y] for y in fps if far(x, y) <= 4)) for x in fps}
    assert {r.fp: r.comp for r in simhash.fingerprint_groups(df).collect()} == {x: min(want[x]) for x in fps}
