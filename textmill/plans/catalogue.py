"""All queries of the core operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import attacks, attributes, spans
from textmill.functions import hashing as H
from textmill.functions import text as T
from textmill.operators import audits, cleaning, decisions, dedup, density, lake, metrics, mining, mixtures, robustness, sampling
from textmill.operators.tables import bound_batches, checkpointed, spread
from textmill.sources import pools, readers

FLAGSHIP = "whole_cleaning_funnel"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_docs(spark, sf)).select(F.col("source").alias("source_id"), F.col("doc_id").alias("source_record_id"), "text")


def _split(docs: DataFrame) -> DataFrame:
    return docs.withColumn("source_group_id", H.group_id("doc_id")).withColumn("split", H.split_of("source_group_id"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as y with a score that is a function of the document."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    return _docs(spark, sf).join(labels, "doc_id").select("doc_id", F.col("source").alias("regime"), "y", ((F.col("n_chars") * 7 + F.col("doc_id")) % 97 / 97.0).alias("s"))


def cleaning_funnel(spark, sf):
    """The stages that SQL can follow: without normalisation and redaction; see whole_cleaning_funnel."""
    return cleaning.funnel_counts(cleaning.judge(_records(spark, sf), normalise=False, redact=False))


def whole_cleaning_funnel(spark, sf):
    """The funnel with all its stages."""
    return cleaning.funnel_counts(cleaning.judge(_records(spark, sf)))


def cleaned_documents(spark, sf):
    return cleaning.clean(_records(spark, sf)).select("doc_id", "token_count", "language_score", "content_sha256", "split", F.array_join("quality.pii_flags", ",").alias("flags"))


def text_statistics(spark, sf):
    t = F.coalesce("text", F.lit(""))
    each = {"tokens": T.token_count(t), "symbols": F.round(T.symbol_ratio(t), 9), "repeated": F.round(T.repeated_line_ratio(t), 9), "word_length": F.round(T.mean_word_length(t), 9), "distinct_words": F.round(T.unique_word_ratio(t), 9)}
    return spread(_docs(spark, sf).select("doc_id", "text")).select("doc_id", *[c.alias(n) for n, c in each.items()])


def language_scores(spark, sf):
    lang = T.language(F.coalesce("text", F.lit("")))
    return _docs(spark, sf).select("doc_id", lang.alias("l")).select("doc_id", "l.language", F.round("l.score", 4).alias("score"))


def personal_data(spark, sf):
    return T.with_redacted(spread(_docs(spark, sf)).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "r").select("doc_id", F.array_join("r.flags", ",").alias("flags"), H.sha256("r.text").alias("redacted_sha256"))


def exact_dedup(spark, sf):
    docs = _docs(spark, sf).select("doc_id", H.sha256("text").alias("content_sha256"))
    return dedup.first_of_content(docs)


def near_duplicates(spark, sf):
    return dedup.near_duplicates(spread(_docs(spark, sf)))


def split_assignment(spark, sf):
    return _split(_docs(spark, sf)).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


def shard_sizes(spark, sf):
    return _docs(spark, sf).select(H.shard_of(H.sha256("text"), 16).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def regime_rates(spark, sf):
    found = metrics.regime_scores(_scores(spark, sf), 0.5, 0.01)
    return found.select("regime", "n", "n_human", "n_ai", *[F.round(c, 9).alias(c) for c in ("auroc", "fpr", "fnr", "precision", "ece")], "measurable")


def fpr_threshold(spark, sf):
    return metrics.threshold_at_fpr(_scores(spark, sf), 0.05, ("regime",)).select("regime", "n_human", F.round("cut", 9).alias("cut"))


def condition_cost(spark, sf):
    return metrics.condition_cost(_scores(spark, sf), 0.9, ("regime",)).select("regime", *[F.round(c, 9).alias(c) for c in ("fpr", "median", "p95", "p99", "largest")])


def discordant_pairs(spark, sf):
    paired = _scores(spark, sf).select("y", F.col("s").alias("a"), ((F.col("s") * 97 + F.col("doc_id")) % 89 / 89).alias("b"))
    return metrics.discordant(paired, 0.5, 0.6)


def value_drift(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    sides = events.select((F.col("value") / 40).alias("v"), F.when(F.col("event_id") % 3 == 0, "current").otherwise("reference").alias("side"))
    found = metrics.drift(sides, "v", "side")
    return found.select(*[F.round(c, 9).alias(c) for c in ("psi", "kl", "reference_mean", "current_mean")], "n_reference", "n_current", "severity")


def group_scores(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = turns.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("row_order"), (F.col("role") == "assistant").cast("int").alias("y"), (F.length("text") % 101 / 101.0).alias("s"))
    return metrics.group_aware(rows).select("group_id", "y", F.round("s", 9).alias("s"))


def hash_subsample(spark, sf):
    return sampling.subsample(_docs(spark, sf).select("doc_id", "source"), 100)


def labelled_subsample(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("label")).dropDuplicates(["doc_id"])
    return sampling.stratified_subsample(rows, 41)


def capped_documents(spark, sf):
    return sampling.cap_documents(_split(_docs(spark, sf)).select("doc_id", "split"), 120)


def matched_cap(spark, sf):
    # texts are read once, and no more than their bins is moved
    docs = checkpointed(_split(spread(_docs(spark, sf).select("doc_id", "lang", "text"))).select("doc_id", "lang", "split", sampling.length_bin("text").alias("bin")), "bins")
    return sampling.cap_documents_matching(docs.where("lang != 'en'"), docs.where("lang = 'en'"), 90, bin="bin").select("doc_id", "split")


def length_bins(spark, sf):
    return _split(spread(_docs(spark, sf).select("doc_id", "text"))).groupBy("split", sampling.length_bin(F.coalesce("text", F.lit(""))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def interleaved(spark, sf):
    return sampling.interleave(_docs(spark, sf).select("doc_id", "source"), "source", "doc_id", 150)


def cluster_selection(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("cluster"), (F.col("vec_id") * 37 % 1009 / 1009.0).alias("confidence"))
    return sampling.select_proportional(rows, budget=200)


def exact_contamination(spark, sf):
    """Odd documents against even ones, byte for byte, as its SQL has it; see whole_exact_contamination."""
    docs = _docs(spark, sf).select("doc_id", "text")
    return audits.exact_overlap(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), normalise=False)


def whole_exact_contamination(spark, sf):
    """Benchmark items that some document equals after normalisation: all items against all documents."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return audits.exact_overlap(spread(_docs(spark, sf).select("doc_id", "text")), items).select(F.col("doc_id").alias("item_id"), "train_id")


def contamination(spark, sf):
    docs, items = spread(_docs(spark, sf)), spark.read.parquet(f"{sf}/benchmark.parquet")
    return audits.contamination(docs.select("doc_id", "text"), items.select(F.col("item_id").alias("doc_id"), "text"))


def leaking_groups(spark, sf):
    docs = _docs(spark, sf).select(H.sha256(F.coalesce("text", F.lit(""))).alias("source_group_id"), H.split_of(H.group_id("doc_id")).alias("split"))
    return audits.leaking_groups(docs)


def unseen_domain(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.col("source").alias("domain"), H.sha256(F.coalesce("text", F.lit(""))).alias("source_group_id"))
    return audits.unseen_domain(rows, ["src3", "src7"]).groupBy("side", "domain").agg(F.count(F.lit(1)).alias("n"))


def token_windows(spark, sf):
    n = T.token_count(F.coalesce("text", F.lit("")))
    return _docs(spark, sf).select("doc_id", F.posexplode(spans.windows(n)).alias("window_index", "w")).select("doc_id", "window_index", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def role_segments(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    label = F.when(F.col("role") == "system", spans.IGNORE).when(F.col("role") == "assistant", 2).otherwise(0)
    rows = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), label.alias("label"))
    return spans.segments(rows, positive_only=False)


def page_text(spark, sf):
    pages = spread(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"))
    bound_batches(spark)
    return pages.select("page_id", T.token_count(readers.html_text("html")).alias("tokens"))


def quotes(spark, sf):
    return readers.quotes(_docs(spark, sf))


def attack_report(spark, sf):
    made = attacks.judged_matrix(spread(_docs(spark, sf).select("doc_id", "text")), forms=False)
    scored = made.select("attack", "severity", "noop", "valid", "known", "plain", (F.length("attacked") % 101 / 101.0).alias("s"))
    return attacks.attack_report(attacks.settled(scored), 0.5)


def attack_conditions(spark, sf):
    """All documents under all attacks and conditions, against themselves unchanged."""
    docs = spread(_docs(spark, sf).select("doc_id", "text"))
    return robustness.attack_table(docs, lambda t: F.length(t) % 101 / 101.0, 0.5, conditions=tuple(robustness.CONDITIONS))


def source_manifest(spark, sf):
    return lake.manifest(_split(_docs(spark, sf)))


def cluster_atlas(spark, sf):
    """Clusters with their commonest values, exemplars and labels; domains, sources and registers are functions of the vector's id."""
    named = [F.concat(F.lit(c), (F.col("vec_id") % n).cast("string")).alias(c) for c, n in (("domain", 7), ("source", 5), ("register", 3))]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("cluster"), (F.col("vec_id") * 37 % 1009 / 1009.0).alias("confidence"), *named)
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("domains", "sources", "registers", "exemplars")]
    return mining.cluster_summary(rows).select("cluster", "size", F.round("share", 9).alias("share"), F.round("mean_confidence", 9).alias("mean_confidence"), "label", *joined)


def decided(spark, sf):
    """Verdicts of all documents under a threshold and a band that come from their own scores."""
    scores = _scores(spark, sf).select("doc_id", "y", "s")
    policy = decisions.Policy(*decisions.band(scores, 0.05, 0.1))
    return scores.select("doc_id", decisions.decide("s", policy).alias("d")).select("doc_id", "d.verdict", F.round("d.confidence", 9).alias("confidence"), "d.abstained")


def training_rows(spark, sf):
    """English documents stand for the human side, all others for the generated one."""
    docs = _split(_docs(spark, sf)).withColumn("domain", F.col("source"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    ai = docs.where(~english).withColumns({"sample_id": F.col("doc_id"), "generator_family": F.col("lang"), "generator_released": F.lit(None), "prompt_version": F.lit("mirror_v2")})
    made = pools.training_rows(docs.where(english), ai, splits=("train", "val"), arm="mirror")
    return made.select("doc_id", "source_group_id", "split", "label", "domain", "generator_family", F.size("spans").alias("n_spans"), F.col("spans")[0]["end_char"].alias("end_char"))


def document_attributes(spark, sf):
    return attributes.attributes(spread(_docs(spark, sf))).withColumn("key_anchors", F.array_join("key_anchors", ","))


def decodings(spark, sf):
    """Decoding settings of all documents with words."""
    docs = spread(_docs(spark, sf).select("doc_id", "text")).select("doc_id", T.token_count(F.coalesce("text", F.lit(""))).alias("n")).where("n > 0")
    return docs.select("doc_id", attributes.decoding("doc_id", [0.6, 0.8, 1.0], [0.9, 0.95], 1024, "n", greedy=True).alias("d")).select("doc_id", "d.*")


def splice_controls(spark, sf):
    """Pairs of documents of a split, spliced line by line: the test texts have no blank lines."""
    docs = _split(_docs(spark, sf)).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    made = mixtures.splice(mixtures.neighbours(docs.select("doc_id", "source_group_id", "split", "text")))
    return made.select("doc_id", "human_source_id", "ai_source_id", "split", H.sha256("text").alias("text_sha256"), F.size("spans").alias("n_spans"), F.round(spans.ai_char_fraction(F.col("text"), F.col("spans")), 9).alias("ai_share"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("cluster"))


def density_clusters(spark, sf):
    """Density clusters of all vectors."""
    return density.hdbscan(_vectors(spark, sf).drop("cluster"), density.Density(10))


def kmeans_clusters(spark, sf):
    """Sizes and costs of ten clusters of all vectors."""
    found = mining.kmeans(_vectors(spark, sf).drop("cluster"), 10)
    return found.labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("sample_id").alias("first")).withColumns({"converged": F.lit(found.converged), "rounds": F.lit(found.rounds)})


def cluster_silhouette(spark, sf):
    """Mean silhouette of the vectors' labels: 2,000 vectors (all of the smaller tables) against all."""
    return spark.createDataFrame([(round(mining.silhouette(_vectors(spark, sf)), 6),)], "silhouette double")


def atlas_warnings(spark, sf):
    """What speaks against the clusters of cluster_atlas."""
    found = mining.quality_warnings(cluster_atlas(spark, sf), mining.silhouette(_vectors(spark, sf)), "hashing_v1")
    return found.withColumn("value", F.round("value", 6))


QUERIES = {f.__name__: f for f in (
    cleaning_funnel, cleaned_documents, text_statistics, language_scores, personal_data, exact_dedup, near_duplicates, split_assignment, shard_sizes,
    regime_rates, fpr_threshold, condition_cost, discordant_pairs, value_drift, group_scores, hash_subsample, labelled_subsample, capped_documents,
    matched_cap, length_bins, interleaved, cluster_selection, exact_contamination, contamination, leaking_groups, unseen_domain, token_windows,
    role_segments, page_text, quotes, attack_report, source_manifest, cluster_atlas, whole_cleaning_funnel, whole_exact_contamination,
    decided, training_rows, document_attributes, decodings, splice_controls, density_clusters, kmeans_clusters, attack_conditions, cluster_silhouette, atlas_warnings,
)}

_TEXT = "coalesce(text, '')"
_TOKENS = f"len(regexp_extract_all({_TEXT}, '{T.TOKEN}'))"
_WORDS = rf"regexp_extract_all({_TEXT}, '{T.WORD}')"
_LOWER_WORDS = rf"regexp_extract_all(lower({_TEXT}), '{T.WORD}')"
_STRIP = rf"regexp_replace(x, '\A[{T.SPACE}]+|[{T.SPACE}]+\z', '', 'g')"
_LINES = rf"list_filter(list_transform(string_split({_TEXT}, chr(10)), lambda x: {_STRIP}), lambda x: x <> '')"
_SYMBOLS = rf"CASE WHEN {_TEXT} = '' THEN 1.0 ELSE length(regexp_replace({_TEXT}, '[\p{{L}}\p{{N}}_{T.SPACE}]', '', 'g')) / length({_TEXT}) END"
_REPEATED = f"CASE WHEN len({_LINES}) < 2 THEN 0.0 ELSE 1 - len(list_distinct({_LINES})) / len({_LINES}) END"
_WORD_LENGTH = f"CASE WHEN len({_WORDS}) = 0 THEN 0.0 ELSE length(array_to_string({_WORDS}, '')) / len({_WORDS}) END"
_DISTINCT = f"CASE WHEN len({_LOWER_WORDS}) = 0 THEN 0.0 ELSE len(list_distinct({_LOWER_WORDS})) / len({_LOWER_WORDS}) END"
_ENGLISH = ", ".join(f"'{w}'" for w in T.ENGLISH)
_LATIN_WORDS = rf"list_filter({_LOWER_WORDS}, lambda x: regexp_full_match(x, '[a-z]+'))"
_SHARE = f"least(len(list_filter({_LATIN_WORDS}, lambda x: x IN ({_ENGLISH}))) / len({_LATIN_WORDS}) / 0.25, 1.0)"


def _number(text: str, digits: int = 8) -> str:
    return f"CAST('0x' || substr(sha256({text}), 1, {digits}) AS BIGINT)"


def _split_sql(group: str) -> str:
    at = f"{_number(f'{group} || {chr(39)}{H.SPLIT_SALT}{chr(39)}')} % 10000"
    return f"CASE WHEN {at} < 8000 THEN 'train' WHEN {at} < 9000 THEN 'val' ELSE 'test' END"


def _top_sql(column: str) -> str:
    """CTE t<column>: the three commonest values of each cluster of e, smaller values first among equals."""
    counts = f"(SELECT cluster, {column} AS v, count(*) AS n FROM e GROUP BY ALL)"
    return f"t{column} AS (SELECT cluster, list(v ORDER BY n DESC, v)[1:3] AS {column}s FROM {counts} GROUP BY cluster)"


_DOC_SPLIT = _split_sql("'grp_' || CAST(doc_id AS VARCHAR)")
_SCORES = "scores AS (SELECT doc_id, source AS regime, toxic AS y, ((n_chars * 7 + doc_id) % 97) / 97.0 AS s FROM documents JOIN labels USING (doc_id))"

ORACLE_SQL: dict[str, str] = {
    "cleaning_funnel": f"""
WITH judged AS (SELECT doc_id, source, text, CASE
  WHEN {_TEXT} = '' THEN 'empty_or_unidentified'
  WHEN length({_TEXT}) < 200 THEN 'too_short_chars' WHEN {_TOKENS} < 50 THEN 'too_short_tokens' WHEN {_TOKENS} > 20000 THEN 'too_long_tokens'
  WHEN len({_LATIN_WORDS}) = 0 OR {_SHARE} < 0.84995 THEN 'language'
  WHEN {_SYMBOLS} > 0.2 THEN 'high_symbol_ratio' WHEN {_REPEATED} > 0.3 THEN 'repetitive_lines'
  WHEN NOT {_WORD_LENGTH} BETWEEN 2.5 AND 12 THEN 'anomalous_word_length' WHEN {_DISTINCT} < 0.2 THEN 'low_lexical_diversity' END AS reason FROM documents),
kept AS (SELECT min(source || '_' || CAST(doc_id AS VARCHAR)) AS id FROM judged WHERE reason IS NULL GROUP BY text)
SELECT 'kept' AS reason, {_split_sql("'grp_' || id")} AS split, count(*) AS n FROM kept GROUP BY ALL
UNION ALL SELECT reason, NULL, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY ALL""",
    "text_statistics": f"SELECT doc_id, {_TOKENS} AS tokens, round({_SYMBOLS}, 9) AS symbols, round({_REPEATED}, 9) AS repeated, round({_WORD_LENGTH}, 9) AS word_length, round({_DISTINCT}, 9) AS distinct_words FROM documents",
    "language_scores": f"SELECT doc_id, CASE WHEN len({_LATIN_WORDS}) > 0 AND {_SHARE} >= 0.5 THEN 'en' ELSE 'unknown' END AS language, CASE WHEN len({_LATIN_WORDS}) = 0 THEN 0.0 ELSE round_even({_SHARE}, 4) END AS score FROM documents",
    "exact_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha256 FROM documents WHERE text IS NOT NULL GROUP BY text",
    "split_assignment": f"SELECT source, {_DOC_SPLIT} AS split, count(*) AS n FROM documents GROUP BY ALL",
    "shard_sizes": f"SELECT CAST({_number('text')} % 16 AS INTEGER) AS shard, count(*) AS n FROM documents GROUP BY ALL",
    "regime_rates": f"""
WITH {_SCORES}, ranked AS (SELECT *, rank() OVER (PARTITION BY regime ORDER BY s) + (count(*) OVER (PARTITION BY regime, s) - 1) / 2 AS r,
  CASE WHEN s <= 1/15::DOUBLE THEN 0 ELSE CAST(ceil(s * 15) AS INTEGER) - 1 END AS bin FROM scores),
bins AS (SELECT regime, bin, count(*) AS n, avg(CAST((s >= 0.5) = (y = 1) AS INTEGER)) AS acc, avg(greatest(s, 1 - s)) AS conf FROM ranked GROUP BY ALL),
ece AS (SELECT regime, sum(n * abs(acc - conf)) / sum(n) AS ece FROM bins GROUP BY ALL),
base AS (SELECT regime, count(*) AS n, count(*) FILTER (y = 0) AS n_human, count(*) FILTER (y = 1) AS n_ai, sum(r) FILTER (y = 1) AS ranks,
  avg(CAST(s >= 0.5 AS INTEGER)) FILTER (y = 0) AS fpr, avg(CAST(s < 0.5 AS INTEGER)) FILTER (y = 1) AS fnr, avg(CAST(y = 1 AS INTEGER)) FILTER (s >= 0.5) AS precision FROM ranked GROUP BY ALL)
SELECT regime, n, n_human, n_ai, round(CASE WHEN n_ai > 0 AND n_human > 0 THEN (ranks - n_ai * (n_ai + 1) / 2) / (n_ai * n_human) END, 9) AS auroc,
  round(fpr, 9) AS fpr, round(fnr, 9) AS fnr, round(precision, 9) AS precision, round(ece, 9) AS ece, n_human >= 500 AS measurable FROM base JOIN ece USING (regime)""",
    "fpr_threshold": f"""
WITH {_SCORES}, human AS (SELECT regime, s, row_number() OVER (PARTITION BY regime ORDER BY s) AS r, count(*) OVER (PARTITION BY regime) AS n FROM scores WHERE y = 0)
SELECT regime, n AS n_human, round(s, 9) AS cut FROM human WHERE r = least(greatest(ceil((1.0::DOUBLE - 0.05::DOUBLE) * n), 1), n)""",
    "condition_cost": f"WITH {_SCORES} SELECT regime, round(avg(CAST(s >= 0.9 AS INTEGER)), 9) AS fpr, round(median(s), 9) AS median, round(quantile_disc(s, 0.95), 9) AS p95, round(quantile_disc(s, 0.99), 9) AS p99, round(max(s), 9) AS largest FROM scores GROUP BY ALL",
    "discordant_pairs": f"WITH {_SCORES}, p AS (SELECT s AS a, ((s * 97 + doc_id) % 89) / 89 AS b FROM scores WHERE y = 1) SELECT count(*) FILTER (a <= 0.5 AND NOT b <= 0.6) AS only_a, count(*) FILTER (b <= 0.6 AND NOT a <= 0.5) AS only_b FROM p",
    "value_drift": """
WITH v AS (SELECT value / 40 AS v, event_id % 3 = 0 AS cur FROM events), h AS (SELECT v, cur, least(CAST(floor(v * 10) AS INTEGER), 9) AS bin FROM v WHERE v BETWEEN 0 AND 1),
b AS (SELECT i AS bin, count(h.bin) FILTER (NOT cur) AS e, count(h.bin) FILTER (cur) AS a FROM range(10) t(i) LEFT JOIN h ON h.bin = i GROUP BY i),
p AS (SELECT greatest(e / (SELECT sum(e) FROM b), 1e-6) AS e, greatest(a / (SELECT sum(a) FROM b), 1e-6) AS a FROM b),
g AS (SELECT sum((a - e) * ln(a / e)) AS psi, sum(a * ln(a / e)) AS kl FROM p)
SELECT round(psi, 9) AS psi, round(kl, 9) AS kl, round((SELECT avg(v) FROM v WHERE NOT cur), 9) AS reference_mean, round((SELECT avg(v) FROM v WHERE cur), 9) AS current_mean,
  (SELECT count(*) FROM v WHERE NOT cur) AS n_reference, (SELECT count(*) FROM v WHERE cur) AS n_current, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'minor' ELSE 'stable' END AS severity FROM g""",
    "group_scores": "SELECT conv_id AS group_id, CAST(arg_max(role = 'assistant', turn) AS INTEGER) AS y, round(avg((length(text) % 101) / 101.0), 9) AS s FROM conversations GROUP BY ALL",
    "hash_subsample": "SELECT doc_id, source FROM documents ORDER BY sha256('subsample:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100",
    "labelled_subsample": """
WITH r AS (SELECT DISTINCT ON (doc_id) doc_id, toxic AS label FROM labels), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('ood-sample:' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM r)
SELECT doc_id, label FROM k WHERE (label = 0 AND n <= 20) OR (label = 1 AND n <= 21)""",
    "length_bins": f"SELECT {_DOC_SPLIT} AS split, CASE WHEN {_TOKENS} >= 1100 THEN 6 WHEN {_TOKENS} >= 750 THEN 5 WHEN {_TOKENS} >= 500 THEN 4 WHEN {_TOKENS} >= 350 THEN 3 WHEN {_TOKENS} >= 250 THEN 2 WHEN {_TOKENS} >= 150 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM documents GROUP BY ALL",
    "interleaved": "WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT * FROM k ORDER BY turn, source LIMIT 150",
    "exact_contamination": "WITH t AS (SELECT text, min(doc_id) AS train_id FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL GROUP BY text) SELECT doc_id, train_id FROM documents JOIN t USING (text) WHERE doc_id % 2 = 1",
    "leaking_groups": f"WITH d AS (SELECT sha256({_TEXT}) AS source_group_id, {_DOC_SPLIT} AS split FROM documents) SELECT source_group_id FROM d GROUP BY ALL HAVING count(DISTINCT split) > 1",
    "unseen_domain": f"WITH d AS (SELECT doc_id, source AS domain, {_TEXT} AS g FROM documents), k AS (SELECT g, arg_min(domain, doc_id) AS key FROM d GROUP BY g) SELECT CASE WHEN key IN ('src3', 'src7') THEN 'test' ELSE 'train' END AS side, domain, count(*) AS n FROM d JOIN k USING (g) GROUP BY ALL",
    "token_windows": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(CAST(greatest(0, ceil((n - 512) / 384)) AS BIGINT) + 1)) AS k FROM d WHERE n > 0)
SELECT doc_id, CAST(k AS INTEGER) AS window_index, k * 384 AS start, least(k * 384 + 512, n) AS "end" FROM w""",
    "role_segments": """
WITH p AS (SELECT conv_id AS doc_id, turn AS pos, CASE WHEN role = 'assistant' THEN 2 ELSE 0 END AS label FROM conversations WHERE role <> 'system'),
q AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(pos) OVER w = pos - 1 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM q)
SELECT doc_id, label, min(pos) AS start, max(pos) + 1 AS "end" FROM r GROUP BY doc_id, run, label""",
    "cluster_atlas": f"""
WITH e AS (SELECT vec_id, label AS cluster, (vec_id * 37 % 1009) / 1009.0 AS c, 'domain' || CAST(vec_id % 7 AS VARCHAR) AS domain, 'source' || CAST(vec_id % 5 AS VARCHAR) AS source, 'register' || CAST(vec_id % 3 AS VARCHAR) AS register FROM embeddings WHERE label <> -1),
{", ".join(_top_sql(c) for c in ("domain", "source", "register"))},
x AS (SELECT cluster, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY place) AS exemplars FROM (SELECT cluster, vec_id, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, vec_id) AS place FROM e) WHERE place <= 5 GROUP BY cluster),
b AS (SELECT cluster, count(*) AS size, round(count(*) / (SELECT count(*) FROM e), 9) AS share, round(avg(c), 9) AS mean_confidence FROM e GROUP BY cluster)
SELECT cluster, size, share, mean_confidence, registers[1] || ' / ' || domains[1] || ' / via ' || sources[1] AS label, array_to_string(domains, ',') AS domains, array_to_string(sources, ',') AS sources, array_to_string(registers, ',') AS registers, exemplars
FROM b JOIN tdomain USING (cluster) JOIN tsource USING (cluster) JOIN tregister USING (cluster) JOIN x USING (cluster)""",
    "capped_documents": f"""
WITH d AS (SELECT doc_id, {_DOC_SPLIT} AS split FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('cap:' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM d),
z AS (SELECT count(*) AS n, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val FROM d),
q AS (SELECT n, n_val, least(round_even(120 * n_test::DOUBLE / n, 0), n_test) AS q_test, least(round_even(120 * n_train::DOUBLE / n, 0), n_train) AS q_train FROM z)
SELECT doc_id, split FROM k, q WHERE n <= 120 OR place <= CASE split WHEN 'test' THEN q_test WHEN 'train' THEN least(q_train, 120 - q_test) ELSE least(n_val, 120 - q_test - least(q_train, 120 - q_test)) END""",
    # the budget here exceeds the floors, so the deal by rounds never applies
    "cluster_selection": f"""
WITH e AS (SELECT vec_id AS sample_id, label AS cluster, (vec_id * 37 % 1009) / 1009.0 AS confidence FROM embeddings WHERE label <> -1),
z AS (SELECT cluster, count(*) AS size, {_number("'cluster_' || CAST(cluster AS VARCHAR) || " + f"'|{H.SPLIT_SALT}'")} / 4294967295.0::DOUBLE < 0.25::DOUBLE AS low FROM e GROUP BY cluster),
h AS (SELECT cluster, size, CASE WHEN bool_and(low) OVER () THEN false WHEN bool_or(low) OVER () THEN low ELSE count(*) OVER () > 1 AND row_number() OVER (ORDER BY size, cluster DESC) = 1 END AS held FROM z),
s AS (SELECT cluster, size, least(size, 10) AS least_rows, (200 - sum(least(size, 10)) OVER ()) * size::DOUBLE / sum(size) OVER () AS exact FROM h WHERE NOT held),
q AS (SELECT cluster, size, exact - floor(exact) AS part, least(least_rows + CAST(floor(exact) AS BIGINT), size) AS quota FROM s),
r AS (SELECT cluster, quota, size, row_number() OVER (ORDER BY quota >= size, part DESC, cluster) AS turn, 200 - sum(quota) OVER () AS open FROM q),
f AS (SELECT cluster, quota + CASE WHEN quota < size AND turn <= open THEN 1 ELSE 0 END AS quota FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, sample_id) AS place FROM e)
SELECT sample_id, cluster, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN held THEN 'holdout' ELSE 'train' END AS pool FROM k JOIN h USING (cluster) LEFT JOIN f USING (cluster) WHERE held OR place <= quota""",
    "source_manifest": f"""
WITH d AS (SELECT source, {_DOC_SPLIT} AS split, {_number("CAST(doc_id AS VARCHAR)", 12)} AS h FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, sha256(CAST(count(*) AS VARCHAR) || '/' || CAST(sum(h) AS VARCHAR)) AS ids_sha256 FROM d GROUP BY source""",
    # a sentence's end is marked by a character that no text holds, as this dialect has no look-behind
    "quotes": r"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(list_transform(parts, lambda x: trim(x, ' '))) AS quote, generate_subscripts(parts, 1) AS pos FROM s),
f AS (SELECT doc_id, lower(quote) AS folded, min(pos) AS pos, arg_min(quote, pos) AS quote FROM e WHERE length(quote) BETWEEN 28 AND 240 GROUP BY ALL),
k AS (SELECT doc_id, quote, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM f)
SELECT doc_id, CAST(r - 1 AS INTEGER) AS place, quote FROM k WHERE r <= 8""",
    "decided": f"""
WITH {_SCORES}, human AS (SELECT s, row_number() OVER (ORDER BY s) AS r, count(*) OVER () AS n FROM scores WHERE y = 0),
c AS (SELECT s AS cut FROM human WHERE r = least(greatest(ceil((1.0::DOUBLE - 0.05::DOUBLE) * n), 1), n)),
k AS (SELECT count(*) AS n, count(*) FILTER (s <= cut) AS under, greatest(CAST(floor(count(*) * 0.1::DOUBLE / 2) AS BIGINT), 1) AS half FROM scores, c),
o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS place FROM scores),
b AS (SELECT cut, (SELECT s FROM o WHERE place = greatest(under - half, 0)) AS low, (SELECT s FROM o WHERE place = least(under + half, n - 1)) AS high FROM c, k),
j AS (SELECT doc_id, s, cut, s >= low AND CASE WHEN high > cut THEN s < high ELSE s <= cut END AS abstained FROM scores, b)
SELECT doc_id, CASE WHEN abstained THEN 'uncertain' WHEN s > cut THEN 'ai' ELSE 'human' END AS verdict, round(abs(s - cut) / greatest(cut, 1 - cut), 9) AS confidence, abstained FROM j""",
    "training_rows": f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'grp_' || CAST(doc_id AS VARCHAR) AS source_group_id, {_DOC_SPLIT} AS split, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS label, coalesce(source, 'unknown') AS domain,
  CASE WHEN lang = 'en' THEN NULL ELSE coalesce(lang, 'unknown') END AS generator_family, 1 AS n_spans, length(text) AS end_char FROM documents WHERE {_DOC_SPLIT} IN ('train', 'val')""",
    "decodings": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS n, {_number("CAST(doc_id AS VARCHAR) || '|decoding'", 12)} % 7 AS k, {_number("CAST(doc_id AS VARCHAR) || '|seed'", 12)} % 2147483648 AS seed FROM documents)
SELECT doc_id, CAST(CASE WHEN k = 6 THEN 0.0 ELSE [0.6, 0.8, 1.0][k // 2 + 1] END AS DOUBLE) AS temperature, CAST(CASE WHEN k = 6 THEN 1.0 ELSE [0.9, 0.95][k % 2 + 1] END AS DOUBLE) AS top_p,
  CAST(greatest(96, least(floor(CAST(n AS DOUBLE) * 1.35::DOUBLE * 1.3::DOUBLE), 1024)) AS INTEGER) AS max_new_tokens, seed FROM d WHERE n > 0""",
}

_SILHOUETTE = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label <> -1),
d AS (SELECT a.vec_id, a.label = b.label AS own, CASE WHEN a.label = b.label THEN sum(list_distance(a.v, b.v)) / nullif(a.n - 1, 0) ELSE avg(list_distance(a.v, b.v)) END AS d FROM e a, e b GROUP BY a.vec_id, a.label, b.label, a.n),
s AS (SELECT vec_id, max(d) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM d GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s WHERE a IS NOT NULL"""
ORACLE_SQL["cluster_silhouette"] = _SILHOUETTE
ORACLE_SQL["atlas_warnings"] = f"""
WITH atlas AS ({ORACLE_SQL["cluster_atlas"]}), q AS ({_SILHOUETTE}), big AS (SELECT cluster, share FROM atlas ORDER BY size DESC, cluster LIMIT 1)
SELECT 'low_silhouette' AS kind, NULL AS subject, silhouette AS value FROM q WHERE silhouette < 0.4
UNION ALL SELECT 'surface_embedder', 'hashing_v1', NULL
UNION ALL SELECT 'dominant_cluster', CAST(cluster AS VARCHAR), round(share, 6) FROM big WHERE share > 0.5
UNION ALL SELECT 'shared_label', label, count(*) FROM atlas GROUP BY label HAVING count(*) > 1"""
