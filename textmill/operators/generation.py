"""Generated texts by rounds of rejection sampling, with an injected model.

Requests are laid out once: key, family, prompt, decoding and what the check of the answer
needs.  In a round the model answers all requests of a family that are still refused, in
parts; each part's answers, with why they are refused, are a folder of the ledger that
Spark commits as a whole.  What is committed is never asked for again, so a run that was
killed goes on with the parts that are missing, and attempts, reasons and the rate of
acceptance are counts over the ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import attributes as A
from textmill.functions import hashing as H
from textmill.functions import text as T
from textmill.operators.sampling import numbered
from textmill.operators.tables import require_empty

#: family -> a function of (prompts, decodings) that gives as many texts; made once in each task.
Generator = Callable[[str], Callable[[list[str], list[dict]], list[str]]]
ANSWER = "key string, family string, attempt int, temperature double, top_p double, max_new_tokens int, seed long, text string"
#: Prompts that a model gets at once, and parts of a round that are committed one by one.
BATCH, PARTS = 512, 8
# Words of an anchor, and words in a row that an anchor may not share with its source.
MOST_ANCHOR_WORDS, VERBATIM_WORDS = 4, 8


@dataclass(frozen=True)
class Family:
    """A model family of the roster: role is held_in or held_out."""

    family: str
    role: str
    provider: str = "open_source"
    model_id: str = ""
    revision: str = ""
    released: str = ""


def held_in(roster: list[Family]) -> list[str]:
    return [f.family for f in roster if f.role == "held_in"]


def held_out(roster: list[Family]) -> list[str]:
    return [f.family for f in roster if f.role == "held_out"]


def require_held_in(rows: DataFrame, roster: list[Family]) -> None:
    """Raise if a held-out family, or one that the roster lacks, has generated rows."""
    require_empty(rows.where(~F.col("family").isin(*held_in(roster))).select("family").distinct(), "families that must not generate")


def assigned_family(key: Column | str, families: list[str]) -> Column:
    """The family of a key, by its hash over all held-in families: a run of one family leaves the others' keys alone."""
    if not families:
        raise ValueError("no held-in families")
    return H.pick(families, H.digest(key, "family"))


def copies_source(anchors: Column | str, text: Column | str) -> Column:
    """Whether an anchor is over-long or repeats VERBATIM_WORDS words in a row of the text."""
    a, source = (F.col(x) if isinstance(x, str) else x for x in (anchors, text))
    joined = lambda x: F.concat(F.lit(" "), F.array_join(A.words(x), " "), F.lit(" "))
    whole = joined(F.coalesce(source, F.lit("")))

    def repeats(anchor: Column) -> Column:
        w = A.words(anchor)
        starts = F.sequence(F.lit(1), F.size(w) - VERBATIM_WORDS + 1)
        spans = F.exists(starts, lambda k: F.contains(whole, F.concat(F.lit(" "), F.array_join(F.slice(w, k, VERBATIM_WORDS), " "), F.lit(" "))))
        return (F.size(w) > MOST_ANCHOR_WORDS) | F.when(F.size(w) >= VERBATIM_WORDS, spans).otherwise(False)

    return F.exists(a, repeats)


@dataclass(frozen=True)
class Grid:
    temperatures: tuple[float, ...] = (0.7, 1.0)
    top_ps: tuple[float, ...] = (0.9, 0.95)
    most_tokens: int = 1024
    greedy: bool = False


def mirror_requests(humans: DataFrame, template: str, families: list[str], grid: Grid = Grid()) -> tuple[DataFrame, DataFrame]:
    """(requests, refused) for humans (doc_id, source_group_id, text, domain, split): one mirror each, in its source's group and split.

    refused: doc_id of those whose anchors copy the text, or that have none (what stands in for them is over-long); null texts and keys make no request.
    """
    real = humans.where("doc_id is not null and text is not null")
    told = A.attributes(real).join(real.select("doc_id", F.col("text").alias("source_text"), "source_group_id", "domain", "split"), "doc_id").withColumn("copies", copies_source("key_anchors", "source_text"))
    fine = told.where("not copies")
    # the prompt is made from the same row, so the texts are not joined again
    asked = A.prompts(fine.withColumn("row", F.struct(*fine.columns)), template, "row").select("row.*", "prompt")
    key = F.col("doc_id").cast("string")
    d = A.decoding(key, list(grid.temperatures), list(grid.top_ps), grid.most_tokens, "target_tokens", greedy=grid.greedy)
    made = asked.select(
        key.alias("key"), assigned_family(key, families).alias("family"), "prompt", d.alias("d"), "source_text", F.col("target_tokens").cast("int").alias("target_tokens"),
        F.concat(F.lit("mirror_"), key).alias("sample_id"), key.alias("source_human_id"), "source_group_id", "split", "domain", "genre", "register", "structure", "difficulty",
    )
    return made, told.where("copies").select("doc_id")


RANDOM_PROMPT = "Write a {genre} in a {register} register about {topic}.\n\n- Length: approximately {target_tokens} words.\n- Write continuous prose unless the genre calls for another shape.\n\nOutput only the text itself. Do not add a preamble, a title line, a sign-off, or any\nmeta commentary."


def random_requests(lengths: DataFrame, n: int, topics: list[str], genres: list[str], registers: list[str], families: list[str], grid: Grid = Grid()) -> DataFrame:
    """n requests that match no document: topic, genre and register by hashes of a number, the length one of lengths (token_count) drawn by hash.

    Lengths are numbered by value, so the draw does not hang on how they lie; without any the job fails (ValueError).
    """
    spark = lengths.sparkSession
    pool = numbered(lengths.where("token_count is not null").select(F.lit(0).alias("all"), F.col("token_count").cast("int").alias("target_tokens")), "all", "target_tokens", "place").select("target_tokens", "place")
    size = pool.count()
    if not size:
        raise ValueError("no lengths to draw from")
    k = F.col("id").cast("string")
    drawn = [H.pick(options, H.digest(k, salt)).alias(name) for name, salt, options in (("topic", "topic", topics), ("genre", "genre", genres), ("register", "register", registers))]
    rows = spark.range(n).select("id", *drawn, (H.digest(k, "len") % size + 1).alias("place")).join(pool, "place")
    key = F.concat(F.lit("rand_"), k)
    pieces = {"{genre}": "genre", "{register}": "register", "{topic}": "topic", "{target_tokens}": "target_tokens"}
    prompt = F.lit(RANDOM_PROMPT)
    for mark, column in pieces.items():
        prompt = F.replace(prompt, F.lit(mark), F.col(column).cast("string"))
    d = A.decoding(key, list(grid.temperatures), list(grid.top_ps), grid.most_tokens, "target_tokens", greedy=grid.greedy)
    group = F.concat(F.lit("grp_"), key)
    return rows.select(
        key.alias("key"), assigned_family(key, families).alias("family"), prompt.alias("prompt"), d.alias("d"), F.lit(None).cast("string").alias("source_text"), "target_tokens",
        key.alias("sample_id"), F.concat(F.lit("none_"), key).alias("source_human_id"), group.alias("source_group_id"), H.split_of(group).alias("split"), F.lit("web").alias("domain"),
        "genre", "register", F.lit(None).cast("string").alias("structure"), F.lit(None).cast("string").alias("difficulty"),
    )


def refusal(policy: A.MirrorPolicy = A.MirrorPolicy()) -> Column:
    """Why an answer (text) to a request is refused: one policy for mirrors and for texts without a source, which can't be near it."""
    return F.when(F.col("source_text").isNotNull(), A.mirror_rejection("text", "source_text", "target_tokens", policy)).otherwise(A.mirror_rejection("text", F.lit(""), "target_tokens", policy))


@dataclass
class Rounds:
    """Rounds over requests under a shared folder.

    The first call of run() writes the requests; later ones take them from there, so a
    resumed run asks what the first one did.  Rows with a null key are left out and a
    repeated key is one request.
    """

    spark: SparkSession
    path: str
    retries: int = 2
    parts: int = PARTS
    batch: int = BATCH

    def _there(self, what: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def requests(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/requests")

    def _ledger(self, attempt: int, family: str, part: int) -> str:
        return f"ledger/{attempt}/{family}/{part}"

    def _done(self) -> list[tuple[int, str, int]]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger/*/*/*/_SUCCESS")
        found = [f.getPath().getParent() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or ()]
        return sorted((int(p.getParent().getParent().getName()), p.getParent().getName(), int(p.getName())) for p in found)

    def ledger(self, attempt: int | None = None, family: str | None = None) -> DataFrame:
        """All committed answers (ANSWER, reason: null if accepted)."""
        paths = [f"{self.path}/{self._ledger(*d)}" for d in self._done() if attempt in (None, d[0]) and family in (None, d[1])]
        schema = f"{ANSWER}, reason string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def run(self, requests: DataFrame, generator: Generator, reason: Column | None = None, only: str | None = None) -> None:
        """Answer all requests, family by family (or `only` one of them), in up to retries + 1 rounds; reason is over request and text, refusal() by default."""
        if not self._there("requests"):
            placed = requests.where("key is not null").dropDuplicates(["key"]).withColumn("part", (F.pmod(F.xxhash64("key"), F.lit(self.parts))).cast("int"))
            placed.write.mode("overwrite").parquet(f"{self.path}/requests")
        asked = self.requests()
        families = sorted(r[0] for r in asked.select("family").distinct().collect())
        if only is not None and only not in families:
            raise ValueError(f"{only} has no requests; {families} have")
        for family in families if only is None else [only]:
            for attempt in range(self.retries + 1):
                refused = self.ledger(attempt - 1, family).where("reason is not null").select("key") if attempt else None
                for part in range(self.parts):
                    at = self._ledger(attempt, family, part)
                    if self._there(at):
                        continue
                    todo = asked.where((F.col("family") == family) & (F.col("part") == part))
                    todo = todo if refused is None else todo.join(refused, "key", "left_semi")
                    self._answered(todo, generator, attempt, reason).write.mode("overwrite").parquet(f"{self.path}/{at}")
                if self.ledger(attempt, family).where("reason is not null").isEmpty():
                    break

    def _answered(self, todo: DataFrame, generator: Generator, attempt: int, reason: Column | None) -> DataFrame:
        batch = self.batch

        def answers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for part in parts:
                for k in range(0, len(part), batch):
                    some = part.iloc[k : k + batch]
                    model = model or generator(some["family"].iloc[0])
                    # another seed and prompt each time, or a deterministic model would answer alike
                    decodings = [{**d, "seed": d["seed"] + attempt} for d in (x.asDict() if hasattr(x, "asDict") else dict(x) for x in some["d"])]
                    texts = model([p + " " * attempt for p in some["prompt"]], decodings)
                    if len(texts) != len(some):
                        raise ValueError(f"{len(texts)} texts for {len(some)} prompts")
                    yield pd.DataFrame({"key": some["key"], "family": some["family"], "attempt": attempt, **{c: [d[c] for d in decodings] for c in ("temperature", "top_p", "max_new_tokens", "seed")}, "text": list(texts)})

        raw = todo.select("key", "family", "prompt", "d").mapInPandas(answers, ANSWER)
        # the answers are written and read again before they are judged, so that judging can't ask the model again
        clean = raw.withColumn("text", A.strip_wrapper("text"))
        judged = clean.join(todo.select("key", "source_text", "target_tokens"), "key")
        return judged.select(*[c.split()[0] for c in ANSWER.split(", ")], (refusal() if reason is None else reason).alias("reason"))

    def accepted(self) -> DataFrame:
        """Accepted texts with their requests' columns, decoding and attempt."""
        kept = self.ledger().where("reason is null").drop("reason", "family")
        return kept.join(self.requests().drop("prompt", "d", "part"), "key")

    def counts(self) -> DataFrame:
        """family, attempt, reason (null: accepted) and n over the ledger."""
        return self.ledger().groupBy("family", "attempt", "reason").agg(F.count(F.lit(1)).alias("n"))

    def summary(self) -> DataFrame:
        """family, requests, attempts, accepted, given_up and acceptance (accepted of attempts) of each family."""
        asked = self.requests().groupBy("family").agg(F.count(F.lit(1)).alias("requests"))
        told = self.ledger().groupBy("family").agg(F.count(F.lit(1)).alias("attempts"), F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"))
        both = asked.join(told, "family", "left").fillna(0, ["attempts", "accepted"])
        return both.select("family", "requests", "attempts", "accepted", (F.col("requests") - F.col("accepted")).alias("given_up"), (F.col("accepted") / F.nullif(F.col("attempts"), F.lit(0))).alias("acceptance"))


def require_mirrors(humans: DataFrame, mirrors: DataFrame) -> None:
    """Every mirror has the split and group of its human source."""
    h = humans.select(F.col("doc_id").cast("string").alias("source_human_id"), F.col("split").alias("__s"), F.col("source_group_id").alias("__g"))
    bad = mirrors.join(h, "source_human_id", "left").where("__s is null or split != __s or source_group_id != __g")
    require_empty(bad.select("sample_id"), "mirrors that do not inherit")


def length_pool(humans: DataFrame) -> DataFrame:
    """token_count of every human text, from which random_requests draws."""
    return humans.select(T.token_count(F.coalesce("text", F.lit(""))).alias("token_count")).where("token_count > 0")
