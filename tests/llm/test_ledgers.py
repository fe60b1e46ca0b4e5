"""Operators 11 to 13 against plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tests.llm.common import SPACE, awkward, empty, lower
from textmill.llm import conversations, merkle, secrets


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11: secrets

_KEYS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
_BASE = [("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]


def _secrets(text):
    rules = _BASE + [(r.kind, r.pattern, 0, 1) for r in secrets.FORMATS.rules]
    found = sorted((m.start(), rank, kind, m.end()) for rank, (kind, p, g, least) in enumerate(rules) for m in re.finditer(p, text or "") if len(m[g]) >= least)
    told = lambda rows: ",".join(f"{k}:{a}:{b}" for a, _, k, b in rows)
    base = [x for x in found if x[1] < 3]
    return (*[sum(x[1] == i for x in base) for i in range(3)], sha(told(base)), told(found))


_BITS = [
    "token=", "secret: ", "PassWord = '", "api_key:", "é\U0001f600", "AKIA", "0123456789ABCDEFGH", " ", "deadbeef" * 4, "abc", "=", "ſecret=abcdefgh", "toKen=abcdefgh", "ghp_" + "a1B2" * 9,
    "xoxb-123456789-abc", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIiOiIx.abcdefgh12", "\n", '"', "AIza" + "x" * 35, "sk_live_" + "9" * 20, "secret=token: abcdefgh",
]


def _documents(spark, seed=2):
    rng = random.Random(seed)
    rows = [(i if i % 17 else None, "".join(rng.choice(_BITS) for _ in range(rng.choice([0, 1, 3, 10, 60])))) for i in range(500)]
    rows += [(901, "token=abcdef")] * 3 + [(902, None)] + [(1000 + i, "secret=token: abcdefgh token=ab") for i in range(200)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_secrets_match_plain_python(spark, tmp_path, broadcast):
    rows, df = _documents(spark)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = secrets.document_secrets(df, str(tmp_path / "l")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert _sorted(got) == _sorted((d, *_secrets(t)) for d, t in rows)


def test_only_unseen_blobs_and_packs_are_scanned(spark, tmp_path):
    _, df = _documents(spark)
    ledger = secrets.BlobLedger(spark, str(tmp_path / "l"))
    blobs = lambda d: d.select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"), F.lit(1).alias("handle"))
    first = df.where("doc_id < 250 or doc_id is null")
    ledger.scan(first, ("doc_id",), (secrets.BASE,))
    n, m = blobs(df).distinct().count(), blobs(first).distinct().count()
    assert ledger.due(blobs(df), (secrets.BASE,)).count() == n - m
    due = ledger.due(blobs(df))
    assert due.count() == n and due.where(F.size("packs") == 1).count() == m
    whole = ledger.scan(df, ("doc_id",))
    assert ledger.due(blobs(df)).isEmpty() and whole.count() == df.count()
    # the ledger names every path that it has seen, with what is known by now
    assert ledger.report().count() == first.count() + df.count()
    changed = secrets.Pack("base", (*secrets.BASE.rules, secrets.Rule("pin", "PIN[0-9]{4}")))
    assert changed.version != secrets.BASE.version and ledger.due(blobs(df), (changed,)).count() == n
    # a scan that broke off before it told what it scanned is not read
    spark.createDataFrame([("x", "y", "z", 0, 1)], secrets._FINDINGS).write.parquet(str(tmp_path / "l" / "broken" / "findings"))
    assert ledger.report().count() == first.count() + df.count()


def test_secrets_awkward(spark, tmp_path):
    docs = awkward(spark)
    got = secrets.document_secrets(docs, str(tmp_path / "a")).collect()
    assert _sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == _sorted((r.doc_id, *_secrets(r.text)) for r in docs.collect())
    assert secrets.document_secrets(empty(spark), str(tmp_path / "b")).collect() == []


# 12: Merkle manifest


def _leaf(d, text):
    fields = (d[0], d[3], d[2], d[4], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def _levels(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + 8])) for i in range(0, len(found[-1]), 8)])
    return found


def _path(levels, i):
    found = []
    for nodes in levels[:-1]:
        run = i - i % 8
        found.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        i //= 8
    return found


def _manifest(docs):
    """docs: doc_id, text, lang, source, n_chars."""
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(rows, key=lambda d: (d[0] is not None, d[0] or 0, _leaf(d, d[1]))) for g, rows in groups.items()}
    levels = {g: _levels([_leaf(d, d[1]) for d in rows]) for g, rows in trees.items()}
    top = _levels([levels[g][-1][0] for g in names])
    for j, g in enumerate(names):
        for i, d in enumerate(trees[g]):
            path, own = _path(levels[g], i) + _path(top, j), _leaf(d, d[1])
            folded = own
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0:
                folded = _leaf(d, None if d[1] is None else lower(d[1]))
            for a, b in path:
                folded = sha(a + folded + b)
            yield d[0], own, levels[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]


@pytest.mark.parametrize("block_levels", [1, 2, 4])
def test_manifest_matches_plain_python(spark, block_levels):
    rng = random.Random(1)
    docs = [(i, rng.choice(["Abc", "xyz", None, "", " ÉA b"]), rng.choice(["en"] * 20 + [None, "", "fr", "de"]), rng.choice(["a", None]), rng.choice([1, None, 40])) for i in range(900)]
    docs += [docs[3]] * 5 + [(None,) * 5] * 3 + [(None, "T", "en", "q", 2)] + [(5, "X", f"l{i}", "z", 1) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = merkle.manifest(merkle.document_leaves(df), block_levels).collect()
    assert _sorted(got) == _sorted(_manifest(docs))
    assert not any(r.verified for r in got if r.folded_root != r.root) and any(not r.verified for r in got)


def test_manifest_awkward(spark):
    docs = awkward(spark)
    want = _sorted(_manifest([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]))
    assert _sorted(merkle.document_manifest(docs).collect()) == want
    assert merkle.document_manifest(empty(spark)).collect() == []
    one = merkle.document_manifest(docs.where("doc_id = 9")).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


# 13: conversations


def _after_damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        drawn = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(drawn, text)
        mine.extend([(turn, "user" if drawn == 4 else role, text)] * {0: 0, 3: 2}.get(drawn, 1))
    return found


_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def _repair(rows):
    """(cost, audit, repaired rows) of least cost, then least audit, over all edits, by memo from the end."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = SPACE.findall(text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1][-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def then(cost, letter, row, found):
            ways.append((cost + found[0], letter + found[1], ((row,) if row else ()) + found[2]))

        if inserts:
            for t, to in _NEXT[state].items():
                if t != "s":
                    then(3, "I", ({"u": "user", "a": "assistant"}[t], ""), best(i, to, inserts - 1))
        if i < len(rows):
            _, role, text = rows[i]
            then(4, "D", None, best(i + 1, state, 3))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                for t, to in _NEXT[state].items():
                    if role[:1] == t:
                        then(more, "K", (role, text), best(i + 1, to, 3))
                    if t != "s":
                        then(3 + more, "R", ({"u": "user", "a": "assistant"}[t], text), best(i + 1, to, 3))
        return min(ways, default=(10**9, "", ()))

    return faults, best(0, 0, 3)


def _digests(rows):
    for conv, mine in _after_damage(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, (cost, audit, kept) = _repair(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        yield conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))


_TURNS = "conv_id long, turn long, role string, text string"


def test_repairs_match_all_edits(spark):
    rng, rows = random.Random(7), []
    texts = ["Hi there.", "ok", "", None, " \n", "Yes!", "x? ", "é。", *[f"t{i}." for i in range(8)]]
    for conv in [*range(600), None]:
        for i in range(60 if conv == 7 else rng.choice([1, 2, 3, 5, 8, 20])):
            role = rng.choice(["system", *["user", "assistant"] * 3, None, "", "tool", "sage"]) if rng.random() < 0.5 else ("user", "assistant")[i % 2]
            rows.append((conv, rng.choice([i, i, i, i, None, 2 * i]), role, rng.choice(texts)))
    df = spark.createDataFrame(rows, _TURNS).repartition(3)
    got = conversations.digests(conversations.repair(conversations.damaged(df))).collect()
    assert _sorted(got) == _sorted(_digests(rows))


def test_long_conversations_keep_little(spark):
    """Rows are told as soon as items agree, and runs of copies are held as one."""
    chart, most = conversations.Chart(), 0
    for i in range(5000):
        chart.scan(("user", "assistant")[i % 2] if i % 7 else "system", f"t{i}.", i % 11 == 0)
        chart.agreed()
        most = max(most, len(chart.rows))
    assert most <= 2 * conversations.PENDING
    for _ in range(100_000):
        chart.must_go()
    assert len(chart.rows) <= 2 * conversations.PENDING
    assert chart.goal()[1][-1][:2] == ("D", 100_000)


def test_repaired_rows_follow_the_grammar(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "And"), (2, 0, "user", " "), (3, 5, "user", "Q?"), (3, 6, "assistant", "A.")]
    df = spark.createDataFrame(rows, _TURNS)
    got = {}
    for r in conversations.repaired(df).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert got == {1: [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello.")], 3: [("K", "user", "Q?"), ("K", "assistant", "A.")]}
    last = {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.gaps) for r in conversations.repair(df).where("edit is null").collect()}
    assert last == {1: (0, 1, 1, 2, 11, 0), 2: (1, 0, 0, 0, 4, 0), 3: (0, 0, 0, 0, 0, 0)}


def test_conversations_awkward(spark):
    rows = [(None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (2, 3, "", "x."), (3, 1, "user", " ".join(f"w{i}" for i in range(50_000)) + "."), (3, 1, "assistant", "."), (4, 9, "tool", None)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], _TURNS + ", place long, edit string")
    got = conversations.digests(conversations.repair(conversations.damaged(df))).collect()
    assert _sorted(got) == _sorted(_digests(rows))
    assert conversations.digests(conversations.repair(conversations.damaged(df.limit(0)))).collect() == []
    gone = df.select("conv_id", "turn", "role", "text", F.lit(True).alias("gone"))
    assert {(r.cost, r.audit, r.repaired_sha256) for r in conversations.digests(conversations.repair(gone)).collect()} == {(0, "", sha(""))}
