"""DuckDB SQL of the llm queries that SQL can express."""

TOKEN_ROLLUP = r"""
WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
poor AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
counted AS (
  SELECT doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+')) AS letters
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM toxic)
),
rows AS (
  SELECT source, lang, 'words' AS tokenizer, CASE WHEN doc_id IN (SELECT doc_id FROM poor) THEN letters ELSE words END AS n FROM counted
  UNION ALL
  SELECT source, lang, 'letters', letters FROM counted
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM rows GROUP BY ALL
"""

#: CRC-32 byte by byte with the table that its polynomial gives; parts are compared as the doubles that the operator orders by.
SHARDING = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS crc),
b AS (SELECT doc_id, source, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, source, CAST(strlen(text) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
h AS (SELECT *, coalesce('=' || source, '') AS stratum, CAST('0x' || substr(md5(concat_ws(':', 42, doc_id, text_crc32, size)), 1, 15) AS BIGINT) AS hash FROM d),
p AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY hash, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS part FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY part, stratum, hash, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM p),
s AS (SELECT *, CAST(place * 16 // n AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(place - (shard * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM s
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i : i + 19], ' '))) AS spans FROM d WHERE len(w) >= 20),
v AS (SELECT doc_id, unnest(spans) AS span, generate_subscripts(spans, 1) AS pos FROM l),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY span ORDER BY doc_id, pos) > 1 AS later FROM v),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM k WHERE later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Entries of CRC-32's table as its polynomial gives them, and the checksum of a text with it (FROM t).
CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS crc)"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)"


def secrets(packs) -> str:
    """Spans of every rule, from the lengths of matches and of what lies between them."""
    rules = [r for p in packs for r in p.rules]
    base = ", ".join(f"'{r.kind}'" for r in packs[0].rules)

    def found(rank, r):
        p = "'" + r.pattern.replace("'", "''") + "'"
        m = f"regexp_extract_all(text, {p})"
        return f"SELECT rid, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, {p}) AS gaps, {m} AS own, regexp_extract_all(text, {p}, {r.group}) AS vals FROM d WHERE regexp_matches(text, {p})"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(found(*x) for x in enumerate(rules))}),
u AS (SELECT rid, rank, kind, least, unnest(gaps[1 : len(own)]) AS gap, unnest(own) AS own, unnest(vals) AS val, generate_subscripts(own, 1) AS nth FROM m),
e AS (SELECT *, CAST(sum(length(gap) + length(own)) OVER (PARTITION BY rid, rank ORDER BY nth) AS BIGINT) AS stop FROM u),
s AS (SELECT rid, kind, rank, stop - length(own) AS start, kind || ':' || (stop - length(own)) || ':' || stop AS span FROM e WHERE length(val) >= least),
g AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in packs[0].rules)}, string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in packs[0].rules)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob FROM d LEFT JOIN g USING (rid)
"""


def _climb(name: str, levels: int) -> list[str]:
    """CTEs name0 to name<levels> of the nodes (grp, i, d) of each level; a tree of one node keeps it."""
    return [
        f"{name}{k + 1} AS (SELECT grp, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{k}) GROUP BY grp, i // 8, n)"
        for k in range(levels)
    ]


def _walk(walk: str, name: str, levels: int) -> list[str]:
    """CTEs walk1 to walk<levels>: each row's own digest y and the siblings s so far, a level further up."""
    return [
        f"{walk}{k + 1} AS (SELECT w.rid, w.grp, w.i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(CASE WHEN c.i = w.i THEN w.y ELSE c.d END, '' ORDER BY c.i)) ELSE any_value(w.y) END AS y, "
        f"any_value(w.s) || coalesce(string_agg(c.d, '' ORDER BY c.i) FILTER (c.i <> w.i), '') AS s "
        f"FROM {walk}{k} w JOIN (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{k}) c ON c.grp = w.grp AND c.i // 8 = w.i // 8 GROUP BY w.rid, w.grp, w.i, n)"
        for k in range(levels)
    ]


def manifest(levels: int = 7, group_levels: int = 2) -> str:
    """Trees of up to 8 ** levels documents, and up to 8 ** group_levels languages."""
    f = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        CRC_TABLE,
        f"d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS grp, sha256({head} || {f('text')}) AS leaf, sha256({head} || {f(low)}) AS low, doc_id IS NOT NULL AND {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 AS tampered FROM documents, t)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "a0 AS (SELECT grp, i, leaf AS d FROM o)",
        *_climb("a", levels),
        "w0 AS (SELECT rid, grp, i, CASE WHEN tampered THEN low ELSE leaf END AS y, '' AS s FROM o)",
        *_walk("w", "a", levels),
        f"g AS (SELECT grp AS own, d, row_number() OVER (ORDER BY grp) - 1 AS i FROM a{levels})",
        "b0 AS (SELECT '' AS grp, i, d FROM g)",
        *_climb("b", group_levels),
        f"v0 AS (SELECT rid, '' AS grp, g.i, y, s FROM w{levels} JOIN g ON own = w{levels}.grp)",
        *_walk("v", "b", group_levels),
    ]
    return f"""
WITH {', '.join(ctes)}
SELECT doc_id, leaf, g.d AS subroot, r.d AS root, sha256(s) AS proof_sha256, y AS folded_root, y = r.d AS verified
FROM o JOIN g ON own = o.grp JOIN v{group_levels} v ON v.rid = o.rid, b{group_levels} r
"""


def repairs() -> str:
    """Repair of conversations: a table of the cheapest (cost, audit) of four states, row by row; costs lead as nine digits."""

    def plus(v, cost, letters):
        return f"(lpad(CAST(CAST(left({v}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({v}, 10) || '{letters}')"

    def best(x, r, before):
        more = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
        ways = [plus(x, 4, "D")]
        for b in before:
            ways.append(f"CASE WHEN stays AND initial = '{r}' THEN {plus(b, more, 'K')} END")
            if r in "ua":
                ways.append(f"CASE WHEN stays THEN {plus(b, f'3 + {more}', 'R')} END")
        return f"least({', '.join(ways)})"

    ask = f"least(a, {plus('s', 3, 'I')}, {plus('l', 3, 'I')}, {plus('p', 3, 'I')})"
    return f"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS drawn FROM conversations, t),
d AS (SELECT conv, turn, CASE WHEN drawn = 4 THEN 'user' ELSE role END AS role, CASE WHEN drawn = 1 THEN '' WHEN drawn = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN drawn = 3 THEN 2 ELSE 1 END)) AS time FROM c WHERE drawn <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, substr(role, 1, 1) AS initial FROM o),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, fault IN ('', 'truncated') AS stays, lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM r),
dp AS (
  SELECT conv, 0 AS i, '000000000' AS s, CAST(NULL AS VARCHAR) AS l, '000000003I' AS a, '000000006II' AS p FROM (SELECT DISTINCT conv FROM f)
  UNION ALL
  SELECT conv, i, s, l, {ask} AS a, least(p, {plus(ask, 3, 'I')}) AS p
  FROM (SELECT dp.conv, f.i, {plus('s', 4, 'D')} AS s, {best('l', 's', ['s'])} AS l, {best('a', 'u', ['s', 'l', 'p'])} AS a, {best('p', 'a', ['a'])} AS p FROM dp JOIN f ON f.conv = dp.conv AND f.i = dp.i + 1)
),
w AS (SELECT conv, max_by(least(s, p), i) AS best FROM dp GROUP BY conv),
x AS (SELECT conv, unnest(regexp_extract_all(substr(best, 10), '.')) AS edit, generate_subscripts(regexp_extract_all(substr(best, 10), '.'), 1) AS pos FROM w),
y AS (SELECT conv, edit, pos, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY pos) AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY pos) AS place, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS n FROM x),
z AS (SELECT y.conv, sha256(string_agg(CASE WHEN edit = 'K' THEN f.role WHEN (place + n) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY pos)) AS digest FROM y LEFT JOIN f ON f.conv = y.conv AND f.i = y.i WHERE edit <> 'D' GROUP BY y.conv),
k AS (SELECT conv, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM c) q LEFT JOIN k USING (conv) LEFT JOIN w USING (conv) LEFT JOIN z USING (conv)
"""
