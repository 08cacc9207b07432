"""The contract queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import bpe, chat, decontam, fim, html, langid, linededup, packing, quality, search, sharding, simhash, tokencount
from trellis.llm.common import table


#: Added to the conversations: control strings of other templates inside the texts.
EXTRA = r"\### Assistant: </turn> ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.windows(turns))


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.fit_and_identify(table(spark, sf_dir, "documents"))


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > tokencount.LIMIT)


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op8_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.cleaned(table(spark, sf_dir, "documents"))


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"))))


def op12_blocked_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_WORDS6 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS6}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS6}, []) AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)
),
o AS (SELECT dw.r, dw.i, dw.m, iw.item_id FROM dw JOIN iw USING (m, g)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM o) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

_ENOUGH9 = f"CASE WHEN n >= {linededup.LONG} THEN {min(linededup.LONG_DOCS, linededup.MIN_DOCS)} ELSE {linededup.MIN_DOCS} END"
_WEIGHT9 = "coalesce(list_sum(list_transform({0}, lambda x: floor(16 * pow(2.0, x.s / 2.0)))), 0)"
OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT r, text, t, unnest(w) AS line, unnest(range(0, len(w))) AS i FROM d),
k AS (SELECT r, text, t, line, i, list_transform(list_filter(regexp_split_to_array(line, '[ \t\x0b\f\r]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS k FROM l),
m AS (SELECT r, text, t, line, i, k, len(k) AS n, array_to_string(k[1:{linededup.LEADING}], ' ') AS lead, array_to_string(k, ' ') AS g FROM k),
c AS (SELECT n, lead, g, any_value(k) AS k, count(*) AS c FROM (SELECT DISTINCT r, n, lead, g, k FROM m WHERE n >= {linededup.MIN_TOKENS}) GROUP BY ALL),
v AS (SELECT n, lead FROM c WHERE n > {linededup.LEADING} AND n < {linededup.LONG} GROUP BY ALL HAVING sum(c) >= {linededup.MIN_DOCS} AND count(*) > 1),
p AS (SELECT n, lead, g, c, k, unnest(k[{linededup.LEADING + 1}:]) AS token, unnest(range(0, n - {linededup.LEADING})) AS pos FROM c JOIN v USING (n, lead)),
s AS (SELECT n, lead, pos, token FROM p GROUP BY ALL HAVING sum(c) >= {linededup.MIN_DOCS}),
f AS (SELECT n, lead, g, any_value(c) AS c, string_agg(CASE WHEN s.pos IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.pos) AS template, {linededup.LEADING} + count(s.pos) AS held FROM p LEFT JOIN s USING (n, lead, pos, token) GROUP BY n, lead, g),
fields AS (SELECT n, lead, g, c, 'f ' || template AS template FROM f WHERE held < n AND 2 * held > n AND held >= 3),
nodes AS (
  SELECT n, lead, g, 'g ' || g AS template FROM c ANTI JOIN fields USING (n, lead, g) WHERE c >= {_ENOUGH9}
  UNION ALL SELECT n, lead, g, template FROM fields JOIN (SELECT n, lead, template FROM fields GROUP BY ALL HAVING sum(c) >= {linededup.MIN_DOCS}) USING (n, lead, template)
),
found AS (SELECT m.*, template FROM m JOIN nodes USING (n, lead, g)),
held AS (SELECT DISTINCT text, n, lead, template FROM found JOIN (SELECT n, lead, template FROM found GROUP BY ALL HAVING count(DISTINCT text) >= {_ENOUGH9}) USING (n, lead, template)),
ends AS (
  SELECT text, list(e) AS e FROM (
    SELECT DISTINCT text, unnest([{{'k': 'first ' || lead, 's': round(2 * log2(n))}}, {{'k': 'last ' || array_to_string(k[greatest(n - {linededup.LEADING - 1}, 1):], ' '), 's': round(2 * log2(n))}}]) AS e
    FROM m SEMI JOIN held USING (text) WHERE n > 0
  ) GROUP BY text
),
pairs AS (SELECT DISTINCT a.text AS a, b.text AS b FROM held a JOIN held b USING (n, lead, template) WHERE a.text <> b.text),
sums AS (SELECT a, b, {_WEIGHT9.format('x.e')} + {_WEIGHT9.format('y.e')} AS t, {_WEIGHT9.format('list_filter(x.e, lambda z: list_contains(y.e, z))')} AS s FROM pairs JOIN ends x ON x.text = a JOIN ends y ON y.text = b),
links AS (SELECT a, b FROM sums WHERE 4 * s >= 3 * (t - s)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
roots AS (SELECT a AS text, least(a, min(b)) AS root FROM reach GROUP BY a),
hot AS (SELECT n, lead, template FROM held LEFT JOIN roots USING (text) GROUP BY ALL HAVING count(DISTINCT coalesce(root, text)) >= {_ENOUGH9}),
h AS (SELECT m.r, m.line, m.i, nodes.g IS NOT NULL AS recurring, hot.n IS NOT NULL AS hit FROM m LEFT JOIN nodes USING (n, lead, g) LEFT JOIN hot ON hot.n = m.n AND hot.lead = m.lead AND hot.template = nodes.template),
o AS (SELECT r, count(*) AS n_lines, sum(recurring::INT) AS n_recurring, sum(hit::INT) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT hit), '') AS rest FROM h GROUP BY r)
SELECT doc_id, CASE WHEN n_dropped > 0 THEN rest ELSE text END AS text, CASE WHEN text IS NULL THEN 0 ELSE n_lines END::BIGINT AS n_lines, n_recurring::BIGINT AS n_recurring, n_dropped::BIGINT AS n_dropped
FROM d JOIN o USING (r)
"""

OP7_SQL = f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes)::BIGINT AS b, count(*) AS n FROM r, (SELECT unnest(range(0, 41)) AS d) GROUP BY ALL),
f AS (SELECT doc_id, r.n_bytes, h, min(d) AS depth FROM r, p WHERE p.p = h >> (60 - d) AND (b <= {sharding.LIMIT} OR n = 1) GROUP BY ALL)
SELECT doc_id, right(lpad(bin(h), 60, '0'), 60)[1:depth] AS shard, depth::INT AS depth, n_bytes, b AS shard_bytes FROM f JOIN p ON p.d = f.depth AND p.p = h >> (60 - depth)
"""

_ESC = r"length(replace(replace({0}, '\', '\\'), '<|', '<\|'))"
_ORDER = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text"
OP1_SQL = rf"""
WITH raw AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '{EXTRA}'), (-7::BIGINT, 1::BIGINT, 'assistant', '{EXTRA}')) AS v(conv_id, turn, role, text)
),
t AS (
  SELECT conv_id, turn, role, text, 24 + {_ESC.format("role")} + {_ESC.format("text")} AS size,
    len(regexp_extract_all(text, '\p{{L}}+|\p{{N}}+|[^ \t\n\x0b\f\r\p{{L}}\p{{N}}]')) + {chat.MARKS} AS tokens
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM raw)
),
a AS (
  SELECT *, row_number() OVER ({_ORDER}) AS pos, sum(tokens) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS prefix,
    first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS system FROM t
),
b AS (SELECT *, pos = 1 AND role = 'system' AS is_system, greatest({chat.BUDGET} - system - {chat.HISTORY}, {chat.BUDGET // 4}) AS stride FROM a),
c AS (
  SELECT *, CASE WHEN is_system THEN 0 ELSE (prefix - tokens - system) // stride END AS bucket,
    NOT is_system AND (prefix - system - 1) // stride > (prefix - tokens - system) // stride AS over_end FROM b
),
d AS (SELECT *, over_end AND sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id, bucket) > stride AS alone FROM c),
e AS (SELECT *, CASE WHEN lag(bucket) OVER (PARTITION BY conv_id ORDER BY pos) <> bucket OR (alone AND pos > 1) THEN 1 ELSE 0 END AS change FROM d),
f AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM e),
g AS (SELECT *, max(prefix) OVER (PARTITION BY conv_id, span) AS span_end, max(span) OVER (PARTITION BY conv_id) AS last_span FROM f),
h AS (
  SELECT conv_id, sum(size * CASE WHEN is_system AND last_span > 0 THEN 1 + last_span WHEN NOT is_system AND span < last_span AND span_end - prefix + tokens <= {chat.HISTORY} THEN 2 ELSE 1 END)::BIGINT AS formatted_chars
  FROM g GROUP BY conv_id
)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM t JOIN h ON h.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id
"""

def _op5_sql() -> str:
    """Base statistics and the estimates step by step: medians and spreads, two steps from each start, STEPS more from the best, distances."""
    q, n = quality, len(quality.FLOORS)
    names, key = list(q.FLOORS), "e_lang, e_source"
    cells = [(i, j) for i in range(n) for j in range(i + 1)]
    at = lambda i, j: f"p_{max(i, j)}_{min(i, j)}"
    rank = lambda v, share: f"list_sort(list({v}))[ceil(count(*) * {share})::INT]"
    factor = q.H / q.chi_square_cdf(q.chi_square_quantile(q.H, n), n + 2)
    white = r"[ \t\n\x0b\f\r]"
    ctes = [
        rf"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS g_lang, coalesce(source, '') AS g_source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{white}+'), lambda x: x <> '') AS w FROM documents)",
        "g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))",
        "rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r)",
        rf"ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \t\n\x0b\f\r]') GROUP BY r)",
        rf"s AS (SELECT d.r, doc_id, g_lang, g_source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{white}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r))",
        f"f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS nw, greatest(word_chars, 1)::DOUBLE AS nc FROM s)",
        f"x AS (SELECT *, ln(nw) AS {names[0]}, ln(nc / nw) AS {names[1]}, sqrt(n_symbols / nc) AS {names[2]}, sqrt(n_dup_lines / nw) AS {names[3]}, sqrt(n_repeat_words / nw) AS {names[4]} FROM f)",
        "sz AS (SELECT g_lang, g_source, count(*) AS n FROM x WHERE NOT base_failed GROUP BY ALL)",
        f"pool AS (SELECT g_lang, sum(n) AS pool FROM sz WHERE n < {q.MIN_GROUP} GROUP BY 1)",
        f"asg AS (SELECT sz.g_lang, g_source, CASE WHEN n >= {q.MIN_GROUP} OR pool >= {q.MIN_GROUP} THEN sz.g_lang ELSE '*pool*' END AS e_lang, CASE WHEN n >= {q.MIN_GROUP} THEN g_source ELSE '*pool*' END AS e_source FROM sz LEFT JOIN pool USING (g_lang))",
        "v AS (SELECT x.*, e_lang, e_source FROM x JOIN asg USING (g_lang, g_source) WHERE NOT base_failed)",
        f"e0 AS (SELECT {key}, " + ", ".join(f"{rank(f'round({x} * 1024)', 0.5)} / 1024 AS m_{x}, greatest(({rank(f'round({x} * 1024)', 0.75)} - {rank(f'round({x} * 1024)', 0.25)}) / (1.349 * 1024), {q.FLOORS[x]}) AS s_{x}" for x in names) + " FROM v GROUP BY ALL)",
    ]
    exact = " + ".join(f"{1 if i == j else 2} * {at(i, j)} * ({names[i]} - m_{names[i]}) * ({names[j]} - m_{names[j]})" for i, j in cells)
    z = [f"abs(({x} - m_{x}) / s_{x})" for x in names]
    forms = {"squares": " + ".join(f"{d} * {d}" for d in z), "largest": f"greatest({', '.join(z)})", "sum": " + ".join(z)}
    first = "CASE start " + " ".join(f"WHEN {i} THEN {forms[name]}" for i, name in enumerate(q.STARTS)) + " END"
    ctes.append(f"es0 AS (SELECT *, unnest(range({len(q.STARTS)})) AS start FROM e0)")
    group, means, now = f"{key}, start", ", ".join(f"m_{x}" for x in names), "es0"
    for k in range(q.STEPS + 2):
        ctes.append(f"d{k} AS MATERIALIZED (SELECT v.*, start, round(ln({first if k == 0 else exact} + 1e-6) * 256) AS b FROM v JOIN {now} USING ({key}))")
        ctes.append(f"c{k} AS (SELECT {group}, {rank('b', q.H)} AS cut FROM d{k} GROUP BY ALL)")
        sums = ", ".join([f"sum({x}) / count(*) AS m_{x}" for x in names] + [f"sum({names[i]} * {names[j]}) / count(*) AS c_{i}_{j}" for i, j in cells])
        ctes.append(f"t{k} AS (SELECT {group}, {sums} FROM d{k} JOIN c{k} USING ({group}) WHERE b <= cut GROUP BY ALL)")
        ctes.append(f"a{k}_0 AS (SELECT {group}, 1.0::DOUBLE AS det, {means}, " + ", ".join(f"(c_{i}_{j} - m_{names[i]} * m_{names[j]}) * {factor!r} + {q.FLOORS[names[i]] ** 2 if i == j else 0.0!r} AS {at(i, j)}" for i, j in cells) + f" FROM t{k})")
        for p in range(n):
            swept = ", ".join((f"-1 / {at(p, p)}" if i == j == p else f"{at(i, j)} / {at(p, p)}" if p in (i, j) else f"{at(i, j)} - {at(i, p)} * {at(j, p)} / {at(p, p)}") + f" AS {at(i, j)}" for i, j in cells)
            ctes.append(f"a{k}_{p + 1} AS (SELECT {group}, det * {at(p, p)} AS det, {means}, {swept} FROM a{k}_{p})")
        pick = f" QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY det, start) = 1" if k == 1 else ""
        now = f"e{k + 1}"
        ctes.append(f"{now} AS MATERIALIZED (SELECT {group}, {means}, det, " + ", ".join(f"-{at(i, j)} AS {at(i, j)}" for i, j in cells) + f" FROM a{k}_{n}{pick})")
    limit = q.chi_square_quantile(1 - q.TAIL, n)
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({exact} <= {limit!r}, true) AS kept
FROM x LEFT JOIN asg USING (g_lang, g_source) LEFT JOIN {now} USING ({key})"""


OP5_SQL = _op5_sql()

_TERMS12 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS12}, []) AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, coalesce({_TERMS12}, []) AS w FROM benchmark),
q AS (SELECT i, item_id, t, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
s AS (SELECT count(*)::HUGEINT AS n_docs, sum(len(w))::HUGEINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t),
v AS (SELECT r, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)::BIGINT)) AS impact FROM p JOIN f USING (t), s),
c AS (SELECT i, item_id, r, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN v USING (t) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0) WHERE rank <= {search.TOP}
"""

_JOINED13 = r"CASE WHEN {1} = 0 THEN '' ELSE array_to_string(w[1:{1}], chr(10)) || CASE WHEN {1} < len(w) THEN chr(10) ELSE '' END END"
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS w, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (
  SELECT *, CASE WHEN t = '' THEN 0 WHEN w[-1] = '' THEN len(w) - 1 ELSE len(w) END AS n,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (
  SELECT doc_id, t, n, a, b, h3, h4, {_JOINED13.replace("{1}", "a")} AS prefix, {_JOINED13.replace("{1}", "b")} AS upto FROM c
),
s AS (SELECT *, substr(upto, length(prefix) + 1) AS middle, substr(t, length(upto) + 1) AS suffix FROM p),
f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fim.RATE} THEN 'plain' WHEN h4 % 100 < {fim.SPM} THEN 'spm' ELSE 'psm' END AS form FROM s
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM f
"""

QUERIES = {
    f.__name__: f
    for f in (op1_chat_windows, op2_cost_balanced_packing, op3_family_svm, op4_prefix_token_counts, op5_robust_outliers, op6_winnowing_decontamination, op7_extendible_sharding, op8_block_rules, op9_line_templates, op10_simhash_bktree, op11_rank_array_bpe, op12_blocked_product_search, op13_fill_in_middle)
}
ORACLE_SQL = {"op1_chat_windows": OP1_SQL, "op5_robust_outliers": OP5_SQL, "op6_winnowing_decontamination": OP6_SQL, "op7_extendible_sharding": OP7_SQL, "op9_line_templates": OP9_SQL, "op12_blocked_product_search": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
