"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import chat, embed_dedup, license, line_dedup, mixing, ngram_join, packing, pieces, pii, quality, repair, resampling, token_codes
from thalweg.llm.common import scratch_path, table


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pii.annotate(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    spans = pii.listed((*pii.KINDS, *pii.ADDED))
    return marked.select("doc_id", *counts, F.sha2(pii.listed(pii.KINDS), 256).alias("base_sha256"), spans.alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=1, length=2048)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    trial = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trial)
    back = chat.read_back(chat.formatted(turns))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licences(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, n_lines, n_removed = line_dedup.dedup(docs)
    return out.select("doc_id", F.col(n_lines).cast("long").alias("n_lines"), F.col(n_removed).cast("long").alias("n_removed"),
                      F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, stats, failed, kept = quality.judge(docs, table(spark, sf_dir, "labels"))
    counts = [F.col(f"{stats}.{c}").alias(c) for c in quality.COUNTS]
    return out.select("doc_id", *counts, F.col(failed).alias("base_failed"), F.col(kept).alias("kept"))


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    return token_codes.write_read(spark, table(spark, sf_dir, "documents"), vocabulary(), end_id=2, path=path)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"))


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.links(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with the faults of op11: a checksum of their place picks one for a fifth of them."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    k = F.crc32(F.concat(shown["conv_id"], F.lit(":"), shown["turn"]).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(shown["text"], ".!?", "")).otherwise(shown["text"])
    rows = turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(shown["role"]).alias("role"), text.alias("text"), k.alias("k")).where("k > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))).drop("k", "copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = repair.Repair(damaged(turns))
    line = F.struct("at", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = done.edited().where("edit <> 'D'").groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    repaired = lines.select(F.col("conv_id").alias("of"), F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("sha"))
    audit, every = done.audit(), turns.select(F.col("conv_id").alias("asked")).distinct()
    both = every.join(audit, every.asked.eqNullSafe(audit.conv_id), "left").drop("conv_id")
    both = both.join(repaired, both.asked.eqNullSafe(repaired.of), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("asked").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded, ids = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back, text = pieces.decode(coded.select("doc_id", ids), model, ids)
    shown = F.array_join(F.col(ids).cast("array<string>"), ",")
    return back.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


_QUERIES = [op1_pii, op2_packing, op3_chat, op4_license, op5_line_dedup, op6_quality, op7_token_codes, op8_ngram_join, op9_embed_dedup, op10_mixing,
            op11_repair, op12_pieces, op13_resampling]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'null') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<join>', '\j') AS safe,
         role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS joins
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + CASE WHEN joins THEN 6 ELSE 14 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS symbols
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
            / (1.0 / (1 + symbols::DOUBLE / greatest(size, 1))) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w, (source_size * 3)::HUGEINT AS cap FROM s),
o AS (
  SELECT *, sum(cap) OVER (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS capped,
         sum(w) OVER (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         sum(source_size) OVER () AS all_size
  FROM w),
l AS (
  SELECT capped, open_w, all_size FROM o WHERE cap::DOUBLE / w::DOUBLE >= (all_size - capped)::DOUBLE / open_w::DOUBLE
  ORDER BY cap::DOUBLE / w::DOUBLE, capped LIMIT 1),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, w::DOUBLE * (l.all_size - l.capped)::DOUBLE / l.open_w::DOUBLE) AS target FROM o, l),
p AS (
  SELECT k.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS running,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - running)))::BIGINT AS taken
FROM p
"""


_EMBED = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.node AS vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, component_id, c.node = component_id AS kept FROM c LEFT JOIN n ON n.a = c.node
"""

_NGRAM = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN z x ON x.doc_id = a.doc_id JOIN z y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING count(*) * 9 >= 4 * (any_value(x.n) + any_value(y.n))),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.node AS doc_id, coalesce(n.n_links, 0)::BIGINT AS n_links, component_id, c.node = component_id AS kept FROM c LEFT JOIN n ON n.a = c.node
"""

# Pairs share one of the rarest n - ceil(0.8 n) + 1 character runs of both lines (no link lacks one); these alone are joined.
_LINES = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
o AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS line FROM d WHERE text IS NOT NULL),
v AS (SELECT *, doc_id::HUGEINT * 4294967296 + line AS place FROM o WHERE regexp_matches(t, '[^\s]')),
k AS (SELECT t, min(place) AS first FROM v GROUP BY t),
s AS (SELECT first, list_distinct(list_transform(range(1, greatest(2, length(t) - 3)), lambda i: substr(t, i, 5))) AS g FROM k),
u AS (SELECT first, len(g) AS n, unnest(g) AS g FROM s),
f AS (SELECT g, count(*) AS f FROM u GROUP BY g),
p AS (SELECT first, n, g FROM (
  SELECT u.first, u.n, u.g, row_number() OVER (PARTITION BY u.first ORDER BY f.f, u.g) AS seat FROM u JOIN f ON u.g = f.g) WHERE seat <= n - ceil(0.8 * n) + 1),
c2 AS (SELECT DISTINCT a.first AS a, b.first AS b FROM p a JOIN p b ON a.g = b.g AND a.first < b.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
l1 AS (SELECT a, b FROM c2 JOIN s x ON x.first = a JOIN s y ON y.first = b WHERE len(list_intersect(x.g, y.g)) * 9 >= 4 * (len(x.g) + len(y.g))),
l AS (SELECT a, b FROM l1 UNION ALL SELECT b, a FROM l1),
r AS (SELECT first AS node, first AS reach FROM k UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS root FROM r GROUP BY 1),
keep AS (SELECT v.doc_id, v.line, v.place <> c.root AS gone FROM v JOIN k ON k.t = v.t JOIN c ON c.node = k.first),
z AS (SELECT o.doc_id, count(q.line) AS n_lines, count(*) FILTER (WHERE q.gone) AS n_removed, coalesce(string_agg(o.t, chr(10) ORDER BY o.line) FILTER (WHERE q.gone IS NOT TRUE), '') AS left_
  FROM o LEFT JOIN keep q ON q.doc_id = o.doc_id AND q.line = o.line GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(left_)::BIGINT AS chars_left, sha256(left_) AS text_sha256
FROM d LEFT JOIN z ON z.doc_id = d.doc_id
"""


# CRC-32: the table of its bytes, and the sum of a text over it.
_SUMS = """tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(text: str) -> str:
    byte = f"('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2])::BIGINT"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), "
            f"lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))")  # fmt: skip


# Best cost, edits and lines by turn and state; insertions between two turns are a fixed closure of the pattern's states.
_REPAIR = rf"""
WITH RECURSIVE {_SUMS},
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
y AS (SELECT x.*, {_crc("place")} % 20 AS k FROM x, tab),
z AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM y WHERE k > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
             right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last FROM z),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
step(p, role, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
added(p, q, c, a, l) AS (
  SELECT p, p, 0, '', []::VARCHAR[] FROM (SELECT unnest(range(4))::INT AS p)
  UNION ALL VALUES (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
arcs AS (
  SELECT conv_id, i, p, p AS q, 4 AS c, 'D' AS a, []::VARCHAR[] AS l FROM f, (SELECT unnest(range(4))::INT AS p)
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault IS NULL THEN 0 ELSE 3 END, 'K', [f.role || ':' || text] FROM f JOIN step ON step.role = f.initial WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault IS NULL THEN 3 ELSE 6 END, 'R', [CASE step.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM f JOIN step ON step.role <> 's' WHERE fault IS NULL OR fault = 'truncated'),
best(conv_id, i, q, b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}} FROM f
  UNION ALL
  SELECT b.conv_id, b.i + 1, x.q, min({{'c': b.b.c + n.c + x.c, 'a': b.b.a || n.a || x.a, 'l': b.b.l || n.l || x.l}})
  FROM best b JOIN added n ON n.p = b.q JOIN arcs x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i + 1 AND x.p = n.q GROUP BY 1, 2, 3),
n AS (SELECT conv_id, max(i) AS n FROM f GROUP BY 1),
w AS (SELECT b.conv_id, min({{'c': b.b.c + a.c, 'a': b.b.a || a.a, 'l': b.b.l || a.l}}) AS b FROM best b JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.n = b.i JOIN added a ON a.p = b.q WHERE a.q IN (0, 3) GROUP BY 1),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.b.c, 0)::BIGINT AS cost, coalesce(w.b.a, '') AS audit, sha256(coalesce(array_to_string(w.b.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM e.conv_id
"""

_RESAMPLE = rf"""
WITH {_SUMS},
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
fb AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
h AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM fb)), tab),
s AS (SELECT bucket, count(*) AS n FROM fd JOIN h ON h.f = fd.f GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM fb JOIN h ON h.f = fb.f GROUP BY 1),
a AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (a.s + 10000) / ((s.n + 1)::DOUBLE * (a.t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
m AS (SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM fd JOIN h ON h.f = fd.f JOIN g USING (bucket) GROUP BY 1),
z AS (SELECT doc_id, len(w) AS words, coalesce(m.n, 0)::BIGINT AS n_features, coalesce(m.weight, 0)::BIGINT AS weight,
             coalesce(m.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score FROM d LEFT JOIN m USING (row)),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) OVER (PARTITION BY words >= 20) AS fit FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * fit // 100 THEN place END::BIGINT AS rank FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat": _CHAT, "op5_line_dedup": _LINES, "op8_ngram_join": _NGRAM, "op9_embed_dedup": _EMBED, "op10_mixing": _MIX,
        "op11_repair": _REPAIR, "op13_resampling": _RESAMPLE,
    }
