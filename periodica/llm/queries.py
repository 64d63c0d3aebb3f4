"""The registered queries of this subpackage, one per operator, and their SQL where it can state them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm import ann, audit, chat, decontamination, extraction, language, lines, neardup, packing, pii, repair, substrings, warc
from periodica.llm.common import ship, table
from periodica.session import materialise, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_best_fit_packing")
def op2(spark, sf):
    return packing.pack(packing.pieces(table(spark, sf, "documents"), word_tokenizer()))


@query("op4_warc_archives", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g""")
def op4(spark, sf):
    folder = shared_folder(spark, "warc")
    warc.write(table(spark, sf, "pages"), folder)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return warc.read(spark, folder).select(
        page(F.col("record")).alias("page_id"), F.col("payload_bytes").cast("long").alias("payload_bytes"),
        "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


_ESC = "replace(replace(replace(replace(replace({}, '\\', '\\0'), '<s>', '\\1'), '</s>', '\\2'), '[INST]', '\\3'), '[/INST]', '\\4')"


@query("op7_chat_reply_trees", f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def op7(spark, sf):
    extra = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(extra).alias("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    nodes = chat.chain(rows)
    back = chat.read_back(chat.format_paths(nodes, chat.reply_paths(nodes)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op1_cgk_decontamination")
def op1(spark, sf):
    return decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_byte_cnn_language")
def op9(spark, sf):
    docs = table(spark, sf, "documents")
    net = language.fit(docs.filter(~language.held_out()))
    return language.predict(docs.select("doc_id", "text"), net).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op6_superminhash_near_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS m FROM n UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.a)
SELECT n.doc_id, n.n AS n_shingles, min(m) AS component_id, n.doc_id = min(m) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""")
def op6(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents"), k=3, percent=85)


@query("op10_hnsw_nearest")
def op10(spark, sf):
    vectors = table(spark, sf, "embeddings")
    index = materialise(ann.build_index(vectors), "index")
    return ann.nearest(index, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op8_bootstrapped_pii")
def op8(spark, sf):
    return pii.find(table(spark, sf, "documents"))


@query("op3_substring_dedup", r"""
WITH RECURSIVE s AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?][ \t]+|\n+)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i,
  trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM s WHERE part <> ''),
q AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS w, length(replace(norm, ' ', '')) AS c,
  coalesce(sum(CASE WHEN part LIKE '%' || chr(10) THEN 1 ELSE 0 END) OVER f, 0) AS line,
  coalesce(sum(CASE WHEN part LIKE '%' || chr(10) || chr(10) THEN 1 ELSE 0 END) OVER f, 0) AS para,
  sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT doc_id, i, 0 AS g, line AS held, w AS sw, c AS sc FROM q WHERE i = 1
  UNION ALL SELECT doc_id, i, g + fresh, CASE WHEN w = 0 THEN held ELSE line END, CASE WHEN fresh = 1 THEN w ELSE sw + w END, CASE WHEN fresh = 1 THEN c ELSE sc + c END
  FROM (SELECT q.*, r.g, r.held, r.sw, r.sc,
    CASE WHEN q.w > 0 AND r.sw > 0 AND (q.line <> r.held OR r.sw >= 6 OR r.sc >= 48 OR q.w >= 6 OR q.c >= 48) THEN 1 ELSE 0 END AS fresh
    FROM r JOIN q ON q.doc_id = r.doc_id AND q.i = r.i + 1)),
t AS (SELECT doc_id, g AS h, min(stop - length(part)) AS start, max(stop) AS stop, sum(w) AS w, sum(c) AS c,
  min(line) FILTER (WHERE w > 0) AS line, min(para) FILTER (WHERE w > 0) AS para,
  string_agg(norm, ' ' ORDER BY i) FILTER (WHERE w > 0) AS norm FROM q JOIN r USING (doc_id, i) GROUP BY doc_id, g HAVING sum(w) > 0),
l AS (SELECT *, w >= 6 OR c >= 48 AS enough, lag(start) OVER b AS since, lag(norm) OVER b || ' ' || norm AS joint
  FROM t WINDOW b AS (PARTITION BY doc_id, line ORDER BY h)),
e AS (SELECT doc_id, para, line, min(start) AS start, max(stop) AS stop, sum(w) AS w, sum(c) AS c, string_agg(norm, ' ' ORDER BY h) AS norm,
  arg_min(enough, h) AS starts FROM l GROUP BY doc_id, para, line),
g AS (SELECT doc_id, para, min(start) AS start, max(stop) AS stop, sum(w) AS w, sum(c) AS c, string_agg(norm, ' ' ORDER BY line) AS norm
  FROM e GROUP BY doc_id, para HAVING bool_or(w < 6 AND c < 48)),
d AS (SELECT doc_id, min(start) AS start, max(stop) AS stop, string_agg(norm, ' ' ORDER BY line) AS norm FROM e
  WHERE doc_id IN (SELECT doc_id FROM g WHERE w < 6 AND c < 48) GROUP BY doc_id),
u AS (SELECT doc_id, start, stop, norm FROM l WHERE enough UNION ALL SELECT doc_id, since, stop, joint FROM l WHERE NOT enough AND since IS NOT NULL
  UNION ALL SELECT doc_id, start, stop, norm FROM e WHERE (w >= 6 OR c >= 48) AND NOT starts
  UNION ALL SELECT doc_id, start, stop, norm FROM g WHERE w >= 6 OR c >= 48 UNION ALL SELECT * FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS gone FROM u),
o AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k WHERE gone),
x AS (SELECT doc_id, start, stop FROM o WHERE before IS NULL OR stop > before),
y AS (SELECT doc_id, count(*) AS n_removed, string_agg(cast(start AS BIGINT) || ':' || cast(stop AS BIGINT), ',' ORDER BY start) AS removed FROM x GROUP BY doc_id),
z AS (SELECT q.doc_id, coalesce(string_agg(q.part, '' ORDER BY q.i) FILTER (WHERE x.start IS NULL), '') AS text
  FROM q LEFT JOIN x ON x.doc_id = q.doc_id AND q.stop > x.start AND q.stop <= x.stop GROUP BY q.doc_id)
SELECT doc_id, n_removed, removed, text FROM y JOIN z USING (doc_id)""")
def op3(spark, sf):
    spans = F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string")))
    return substrings.dedup(table(spark, sf, "documents")).select("doc_id", "n_removed", F.array_join(spans, ",").alias("removed"), "text")


@query("op5_suffix_array_lines", r"""
WITH l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l WHERE regexp_matches(line, '\S')),
w AS (SELECT *, lead(line, 1) OVER p AS l1, lead(line, 2) OVER p AS l2 FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY s)),
d AS (SELECT doc_id, s, 3 AS n, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, s) > 1 AS later FROM w WHERE l2 IS NOT NULL
  UNION ALL SELECT doc_id, s, 2, row_number() OVER (PARTITION BY line, l1 ORDER BY doc_id, s) > 1 FROM w WHERE length(line) + length(l1) >= 150
  UNION ALL SELECT doc_id, s, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, s) > 1 FROM w WHERE length(line) >= 150),
c AS (SELECT DISTINCT doc_id, s + k AS s FROM d, (SELECT unnest([0, 1, 2]) AS k) WHERE later AND k < n),
g AS (SELECT f.doc_id, f.i, c.s IS NOT NULL AS gone FROM f LEFT JOIN c USING (doc_id, s)),
a AS (SELECT l.doc_id, l.i, l.line, g.gone, last_value(g.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS before,
  first_value(g.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM l LEFT JOIN g USING (doc_id, i)),
r AS (SELECT *, coalesce(gone, before AND after, false) AS cut FROM a)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '') AS text FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""")
def op5(spark, sf):
    return lines.dedup(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query("op11_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
  + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS f FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS g, coalesce(sum(toxic), 0) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM b a, b b, b c, b d, b e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS gone
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, any_value(bit) AS bit,
  sum(CASE WHEN f & (gone + bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN f & gone = 0 AND f & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN f & gone <> 0 AND f & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN f = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN f & gone = 0 AND f & bit <> 0 THEN g ELSE 0 END) AS good_lost,
  sum(CASE WHEN f & gone = 0 AND f & bit <> 0 THEN x ELSE 0 END) AS toxic_lost FROM n, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""")
def op11(spark, sf):
    counted = audit.classes(table(spark, sf, "documents"), audit.text_tests(F.coalesce("text", F.lit(""))))
    return audit.orders(audit.survivors(counted, table(spark, sf, "labels")))


@query("op12_line_block_text", r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
s AS (SELECT *, list_transform(regexp_split_to_array(h, '</?(?:p|h[1-6]|div|section|ul|ol|li|blockquote)(?:\s[^>]*)?>'), lambda x:
  regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')) AS parts FROM a),
d AS (SELECT *, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x,
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM s)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') AS text,
  length(coalesce(array_to_string(blocks, chr(10) || chr(10)), ''))::BIGINT AS n_chars FROM d""")
def op12(spark, sf):
    text = F.array_join("blocks", "\n\n")
    return extraction.extract(table(spark, sf, "pages")).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


@query("op13_conversation_repair", r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT name, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)),
    4294967295::BIGINT) % 20 AS fault FROM (SELECT DISTINCT name FROM k)),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k JOIN h USING (name) WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS c FROM d),
f AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair, CASE
    WHEN regexp_matches(text, '^[\x20\x09-\x0D]*$') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
m AS (SELECT conv_id, i, c, role || ':' || text AS line, text, fault IN ('none', 'truncated') AS k, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM f),
r AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS z, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']} AS s,
    {'c': 3, 'a': 'I', 'r': ['assistant:']} AS u, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS e FROM g
  UNION ALL
  SELECT conv_id, i, list_min([z, {'c': u.c + 3, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}]),
    list_min([s, {'c': u.c + 3, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}]), u, e
  FROM (SELECT conv_id, i, z, s, list_min([u, {'c': e.c + 3, 'a': 'I' || e.a, 'r': list_prepend('assistant:', e.r)}]) AS u,
      list_min([e, {'c': u.c + 3, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}]) AS e
    FROM (SELECT conv_id, i, list_min([dz, CASE WHEN k AND c = 's' THEN {'c': t + s.c, 'a': 'K' || s.a, 'r': list_prepend(line, s.r)} END, pu]) AS z,
        list_min([ds, pu]) AS s, list_min([du, pa]) AS u, list_min([de, pu]) AS e
      FROM (SELECT r.conv_id, m.i, c, s, k, t, line,
          {'c': z.c + 4, 'a': 'D' || z.a, 'r': z.r} AS dz, {'c': s.c + 4, 'a': 'D' || s.a, 'r': s.r} AS ds,
          {'c': u.c + 4, 'a': 'D' || u.a, 'r': u.r} AS du, {'c': e.c + 4, 'a': 'D' || e.a, 'r': e.r} AS de,
          CASE WHEN k THEN CASE WHEN c = 'u' THEN {'c': t + u.c, 'a': 'K' || u.a, 'r': list_prepend(line, u.r)}
            ELSE {'c': t + 3 + u.c, 'a': 'R' || u.a, 'r': list_prepend('user:' || text, u.r)} END END AS pu,
          CASE WHEN k THEN CASE WHEN c = 'a' THEN {'c': t + e.c, 'a': 'K' || e.a, 'r': list_prepend(line, e.r)}
            ELSE {'c': t + 3 + e.c, 'a': 'R' || e.a, 'r': list_prepend('assistant:' || text, e.r)} END END AS pa
        FROM r JOIN m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.i = r.i - 1))))
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit,
  sha256(coalesce(array_to_string(z.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN (SELECT * FROM r WHERE i = 1) w ON w.conv_id IS NOT DISTINCT FROM a.conv_id""")
def op13(spark, sf):
    rows = table(spark, sf, "conversations")
    report, repaired = repair.repair(repair.damage(rows))
    whole = repaired.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(
        "place", "at", F.concat("role", F.lit(":"), "text").alias("line")))).alias("lines")).select(
        F.col("conv").alias("_conv"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    ids = rows.select("conv_id").distinct()
    none = F.lit(0).cast("long")
    return ids.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(
        whole, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *(F.coalesce(c, none).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"))
