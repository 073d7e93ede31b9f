"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rooftally.llm import decontamination, divergence, language, middle, mixing, pieces, quality, secrets, sharding, simhash, token_files, toxicity, unigram
from rooftally.llm.text import read, word_count


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, "doc_id", "source", word_count(F.col("text"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "repeats")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), "doc_id", "text").select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(read(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text")
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def id_crc(id_col: str, n: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "doc_id", "text", "toxic", id_crc("_id", 5) != 0, "lang")
    rows = toxicity.score(docs, "text", model, ["doc_id"])
    held = F.coalesce(id_crc("doc_id", 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.new_folder(spark)
    token_files.write(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_file("byte_bpe_50k.json"), out)
    return token_files.digest(spark, out)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs, "text", "lang", "doc_id", id_crc("_id", 4) != 2)
    rows = language.predict(docs, "text", model, ["doc_id"])
    held = F.coalesce(id_crc("doc_id", 4) == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_file("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = middle.transformed(read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encoded(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_file("piece_bpe_32k.model"), decode=True)
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), "text", "lang", "source")


def queries() -> dict:
    every = (op1_mix, op2_simhash, op3_quality, op4_secrets, op5_decontaminate, op6_toxicity, op7_tokens, op8_language, op9_count, op10_shard, op11_middle, op12_pieces, op13_divergence)
    return {f.__name__: f for f in every}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
w AS (
  SELECT *, sum(size) OVER () - coalesce(sum(size * 3) OVER o, 0) AS room,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open
  FROM s WINDOW o AS (ORDER BY size * 3 / CAST(weight AS DOUBLE), weight, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * room < size * 3 * open AS free FROM w),
t AS (
  SELECT source, size,
         CASE WHEN free THEN weight * max(CASE WHEN free THEN CAST(room AS DOUBLE) / CAST(open AS DOUBLE) END) OVER ()
              ELSE CAST(size * 3 AS DOUBLE) END AS target
  FROM f),
e AS (SELECT source, size AS source_size, target, CASE WHEN size > 0 THEN CAST(floor(target / size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
m AS (SELECT *, whole + CASE WHEN part > 0 AND size > 0 AND 2 * before + size <= 2 * part THEN 1 ELSE 0 END AS n FROM r)
SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken, CAST(n AS BIGINT) AS repeats FROM m
"""



OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT k, i, w[i:i+7] AS win FROM (SELECT k, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w)),
p AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM g) WHERE c > 1),
r AS (SELECT k, sum(least(8, coalesce(j - i, 8))) AS n_repeat_words FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS j FROM p) GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
u AS (SELECT k, line, min(pos) AS pos, count(*) AS c FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k, line),
v AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(line, '\||»|›|•|·| > ')) AS nav,
        len(regexp_extract_all(line, '[#*$%&|<>]|!!')) AS marks,
        len(regexp_extract_all(lower(line), '(^|[^\pL\pN])('
          || 'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|accept cookies|click here|read more|sign up|log in|subscribe to our|share this|skip to content|enable javascript|lorem ipsum|licensed under'
          || '|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|cookies akzeptieren|hier klicken|weiterlesen|jetzt anmelden|newsletter abonnieren|zum inhalt springen'
          || '|tous droits réservés|conditions d''utilisation|politique de confidentialité|accepter les cookies|cliquez ici|lire la suite|se connecter|abonnez-vous|aller au contenu'
          || '|todos los derechos reservados|términos de uso|política de privacidad|aceptar cookies|haga clic aquí|leer más|iniciar sesión|suscríbete|saltar al contenido'
          || ')($|[^\pL\pN])')) AS furniture FROM u),
f AS (SELECT *, (nav >= 3 AND nav * 4 >= n) OR (marks >= 3 AND marks * 4 >= n)
        OR (furniture > 0 AND furniture * 8 >= n)
        OR (n < 3 AND NOT regexp_matches(line, '[.!?:;,…"”»)\]][\x20\x09-\x0D]*$')) OR (n >= 100 AND NOT regexp_matches(line, '[.!?:;,…。！？]')) AS bad FROM v),
s AS (SELECT k, sum(c) - count(*) AS dup, coalesce(sum(CASE WHEN NOT bad THEN length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) END), 0) AS stay FROM f GROUP BY k),
a AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stay, 0) AS stay
  FROM d JOIN w USING (k) LEFT JOIN r USING (k) LEFT JOIN s USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND stay * 100 > word_chars * 50 AS kept
FROM b
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
iw AS (SELECT DISTINCT item, w[s:s+12] AS win FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0)),
ln AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT k, s, n, w[s:s+n-1] AS win FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, ln)),
h AS (SELECT dw.k, dw.s, dw.n, iw.item FROM dw JOIN iw ON dw.win = iw.win),
hw AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT k, s, n FROM h)) GROUP BY k),
hi AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (k) LEFT JOIN hi USING (k)
"""



#: Patterns are written out here once more, so that a slip in the operator's shows.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
p(kind, name) AS (VALUES (0, 'assign'), (1, 'access'), (2, 'hex'), (3, 'entropy')),
f AS (FOUND),
s AS (SELECT k, kind, i, v[i] AS value, g[i] AS gap FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM f)),
o AS (SELECT k, kind, i, value, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY k, kind ORDER BY i) AS BIGINT) AS stop FROM s),
q AS (SELECT *, stop - length(value) AS start FROM o),
base AS (SELECT * FROM q WHERE kind IN (1, 2) OR (kind = 0 AND length(regexp_extract(value, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 6)),
c AS (SELECT * FROM q WHERE kind = 3
  AND NOT regexp_matches(value, '^[0-9+/_=-]+$')
  AND NOT regexp_matches(value, '^[+/_=-]*(([A-Z]?[a-z]{2,})+|[A-Z]+)([+/_=-]+(([A-Z]?[a-z]{2,})+|[A-Z]+))*[+/_=-]*$')
  AND NOT regexp_matches(value, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
  AND NOT regexp_matches(value, '(?i)^(.*=)?[a-z_-]*(example|placeholder|changeme|dummy|sample|xxxx)[a-z_-]*[0-9]{0,4}$')
  AND NOT regexp_matches(value, '(?i)^(.*=)?(0?123456789|abcdef(ghijkl(mnopqr(stuvwxyz)?)?)?|[+/_-])+[0-9a-f]{0,5}$')
  AND NOT regexp_matches(value, '^(/?[a-z]+)+(/[a-z0-9_-]+)+/?$')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.k = q.k AND b.start <= q.start AND q.stop <= b.stop)),
w AS (SELECT k, i, o, substr(value, o, 20) AS win FROM (SELECT k, i, value, unnest(generate_series(1, length(value) - 19)) AS o FROM c)),
h AS (SELECT k, i, o, -sum(n / 20.0E0 * log2(n / 20.0E0)) AS bits FROM (SELECT k, i, o, ch, count(*) AS n FROM (SELECT k, i, o, unnest(string_split(win, '')) AS ch FROM w) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT k, i, max(bits) AS bits FROM h GROUP BY ALL),
every_ AS (SELECT k, kind, start, stop FROM base UNION ALL SELECT c.k, c.kind, c.start, c.stop FROM c JOIN m USING (k, i)
  WHERE m.bits >= CASE WHEN regexp_matches(value, '^[0-9a-fA-F]+$') THEN 3.02 WHEN regexp_matches(value, '^([0-9a-z]+|[0-9A-Z]+)$') THEN 3.62 ELSE 3.82 END),
r AS (SELECT k, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM every_ JOIN p USING (kind) GROUP BY k)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (k)""".replace("FOUND", " UNION ALL ".join(
    f"SELECT k, {kind} AS kind, regexp_extract_all(text, {p}, 0) AS v, regexp_split_to_array(text, {p}) AS g FROM d"
    for kind, p in enumerate((
        r"""'(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""", "'AKIA[A-Z0-9]{16,}'", "'[0-9a-f]{24,}'", "'[A-Za-z0-9+/_=-]{20,}'"))))  # fmt: skip


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
n AS (SELECT *, len(t) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS u FROM d),
c AS (SELECT *, least(u[1] % (n + 1), u[2] % (n + 1)) AS a, greatest(u[1] % (n + 1), u[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR u[3] % 100 >= 50 THEN 'plain' WHEN u[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

OP13_SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, c, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p FROM f JOIN v USING (lang)),
l AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q
  FROM (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM c GROUP BY ALL) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b USING (lang, term) GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN l USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_middle": OP11_SQL, "op13_divergence": OP13_SQL, "op1_mix": OP1_SQL, "op3_quality": OP3_SQL, "op4_secrets": OP4_SQL, "op5_decontaminate": OP5_SQL}
