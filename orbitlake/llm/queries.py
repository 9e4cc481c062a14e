"""The queries of this subpackage: op1 to op13 over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(spark_id: str = "doc_id"):
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.pmod(F.crc32(F.col(spark_id).cast("string")), F.lit(5))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    out = archive_round_trip(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
top AS (SELECT hex, payload_bytes, max(page_id) AS top FROM p GROUP BY ALL)
SELECT p.page_id, p.payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(p.hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN p.page_id = top.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = top.top THEN NULL ELSE top.top END AS refers_to
FROM p JOIN top USING (hex, payload_bytes)
"""


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_repeats

    out = dedup_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import apply_rules

    return apply_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def _op3_sql() -> str:
    from .quality import ALPHA, DELTA, RULES

    grid = ", ".join(f"('{r}', {j}, {c})" for r, cuts in RULES.items() for j, c in enumerate(cuts, 1))
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT grams.doc_id, i, unnest(range(5)) AS k FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(lines) AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
v AS (SELECT doc_id, stratum, unnest([{{'rule': 'symbols', 'v': 1000 * n_symbols // greatest(n_words, 1)}},
             {{'rule': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1)}}, {{'rule': 'repeat_words', 'v': 1000 * n_repeat_words // greatest(n_words, 1)}},
             {{'rule': 'long_words', 'v': 1000 * word_chars // greatest(n_words, 1)}}, {{'rule': 'short_words', 'v': 1000 * n_words // greatest(word_chars, 1)}}]) AS x FROM c),
grid(rule, level, cutoff) AS (VALUES {grid}),
rejected AS (SELECT v.doc_id, min(level) AS first FROM v JOIN grid ON grid.rule = v.x.rule AND v.x.v > cutoff GROUP BY v.doc_id),
good AS (SELECT c.doc_id, stratum, first FROM c JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) LEFT JOIN rejected USING (doc_id)),
sizes AS (SELECT stratum, count(*) AS own, count(*) OVER () AS strata FROM good GROUP BY stratum),
pools AS (SELECT stratum, strata, CASE WHEN own >= ceil(ln({DELTA} / (strata + 1)) / ln(1 - {ALPHA})) THEN '=' || stratum ELSE '' END AS pool FROM sizes),
tests AS (SELECT pool, any_value(strata) AS strata, level, count(*) AS n, count(*) FILTER (WHERE first <= level) AS k
  FROM good JOIN pools USING (stratum) CROSS JOIN (SELECT DISTINCT level FROM grid) GROUP BY pool, level),
passed AS (SELECT pool, max(level) AS level FROM tests WHERE k <= n * {ALPHA}
  AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) <= {DELTA} / (strata + 1) GROUP BY pool)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(rejected.first > passed.level, true) AS kept
FROM c LEFT JOIN rejected USING (doc_id) LEFT JOIN pools USING (stratum) LEFT JOIN passed USING (pool)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT keyed.doc_id, pos, line, common.k IS NOT NULL AND common.top <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels.where(_fold() != 0)), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import embedding_groups

    out = embedding_groups(_read(spark, sf_dir, "embeddings"), threshold=0.9)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP6_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT comp.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, comp.vec_id = component_id AS kept
FROM comp LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = comp.vec_id
"""


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    out = simhash_groups(_read(spark, sf_dir, "documents"), width=3, radius=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_texts

    return encode_texts(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), keep=["doc_id"], with_ids=False)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = _read(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.where(_fold() != 0)), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored

    out = fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    lengths = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return out.select("doc_id", "n", "form", *lengths, sha("output").alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, list_transform(range(4), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS h FROM d),
c AS (SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked_search

    out = ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP12_SQL = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_all FROM sizes),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
posted AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posted CROSS JOIN whole GROUP BY term, n_docs),
gains AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all))) AS gain FROM posted JOIN weighed USING (term) JOIN sizes USING (doc_id) CROSS JOIN whole),
scores AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10
"""


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import fit, labelled_strings, scan

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(labelled_strings(docs)))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    many = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = told(F.filter("secrets", lambda x: x["kind"] != "random"))
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(base, 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def _op13_sql() -> str:
    from .secrets import ACCESS, ALPHABET, ASSIGN, ASSIGN_LEAST, HEX, LEARN_LEAST, LEARNED, LEAST_MEAN, LEAST_RATIO, ORDINARY_PRIOR, RANDOM_PRIOR, RUN, SCORE_LEAST, TRAIN_ROWS

    size = len(ALPHABET)
    quoted = {k: p.replace("'", "''") for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("runs", f"{RUN}{{{SCORE_LEAST},}}"))}

    def matches(kind: str) -> str:
        p = quoted[kind]
        return f"""
{kind} AS (SELECT rid, e - len(m) AS s, e, m, v FROM (SELECT rid, m, v, sum(len(gap) + len(m)) OVER (PARTITION BY rid ORDER BY i) AS e
  FROM (SELECT rid, unnest(f) AS m, unnest(v) AS v, unnest(g[1:len(f)]) AS gap, unnest(range(len(f))) AS i
    FROM (SELECT rid, regexp_extract_all(t, '{p}') AS f, regexp_extract_all(t, '{p}', {2 if kind == "assign" else 0}) AS v, string_split_regex(t, '{p}') AS g FROM d)))
  {f"WHERE len(v) >= {ASSIGN_LEAST}" if kind == "assign" else ""}),"""

    rest = "t"
    for kind in ("assign", "access", "hex"):
        rest = f"regexp_replace({rest}, '{quoted[kind]}', ' ', 'g')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),{"".join(map(matches, quoted))}
base AS (SELECT rid, 0 AS k, s, e, v FROM assign UNION ALL SELECT rid, 1, s, e, v FROM access UNION ALL SELECT rid, 2, s, e, v FROM hex),
n AS (SELECT count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
chosen AS (SELECT d.* FROM d, n WHERE doc_id IS NOT NULL AND (n <= {TRAIN_ROWS} OR ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT * n < {TRAIN_ROWS << 32})),
samples AS (SELECT v, max(label) AS label FROM (
  SELECT v, 1 AS label FROM base JOIN chosen USING (rid)
  UNION ALL SELECT unnest(regexp_extract_all({rest}, '{RUN}{{{LEARN_LEAST},64}}')), 0 FROM chosen) WHERE len(v) >= {LEARN_LEAST} GROUP BY v),
counts AS (SELECT label, a, b, count(*) AS n FROM (SELECT label, instr('{ALPHABET}', v[i]) AS a, instr('{ALPHABET}', v[i + 1]) AS b
  FROM (SELECT label, v, unnest(range(1, len(v))) AS i FROM samples)) WHERE a > 0 AND b > 0 GROUP BY label, a, b),
sums AS (SELECT label, a, sum(n) AS n FROM counts GROUP BY ALL),
places AS (SELECT range AS a FROM range(1, {size + 1})),
shares AS (SELECT a AS b, (coalesce(n, 0) + 1)::DOUBLE / (sum(coalesce(n, 0)) OVER () + {size})::DOUBLE AS share FROM places LEFT JOIN (SELECT b, sum(n) AS n FROM counts WHERE label = 0 GROUP BY b) s ON s.b = places.a),
ratios AS (SELECT x.a, y.a AS b, floor(1000 * ln(({LEARNED} * ((coalesce(c1.n, 0) + {RANDOM_PRIOR * (1 / size)!r}::DOUBLE) / (coalesce(s1.n, 0) + {RANDOM_PRIOR}::DOUBLE)) + {(1 - LEARNED) * (1 / size)!r}::DOUBLE)
    / ((coalesce(c0.n, 0) + {ORDINARY_PRIOR}::DOUBLE * share) / (coalesce(s0.n, 0) + {ORDINARY_PRIOR}::DOUBLE))) + 0.5)::BIGINT AS r
  FROM places x CROSS JOIN places y JOIN shares ON shares.b = y.a LEFT JOIN counts c1 ON c1.label = 1 AND c1.a = x.a AND c1.b = y.a LEFT JOIN counts c0 ON c0.label = 0 AND c0.a = x.a AND c0.b = y.a
  LEFT JOIN sums s1 ON s1.label = 1 AND s1.a = x.a LEFT JOIN sums s0 ON s0.label = 0 AND s0.a = x.a),
pairs AS (SELECT rid, s, e, instr('{ALPHABET}', m[i]) AS a, instr('{ALPHABET}', m[i + 1]) AS b FROM (SELECT *, unnest(range(1, len(m))) AS i FROM runs)),
random AS (SELECT rid, s, e FROM pairs JOIN ratios USING (a, b) GROUP BY rid, s, e HAVING sum(r) >= {LEAST_RATIO} AND sum(r) >= {LEAST_MEAN} * (e - s - 1)),
told AS (SELECT rid, k, s, e FROM base UNION ALL SELECT rid, 3, s, e FROM random WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = random.rid AND base.s <= random.s AND base.e >= random.e)),
named AS (SELECT *, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM told)
SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
       sha256(coalesce(string_agg(x, ',' ORDER BY s, k, e) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, k, e), '') AS spans
FROM d LEFT JOIN named USING (rid) GROUP BY rid, doc_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_suffix_array_dedup, op3_quality_rules, op4_line_dedup, op5_toxicity, op6_embedding_near_dedup, op7_simhash_near_dedup, op8_packing, op9_sentencepiece, op10_language_id, op11_fill_in_middle, op12_lexical_search, op13_secret_scans, pipeline)
}

SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op3_quality_rules": _op3_sql(), "op4_line_dedup": OP4_SQL, "op6_embedding_near_dedup": OP6_SQL, "op11_fill_in_middle": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_secret_scans": _op13_sql()}
