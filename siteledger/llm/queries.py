"""The query of each operator over the whole table of documents, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best_fit import packed_rows
from .binary_pieces import binary_pieces
from .block_naming import exact_groups
from .golay_simhash import near_groups
from .hyper_language import identify_languages
from .lm_scoring import score_texts
from .merkle import dataset_manifest, folded, proof_text
from .mixing import mix_sources
from .passage_dedup import remove_passages
from .registry import QUERIES, SQL, query
from .repetition import repetition_rules
from .secrets import find_secrets, span_text
from .substring_dedup import remove_repeats
from .token_alignment import align_corpus

__all__ = ["QUERIES", "SQL"]


@query("op1_lm_scores")
def lm_scores(documents: DataFrame) -> DataFrame:
    return score_texts(documents)


@query("op2_substring_dedup")
def substrings(documents: DataFrame) -> DataFrame:
    rows = remove_repeats(documents)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query(
    "op3_mix_sources",
    r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), ordered AS (
  SELECT *, source_size::DOUBLE * 3 AS cap, row_number() OVER (ORDER BY source_size::DOUBLE * 3 / weight, source NULLS LAST) AS k FROM per
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ordered
), targets AS (
  SELECT source, source_size, n_docs,
         round(least(cap, coalesce((SELECT max(level) FROM levels WHERE cap / weight > level), 'inf'::DOUBLE) * weight), 6) AS target
  FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS certain FROM targets
), rest AS (
  SELECT *, target - certain * source_size AS rest FROM rated
), drawn AS (
  SELECT d.doc_id, d.size, r.source, r.source_size, r.target, r.certain, r.rest,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u,
         r.rest / r.source_size AS share, sqrt(r.source_size::DOUBLE / r.n_docs / d.size) AS tilt
  FROM d JOIN rest r ON d.source IS NOT DISTINCT FROM r.source
), ranked AS (
  SELECT *, CASE WHEN rest > 0 AND size > 0 THEN ((u / (1 - u)) / (share / (1 - share) * tilt)) / (1 + (u / (1 - u)) / (share / (1 - share) * tilt)) ELSE 1.0 END AS z
  FROM drawn
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY z, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM ranked
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (certain + CASE WHEN rest > 0 AND (upto <= rest OR (rest > upto - size AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
""",
)
def mixed(documents: DataFrame) -> DataFrame:
    return mix_sources(documents).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op4_secret_scan",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), patterns(o, kind, p, grp, least, width, most) AS (
  VALUES (0, 'assign', '(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 2, 6, 0, 0.0),
         (1, 'access', 'AKIA[A-Z0-9]+', 0, 20, 0, 0.0),
         (2, 'hex', '[0-9a-f]+', 0, 24, 0, 0.0),
         (3, 'entropy', '[A-Za-z0-9+/_=-]{20,}', 0, 0, 20, 20 * (log2(20) - 3.75)),
         (4, 'entropy_hex', '[0-9A-Fa-f]{24,}', 0, 0, 24, 24 * (log2(24) - 3.0))
), parted AS (
  SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
           '[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}', repeat(' ', 36), 'g'), '(?i)abcdefghijklmnop|0123456789abcdef', repeat(' ', 16), 'g'),
           '(?i)placeholder', repeat(' ', 11), 'g'), '(?i)changeme', repeat(' ', 8), 'g'), '(?i)example', repeat(' ', 7), 'g'), '(?i)sample', repeat(' ', 6), 'g'), '(?i)dummy', repeat(' ', 5), 'g'), '(?i)xxxx', repeat(' ', 4), 'g') AS u
  FROM d
), looked AS (
  SELECT doc_id, o, kind, p, grp, least, width, most, CASE WHEN o < 3 THEN t ELSE u END AS t FROM parted, patterns
), hits AS (
  SELECT doc_id, o, kind, least, width, most, regexp_extract_all(t, p, 0) AS m,
         CASE WHEN grp = 2 THEN regexp_extract_all(t, p, 2) ELSE regexp_extract_all(t, p, 0) END AS v, string_split_regex(t, p) AS g
  FROM looked WHERE regexp_matches(t, p)
), one AS (
  SELECT doc_id, o, kind, least, width, most, k, m[k] AS m, v[k] AS v,
         (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hits)
), base AS (
  SELECT doc_id, o, kind, s, s + length(m) AS e FROM one WHERE o < 3 AND length(v) >= least
), rest AS (
  SELECT doc_id, o, kind, width, most, s + length(lead) AS s, substr(m, length(lead) + 1) AS m
  FROM (SELECT *, regexp_extract(m, '^/?(?:[a-z_-]+[0-9]{0,4}[/=]+)+') AS lead FROM one WHERE o >= 3)
), windows AS (
  SELECT doc_id, o, kind, s, m, width, most, unnest(range(0, length(m) - width + 1)) AS j FROM rest
  WHERE length(m) >= width AND NOT regexp_matches(m, '^[^0-9]*$|^[^A-Za-z]*$|^/?(?:[a-z_-]+[0-9]{0,4}/)*[a-z_-]+[0-9]{0,4}/?$')
), added AS (
  SELECT doc_id, o, kind, s + min(j) AS s, s + max(j) + any_value(width) AS e FROM windows
  WHERE list_sum(list_transform(map_values(list_histogram(string_split(substr(m, j + 1, width), ''))), lambda n: n * log2(n))) <= most + 1e-8
  GROUP BY doc_id, o, kind, s
), spans AS (
  SELECT * FROM base UNION ALL SELECT * FROM added
), joined AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS a
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)
""",
)
def secrets(documents: DataFrame) -> DataFrame:
    found = find_secrets(documents)

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


@query("op5_language_id")
def languages(documents: DataFrame) -> DataFrame:
    return identify_languages(documents)


@query(
    "op6_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents
), r AS (
  SELECT doc_id, plain, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size
  FROM d WINDOW w AS (PARTITION BY plain ORDER BY length(t) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(plain) AS text_sha256 FROM r
""",
)
def copies(documents: DataFrame) -> DataFrame:
    return exact_groups(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_packed_rows")
def matrix_rows(documents: DataFrame) -> DataFrame:
    rows = packed_rows(documents)
    return rows.select("row_id", "n_tokens", "cu_seqlens", "resets", "doc_ids", "starts", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


@query("op8_binary_pieces")
def pieces(documents: DataFrame) -> DataFrame:
    rows = binary_pieces(documents)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query(
    "op9_quality_rules",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
), words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM d
), runs AS (
  SELECT doc_id, i, 3 AS k, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS g FROM words QUALIFY i + 2 <= n
  UNION ALL
  SELECT doc_id, i, 8, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) FROM words QUALIFY i + 7 <= n
  UNION ALL
  SELECT doc_id, i, 101, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 100 FOLLOWING) FROM words QUALIFY i + 100 <= n
), named AS (
  SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, g) AS n FROM runs
), hit AS (
  SELECT doc_id, k, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM named WHERE n > 1) GROUP BY doc_id, k
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines,
         coalesce(a.n, 0) AS n_repeat_words, coalesce(b.n, 0) AS n_covered_words, c.n IS NOT NULL AS too_long
  FROM d JOIN lines USING (doc_id) LEFT JOIN hit a ON a.doc_id = d.doc_id AND a.k = 3 LEFT JOIN hit b ON b.doc_id = d.doc_id AND b.k = 8
  LEFT JOIN hit c ON c.doc_id = d.doc_id AND c.k = 101
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= 30 * n_words AND NOT too_long AS kept
FROM base
""",
)
def rules(documents: DataFrame) -> DataFrame:
    rows = repetition_rules(documents)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "base_failed", "kept")


@query("op10_near_dedup")
def near_copies(documents: DataFrame) -> DataFrame:
    rows = near_groups(documents)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op11_token_alignment")
def alignment(documents: DataFrame) -> DataFrame:
    rows, _ = align_corpus(documents)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query(
    "op12_merkle_manifest",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(changed)::VARCHAR || ':' || changed, '-')) AS claimed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-'))) - 1 AS place
  FROM (
    SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
              || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') AS head,
           CASE WHEN xor(crc, 4294967295) & 1 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
    FROM d
  )
), tiers AS (
  SELECT source, 0 AS tier, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY source
  UNION ALL
  SELECT source, tier + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM tiers WHERE len(nodes) > 1
), subroots AS (
  SELECT source, tier AS top, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tiers WHERE len(nodes) = 1
), crown AS (
  SELECT 0 AS tier, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT tier + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM crown WHERE len(nodes) > 1
), path AS (
  SELECT l.doc_id, l.source, l.place AS row, l.leaf, s.subroot, s.top, s.place AS above, 0 AS tier, l.place AS place, '' AS proof, l.claimed AS own
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT p.doc_id, p.source, p.row, p.leaf, p.subroot, p.top, p.above, p.tier + 1,
         CASE WHEN p.tier + 1 = p.top THEN p.above ELSE p.place // 3 END,
         p.proof || array_to_string(r.left_side, '') || array_to_string(r.right_side, ''),
         sha256(array_to_string(r.left_side, '') || p.own || array_to_string(r.right_side, ''))
  FROM (SELECT * FROM path WHERE tier < top) p JOIN tiers t ON p.source IS NOT DISTINCT FROM t.source AND p.tier = t.tier,
       LATERAL (SELECT t.nodes[p.place // 3 * 3 + 1:p.place] AS left_side, t.nodes[p.place + 2:p.place // 3 * 3 + 3] AS right_side) r
), crown_path AS (
  SELECT doc_id, source, row, leaf, subroot, 0 AS tier, above AS place, proof, own FROM path WHERE tier = top
  UNION ALL
  SELECT p.doc_id, p.source, p.row, p.leaf, p.subroot, p.tier + 1, p.place // 3,
         p.proof || array_to_string(t.nodes[p.place // 3 * 3 + 1:p.place], '') || array_to_string(t.nodes[p.place + 2:p.place // 3 * 3 + 3], ''),
         sha256(array_to_string(t.nodes[p.place // 3 * 3 + 1:p.place], '') || p.own || array_to_string(t.nodes[p.place + 2:p.place // 3 * 3 + 3], ''))
  FROM crown_path p JOIN crown t ON p.tier = t.tier AND len(t.nodes) > 1
), root AS (
  SELECT tier, nodes[1] AS root FROM crown WHERE len(nodes) = 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified
FROM crown_path JOIN root USING (tier)
""",
)
def manifest(documents: DataFrame) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = dataset_manifest(documents, claim={"text": tampered})
    rows = rows.withColumn("folded_root", folded(F.col("claimed"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_passage_dedup")
def passages(documents: DataFrame) -> DataFrame:
    rows = remove_passages(documents)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
