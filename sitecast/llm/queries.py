"""The queries of this subpackage; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.llm import conversation_repair, decontaminate, lexical_search, licenses, pii, quality, secrets_scan, url_filter
from sitecast.llm.common import table
from sitecast.llm.langid import identify
from sitecast.llm.ngram_join import join_components
from sitecast.llm.offsets import offsets
from sitecast.llm.packing import pack
from sitecast.llm.token_counts import count_tokens
from sitecast.llm.wavelet import round_trip

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.find_secrets(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False).drop("ids")


#: E-mail addresses, which the query's edits replace; possessive, so that each run is read once.
ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after every e-mail address gives way to a tag."""
    text = F.coalesce("text", F.lit(""))
    places = offsets(text, ADDRESS, F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)))
    edits = F.transform(places, lambda s: F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop"), F.lit("[EMAIL]").alias("replacement")))
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits")), TOKENIZER)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents")).drop("node")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")).drop("redacted"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False).drop("ids")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs, docs.where(~held_out).where("doc_id is not null"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table(spark, sf_dir, "documents")).select(*columns)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_join": op4_ngram_join,
    "op5_pii": op5_pii,
    "op6_token_output": op6_token_output,
    "op7_licenses": op7_licenses,
    "op8_decontamination": op8_decontamination,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_url_filter": op13_url_filter,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Where SQL can express the whole result: all pairs over shared shingles, and windows looked up as text.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
      sh AS (SELECT DISTINCT doc_id, array_to_string(w[k.k : k.k + 4], ' ') AS s FROM w, range(1, 30000) k(k) WHERE k.k <= greatest(1, len(w) - 4) AND len(w) > 0),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
      r AS (SELECT doc_id AS doc, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc)
      SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc, min(root) AS component_id FROM r GROUP BY 1) m ON m.doc = w.doc_id""",
    "op8_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), i AS (SELECT CAST(item_id AS varchar) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
      iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k.k : k.k + least(13, len(w)) - 1], ' ') AS s FROM i, range(1, 30000) k(k) WHERE len(w) > 0 AND k.k <= greatest(1, len(w) - 12)),
      dw AS (SELECT doc_id, k.k AS k, z.n, array_to_string(w[k.k : k.k + z.n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw) z, range(1, 30000) k(k) WHERE k.k <= len(w) - z.n + 1),
      h AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n), hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
      it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
      SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op12_lexical_search": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents), dn AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
      z AS (SELECT count(*) AS nn, sum(n)::bigint AS l FROM dn), tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM dn) GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
      it AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
      w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS double))) AS bigint) AS w FROM df, z), m AS (SELECT r, doc_id, 50 + (50 * n * nn) // l AS m FROM dn, z),
      s AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS bigint) AS score FROM it JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY 1, 2, 3),
      o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS integer) AS rank, doc_id, score FROM s WHERE score > 0)
      SELECT * FROM o WHERE rank <= 50""",
    # A sum over 24 steps of the mass that moves along (forward) and against the edges; see url_filter.
    "op13_url_filter": r"""WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
      p AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
      rules(rh, rp, allowed) AS (VALUES ('com', '/', true), ('example.com', '/en/', false), ('www.example.com', '/en/', true), ('net', '/es/', false), ('net', '/fr/', false)),
      j AS (SELECT page_id, html, host, path, (SELECT arg_max({'rule': rh || rp, 'allowed': allowed}, length(rh || rp)) FROM rules WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)) AS r FROM p),
      h AS (SELECT host, avg(CASE WHEN r.allowed THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN NOT r.allowed THEN 1.0 ELSE 0.0 END) AS distrust FROM j WHERE host <> '' GROUP BY 1),
      l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)<a\b[^<>]*?\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM j WHERE host <> ''),
      k AS (SELECT a.host AS src, b.host AS dst FROM h a JOIN h b ON instr(a.host, '.') > 0 AND b.host = substr(a.host, instr(a.host, '.') + 1)),
      e AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, 1.0 AS n FROM l WHERE src <> dst UNION ALL SELECT src, dst, 1.0 FROM k UNION ALL SELECT dst, src, 1.0 FROM k) GROUP BY 1, 2),
      ways AS (SELECT true AS fw, src, dst, n FROM e UNION ALL SELECT false, dst, src, n FROM e),
      mv AS (SELECT fw, src, dst, n / sum(n) OVER (PARTITION BY fw, src) AS w FROM ways UNION ALL (SELECT DISTINCT fw, dst, dst, 1.0 FROM ways x WHERE NOT EXISTS (SELECT 1 FROM ways y WHERE y.fw = x.fw AND y.src = x.dst))),
      st AS (SELECT host, true AS fw, trust AS m FROM h WHERE trust > 0 UNION ALL SELECT host, false, distrust FROM h WHERE distrust > 0),
      f AS (SELECT 0 AS k, host, fw, m * CAST(0.15 AS double) AS m FROM st WHERE host IN (SELECT src FROM mv) UNION ALL SELECT k + 1, dst, fw, sum(m * w * CAST(0.85 AS double)) FROM f JOIN mv USING (fw) WHERE f.host = mv.src AND k < 24 GROUP BY ALL),
      s AS (SELECT host, round(sum(CASE WHEN fw THEN m ELSE 0 END), 9) AS t, round(sum(CASE WHEN fw THEN 0 ELSE m END), 9) AS d FROM (SELECT host, fw, m FROM f UNION ALL SELECT host, fw, m FROM st WHERE host NOT IN (SELECT src FROM mv)) GROUP BY 1)
      SELECT page_id, j.host, path, r.rule AS rule, CASE WHEN r.allowed THEN 'allow' WHEN NOT r.allowed THEN 'block' WHEN d >= 0.25 AND d > t THEN 'block' ELSE 'allow' END AS verdict FROM j LEFT JOIN s ON s.host = j.host""",
}
