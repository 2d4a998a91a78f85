"""The registered query of each operator, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import decontam, exact_dedup, license_scan, line_templates, mixing, packing, secrets, setsketch_dedup, spelling, token_align, toxicity, url_filter, warc
from churnscope.llm.common import shared_path, table


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return warc.read_index(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to",
        (F.col("verified") & F.col("length_ok")).alias("intact"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    locator = F.concat_ws("#", "_metadata.file_path", "_metadata.row_index")
    return exact_dedup.exact_dedup(docs, locator=locator).drop("keep_locator")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


#: The contract's rules; longest wins. Pattern rules of the operator judge the other URLs.
URL_RULES = (
    url_filter.HostRule("allow", "org"),
    url_filter.HostRule("block", "example.org", "/es/"),
    url_filter.HostRule("block", "example.org", "/en/1"),
    url_filter.HostRule("allow", "com", "/fr/"),
    url_filter.HostRule("block", "com", "/de/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES + url_filter.PATTERNS)
    return judged.drop("pattern")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
        F.array_join("licences", ",").alias("licences"), F.col("n_sentences").cast("long").alias("n_sentences"),
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_duplicates(table(spark, sf_dir, "documents"), params=setsketch_dedup.SketchParams(words=2))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_templates.drop_template_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), "text",
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), every=31)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = token_align.align_tokens(table(spark, sf_dir, "documents"), a, b, params=token_align.AlignParams(digest=True))
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archive": op1_warc_archive,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_license_scan": op6_license_scan,
    "op7_source_mixing": op7_source_mixing,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_line_templates": op10_line_templates,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_sequence_packing": op13_sequence_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_archive": """
        WITH p AS (
            SELECT page_id, sha256(encode(coalesce(html, ''))) AS digest,
                   octet_length(encode(coalesce(html, ''))) AS n
            FROM pages
        ), w AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
               true AS intact
        FROM w
    """,
    "op2_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), w AS (
            SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(encode(norm)) AS text_sha256
        FROM w
    """,
    "op4_url_filter": r"""
        WITH u AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), r AS (
            SELECT *, CASE
                WHEN regexp_matches(host || path, '^([^/]*\.)?example\.org/en/1') THEN 'example.org/en/1'
                WHEN regexp_matches(host || path, '^([^/]*\.)?example\.org/es/') THEN 'example.org/es/'
                WHEN regexp_matches(host || path, '^([^/]*\.)?com/fr/') THEN 'com/fr/'
                WHEN regexp_matches(host || path, '^([^/]*\.)?com/de/') THEN 'com/de/'
                WHEN regexp_matches(host || path, '^([^/]*\.)?org/') THEN 'org/'
            END AS rule
            FROM u
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])(ads|adserver|doubleclick|tracker|popup|casino|poker|bets|betting|gambling|adult|porn|xxx|sex|escort|pills|viagra|pharmacy|spam|warez|torrent|replica-watches)([^a-z0-9]|$)') THEN 'block'
            WHEN regexp_matches(lower(host || path), '/wp-login\.php|/affiliate/.*/click([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM r
    """,
    "op8_minhash_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), s AS (
            SELECT doc_id, CASE
                WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))
                WHEN len(ws) = 1 THEN [ws[1]] ELSE [] END AS sh
            FROM w
        ), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
                AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (
            SELECT doc_id, doc_id AS seen FROM s
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.seen = l.a
        ), c AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
        SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN c USING (doc_id)
    """,
    "op10_line_templates": r"""
        WITH l AS (
            SELECT doc_id, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tk
            FROM (SELECT doc_id, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents)
        ), t AS (
            SELECT *, list_transform(tk, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS mk
            FROM l WHERE len(tk) >= 3
        ), leaves AS (
            SELECT len(tk) AS n, mk[1:3] AS lead FROM t GROUP BY ALL HAVING count(*) >= 10
        ), k AS (
            SELECT t.*, len(tk) AS n, mk[1:3] AS lead FROM t JOIN leaves ON len(tk) = leaves.n AND mk[1:3] = leaves.lead
        ), f AS (SELECT n, lead, line, doc_id, unnest(mk) AS token, unnest(range(1, n + 1)) AS pos FROM k),
        c AS (SELECT n, lead, pos, token FROM f WHERE token <> '<*>' GROUP BY ALL HAVING count(*) >= 10),
        m AS (
            SELECT f.line, f.n, count(c.token) AS constants,
                   string_agg(CASE WHEN c.token IS NULL THEN '<*>' ELSE f.token END, ' ' ORDER BY f.pos) AS template
            FROM (SELECT DISTINCT n, lead, line, token, pos FROM f) f LEFT JOIN c USING (n, lead, pos, token)
            GROUP BY f.line, f.n HAVING 100 * count(c.token) >= 60 * f.n
        ), often AS (
            SELECT template FROM l JOIN m USING (line) GROUP BY template HAVING count(DISTINCT doc_id) >= 10
        ), gone AS (SELECT line FROM m SEMI JOIN often USING (template)),
        p AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents
        )
        SELECT doc_id, count(*) AS n_lines, count(gone.line) AS n_dropped,
               coalesce(string_agg(CASE WHEN gone.line IS NOT NULL THEN pos::VARCHAR END, ',' ORDER BY pos), '') AS dropped,
               coalesce(string_agg(CASE WHEN gone.line IS NULL THEN p.line END, chr(10) ORDER BY pos), '') AS text
        FROM p LEFT JOIN gone USING (line) GROUP BY doc_id
    """,
}


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(form)}, {quoted(k)}, {i})" for i, (k, forms) in enumerate(license_scan.SENTENCES.items()) for form in forms)
    number = {k: i for i, k in enumerate(license_scan.SENTENCES)}
    rules = ", ".join(
        f"({i}, {quoted(r.licence)}, {quoted(license_scan.rule_pattern(r, number, 2))})" for i, r in enumerate(license_scan.RULES)
    )
    return rf"""
        WITH s AS (
            SELECT doc_id, list_filter(list_transform(
                regexp_split_to_array(coalesce(text, ''), '[\n\r]+|[.!?;]+[\x20\x09]+|[.!?;]+\z'),
                lambda x: regexp_replace(trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '^(c )?copyright .*$', 'copyright holder')
            ), lambda x: x <> '') AS sentences
            FROM documents
        ), n AS (SELECT doc_id, unnest(sentences) AS sentence, unnest(range(len(sentences))) AS position FROM s),
        known(sentence, id, number) AS (VALUES {known}),
        rules(place, licence, pattern) AS (VALUES {rules}),
        g AS (
            SELECT doc_id, string_agg(id, ',' ORDER BY position) AS ids,
                   string_agg(CASE WHEN id IS NOT NULL THEN position::VARCHAR END, ',' ORDER BY position) AS positions,
                   string_agg('<' || coalesce(number::VARCHAR, '-') || '>', '' ORDER BY position) AS trail, count(*) AS n
            FROM n LEFT JOIN known USING (sentence) GROUP BY doc_id
        ), m AS (
            SELECT doc_id, licence, min(place) AS place FROM g JOIN rules ON regexp_matches(trail, pattern) GROUP BY ALL
        ), ls AS (SELECT doc_id, string_agg(licence, ',' ORDER BY place) AS licences FROM m GROUP BY doc_id)
        SELECT d.doc_id, coalesce(g.ids, '') AS sentence_ids, coalesce(g.positions, '') AS positions,
               coalesce(ls.licences, '') AS licences, coalesce(g.n, 0) AS n_sentences
        FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN ls USING (doc_id)
    """


ORACLE_SQL["op6_license_scan"] = _license_sql()
