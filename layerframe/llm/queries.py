"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerframe.llm import (
    bpe,
    grace_dedup,
    language,
    line_dedup,
    merkle,
    mixing,
    near_dedup,
    packing,
    revisits,
    secrets,
    top_inner,
    whitening,
    wrappers,
)
from layerframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op1_secret_scan",
    r"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    k(kind, pattern) AS (VALUES
        (0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
        (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]{16,}'), (3, '(?:gh[opsur]|npm)_[0-9A-Za-z]+')),
    m AS (SELECT row, kind, pattern, t AS rest, 0 AS base, regexp_extract(t, pattern) AS hit FROM d, k WHERE regexp_matches(t, pattern)
        UNION ALL SELECT row, kind, pattern, after, upto, regexp_extract(after, pattern)
        FROM (SELECT *, substr(rest, strpos(rest, hit) + length(hit)) AS after, base + strpos(rest, hit) - 1 + length(hit) AS upto FROM m)
        WHERE regexp_matches(after, pattern)),
    h AS (SELECT row, kind, hit, base + strpos(rest, hit) - 1 AS start, base + strpos(rest, hit) - 1 + length(hit) AS stop FROM m),
    c AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(substr(hit, 5, 30), ''), lambda a: ascii(a)::BIGINT)),
            lambda x, b: list_reduce(list_prepend(xor(x, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) AS crc FROM h),
    g AS (SELECT * FROM c WHERE CASE kind WHEN 0 THEN length(regexp_extract(hit, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 WHEN 1 THEN length(hit) >= 18 WHEN 2 THEN true
            ELSE length(hit) = 40 AND substr(hit, 35) = array_to_string(list_transform([916132832::BIGINT, 14776336, 238328, 3844, 62, 1],
                lambda p: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', ((xor(crc, 4294967295) // p) % 62 + 1)::INT, 1)), '') END),
    s AS (SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS e, count(*) FILTER (kind = 3) AS f,
            string_agg(['assign', 'access', 'hex', 'checked'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
            string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base FROM g GROUP BY row)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(e, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(f, 0) AS n_checked FROM d LEFT JOIN s USING (row)
    """,
)
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf, "documents"))


@query("op3_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), bpe.read_model(tokenizer_path()))


@query(
    "op7_source_mix",
    r"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
    w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank % 3 + 1)::INT] AS weight, words::DOUBLE * 2 AS cap FROM r),
    f AS (SELECT *, cap / weight AS fill, (sum(words) OVER () * 150)::DOUBLE / 100.0 AS budget FROM w),
    l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
    v AS (SELECT first(level ORDER BY fill, rank) AS level FROM l WHERE level <= fill),
    t AS (SELECT l.source, l.words, least(l.cap, coalesce(v.level * l.weight, l.cap)) AS target FROM l LEFT JOIN v ON true),
    o AS (SELECT d.*, t.words, t.target, floor(t.target)::BIGINT AS take,
              coalesce(sum(d.size) OVER (PARTITION BY d.source
                  ORDER BY (('0x' || substr(md5('mix:' || d.doc_id || ':1'), 1, 8))::BIGINT % 1024), md5('mix:' || d.doc_id || ':1'), d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, words AS source_size, target,
           (greatest(0, least(start + size, take) - start) + greatest(0, least(start + size + words, take) - start - words))::BIGINT AS taken
    FROM o
    """,
)
def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op9_exact_dedup",
    """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
    """,
)
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return grace_dedup.exact_groups(table(spark, sf, "documents"))


@query(
    "op10_line_dedup",
    """
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
    h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS hv FROM e),
    b AS (SELECT *, (hv + 31 * coalesce(lag(hv) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 AS cut FROM h),
    c AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
    g AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS content FROM c GROUP BY doc_id, k),
    r AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY content, n >= 2 ORDER BY doc_id, k) > 1 AS gone FROM g)
    SELECT doc_id, coalesce(string_agg(content, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text,
           sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks,
           coalesce(sum(n) FILTER (gone), 0)::BIGINT AS removed_lines, count(*) FILTER (gone) AS removed_chunks
    FROM r GROUP BY doc_id
    UNION ALL SELECT doc_id, NULL, 0, 0, 0, 0 FROM documents WHERE text IS NULL
    """,
)
def line_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.remove_repeated_chunks(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "passage_dedup",
    r"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
    s AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS content FROM e),
    f AS (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(i) OVER w AS first_i
          FROM s WHERE regexp_matches(content, '[^ 	-
]') WINDOW w AS (PARTITION BY content ORDER BY doc_id, i)),
    r AS (SELECT doc_id, i FROM f WHERE doc_id <> first_doc OR i > first_i + 1),
    c AS (SELECT doc_id, i FROM r UNION SELECT doc_id, i + 1 FROM r),
    g AS (SELECT e.*, c.i IS NOT NULL AS gone, lag(c.i IS NOT NULL, 1, false) OVER (PARTITION BY e.doc_id ORDER BY e.i) AS before
          FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*)::BIGINT AS n_lines,
           count(*) FILTER (gone) AS removed_lines, count(*) FILTER (gone AND NOT before) AS removed_runs
    FROM g GROUP BY doc_id
    UNION ALL SELECT doc_id, NULL, 0, 0, 0 FROM documents WHERE text IS NULL
    """,
)
def passage_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.remove_repeated_passages(table(spark, sf, "documents").select("doc_id", "text"))


@query("op2_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


@query(
    "op4_top_inner_products",
    """
    WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM p QUALIFY rank <= 10
    """,
)
def top_inner_products(spark: SparkSession, sf: str) -> DataFrame:
    return top_inner.top_inner_products(table(spark, sf, "embeddings"))


@query("op5_html_extract")
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf, "pages"))


@query(
    "op6_revisit_resolution",
    r"""
    WITH u AS (SELECT page_id AS id, url, md5(coalesce(html, '')) AS digest, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages WHERE page_id IS NOT NULL),
    k AS (SELECT *, lower(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)) AS host,
              regexp_replace(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*', '') AS rest FROM u),
    a AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+|&+$', '', 'g') AS asked FROM k),
    c AS (SELECT id, digest, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
              || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '(/index\.html?|\.html?|/+)$', '')
              || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS url_key,
              '"' || substr(digest, 1, 16) || '"' AS tag, 'day ' || (id % 365) AS day FROM a),
    f AS (SELECT id * 2 AS record_id, url_key, id AS time, CASE WHEN id % 7 <> 0 THEN tag END AS etag, day, digest,
              'content-type=text/html' AS kind, tag FROM c),
    g AS (SELECT id * 2 + 1 AS record_id, url_key, id + 1000 AS time,
              CASE WHEN id % 5 = 0 THEN '"changed"' WHEN id % 7 <> 0 THEN tag END AS etag, day FROM c),
    j AS (SELECT g.*, f.record_id AS from_id, f.etag AS from_tag, f.day AS from_day, f.digest, f.tag,
              row_number() OVER (PARTITION BY g.record_id ORDER BY f.time DESC, f.record_id DESC) AS n
          FROM g LEFT JOIN f ON g.url_key = f.url_key AND (f.time, f.record_id) < (g.time, g.record_id)),
    o AS (SELECT *, CASE WHEN from_id IS NULL THEN 'unresolved'
              WHEN etag IS NOT NULL AND from_tag IS NOT NULL THEN CASE WHEN etag = from_tag THEN 'resolved' ELSE 'mismatch' END
              WHEN day = from_day THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE n = 1)
    SELECT record_id, url_key, 'response' AS outcome, -1::BIGINT AS source_id, digest, kind || ';date=' || day || ';etag=' || tag AS headers FROM f
    UNION ALL
    SELECT record_id, url_key, outcome, coalesce(from_id, -1), CASE WHEN outcome = 'resolved' THEN digest ELSE '' END,
           CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=later;etag=' || tag ELSE 'content-length=0;date=later' END FROM o
    """,
)
def revisit_resolution(spark: SparkSession, sf: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.captures_of(table(spark, sf, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.withColumns(
        {
            "headers": F.array_join(lines, ";"),
            "source_id": F.coalesce("source_id", F.lit(-1).cast("long")),
            "digest": F.coalesce("digest", F.lit("")),
        }
    )


@query(
    "op8_near_dedup",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: list_aggregate(ws[i:i + 3], 'string_agg', ' '))
              WHEN len(ws) > 0 THEN [len(ws) || ':' || list_aggregate(ws, 'string_agg', ' ')] ELSE [] END) AS sh FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
)
def near_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op12_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    model = bpe.read_model(tokenizer_path("word_bpe_49k.json"))
    pieces = packing.encode_pieces(table(spark, sf, "documents"), model)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query(
    "op13_merkle_manifest",
    r"""
    WITH RECURSIVE c AS (SELECT *, doc_id IS NOT NULL AND list_reduce(
              list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda a: ascii(a)::BIGINT)),
              lambda x, b: list_reduce(list_prepend(xor(x, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))
          ) % 2 = 1 AS tampered FROM documents),
    f AS (SELECT doc_id, source, text, tampered, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
              || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
              CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS shown FROM c),
    l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
              sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS seen FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
    t(grp, lv, pos, h, n) AS (SELECT coalesce('s' || source, 'n'), 0, pos, leaf, count(*) OVER (PARTITION BY source) FROM o
        UNION ALL SELECT grp, lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY grp, lv, pos // 3, n),
    sub AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM t WHERE n = 1),
    u(lv, pos, h, n) AS (SELECT 0, pos, subroot, (SELECT count(*) FROM sub) FROM sub
        UNION ALL SELECT lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lv, pos // 3, n),
    lower_ AS (SELECT a.grp, a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS le,
              coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS ri
          FROM t a JOIN t b ON a.grp = b.grp AND a.lv = b.lv AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.grp, a.lv, a.pos),
    upper_ AS (SELECT a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS le,
              coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS ri
          FROM u a JOIN u b ON a.lv = b.lv AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lv, a.pos),
    p(doc_id, leaf, grp, start, lv, k, cur, proof) AS (SELECT doc_id, leaf, coalesce('s' || source, 'n'), pos, 0, pos, seen, '' FROM o
        UNION ALL SELECT doc_id, leaf, p.grp, start, p.lv + 1, p.k // 3, sha256(le || cur || ri), proof || le || ri
        FROM p JOIN lower_ s ON p.grp = s.grp AND p.lv = s.lv AND p.k = s.pos),
    q(doc_id, leaf, subroot, grp, start, lv, k, cur, proof) AS (
        SELECT doc_id, leaf, subroot, p.grp, start, 0, sub.pos, cur, proof
        FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY grp, start ORDER BY lv DESC) = 1) p JOIN sub ON p.grp = sub.grp
        UNION ALL SELECT doc_id, leaf, subroot, grp, start, q.lv + 1, q.k // 3, sha256(le || cur || ri), proof || le || ri
        FROM q JOIN upper_ s ON q.lv = s.lv AND q.k = s.pos),
    r AS (SELECT h AS root FROM u WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
    FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY grp, start ORDER BY lv DESC) = 1), r
    """,
)
def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted line ends in every document whose id's CRC-32 is even stand for tampering."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    docs = table(spark, sf, "documents")
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": text})
    folded = rows.withColumn("folded_root", merkle.fold(F.col("seen"), F.col("path")))
    return folded.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
