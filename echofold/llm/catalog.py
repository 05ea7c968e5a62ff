"""Registered queries of the training-data operators and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, spread, table
from . import chat, exact_dedup, importance, langid, mixing, name_join, near_dedup, packing, quality, quality_model, toxicity, url_filters, warc


def _fold(of: str, by: int, rest: int) -> Column:
    """Whether the crc32 of an id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(of).cast("string")) % by == rest, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    held = _fold("doc_id", 3, 1)
    net = langid.train(docs, where=~held)
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archive against a replica with known damage: bytes altered in one of 101 pages,
    one of 997 lost."""
    pages = table(spark, sf_dir, "pages")
    last = F.concat(F.expr("substr(html, 1, length(html) - 1)"), F.lit("~"))
    damaged = pages.where("page_id is null or page_id % 997 <> 13").withColumn("html", F.when(F.col("page_id") % 101 == 7, last).otherwise(F.col("html")))
    return warc.audit(warc.records(pages), warc.records(damaged))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.apply(docs).drop("text")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"), keep="max", carry=["doc_id"])


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated domain list of the hosts in the pages: by their md5 some are blocked from a day on,
    some of those allowed again; two parent domains are always listed."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    digit = lambda k: F.conv(F.substring(F.md5("domain"), k, 2), 16, 10).cast("int")
    day = lambda n: F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(n)
    blocked = hosts.where(digit(1) < 96).select("domain", F.lit("block").alias("action"), day(digit(3)).alias("since"))
    freed = hosts.where((digit(1) < 96) & (digit(5) < 128)).select("domain", F.lit("allow").alias("action"), day(digit(3) + digit(7)).alias("since"))
    fixed = "values ('spam-farm.example.org', 'block', timestamp_ntz'2024-02-01 00:00:00'), ('cheap-pills.example.com', 'block', timestamp_ntz'2024-03-01 00:00:00'), ('cheap-pills.example.com', 'allow', timestamp_ntz'2024-09-01 00:00:00') as t(domain, action, since)"
    return blocked.unionByName(freed).unionByName(pages.sparkSession.sql(f"select * from {fixed}"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    fetched = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("page_id") * 7919 % 525600).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched_at"))
    return url_filters.judge(captures, dated_list(pages))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(spread(table(spark, sf_dir, "documents")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written raw, with some markers lost, and parsed again by a model counted
    on four fifths of them."""
    segments = Scratch(spark, "segments").cut(chat.transcripts(table(spark, sf_dir, "conversations")), "segments")
    return chat.parse(chat.raw(segments), chat.train(segments.where(~_fold("conv_id", 5, 0))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = _fold("doc_id", 5, 0)
    labels = table(spark, sf_dir, "labels").where(~held)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.withColumn("held_out", held), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), with_ids=False)


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = _fold("doc_id", 5, 0)
    net = quality_model.train(docs, table(spark, sf_dir, "labels").where(~held))
    return quality_model.score(docs.withColumn("held_out", held), net).select("doc_id", "held_out", "score", "predicted")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return importance.resample(docs, table(spark, sf_dir, "benchmark"))


def misspelt(vendors: DataFrame) -> DataFrame:
    """``vendors`` with two adjacent letters of about half the names exchanged, by the id's crc32."""
    h, size = F.crc32(F.col("vendor_id").cast("string")), F.char_length("name")
    at = (h % (size - 1)).cast("int")
    turned = F.concat(F.substring("name", F.lit(1), at), F.substring("name", at + 2, F.lit(1)), F.substring("name", at + 1, F.lit(1)), F.substring("name", at + 3, size))
    return vendors.withColumn("name", F.when((h % 2 == 0) & (size >= 2), turned).otherwise(F.col("name")))


def op13_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients whose names are at most one edit from a vendor's misspelt name."""
    clients = table(spark, sf_dir, "clients").select(F.col("client_id").alias("id"), name_join.normal(F.col("name")).alias("name"))
    vendors = misspelt(table(spark, sf_dir, "vendors")).select(F.col("vendor_id").alias("id"), name_join.normal(F.col("name")).alias("name"))
    found = name_join.matches(clients, vendors)
    return found.select(F.col("id").alias("vendor_id"), "distance", F.col("n").alias("n_clients"), F.col("first_id").alias("first_client_id"), F.col("ids_crc").alias("clients_crc"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_merkle_fixity, op3_quality_rules, op4_exact_dedup, op5_url_filters, op6_near_dedup, op7_source_mixing, op8_chat_format, op9_toxicity, op10_packing, op11_quality_model, op12_importance_resampling, op13_name_join)}

_STOPS = ", ".join(f"'{w}'" for s in quality.STOP_WORDS for w in (s, s.capitalize()))
_RECORD = r"""'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(h) || e || e || h || e || e"""


def _side(name: str, rows: str) -> str:
    """An archive side in SQL: offsets and hashes of its records."""
    return f"""{name}_r AS (SELECT page_id // {warc.PER_FILE} AS file_no, page_id, {_RECORD} AS record FROM (SELECT page_id, url, h, chr(13) || chr(10) AS e FROM ({rows}))),
        {name}_h AS (SELECT file_no, page_id, sha256(record) AS hash, strlen(record) AS length FROM {name}_r),
        {name}_l AS (SELECT file_no, page_id, hash, CAST(coalesce(sum(length) OVER (PARTITION BY file_no ORDER BY page_id, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM {name}_h)"""


_DIGIT = "('0x' || substr(md5(domain), {0}, 2))::INTEGER"
_HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', '')"

#: The byte table of crc32 as a list ``t``, and the crc32 of a list of bytes by it.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc(text: str) -> str:
    """crc32 of a text's UTF-8 bytes in SQL, beside ``crc``."""
    listed = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({listed}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


ORACLES = {
    "op2_merkle_fixity": f"""
        WITH {_side("a", "SELECT page_id, url, coalesce(html, '') AS h FROM pages")},
        {_side("b", "SELECT page_id, url, CASE WHEN page_id % 101 = 7 AND html IS NOT NULL THEN substr(html, 1, length(html) - 1) || '~' ELSE coalesce(html, '') END AS h FROM pages WHERE page_id % 997 <> 13")}
        SELECT coalesce(a.file_no, b.file_no) AS file_no, coalesce(a.at, b.at) AS "offset", coalesce(a.page_id, b.page_id) AS page_id,
            CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' ELSE 'altered' END AS damage, 1::BIGINT AS copies, a.hash AS left_hash, b.hash AS right_hash
        FROM a_l a FULL JOIN b_l b ON a.page_id = b.page_id WHERE a.hash IS DISTINCT FROM b.hash""",
    "op3_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
        runs AS (SELECT doc_id, i, w[i:i + 4] AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, r) > 1),
        marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY doc_id),
        c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
            coalesce(m.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, len([x FOR x IN w IF x IN ({_STOPS})]) AS stops, len([x FOR x IN ls IF length(x) < 12]) AS shorts, len(regexp_extract_all(t, '[A-Z]')) AS uppers FROM d LEFT JOIN marked m ON m.doc_id = d.doc_id),
        r AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS mean_word_length, coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0) AS symbol_ratio,
            coalesce(stops / nullif(n_words, 0)::DOUBLE, 0) AS stop_ratio, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_ratio, coalesce(shorts / nullif(n_lines, 0)::DOUBLE, 0) AS short_line_ratio, coalesce(uppers / nullif(word_chars, 0)::DOUBLE, 0) AS upper_ratio,
            n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
        SELECT *, NOT base_failed AND {" AND ".join(" AND ".join([*([f"{n} >= {lo}"] if lo is not None else []), *([f"{n} <= {hi}"] if hi is not None else [])]) for n, lo, hi in quality.THRESHOLDS)} AS kept FROM r""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
    "op5_url_filters": f"""
        WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id * 7919 % 525600) AS fetched_at, nullif({_HOST}, '') AS host FROM pages),
        hosts AS (SELECT DISTINCT host AS domain FROM p WHERE host IS NOT NULL),
        log AS (SELECT domain, 'block' AS action, TIMESTAMP '2024-01-01' + to_days({_DIGIT.format(3)}) AS since FROM hosts WHERE {_DIGIT.format(1)} < 96
            UNION ALL SELECT domain, 'allow', TIMESTAMP '2024-01-01' + to_days({_DIGIT.format(3)} + {_DIGIT.format(7)}) FROM hosts WHERE {_DIGIT.format(1)} < 96 AND {_DIGIT.format(5)} < 128
            UNION ALL VALUES ('spam-farm.example.org', 'block', TIMESTAMP '2024-02-01'), ('cheap-pills.example.com', 'block', TIMESTAMP '2024-03-01'), ('cheap-pills.example.com', 'allow', TIMESTAMP '2024-09-01')),
        one AS (SELECT domain, since, max(action) AS action FROM log GROUP BY ALL),
        met AS (SELECT p.page_id, l.domain, l.since, l.action FROM p JOIN one l ON (p.host = l.domain OR ends_with(p.host, '.' || l.domain)) AND l.since <= p.fetched_at),
        latest AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY page_id, domain ORDER BY since DESC) = 1),
        top AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) = 1)
        SELECT p.page_id, p.url, p.fetched_at, p.host, t.domain AS matched_domain, t.action, t.since AS active_since, coalesce(t.action <> 'block', true) AS kept FROM p LEFT JOIN top t ON t.page_id = p.page_id""",
    "op7_source_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 12))::BIGINT AS place FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
        caps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS level FROM s),
        levels AS (SELECT a.level AS l, (SELECT sum(CASE WHEN b.level < a.level THEN b.cap ELSE b.weight * a.level END) FROM caps b) AS held FROM caps a),
        below AS (SELECT coalesce(max(l), 0) AS l FROM levels WHERE held <= (SELECT 1.5::DOUBLE * sum(source_size) FROM s)),
        water AS (SELECT ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - coalesce(sum(cap) FILTER (level <= l), 0)) / sum(weight) FILTER (level > l) AS w FROM caps, below),
        t AS (SELECT source, source_size, least(cap, w * weight) AS target FROM caps, water),
        e AS (SELECT *, floor(target / source_size)::BIGINT AS whole, target - floor(target / source_size) * source_size AS need FROM t),
        r AS (SELECT d.*, e.source_size, e.target, e.whole, e.need, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, source, size, source_size, target, least(2, whole + (before + size / 2.0::DOUBLE <= need)::BIGINT)::BIGINT AS repeats, size * least(2, whole + (before + size / 2.0::DOUBLE <= need)::BIGINT)::BIGINT AS taken FROM r""",
    "op12_importance_resampling": rf"""
        WITH {_CRC_TABLE},
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        fd AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
        fb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
        k AS MATERIALIZED (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT f FROM fd UNION SELECT f FROM fb), crc),
        s AS (SELECT bucket, count(*) AS n FROM fd JOIN k USING (f) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM fb JOIN k USING (f) GROUP BY bucket),
        g AS (SELECT i AS bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM range(10000) x(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
        m AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM fd JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
        e AS (SELECT d.r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) >= 20 AS asked,
            coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m ON m.r = d.r),
        o AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, doc_id) AS nth FROM e)
        SELECT doc_id, n_features, weight, score, CASE WHEN asked AND nth <= (SELECT count(*) FROM e WHERE asked) * 25 // 100 THEN nth END AS rank FROM o""",
    "op13_name_join": rf"""
        WITH {_CRC_TABLE},
        c AS (SELECT client_id, {_crc("client_id::VARCHAR")} AS crc, regexp_replace({_LOWER.format("name")}, '[\x20\x09-\x0D]', '', 'g') AS a FROM clients, crc),
        h AS (SELECT vendor_id, name, {_crc("vendor_id::VARCHAR")} AS h FROM vendors, crc),
        p AS (SELECT vendor_id, name, CASE WHEN h % 2 = 0 AND length(name) >= 2 THEN h % (length(name) - 1) END AS p FROM h),
        v AS (SELECT vendor_id, regexp_replace({_LOWER.format("CASE WHEN p IS NULL THEN name ELSE left(name, p) || substr(name, p + 2, 1) || substr(name, p + 1, 1) || substr(name, p + 3) END")}, '[\x20\x09-\x0D]', '', 'g') AS b FROM p),
        met AS (SELECT vendor_id, client_id, crc, a, b FROM c JOIN v ON abs(length(a) - length(b)) <= 1 WHERE a <> '' AND b <> ''),
        near AS (SELECT *, a <> b AS far, length(list_filter(range(length(b) + 1), lambda i: left(a, i) = left(b, i) AND (substr(a, i + 2) = substr(b, i + 2) AND length(a) = length(b) OR substr(a, i + 2) = substr(b, i + 1) OR substr(a, i + 1) = substr(b, i + 2)
            OR substr(a, i + 3) = substr(b, i + 3) AND substr(a, i + 1, 1) = substr(b, i + 2, 1) AND substr(a, i + 2, 1) = substr(b, i + 1, 1)))) AS ways FROM met)
        SELECT vendor_id, far::INTEGER AS distance, count(*) AS n_clients, min(client_id) AS first_client_id, sum(crc)::BIGINT AS clients_crc FROM near WHERE NOT far OR ways > 0 GROUP BY vendor_id, far""",
}
