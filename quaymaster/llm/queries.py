"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, html_extract, lm, media, merkle, ngram_join, packing, periodic, pii, sharding, toxicity, url_filter
from .common import table

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85).drop("set_key")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.write_media(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def pii_key(spark: SparkSession) -> str:
    """The secret of the surrogates, from ``spark.quaymaster.pii.key``; without it a name that protects nothing, for tests."""
    return spark.conf.get("spark.quaymaster.pii.key", "test-key")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_rule(v, r) for v, r in URL_RULES]
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).drop("url")


def _planted(doc_id, text):
    """The text of a tenth of the documents, with its words from a place on repeated at a period; all other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        planted = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int"))))
        return F.when(n > 0, F.array_join(planted, " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeat)[0]).otherwise(text)  # one array, so that the words are found once


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("rank"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", (-F.col("best.rank")).alias("length"), "best.period", F.expr("-1000 * best.rank div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit & F.col("n_chars").isNotNull(), merkle.row_digest(*columns(F.try_add("n_chars", F.lit(1)))))
    made = merkle.manifest(docs, merkle.row_digest(*columns(F.col("n_chars"))), F.col("lang"), [F.col("doc_id")], [F.col("doc_id"), tampered.alias("tampered")])
    out = made.proofs().select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256).alias("proof_sha256"), merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_media": op3_media,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_sharding": op8_sharding,
    "op9_pii": op9_pii,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle": op13_merkle,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _row_sql(n_chars: str) -> str:
    """A row's leaf digest in the oracle's dialect."""
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


def _crc_sql(x: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return f"xor(list_reduce([4294967295] || list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b)] || [CAST(k AS BIGINT) for k in range(8)], lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
        FROM d JOIN reach ON d.doc_id = reach.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op10_url_filter": f"""
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        rules(verdict, rule, h, p) AS (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)}),
        fits AS (
            SELECT page_id, host, path, rule, verdict
            FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
        best AS (
            SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM fits GROUP BY page_id, host, path)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
    """,
    "op13_merkle": f"""
        WITH RECURSIVE d AS (
            SELECT *, {_row_sql('n_chars')} AS leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
                   CASE WHEN {_crc_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_row_sql('n_chars + 1')} END AS tampered FROM documents),
        nodes(lvl, g, i, n, h) AS (
            SELECT 0, lang, i, n, leaf FROM d
            UNION ALL SELECT lvl + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lvl, g, i // 2, n),
        subroots AS (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops(lvl, i, n, h) AS (
            SELECT 0, i, n, h FROM subroots
            UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 2, n),
        root AS (SELECT h FROM tops WHERE n = 1),
        own(doc_id, lvl, g, i, n, h, proof) AS (
            SELECT doc_id, 0, lang, i, n, coalesce(tampered, leaf), '' FROM d
            UNION ALL SELECT o.doc_id, o.lvl + 1, o.g, o.i // 2, (o.n + 1) // 2, sha256(CASE WHEN o.i % 2 = 1 THEN coalesce(s.h, '') || o.h ELSE o.h || coalesce(s.h, '') END), o.proof || coalesce(s.h, '')
            FROM own o LEFT JOIN nodes s ON s.lvl = o.lvl AND s.g IS NOT DISTINCT FROM o.g AND s.i = xor(o.i, 1) WHERE o.n > 1),
        upper(doc_id, lvl, i, n, h, proof) AS (
            SELECT o.doc_id, 0, r.i, r.n, o.h, o.proof FROM own o JOIN subroots r ON r.g IS NOT DISTINCT FROM o.g WHERE o.n = 1
            UNION ALL SELECT u.doc_id, u.lvl + 1, u.i // 2, (u.n + 1) // 2, sha256(CASE WHEN u.i % 2 = 1 THEN coalesce(s.h, '') || u.h ELSE u.h || coalesce(s.h, '') END), u.proof || coalesce(s.h, '')
            FROM upper u LEFT JOIN tops s ON s.lvl = u.lvl AND s.i = xor(u.i, 1) WHERE u.n > 1)
        SELECT d.doc_id, d.leaf, r.h AS subroot, (SELECT h FROM root) AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = (SELECT h FROM root) AS verified
        FROM d JOIN subroots r ON r.g IS NOT DISTINCT FROM d.lang JOIN upper u ON u.doc_id = d.doc_id AND u.n = 1
    """,
}
