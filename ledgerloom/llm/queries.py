"""The queries op1 to op10: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, gam, oph, packing, pii, records, rules, sepscan, simhash, urlrep
from ledgerloom.llm.common import spread, table

#: Names of the public tokenizer files; their folder is that of the installed package unless one is given.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Pieces in a generation where a worker does little else, and where it holds records besides: two generations of some 200 bytes a piece.
WIDE_CACHE, RECORD_CACHE = 1_000_000, 600_000


def tokenizer_path(name: str, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(spread(documents(spark, sf_dir)), tokenizer_path(BYTE_BPE), end_id=1, max_tokens=2048, cache=WIDE_CACHE)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spread(documents(spark, sf_dir)), tokenizer_path(WORD_BPE))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = rules.fitted(docs, labels(spark, sf_dir))
    return rules.judged(docs, found, "doc_id").select("doc_id", *rules.BASE, "base_failed", "kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return gam.scored(docs, gam.fitted(docs, labels(spark, sf_dir)), "doc_id").select("doc_id", "held_out", "score", "predicted")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return urlrep.judged(pages, urlrep.outcomes_by_number(pages, labels(spark, sf_dir)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph.compared(documents(spark, sf_dir))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = records.write_records(documents(spark, sf_dir), tokenizer_path(WORD_BPE), end_id=2, cache=RECORD_CACHE)
    return records.read_records(spark, folder, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of flat token files (byte-level BPE, end-of-text as separator): doc_id, n_tokens (without the separator)
    and where it stands: file, place in the file, and start, the ids before it in its file."""
    folder, files = sepscan.write_flat(spread(documents(spark, sf_dir)), tokenizer_path(BYTE_BPE), separator=50256)
    return sepscan.scanned(spark, folder, files, separator=50256).select("doc_id", "n_tokens", "part", "place", "start")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_bpe, op3_quality_rules, op4_quality_classifier, op5_url_filter, op6_simhash, op7_fingerprints, op8_records, op9_separator_scan, op10_pii)
}



def _level_sql(name: str, groups: str, key: str) -> str:
    """Views {name}_k (the strength of the level's prior) and {name} (key, mean, total) from `groups` (key, n, bad, prior)."""
    lows = f"greatest({urlrep.WEAKEST}, least({urlrep.STRONGEST}, noise * scale / spread - 1))"
    return f"""{name}_k AS (SELECT CASE WHEN spread > 0 AND scale > 0 THEN {lows} ELSE {urlrep.STRONGEST} END AS strength FROM (
      SELECT sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior)) AS spread, sum(n) - sum(n * n) / sum(n) AS scale, sum(n * prior * (1 - prior)) / sum(n) AS noise FROM {groups}) q),
    {name} AS (SELECT {key}, (bad + prior * strength) / (n + strength) AS mean, n + strength AS total FROM {groups}, {name}_k)"""


def _rules_sql(column: str) -> str:
    ordered = sorted(urlrep.RULES, key=lambda r: -len(r.name))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, column)}'" for r in ordered) + " END"


def _bound_sql(mean: str, total: str) -> str:
    return f"greatest(0, {mean} - {urlrep.BOUND} * sqrt({mean} * (1 - {mean}) / ({total} + 1)))"


_NAMES = ", ".join(f"'{x}'" for x in urlrep.SECOND_LEVEL)
_LEVELS = f"CASE WHEN len(l) >= 3 AND regexp_full_match(l[-1], '[a-z]{{2}}') AND l[-2] IN ({_NAMES}) THEN 2 ELSE 1 END"

#: What SQL can express: the parts of a url, the rules, and the method, whose posteriors are closed arithmetic. Every page is judged by its
#: host's bound, else by that of the prior which its domain, its suffix or all outcomes together give a host without outcomes.
ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": f"""WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urlrep.UPPER}', '{urlrep.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    split AS (SELECT page_id, host, path, string_split(host, '.') AS l FROM parts),
    pg AS (SELECT page_id, host, path, array_to_string(l[greatest(1, len(l) - {_LEVELS}):], '.') AS domain, array_to_string(l[len(l) - {_LEVELS} + 1:], '.') AS suffix FROM split),
    seen AS (SELECT p.host, p.domain, p.suffix, CAST(l.quality = 0 AS DOUBLE) AS bad FROM (SELECT *, TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html)?/?$', 1), '') AS BIGINT) AS doc_id FROM pg) p JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
    h0 AS MATERIALIZED (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, sum(bad) AS bad FROM seen GROUP BY ALL), d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h0 GROUP BY ALL),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY ALL), w AS (SELECT sum(bad) / sum(n) AS prior FROM s0),
    s1 AS (SELECT s0.*, w.prior FROM s0, w), {_level_sql('s2', 's1', 'suffix')}, d1 AS (SELECT d0.*, s2.mean AS prior FROM d0 JOIN s2 USING (suffix)), {_level_sql('d2', 'd1', 'domain')},
    h1 AS (SELECT h0.*, d2.mean AS prior FROM h0 JOIN d2 USING (domain)), {_level_sql('h2', 'h1', 'host')},
    told AS (SELECT pg.*, CASE WHEN h2.host IS NOT NULL THEN {_bound_sql('h2.mean', 'h2.total')} WHEN d2.domain IS NOT NULL THEN {_bound_sql('d2.mean', '(SELECT strength FROM h2_k)')}
      WHEN s2.suffix IS NOT NULL THEN {_bound_sql('s2.mean', '(SELECT strength FROM d2_k)')} ELSE {_bound_sql('(SELECT prior FROM w)', '(SELECT strength FROM s2_k)')} END AS low
      FROM pg LEFT JOIN h2 USING (host) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix))
    SELECT page_id, host, path, {_rules_sql('name')} AS rule, coalesce({_rules_sql('verdict')}, CASE WHEN low > {urlrep.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM told""",
}
