"""Registered queries of the corpus operators, and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_quality

    return judge_quality(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return round_trip(_table(spark, sf_dir, "pages"), columns=columns).select(*columns)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link_components

    return link_components(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("places")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_bpe, op4_secrets, op5_line_dedup, op6_quality, op7_warc, op8_ngram_jaccard, op9_url_filter, op10_license_scan)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_sql() -> str:
    """The rules and globs of operator 9, as conditions on host and path."""
    import re

    from .urls import BLOCK_GLOBS, RULES

    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in longest)
    glob = lambda g: "".join({"*": ".*", "~": "[^/]*"}.get(c, re.escape(c)) for c in g)
    plain = r"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\.+$', '')"
    blocked = " or ".join(f"regexp_full_match('.' || {plain} || path, '{glob(g)}', 's')" for g in BLOCK_GLOBS)
    return (
        "with a as (select page_id, case when contains(url, '://') then regexp_extract(substr(url, position('://' in url) + 3), '^[^?#]*') else '' end as rest from pages), "
        f"b as (select page_id, regexp_extract(rest, '^[^/]*') as raw, rest from a), c as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, substr(rest, length(raw) + 1) as path from b) "
        f"select page_id, host, path, case {rule} end as rule, case {verdict} when {blocked} then 'block' else 'allow' end as verdict from c"
    )


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_QUARTET = " || ".join(f"substr('{BASE32}', cast(((('0x' || substr(h, g * 5 + 1, 5))::bigint >> {s}) & 31) + 1 as int), 1)" for s in (15, 10, 5, 0))
WARC_SQL = (
    "with a as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages), b as (select *, min(page_id) over (partition by body) as first from a) "
    f"select page_id, cast(strlen(body) as bigint) as payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: {_QUARTET}), '') as payload_digest, "
    "case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type, case when page_id is distinct from first then first end as refers_to from b"
)


def license_sql() -> str:
    """Operator 10 as joins of word positions with the phrases' words."""
    from .licenses import RARE, templates

    known = templates()
    words = ", ".join(f"({t}, {i}, '{w}')" for t, x in enumerate(known) for i, w in enumerate(x.words))
    labels = ", ".join(f"({t}, '{x.label}', {str(x.base).lower()})" for t, x in enumerate(known))
    return (
        f"with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents), "
        f"v(t, i, w) as (values {words}), l(t, label, base) as (values {labels}), u as (select doc_id, unnest(words) as w, generate_subscripts(words, 1) - 1 as pos from d), h as (select * from u semi join v using (w)), "
        "n as (select count(*) as n from d), f as (select w, count(distinct doc_id) as df from h group by 1), g as (select t, i, v.w, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) as idf from n, v left join f using (w)), "
        "r as (select *, row_number() over (partition by t order by idf desc, i) as r, count(*) over (partition by t) as len from g), "
        f"c as (select doc_id, t, pos - i as start from h join r using (w) where r <= {RARE} and pos >= i group by all having count(*) = min(least({RARE}, len))), "
        "p as (select c.doc_id, c.t, c.start from c join r using (t) join h on h.doc_id = c.doc_id and h.pos = c.start + r.i and h.w = r.w group by all having count(*) = max(len)), "
        f"m as (select t, sum(idf) filter (r <= {RARE}) / sum(idf) as mass from r group by 1), s as (select doc_id, max(mass) as mass from c join m using (t) group by 1), "
        "q as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word, string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels from p join l using (t) group by 1) "
        "select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, "
        "round(case when labels is not null then 1.0 else coalesce(mass, 0) end, 6)::double as score from d left join q using (doc_id) left join s using (doc_id)"
    )


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": WARC_SQL, "op9_url_filter": url_sql(), "op10_license_scan": license_sql()}
